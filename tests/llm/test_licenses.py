import random
import re
from collections import Counter

from llm.conftest import EDGES
from runlens.llm import licenses as L

COLS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
RULES = L.rules()


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(doc_id, text):
    """Base places by comparing words; every rule without a prefilter, every pair of detections for containment."""
    w = words(text)
    places = [(i, label) for label, p in PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    flat, found = " ".join(w).encode(), []
    for order, r in enumerate(RULES):
        if not r.name.startswith("base "):
            found += [(r.priority, order, flat[:m.start()].count(b" "), flat[:m.end()].count(b" ") + 1) for m in r.regex.finditer(flat)]
    found += [(0, k, i, i + len(PHRASES[label].split())) for i, label in places for k, r in enumerate(RULES) if r.name == f"base {label}"]

    def hides(a, b):
        inside = a[2] <= b[2] and b[3] <= a[3] and a != b
        return inside and (a[0] < b[0] or a[0] == b[0] and (a[3] - a[2] > b[3] - b[2] or a[1] < b[1]))
    kept = [f for f in found if RULES[f[1]].name.startswith("base ") or RULES[f[1]].label and not any(hides(a, f) for a in found)]
    return (doc_id, len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None,
            ",".join(sorted({k for _, k in places})), ",".join(sorted({RULES[f[1]].label for f in kept})),
            max((RULES[f[1]].weight for f in kept), default=0.0))


BITS = ["under the MIT License", "Apache License, Version 2.0", "CC BY-NC", "-SA 4.0", "licensed", "released under", "the", "GNU General Public License", "version 3", "v2.1", "GPL", "LGPL",
        "GPLv2", "SPDX-License-Identifier:", "MIT", "Apache-2.0", "GPL-3.0-or-later", "https://opensource.org/licenses/MIT", "https://creativecommons.org/licenses/by/4.0/", "license", "licence",
        "MIT Press", "not licensed under the", "All rights reserved.", "Permission is hereby granted, free of charge, to any person obtaining a copy", "for non-commercial use only",
        "prose", "müßig", "中文", "éMIT", "\n", "\t--\t", "BSD 3-Clause", "modified BSD", "Mozilla Public License", "MPL 2.0", "is in the public domain", "Kelvin", "unlicense"]


def test_find_equals_brute_force():
    rng, s = random.Random(7), L.Scanner()
    for i in range(1500):
        text = rng.choice([" ", ", ", "-", ""]).join(rng.choice(BITS) for _ in range(rng.randint(0, 14)))
        assert s.row(i, text)[:8] == brute(i, text), text


def test_there_are_hundreds_of_rules_and_each_can_fire():
    s = L.Scanner()
    assert len(s.rules) > 300
    for k, (label, _, _, spdx, _) in enumerate(L.LICENSES):
        tag = re.sub(r"\(\?:[^)]*\)\??|\[.*?\]|\?", "", spdx).strip()
        got = s.row(1, f"SPDX-License-Identifier: {tag}")[6]
        assert got and got.split("-")[0].split("_")[0][:2] == label[:2] or "[" in spdx, (label, tag, got)


def test_known_notices():
    s = L.Scanner()
    for text, labels in [
            ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
            ("the MIT Press published it", ""), ("my driver's license", ""), ("mit dem Zug", ""),
            ("not licensed under the Apache License 1.1", ""), ("not released under the MIT License", "mit"),
            ("This is free and unencumbered software released into the public domain.", "unlicense"),
            ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
            ("dual: MIT license or Apache-2.0 license", "apache-2,mit"),
            ("see https://www.gnu.org/licenses/gpl-3.0.html", "gpl-3"), ("GNU Lesser General Public License v2.1 license", "lgpl-2.1")]:
        assert s.row(1, text)[6] == labels, text


def test_detections_carry_their_text(frame):
    rows = [(1, "x\nReleased  under the\tMIT\nLicense!"), (2, "nothing"), (3, None)]
    got = {(r.label, r.rule.split()[0], r.start_word, r.end_word, r.text) for r in L.scan(frame(rows)).collect()}
    assert got == {("mit", "base", 2, 6, "under the\tMIT\nLicense"), ("mit", "grant", 1, 6, "Released  under the\tMIT\nLicense")}


def test_report_with_edges(frame):
    many = "under the MIT license " * 20_000
    rows = [(r[0], r[1]) for r in EDGES] + [(20, many), (21, "x " * 400_000 + "cc by nc"), (22, "GPL license " * 3000)]
    got = Counter(map(tuple, L.report(frame(rows)).select(*COLS).collect()))
    small = [r for r in rows if r[0] not in (20, 22)]
    want = Counter(brute(*r) for r in small)
    want.update([(20, 80_000, 20_000, 0, 79_996, "mit", "mit", 0.95), (22, 6000, 0, None, None, "", "gpl", 0.6)])
    assert got == want


def test_report_of_the_table(docs, texts):
    got = Counter(map(tuple, L.report(docs).select(*COLS).collect()))
    assert got == Counter(brute(*r) for r in texts)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.report(empty).collect() == [] and L.scan(empty).collect() == []


def test_pieces_cut_at_spaces(monkeypatch):
    monkeypatch.setattr(L, "PIECE", 7)
    s = L.Scanner()
    for text in ["a bc def ghij klmnopqrstuvw x", "under the mit license", "x" * 50, " " * 30, "aaaaaaa aaaaaaa"]:
        assert s.find(text).n_words == len(words(text)) and b"".join(L.pieces(L.spaced(text))) == L.spaced(text)
    assert s.row(1, "see it under the MIT license")[5] == "mit"
