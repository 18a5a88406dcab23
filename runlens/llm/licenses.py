"""op11: license scan by ordered signature rules.

A text becomes its words (ASCII letters lower-cased; ASCII letters, digits and everything beyond ASCII are word bytes) joined by
single spaces. Rules are regexes over that form, written so that they cannot backtrack far, and matched at word borders only:

* hand-written rules for license bodies and for phrases that only look like a license (``DECOYS``);
* four forms of every license in ``LICENSES``: its SPDX tag, a grant ("licensed under ..."), its address, and its bare name.

Keyword prefilter: a rule runs only on a text that has one of its license's keywords and all of its form's. A text's words
are met with all keywords in one set intersection, so most texts run no regex at all. Every rule has a priority (small
first) and a weight; a detection that lies inside a detection of higher priority, or inside a longer or earlier one of the
same priority, is suppressed, by a running maximum of ends per priority and not by pairs. Decoys suppress and report nothing.

The places of the three base phrases are always reported and never suppressed. ``score`` is the highest weight of the
reported detections, 0 without any.

Defined results: a null or empty text has no words and no labels; repeated rows and null ids are scanned row by row; an
empty table gives an empty result; a text is scanned whole, in one task; only the id and text columns are read.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import common
from runlens.llm.common import by_value

PIECE = 1 << 20     # bytes of a text whose words are held at once before the prefilter has passed

# The contract's base phrases and labels.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

# One line a license: label, keywords (one must be a word of the text), its name, its SPDX identifier, its address.
# All in the normalised form: words in lower case, one space between them. "(?: ...)?" marks words that may be missing.
LICENSES = [
    ("mit", "mit expat", r"(?:mit(?: x11)?|expat)", r"mit", r"opensource org licenses? mit"),
    ("mit-0", "mit", r"mit(?: no attribution| 0)", r"mit 0", r"opensource org licenses? mit 0"),
    ("apache-1", "apache", r"apache(?: software)? license(?: version)? 1 0", r"apache 1 0", r"apache org licenses license 1 0"),
    ("apache-1.1", "apache", r"apache(?: software)? license(?: version)? 1 1", r"apache 1 1", r"apache org licenses license 1 1"),
    ("apache-2", "apache asl2", r"(?:apache(?: software)?(?: license)?(?: version| v)? ?v?2(?: 0)?|asl2)", r"apache 2 0", r"apache org licenses license 2 0"),
    ("bsd-1-clause", "bsd", r"(?:1|one) clause bsd", r"bsd 1 clause", r"opensource org licenses? bsd 1 clause"),
    ("bsd-2-clause", "bsd freebsd simplified", r"(?:(?:2|two) clause bsd|bsd (?:2|two) clause|simplified bsd|freebsd)", r"bsd 2 clause", r"opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", "bsd revised", r"(?:(?:3|three) clause bsd|bsd (?:3|three) clause|(?:new|revised|modified) bsd)", r"bsd 3 clause(?: clear)?", r"opensource org licenses? bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:(?:4|four) clause bsd|bsd (?:4|four) clause|original bsd)", r"bsd 4 clause", r"spdx org licenses bsd 4 clause"),
    ("0bsd", "0bsd bsd", r"(?:0bsd|(?:0|zero) clause bsd)", r"0bsd", r"opensource org licenses? 0bsd"),
    ("isc", "isc", r"isc", r"isc", r"opensource org licenses? isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?", r"zlib", r"opensource org licenses? zlib"),
    ("libpng", "libpng png", r"(?:libpng|png reference library)", r"libpng(?: 2 0)?", r"libpng org pub png src libpng license"),
    ("gpl-1", "gnu gpl gplv1", r"(?:gnu general public license(?: version)? v?1(?: 0)?|(?:gnu )?gpl ?v?1(?: 0)?)", r"gpl 1 0(?: only| or later)?", r"gnu org licenses old licenses gpl 1 0"),
    ("gpl-2", "gnu gpl gplv2 gpl2", r"(?:gnu general public license(?: version)? v?2(?: 0)?|(?:gnu )?gpl(?: version)? ?v?2(?: 0)?)", r"gpl 2 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3", "gnu gpl gplv3 gpl3", r"(?:gnu general public license(?: version)? v?3(?: 0)?|(?:gnu )?gpl(?: version)? ?v?3(?: 0)?)", r"gpl 3 0(?: only| or later)?", r"gnu org licenses gpl 3 0"),
    ("gpl", "gnu gpl", r"(?:gnu general public license|gnu gpl|gpl)", r"gpl", r"gnu org (?:licenses|copyleft) gpl"),
    ("lgpl-2", "gnu lgpl lgplv2 library", r"(?:gnu library general public license(?: version)? v?2(?: 0)?|(?:gnu )?lgpl(?: version)? ?v?2(?: 0)?)", r"lgpl 2 0(?: only| or later)?", r"gnu org licenses old licenses lgpl 2 0"),
    ("lgpl-2.1", "gnu lgpl lgplv2 lesser", r"(?:gnu lesser general public license(?: version)? v?2 1|(?:gnu )?lgpl(?: version)? ?v?2 1)", r"lgpl 2 1(?: only| or later)?", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3", "gnu lgpl lgplv3 lesser", r"(?:gnu lesser general public license(?: version)? v?3(?: 0)?|(?:gnu )?lgpl(?: version)? ?v?3(?: 0)?)", r"lgpl 3 0(?: only| or later)?", r"gnu org licenses lgpl 3 0"),
    ("lgpl", "gnu lgpl lesser library", r"(?:gnu (?:lesser|library) general public license|(?:gnu )?lgpl)", r"lgpl", r"gnu org (?:licenses|copyleft) (?:lgpl|lesser)"),
    ("agpl-3", "affero agpl agplv3", r"(?:gnu affero general public license(?: version)? v?3(?: 0)?|(?:gnu )?agpl(?: version)? ?v?3(?: 0)?)", r"agpl 3 0(?: only| or later)?", r"gnu org licenses agpl(?: 3 0)?"),
    ("agpl-1", "affero agpl", r"affero general public license(?: version)? v?1(?: 0)?", r"agpl 1 0(?: only| or later)?", r"affero org oagpl"),
    ("gfdl-1.1", "gnu gfdl documentation", r"(?:gnu free documentation license|gfdl)(?: version)? v?1 1", r"gfdl 1 1(?: only| or later)?", r"gnu org licenses old licenses fdl 1 1"),
    ("gfdl-1.2", "gnu gfdl documentation", r"(?:gnu free documentation license|gfdl)(?: version)? v?1 2", r"gfdl 1 2(?: only| or later)?", r"gnu org licenses old licenses fdl 1 2"),
    ("gfdl-1.3", "gnu gfdl documentation", r"(?:gnu free documentation license|gfdl)(?: version)? v?1 3", r"gfdl 1 3(?: only| or later)?", r"gnu org licenses fdl 1 3"),
    ("mpl-1.0", "mozilla mpl", r"(?:mozilla public license|mpl)(?: version)? v?1 0", r"mpl 1 0", r"mozilla org mpl (?:mpl )?1 0"),
    ("mpl-1.1", "mozilla mpl", r"(?:mozilla public license|mpl)(?: version)? v?1 1", r"mpl 1 1", r"mozilla org mpl (?:mpl )?1 1"),
    ("mpl-2", "mozilla mpl mpl2 mplv2", r"(?:(?:mozilla public license|mpl)(?: version)? ?v?2(?: 0)?)", r"mpl 2 0", r"mozilla org (?:en us )?mpl 2 0"),
    ("epl-1", "eclipse epl", r"(?:eclipse public license|epl)(?: version)? v?1(?: 0)?", r"epl 1 0", r"eclipse org legal epl v10"),
    ("epl-2", "eclipse epl", r"(?:eclipse public license|epl)(?: version)? v?2(?: 0)?", r"epl 2 0", r"eclipse org legal epl (?:2 0|v20)"),
    ("edl-1", "eclipse edl", r"eclipse distribution license(?: version)? v?1(?: 0)?", r"edl 1 0", r"eclipse org org documents edl v10"),
    ("cpl-1", "cpl common", r"(?:common public license|cpl)(?: version)? v?1(?: 0)?", r"cpl 1 0", r"opensource org licenses? cpl1 0"),
    ("ipl-1", "ibm ipl", r"ibm public license(?: version)? v?1(?: 0)?", r"ipl 1 0", r"opensource org licenses? ipl 1 0"),
    ("cddl-1", "cddl common", r"(?:common development and distribution license|cddl)(?: version)? v?1(?: 0)?", r"cddl 1 0", r"opensource org licenses? cddl 1 0"),
    ("cddl-1.1", "cddl common", r"(?:common development and distribution license|cddl)(?: version)? v?1 1", r"cddl 1 1", r"glassfish java net public cddl gpl 1 1"),
    ("eupl-1.1", "eupl", r"(?:european union public licen[sc]e|eupl)(?: version)? v?1 1", r"eupl 1 1", r"joinup ec europa eu software page eupl"),
    ("eupl-1.2", "eupl", r"(?:european union public licen[sc]e|eupl)(?: version)? v?1 2", r"eupl 1 2", r"joinup ec europa eu collection eupl"),
    ("cc0-1", "cc0 creative zero", r"(?:cc0(?: 1 0)?(?: universal)?|creative commons zero)", r"cc0 1 0", r"creativecommons org publicdomain zero 1 0"),
    ("cc-pdm-1", "creativecommons mark", r"public domain mark(?: 1 0)?", r"cc pddc", r"creativecommons org publicdomain mark 1 0"),
    ("cc-by-2", "cc creative", r"(?:cc by 2 [05]|creative commons attribution 2 [05])", r"cc by 2 [05]", r"creativecommons org licenses by 2 [05]"),
    ("cc-by-3", "cc creative", r"(?:cc by 3 0|creative commons attribution 3 0)", r"cc by 3 0", r"creativecommons org licenses by 3 0"),
    ("cc-by-4", "cc creative", r"(?:cc by 4 0|creative commons attribution 4 0)", r"cc by 4 0", r"creativecommons org licenses by 4 0"),
    ("cc-by", "cc creative", r"(?:cc by|creative commons attribution)", r"cc by", r"creativecommons org licenses by"),
    ("cc-by-sa-3", "cc creative", r"(?:cc by sa 3 0|creative commons attribution share ?alike 3 0)", r"cc by sa 3 0", r"creativecommons org licenses by sa 3 0"),
    ("cc-by-sa-4", "cc creative", r"(?:cc by sa 4 0|creative commons attribution share ?alike 4 0)", r"cc by sa 4 0", r"creativecommons org licenses by sa 4 0"),
    ("cc-by-sa", "cc creative", r"(?:cc by sa|creative commons attribution share ?alike)", r"cc by sa", r"creativecommons org licenses by sa"),
    ("cc-by-nd", "cc creative", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)(?: [1-4] [05])?", r"cc by nd [1-4] [05]", r"creativecommons org licenses by nd"),
    ("cc-by-nc", "cc creative", r"(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [05])?", r"cc by nc [1-4] [05]", r"creativecommons org licenses by nc"),
    ("cc-by-nc-sa", "cc creative", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])?", r"cc by nc sa [1-4] [05]", r"creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "cc creative", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)(?: [1-4] [05])?", r"cc by nc nd [1-4] [05]", r"creativecommons org licenses by nc nd"),
    ("odbl-1", "odbl database", r"(?:open database license|odbl)(?: v?1 0)?", r"odbl 1 0", r"opendatacommons org licenses odbl"),
    ("odc-by-1", "odc", r"(?:open data commons attribution license|odc by)(?: v?1 0)?", r"odc by 1 0", r"opendatacommons org licenses by"),
    ("pddl-1", "pddl", r"(?:open data commons public domain dedication and licen[sc]e|pddl)(?: v?1 0)?", r"pddl 1 0", r"opendatacommons org licenses pddl"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense", r"unlicense org"),
    ("wtfpl", "wtfpl", r"(?:wtfpl|do what the fuck you want to public license)", r"wtfpl", r"wtfpl net"),
    ("boost-1", "boost bsl", r"boost software license(?: version)?(?: 1 0)?", r"bsl 1 0", r"boost org license 1 0"),
    ("artistic-1", "artistic", r"artistic license(?: version)? v?1(?: 0)?", r"artistic 1 0(?: perl| cl8)?", r"opensource org licenses? artistic license 1 0"),
    ("artistic-2", "artistic", r"artistic license(?: version)? v?2(?: 0)?", r"artistic 2 0", r"opensource org licenses? artistic license 2 0"),
    ("psf-2", "python psf", r"(?:python software foundation license|psf license)(?: version)?(?: 2(?: 0)?)?", r"psf 2 0", r"docs python org 3 license"),
    ("php-3", "php", r"php license(?: version)?(?: 3 01| 3 0)?", r"php 3 0(?:1)?", r"php net license 3 0"),
    ("ruby", "ruby", r"ruby license", r"ruby", r"ruby lang org en about license"),
    ("openssl", "openssl ssleay", r"(?:openssl|ssleay) license", r"openssl", r"openssl org source license"),
    ("ofl-1.1", "sil ofl", r"(?:sil open font license|ofl)(?: version)?(?: 1 1)?", r"ofl 1 1(?: rfn| no rfn)?", r"scripts sil org ofl"),
    ("ms-pl", "microsoft", r"microsoft public license", r"ms pl", r"opensource org licenses? ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license", r"ms rl", r"opensource org licenses? ms rl"),
    ("upl-1", "upl", r"universal permissive license(?: version)? ?v?(?:1(?: 0)?)?", r"upl 1 0", r"oss oracle com licenses upl"),
    ("osl-3", "osl", r"(?:open software license|osl)(?: version)? v?3(?: 0)?", r"osl 3 0", r"opensource org licenses? osl 3 0"),
    ("afl-3", "afl academic", r"(?:academic free license|afl)(?: version)? v?3(?: 0)?", r"afl 3 0", r"opensource org licenses? afl 3 0"),
    ("ecl-2", "educational ecl", r"educational community license(?: version)? v?2(?: 0)?", r"ecl 2 0", r"opensource org licenses? ecl 2 0"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?", r"ncsa", r"opensource org licenses? ncsa"),
    ("postgresql", "postgresql", r"postgresql license", r"postgresql", r"opensource org licenses? postgresql"),
    ("vim", "vim", r"vim license", r"vim", r"vimhelp org uganda"),
    ("x11", "x11", r"x11 license", r"x11", r"xfree86 org 3 3 6 copyright2"),
    ("sspl-1", "sspl server", r"(?:server side public license|sspl)(?: version)? ?v?1?", r"sspl 1 0", r"mongodb com licensing server side public license"),
    ("busl-1.1", "busl business bsl", r"(?:business source license|busl)(?: 1 1)?", r"busl 1 1", r"mariadb com bsl11"),
    ("elastic-2", "elastic", r"elastic license(?: version)? ?v?2(?: 0)?", r"elastic 2 0", r"elastic co licensing elastic license"),
    ("cecill-2.1", "cecill", r"cecill(?: version)?(?: v?2 1)?", r"cecill 2 1", r"cecill info licences"),
    ("qpl-1", "qpl", r"(?:q public license|qpl)(?: version)?(?: 1 0)?", r"qpl 1 0", r"opensource org licenses? qtpl"),
    ("json", "json", r"json license", r"json", r"json org license"),
    ("beerware", "beerware beer", r"beer ?ware license", r"beerware", r"people freebsd org phk"),
    ("openrail-m", "openrail rail", r"(?:creativeml )?open ?rail m?", r"creativeml openrail m", r"huggingface co spaces compvis stable diffusion license"),
]

# Bodies and notices of licenses: label, keywords that must all be there, regex.
BODIES = [
    ("mit", "permission hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?"),
    ("mit", "notice permission substantial", r"(?:the )?above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistribution binary forms", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse promote products", r"neither the name of (?:[^ ]+ ){1,12}may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising acknowledgement", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("isc", "permission use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-2", "unless applicable law", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl", "redistribute modify gnu", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2", "either version gnu", r"gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3", "either version gnu", r"gnu general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl", "redistribute modify lesser", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl-3", "redistribute affero", r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl-2", "mozilla subject terms", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "contents mozilla subject", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2", "accompanying eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("epl-1", "accompanying eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented"),
    ("boost-1", "permission boost", r"distributed under the boost software license version 1 0"),
    ("unlicense", "unencumbered released", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("wtfpl", "do what you want", r"you just do what the fuck you want to"),
    ("ofl-1.1", "font sil", r"this font software is licensed under the sil open font license"),
    ("cc0-1", "waived rights extent", r"to the extent possible under law (?:[^ ]+ ){1,12}has waived all copyright"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("proprietary", "confidential proprietary", r"(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", "unauthorized copying prohibited", r"unauthorized (?:copying|reproduction|distribution) (?:[^ ]+ ){0,12}(?:is )?(?:strictly )?prohibited"),
    ("non-commercial", "commercial use", r"for non ?commercial use only"),
    ("research-only", "research purposes only", r"for (?:academic(?: and| or)? )?research purposes only"),
    ("no-ai-training", "training models", r"may not be used (?:for|in|to) (?:the )?train(?:ing)?(?: of)? (?:[^ ]+ ){0,4}models"),
]

# Phrases that look like a license and are none: keywords that must all be there, regex. They suppress what they contain.
DECOYS = [
    ("mit press", r"mit press"),
    ("apache foundation", r"apache software foundation"),
    ("apache helicopter", r"apache helicopters?"),
    ("not under", r"not (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:[^ ]+ ){1,6}licen[sc]e(?: version| v)?(?: [0-9]+){0,2}"),
    ("incompatible with", r"incompatible with (?:the )?(?:[^ ]+ ){1,6}licen[sc]e(?: version| v)?(?: [0-9]+){0,2}"),
    ("drivers license", r"drivers? s? ?licen[sc]e"),
    ("cc bcc", r"cc (?:and )?bcc"),
]

# Forms of every license: name, words the text must hold, priority, weight, regex around {spdx}, {address} and {name}.
FORMS = [
    ("tag", "spdx identifier", 1, 1.0, r"spdx licen[sc]e identifier {spdx}"),
    ("grant", "under", 2, 0.95, r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|governed|redistributed) (?:to you )?under "
     r"(?:(?:the )?terms (?:and conditions )?of )?(?:the |an? )?{name}(?: (?:international|universal|unported|public))?(?: licen[sc]es?)?"),
    ("address", "org com net co eu info", 3, 0.9, r"(?:https? )?(?:www )?{address}"),
    ("name", "license licence licensed licenced copying", 4, 0.6,
     r"(?:{name}(?: (?:international|universal|unported|public))? licen[sc]e|licen[sc]e(?: is)? (?:the )?{name})"),
]
BODY = (2, 0.9)
BASE_WEIGHT = 0.95
DECOY_PRIORITY = 1


@dataclass
class Rule:
    """One signature: the label it reports (None: a decoy), when it runs, how it is matched and how it ranks."""
    name: str
    label: str | None
    some: frozenset      # of each set of words in ``some`` the text must hold one
    regex: re.Pattern
    priority: int
    weight: float


def compiled(regex: str) -> re.Pattern:
    return re.compile(rb"(?<![^ ])(?:" + regex.encode() + rb")(?![^ ])")


def gate(*words: str, each: str = "") -> frozenset:
    """One of every group in ``words``, and every word of ``each``."""
    return frozenset(frozenset(w.encode().split()) for w in words) | frozenset(frozenset([w]) for w in each.encode().split())


def rules() -> list[Rule]:
    """All signatures in order."""
    out = [Rule(f"base {label}", label, gate(each=phrase), compiled(phrase), 0, BASE_WEIGHT) for label, phrase in BASE]
    out += [Rule(f"decoy {w}", None, gate(each=w), compiled(x), DECOY_PRIORITY, 0.0) for w, x in DECOYS]
    out += [Rule(f"body {label}", label, gate(each=w), compiled(x), *BODY) for label, w, x in BODIES]
    for label, words, name, spdx, address in LICENSES:
        for form, needs, priority, weight, shape in FORMS:
            opened = {"tag": gate(words + " " + spdx.split()[0].replace("(?:", ""), each=needs), "grant": gate(words, each=needs),
                      "address": gate(needs, address.replace("?", "").split()[0])}.get(form, gate(words, needs))
            out.append(Rule(f"{form} {label}", label, opened, compiled(shape.format(name=name, spdx=spdx, address=address)), priority, weight))
    return out


_SPACED = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def spaced(text: str | None) -> bytes:
    """The text's bytes in ASCII lower case, every byte outside words as a space (positions are kept)."""
    return (text or "").encode().lower().translate(_SPACED)


def pieces(raw: bytes):
    """Consecutive parts of about ``PIECE`` bytes, cut at spaces."""
    i = 0
    while i < len(raw):
        j = raw.find(b" ", min(i + PIECE, len(raw)))
        j = len(raw) if j < 0 else j
        yield raw[i:j]
        i = j


@dataclass
class Found:
    """Detections of one text, by start: word range (end exclusive), rule number, and whether a base phrase."""
    n_words: int
    start: np.ndarray
    end: np.ndarray
    rule: np.ndarray
    kept: np.ndarray


def suppressed(start: np.ndarray, end: np.ndarray, priority: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which detections lie inside one of higher priority, or inside a longer or (if equal) earlier one of the same."""
    out = np.zeros(len(start), bool)
    for p in np.unique(priority):
        mine = np.flatnonzero(priority == p)
        above = np.flatnonzero(priority < p)
        if len(above):
            by = above[np.argsort(start[above], kind="stable")]
            reach = np.maximum.accumulate(end[by])
            at = np.searchsorted(start[by], start[mine], "right") - 1
            out[mine] |= (at >= 0) & (reach[at] >= end[mine])
        by = mine[np.lexsort((order[mine], -end[mine], start[mine]))]
        reach = np.maximum.accumulate(end[by])
        out[by[1:]] |= reach[:-1] >= end[by[1:]]
    return out


class Scanner:
    """Compiled rules behind one keyword set."""

    def __init__(self):
        self.rules = rules()
        self.words = frozenset().union(*(g for r in self.rules for g in r.some))
        self.priority = np.array([r.priority for r in self.rules])
        self.is_base = np.array([r.name.startswith("base ") for r in self.rules])
        self.report = np.array([r.label is not None for r in self.rules])

    def find(self, text: str | None) -> Found:
        raw, n, have = spaced(text), 0, set()
        for part in pieces(raw):
            w = part.split()
            n += len(w)
            have |= self.words.intersection(w)
        run = [k for k, r in enumerate(self.rules) if all(not g.isdisjoint(have) for g in r.some)] if have else []
        hits = []
        if run:
            flat = re.sub(rb" +", b" ", raw).strip(b" ")
            hits = [(m.start(), m.end(), k) for k in run for m in self.rules[k].regex.finditer(flat)]
        if not hits:
            return Found(n, *(np.empty(0, np.int64) for _ in range(3)), np.empty(0, bool))
        gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
        start, end, rule = np.array(hits, np.int64).T
        start, end = np.searchsorted(gaps, start), np.searchsorted(gaps, end) + 1
        at = np.lexsort((rule, end, start))
        start, end, rule = start[at], end[at], rule[at]
        kept = self.is_base[rule] | (~suppressed(start, end, self.priority[rule], rule) & self.report[rule])
        return Found(n, start, end, rule, kept)

    def row(self, doc_id, text) -> tuple:
        """op11's contract columns and the number of reported detections."""
        f = self.find(text)
        base = f.start[self.is_base[f.rule]] if len(f.rule) else f.start
        labels = [{self.rules[k].label for k in np.unique(x).tolist()} for x in (f.rule[self.is_base[f.rule]], f.rule[f.kept])] if len(f.rule) else [set(), set()]
        score = max((self.rules[k].weight for k in np.unique(f.rule[f.kept]).tolist()), default=0.0) if len(f.rule) else 0.0
        return (doc_id, f.n_words, len(base), int(base.min()) if len(base) else None, int(base.max()) if len(base) else None,
                ",".join(sorted(labels[0])), ",".join(sorted(labels[1])), score, int(f.kept.sum()))

    def detections(self, doc_id, text) -> list[tuple]:
        """Every reported detection with its place in the words and its text."""
        f = self.find(text)
        if not f.kept.any():
            return []
        raw = (text or "").encode()
        inside = np.frombuffer(spaced(text), np.uint8) != 32
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        first, last = edge[0::2], edge[1::2]
        return [(doc_id, self.rules[r].label, self.rules[r].name, self.rules[r].priority, self.rules[r].weight, i, j,
                 raw[first[i]:last[j - 1]].decode(errors="replace"))
                for i, j, r in zip(*(x[f.kept].tolist() for x in (f.start, f.end, f.rule)))]


ROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                 ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_detections", pa.int64())])
DETECTION = pa.schema([("doc_id", pa.int64()), ("label", pa.string()), ("rule", pa.string()), ("priority", pa.int32()), ("weight", pa.float64()),
                       ("start_word", pa.int64()), ("end_word", pa.int64()), ("text", pa.string())])
_DDL = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.string(): "string"}
ROWS = 512          # documents of one output batch


def _scanned(docs: DataFrame, schema: pa.Schema, rows_of) -> DataFrame:
    def run(batches):
        scanner = Scanner()
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                got = [r for i, t in zip(part.column("doc_id").to_pylist(), part.column("text")) for r in rows_of(scanner, i, t.as_py())]
                cols = list(zip(*got)) if got else [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return docs.mapInArrow(run, ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema))


def scan(docs: DataFrame) -> DataFrame:
    """One row per reported detection: label, rule, its rank, its word range and its text."""
    return _scanned(docs, DETECTION, lambda s, i, t: s.detections(i, t))


def report(docs: DataFrame) -> DataFrame:
    """op11's contract columns, one row per document."""
    return _scanned(docs, ROW, lambda s, i, t: [s.row(i, t)])


by_value(common, sys.modules[__name__])
