import re
from collections import Counter

from llm.conftest import EDGES
from runlens.llm import quality_rules as Q
from runlens.llm.queries import ORACLE, QUERIES


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    marked = {p for i, g in enumerate(grams) if n[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked), failed)


def test_base_against_brute_force(spark, docs, texts, frame):
    rows = texts + [(i + 10_000 if i is not None else None, t) for i, t in EDGES]
    got = Counter(tuple(r)[:7] for r in Q.report(frame(rows)).collect())
    assert got == Counter((i, *brute(t)) for i, t in rows)


def test_rules_judge(frame):
    prose = " ".join(f"the {a}{b}" for a in ("river", "house", "garden", "market", "bridge", "forest") for b in ("side", "man", "way", "gate", "ly"))
    rows = [(1, prose), (2, " ".join(w + "###" for w in prose.split())), (3, prose.upper()), (4, "zq vx " * 40), (5, None)]
    kept = frame(rows).transform(Q.keep_good)
    assert [r.doc_id for r in kept.collect()] == [1]
    assert kept.columns == frame(rows).columns


def test_empty_table(frame, docs):
    assert Q.report(docs.limit(0)).collect() == []


def test_oracle(spark):
    from llm.conftest import SF
    from oracle_compare import compare, duck
    ok, msg = compare(QUERIES["op1_quality_rules"](spark, SF), duck(SF), ORACLE["op1_quality_rules"])
    assert ok, msg


def test_stop_words_are_read_whatever_their_case_and_marks(frame):
    plain = " ".join(f"the word{k} of" for k in range(20))
    rows = [(1, plain), (2, plain.replace("the", "The")), (3, plain.replace("the", "the,").replace("of", "OF.")), (4, " ".join(f"word{k}" for k in range(60))),
            (5, " ".join(f"word{k}" for k in range(58)) + " the of")]
    got = {r.doc_id: r.kept for r in Q.report(frame(rows)).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False}
