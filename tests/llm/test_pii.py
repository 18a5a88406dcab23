import hashlib
import random
import re
from collections import Counter

from llm.conftest import EDGES
from runlens.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(t):
    return re.sub("[^0-9]", "", t)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(t):
    t = t or ""
    out = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in CARD.finditer(t) if 12 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(t) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out)


def row(i, t):
    spans = base(t)
    n = Counter(k for *_, k in spans)
    listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    return (i, *(n[k] for k in P.KINDS), hashlib.sha256(listed.encode()).hexdigest())


def test_base_against_brute_force(frame, texts):
    rng = random.Random(4)
    parts = ["a", "b.c", "_", "@", "@x", "1", "23", ".", "%", "+", "-", " ", "(", ")", "4111111111111111", "255.1.", "é", "\U0001f600",
             "\n", "a@b.c", "d@e.fg_h@i.j", "+49 30 1234567", "1.2.3.4", "999.1.1.1"]
    rows = texts + [(10_000 + k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for k in range(800)]
    rows += [(None if i is None else 20_000 + i, t) for i, t in EDGES]
    rows += [(30_000, "9 " * 3000), (30_001, "1" * 20_000), (30_002, "a." * 20_000)]
    got = Counter(tuple(r)[:6] for r in P.report(frame(rows)).collect())
    assert got == Counter(row(i, t) for i, t in rows)


CALLS = [(i, f"foo bar number{i % 3} please ring hotline: +49 30 {1000000 + i * 7919} thanks") for i in range(40)]


def test_trusted_patterns_discover_identifiers(frame):
    rows = CALLS + [(100, "please ring hotline: 0800-12345 now"), (101, "the code 123456 is fine"), (102, "")]
    got = {r.doc_id: r.spans for r in P.report(frame(rows)).collect()}
    assert got[100] == "phone:21:31" and got[101] == got[102] == ""
    assert all(got[i].startswith("phone:") for i in range(40))


def test_common_words_are_no_patterns(frame):
    rows = [(i, f"the +49 30 {1000000 + i * 7919} x") for i in range(40)] + [(50 + i, "the the the the") for i in range(40)]
    got = {r.doc_id: r.spans for r in P.report(frame(rows + [(100, "the 44556 x")])).collect()}
    assert got[100] == ""


def found(frame, rows):
    return {r.doc_id: r.spans for r in P.report(frame(rows)).collect()}


def test_patterns_that_touch_their_identifier(frame):
    for k, mark in enumerate(["tel:", "id=", '"', "(", '{"phone":"']):
        rows = [(i, f"foo{i} bar {mark}+49 30 {1000000 + i * 7919} x{i}") for i in range(40)]
        at = 6 + len(mark)
        assert found(frame, rows + [(100, f"other {mark}0800-12345 now")])[100] == f"phone:{at}:{at + 10}", mark


def test_places_inside_words_count_for_the_share(frame):
    rows = [(i, f"foo{i} bar tel:+49 30 {1000000 + i * 7919} x{i}") for i in range(40)]
    rows += [(200 + i, f"see{i} tel:none{chr(97 + i % 26)}") for i in range(60)]
    assert found(frame, rows + [(100, "other tel:0800-12345 now"), (101, "one tel: b")])[100] == ""


def test_long_words_are_read_whole(frame):
    long = "w" * 100
    rows = [(i, f"{long} {long}: +49 30 {1000000 + i * 7919} x") for i in range(40)]
    got = found(frame, rows + [(100, f"{long} {long}: 0800-12345 now"), (101, "www " + "w" * 79 + ": 0800-12345 now")])
    assert got[100] == "phone:203:213" and got[101] == ""


def test_first_words_are_counted_once(frame):
    rows = [(i, f"ring: +49 30 {1000000 + i * 7919} x") for i in range(40)]
    rows += [(200 + i, f"ring: me{chr(97 + i % 26)}") for i in range(30)]
    assert found(frame, rows + [(100, "ring: 0800-12345 now")])[100] == "phone:6:16"


def test_tokens_with_few_digits_are_found(frame):
    rows = [(i, f"foo{i} mail email: user{i}@example.org thanks") for i in range(40)]
    rows += [(300 + i, f"foo{i} bar host: 10.0.{i}.7 up") for i in range(40)]
    rows += [(100, "xx email: jane(at)example now"), (101, "xx email: johnny, now"), (102, "xx email: the end"), (103, "the a the b the c"),
             (104, "xx host: 2001:db8::ff00:42:8329 up"), (105, "xx email:john.doe1990")]
    got = found(frame, rows)
    assert [got[i] for i in range(100, 106)] == ["email:10:25", "email:10:16", "", "", "ip:9:31", "email:9:21"]


def test_accepted_instances_count_as_entities(frame):
    card = "4111111111111111 4012888888881881 5555555555554444 5105105105105100 378282246310005 371449635398431 6011111111111117 " \
           "6011000990139424"
    rows = [(i, f"pay acct nr: {c} x") for i, c in enumerate(card.split())]
    rows += [(100 + i, f"pay acct nr: A{70000 + i * 37} x") for i in range(12)]        # 40 % seeds
    rows += [(200 + i, f"see{i} my konto= A{70000 + i * 37} y") for i in range(12)]     # a pattern without seeds
    rows += [(300, "we konto= A99887 y")]
    got = found(frame, rows)
    assert all(got[100 + i] == "card:13:19" for i in range(12))
    assert got[300] == "card:10:16"


def test_redact_keeps_other_columns(frame):
    rows = CALLS + [(100, "please ring hotline: 0800-12345 now"), (None, "mail a@b.cd x"), (7, None), (8, "clean é")]
    df = frame(rows)
    out = P.redact(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got[100, "please ring hotline: [PHONE] now"] == got[None, "mail [EMAIL] x"] == got[7, None] == got[8, "clean é"] == 1


def test_overlapping_spans(frame):
    df = frame([(1, "x +378282246310005 y")])          # a phone number whose digits are a card number
    assert P.report(df).first().spans == "phone:2:18,card:3:18"
    assert P.redact(df).first().text == "x [PHONE] y"


def test_native(docs):
    plan = P.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_empty_table(docs):
    assert P.report(docs.limit(0)).collect() == []
