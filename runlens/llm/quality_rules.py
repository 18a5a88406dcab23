"""op1: quality rules as one native projection.

``RULES`` is a threshold table. Each row names a measured share (count and
denominator, both integer columns of ``measures``) and the percentages it must
lie between; ``compile_rules`` turns the table into one boolean column, so
every rule is evaluated in the same scan without user functions. All tests are
integer comparisons, ``100 * count <= max_pct * denominator``, so no
rounding decides a document.

Defined results: a null or empty text has all counts 0, fails the base test
(fewer than 50 words) and is not kept. Rows with a null id and repeated rows
are judged one by one; other columns of the input are passed through
untouched (measure columns use the prefix ``q_`` in ``apply_rules``). An empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import WORD, let

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MARKS = ".,;:!?\"()"      # left off a word before it is looked up among the stop words

# Frequent function words of the corpus languages.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "as", "with", "was", "on", "be", "at", "by", "this", "are",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ein", "eine", "auf", "im", "ist",
    "de", "la", "le", "et", "les", "des", "en", "un", "une", "que", "pour", "du",
    "el", "los", "las", "y", "por", "con", "del", "una", "para", "se",
]


@dataclass(frozen=True)
class Rule:
    """``min_pct * den <= 100 * count <= max_pct * den``."""
    name: str
    count: str
    den: str
    min_pct: int | None = None
    max_pct: int | None = None


RULES = [
    Rule("mean_word_length", "word_chars", "n_words", 200, 1400),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 10),
    Rule("exclamations_per_word", "n_exclaims", "n_words", None, 20),
    Rule("upper_case_share", "n_upper", "word_chars", None, 30),
    Rule("stop_words", "n_stop", "n_words", 5, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 60),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30),
]


def _n_without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array (first occurrence included).

    The windows' 64-bit hashes are sorted as primitives; only a text that has an equal
    pair pays for the positions.
    """
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(0), n - 3),
                        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def marked(g: Column) -> Column:
        tagged = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def near(s: Column) -> Column:
            again = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
            return let(F.transform(again, lambda x: x["i"]),
                       lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda v: v + 1),
                                                                  F.transform(p, lambda v: v + 2)))))
        return let(tagged, near)

    return F.when(n < 3, 0).otherwise(let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0)
                                          .otherwise(marked(g))))


def measures(text: Column) -> dict[str, Column]:
    """Integer measures of a text. Names are the columns the rules refer to."""
    text = F.coalesce(text, F.lit(""))
    size = F.length(text)
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    counts = {
        "n_words": lambda w, ln: F.size(w),
        "n_repeat_words": lambda w, ln: repeat_words(w),
        "n_stop": lambda w, ln: F.size(F.filter(w, lambda x: F.lower(F.translate(x, MARKS, "")).isin(STOP_WORDS))),
        "n_lines": lambda w, ln: F.size(ln),
        "n_dup_lines": lambda w, ln: F.size(ln) - F.size(F.array_distinct(ln)),
        "n_bullet_lines": lambda w, ln: F.size(F.filter(ln, lambda x: x.rlike("^[ \\t]*[-*\u2022]"))),
        "n_ellipsis_lines": lambda w, ln: F.size(F.filter(ln, lambda x: x.rlike("(\\.\\.\\.|\u2026)[ \\t\\r]*$"))),
    }
    by_lists = let(F.struct(words.alias("w"), lines.alias("l")),
                   lambda s: F.struct(*[f(s["w"], s["l"]).cast("long").alias(k) for k, f in counts.items()]))
    flat = {
        "word_chars": _n_without(text, SPACES),
        "n_symbols": size - _n_without(text, SYMBOLS),
        "n_exclaims": size - _n_without(text, "!"),
        "n_upper": F.length(F.regexp_replace(text, "[^A-Z\u00c0-\u00d6\u00d8-\u00de]+", "")),
    }
    return {"lists": by_lists} | {k: c.cast("long") for k, c in flat.items()}


def base_failed(col) -> Column:
    return (col("n_words") < MIN_WORDS) | (100 * col("n_repeat_words") > 50 * col("n_words"))


def compile_rules(rules: list[Rule], col) -> Column:
    """One boolean column: every rule holds. ``col`` maps a measure name to its column."""
    ok = F.lit(True)
    for r in rules:
        den = col(r.den)
        if r.min_pct is not None:
            ok = ok & (100 * col(r.count) >= r.min_pct * den)
        if r.max_pct is not None:
            ok = ok & (100 * col(r.count) <= r.max_pct * den)
    return ok


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a struct ``q_measures`` and booleans ``q_base_failed``, ``q_kept``."""
    rules = RULES if rules is None else rules
    m = measures(F.col(text))
    names = [k for k in m if k != "lists"]
    out = docs.withColumn("q_measures", F.struct(m["lists"].alias("lists"), *[m[k].alias(k) for k in names]))

    def col(k: str) -> Column:
        return F.col(f"q_measures.{k}") if k in names else F.col(f"q_measures.lists.{k}")

    out = out.withColumn("q_base_failed", base_failed(col))
    return out.withColumn("q_kept", ~F.col("q_base_failed") & compile_rules(rules, col))


def keep_good(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns only.

    Rejected rows go by exploding an empty array: a filter would be pushed below the measures and repeat them per rule.
    """
    judged = apply_rules(docs, rules, text)
    none = F.array().cast("array<int>")
    kept = judged.withColumn("q_row", F.explode(F.when(F.col("q_kept"), F.array(F.lit(0))).otherwise(none)))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """op1's contract columns."""
    m = "q_measures.lists"
    return apply_rules(docs.select("doc_id", "text")).select(
        "doc_id", F.col(f"{m}.n_words").alias("n_words"), F.col("q_measures.word_chars").alias("word_chars"),
        F.col("q_measures.n_symbols").alias("n_symbols"), F.col(f"{m}.n_dup_lines").alias("n_dup_lines"),
        F.col(f"{m}.n_repeat_words").alias("n_repeat_words"), F.col("q_base_failed").alias("base_failed"),
        F.col("q_kept").alias("kept"))


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)

REPORT_SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^ \\t-\\r]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS ls FROM t
), g AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
         (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclaims,
         length(regexp_replace(text, '[^A-Z\u00c0-\u00d6\u00d8-\u00de]+', '', 'g'))::BIGINT AS n_upper,
         len(list_filter(ws, lambda x: lower(translate(x, '{MARKS}', '')) IN ({_STOP_SQL})))::BIGINT AS n_stop,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[ \\t]*[-*\u2022]')))::BIGINT AS n_bullet_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|\u2026)[ \\t\\r]*$')))::BIGINT AS n_ellipsis_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (r)
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * word_chars BETWEEN 200 * n_words AND 1400 * n_words
       AND 100 * n_symbols <= 10 * n_words AND 100 * n_exclaims <= 20 * n_words AND 100 * n_upper <= 30 * word_chars
       AND 100 * n_stop >= 5 * n_words AND 100 * n_dup_lines <= 60 * n_lines AND 100 * n_bullet_lines <= 90 * n_lines
       AND 100 * n_ellipsis_lines <= 30 * n_lines AS kept
FROM b
"""
