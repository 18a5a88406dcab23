"""Extraction over log, status and listing rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions import columns as C
from runlens.functions.columns import strip_ws
from runlens.functions.ordering import join_on_keys


# Fixed value: worker ids on a standalone master's status page (text right
# after a ``>``).
WORKER_ID_RE = r"(?<=>)worker-[0-9\-.]*"


def extract_first(df: DataFrame, col: str, pattern: str, group: int = 1,
                  out: str = "match") -> DataFrame:
    """First regex match (capture ``group``), NULL when absent."""
    return df.withColumn(out, F.nullif(F.regexp_extract(F.col(col), pattern, group), F.lit("")))


def extract_all(df: DataFrame, col: str, pattern: str, group: int = 0, explode: bool = False,
                out: str = "match", count_out: str | None = "n_matches",
                pos_out: str = "match_pos") -> DataFrame:
    """All regex matches of a text (S2): their count, or one row per match."""
    matches = F.regexp_extract_all(F.col(col), F.lit(pattern), group)
    if explode:
        return df.select("*", F.posexplode(matches).alias(pos_out, out))
    out_df = df.withColumn(out, matches)
    if count_out:
        out_df = out_df.withColumn(count_out, F.size(F.col(out)))
    return out_df


def json_int(df: DataFrame, col: str, path: str, default: int = 0, out: str = "value") -> DataFrame:
    """Integer at a JSON path; any failure gives ``default`` (S3)."""
    return df.withColumn(out, C.json_int(F.col(col), path, default))


def last_match_value(df: DataFrame, key: str, seq: str, line: str, token: str,
                     default: str | None = "empty", out: str = "value",
                     keys_df: DataFrame | None = None) -> DataFrame:
    """Value of the last line (by ``seq``) holding ``token`` past column 0.

    The value is the text after the first ``=``, stripped. Keys whose lines
    never match get ``default``; ``keys_df`` adds keys with no lines at all.
    A NULL key is a key like any other.
    One hash aggregate (``max_by``) with a partial step: no sort of a group.
    """
    hit = F.instr(F.col(line), token) > 1
    value = strip_ws(C.after_first(F.col(line), "="))
    res = df.groupBy(key).agg(F.max_by(F.when(hit, value), F.when(hit, F.col(seq))).alias(out))
    if keys_df is not None:
        res = join_on_keys(keys_df.select(key).dropDuplicates([key]), res, [key], how="left")
    if default is not None:
        res = res.withColumn(out, F.coalesce(F.col(out), F.lit(default)))
    return res


# Named slices usable in derive_fields.
SLICES = {
    "job_id": lambda c: C.bracket_job_id(c),
    "before": lambda c, sep: C.before_first(c, sep),
    "after": lambda c, sep: C.after_first(c, sep),
    "after_last": lambda c, sep: C.after_last(c, sep),
    "stem": lambda c: C.strip_extension(c),
    "tokens": lambda c, sep, n: C.first_tokens(c, sep, n),
}


def derive_fields(df: DataFrame, spec: dict[str, tuple]) -> DataFrame:
    """Add sliced fields in one projection.

    ``spec`` maps an output name to ``(slice, source, *args)``; a source may
    be an earlier output. Slices: ``job_id``, ``before``, ``after``,
    ``after_last``, ``stem``, ``tokens``.
    """
    out = df
    for name, (kind, src, *args) in spec.items():
        out = out.withColumn(name, SLICES[kind](F.col(src), *args))
    return out
