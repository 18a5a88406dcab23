"""Scalar column expressions shared by the operators.

All of them compile to Catalyst expressions (regexp, substr, higher-order
array functions), so they run inside whole-stage codegen on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# The characters Python's str.strip() removes from ASCII text.
WHITESPACE = " \t\n\r\x0b\x0c"

_INT_RE = r"^\s*[+-]?\d+\s*$"
_DEC_RE = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)\s*$"


def _c(col: ColumnOrName) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col: ColumnOrName) -> Column:
    """Python ``str.strip()`` on ASCII whitespace."""
    return F.trim(_c(col), F.lit(WHITESPACE))


def nonblank(col: ColumnOrName) -> Column:
    """NULL for NULL, empty or whitespace-only text, else the stripped text."""
    return F.nullif(strip_ws(col), F.lit(""))


def is_int_text(col: ColumnOrName) -> Column:
    """True when the text is a plain integer (``int()`` would accept it)."""
    return _c(col).rlike(_INT_RE)


def int_or_null(col: ColumnOrName, dtype: str = "int") -> Column:
    """Integer value of the text, NULL when it is not a plain integer.

    The regex guard keeps ``'4.0'`` NULL; a bare ``try_cast`` disagrees
    between engines on such text.
    """
    c = _c(col)
    return F.when(is_int_text(c), F.trim(c).try_cast(dtype))


def decimal_or_null(col: ColumnOrName, precision: int = 18, scale: int = 5) -> Column:
    c = _c(col)
    return F.when(c.rlike(_DEC_RE), F.trim(c).try_cast(f"decimal({precision},{scale})"))


def json_int(col: ColumnOrName, path: str, default: int | None = 0) -> Column:
    """Integer (bigint) at a JSON path; any failure (bad JSON, missing, non-int) gives default."""
    raw = F.get_json_object(_c(col), path)
    val = int_or_null(raw, "bigint")
    return val if default is None else F.coalesce(val, F.lit(default).cast("bigint"))


def before_first(col: ColumnOrName, sep: str) -> Column:
    """Text before the first ``sep``; the whole text when ``sep`` is absent."""
    return F.substring_index(_c(col), sep, 1)


def after_first(col: ColumnOrName, sep: str) -> Column:
    """Text after the first ``sep``; the whole text when ``sep`` is absent."""
    c = _c(col)
    pos = F.instr(c, sep)
    return F.when(pos > 0, _substr_from(c, pos + len(sep))).otherwise(c)


def _substr_from(c: Column, start: Column) -> Column:
    return c.substr(start, F.length(c) + 1)


def after_last(col: ColumnOrName, sep: str) -> Column:
    """Text after the last ``sep`` (base name); the whole text when absent."""
    return F.substring_index(_c(col), sep, -1)


def strip_extension(col: ColumnOrName) -> Column:
    """Name without its last ``.ext`` (``a.tar.gz`` -> ``a.tar``)."""
    return F.regexp_replace(_c(col), r"\.[^./]*$", "")


def first_tokens(col: ColumnOrName, sep: str, n: int) -> Column:
    """The first ``n`` ``sep``-separated tokens, joined again by ``sep``."""
    return F.substring_index(_c(col), sep, n)


def bracket_job_id(col: ColumnOrName) -> Column:
    """Job id from ``[service]-[id]``: from the first ``-`` plus two to the last char but one.

    The two brackets around the id are cut off. Text without a ``-`` only
    loses its first and last character.
    """
    c = _c(col)
    i = F.instr(c, "-")  # 1-based, 0 when absent == find() + 1
    length = F.length(c) - i - F.lit(2)
    return F.when(length > 0, c.substr(i + F.lit(2), length)).otherwise(F.lit(""))


# Grammar of compressed host lists (``c401-[101-103,105],gpu2``,
# ``rack[1-2]-n[01-03]``): an item is a run of non-comma text and bracket groups.
# A group that is never closed runs to the end, a stray ``]`` stays in its item;
# such items are malformed as a whole and give no host.
HOSTLIST_ITEM_RE = r"(?:[^,\[]|\[[^\]]*(?:\]|$))+"
HOSTLIST_VALID_RE = r"^(?:[^\[\]]*\[[^\[\]]*\])*[^\[\]]*$"
RANGE_RE = r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$"
HOSTLIST_SEGMENT_RE = r"\[[^\]]*\]|[^\[\]]+"


def expand_ranges(body: Column) -> Column:
    """``08-11,15`` -> ``["08", "09", "10", "11", "15"]``.

    A range counts up and keeps the zero padding of its low bound; a
    reversed or malformed range gives nothing.
    """
    def one(r: Column) -> Column:
        lo_txt = F.regexp_extract(r, RANGE_RE, 1)
        hi_txt = F.coalesce(F.nullif(F.regexp_extract(r, RANGE_RE, 2), F.lit("")), lo_txt)
        lo = lo_txt.try_cast("long")
        hi = hi_txt.try_cast("long")
        width = F.length(lo_txt)
        numbers = F.when(lo.isNotNull() & (hi >= lo), F.sequence(lo, hi)) \
            .otherwise(F.array().cast("array<bigint>"))
        return F.transform(numbers, lambda n: F.lpad(
            n.cast("string"), F.greatest(width, F.length(n.cast("string"))), "0"))

    return F.flatten(F.transform(F.split(body, ","), one))


def expand_hostlist_item(item: Column) -> Column:
    """All hosts of one item, any number of bracket groups (their product).

    ``rack[1-2]-n[01-02]`` -> rack1-n01, rack1-n02, rack2-n01, rack2-n02. A
    fold over the item's segments; used for items with several groups.
    """
    segments = F.regexp_extract_all(F.when(item.rlike(HOSTLIST_VALID_RE), item), F.lit(HOSTLIST_SEGMENT_RE), 0)

    def values(seg: Column) -> Column:
        return F.when(seg.startswith("["), expand_ranges(F.regexp_extract(seg, r"^\[(.*)\]$", 1))) \
            .otherwise(F.array(seg))

    hosts = F.aggregate(segments, F.array(F.lit("")),
                        lambda acc, seg: F.flatten(F.transform(
                            acc, lambda a: F.transform(values(seg), lambda x: F.concat(a, x)))))
    return F.coalesce(hosts, F.array().cast("array<string>"))


def expand_hostlist(col: ColumnOrName) -> Column:
    """Expand a compressed host expression into an array of distinct host names.

    Top-level commas separate items; an item is plain text with any number
    of bracket groups. Built from ``regexp_extract_all``, ``sequence`` and
    higher-order array functions (no UDF).
    """
    items = F.regexp_extract_all(_c(col), F.lit(HOSTLIST_ITEM_RE), 0)
    return F.array_distinct(F.flatten(F.transform(
        items, lambda it: expand_hostlist_item(F.trim(it)))))
