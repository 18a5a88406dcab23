"""Configuration rows: key/value split, key filters, classification,
placeholder resolution and overlays (A3, C1, C2, S6, O1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from runlens.functions.columns import strip_ws
from runlens.functions.ordering import join_on_keys


def read_key_values(df: DataFrame, line: str = "line", sep: str = "=", comment: str = "#",
                    key_out: str = "key", value_out: str = "value", dropped: Observation | str | None = None) -> DataFrame:
    """Split ``key<sep>value`` lines on the first separator (A3).

    Blank lines, comment lines and lines without the separator give no row;
    key and value are stripped. ``sep='='`` reads properties, ``sep=': '``
    flat YAML. ``dropped`` counts the lines read and, in the same pass, those
    without a row: ``blank`` (also NULL), ``comment``, ``no_separator``.
    """
    text = strip_ws(F.col(line))
    pos = F.instr(text, sep)
    if dropped is not None:
        blank = F.coalesce(text == "", F.lit(True))
        df = df.observe(dropped, F.count(F.lit(1)).alias("lines"), F.count_if(blank).alias("blank"),
                        F.count_if(~blank & text.startswith(comment)).alias("comment"),
                        F.count_if(~blank & ~text.startswith(comment) & (pos == 0)).alias("no_separator"))
    key = strip_ws(text.substr(F.lit(1), pos - 1))
    value = strip_ws(text.substr(pos + len(sep), F.length(text) + 1))
    return df.where((text != "") & ~text.startswith(comment) & (pos > 0)) \
        .withColumn(key_out, key).withColumn(value_out, value)


def key_filter(col: Column, prefixes: Sequence[str] = (), contains: Sequence[str] = ()) -> Column:
    """OR of ``startswith`` / ``contains`` tests."""
    conds = [col.startswith(p) for p in prefixes] + [col.contains(c) for c in contains]
    if not conds:
        return F.lit(True)
    cond = conds[0]
    for c in conds[1:]:
        cond = cond | c
    return cond


def filter_keys(df: DataFrame, col: str, prefixes: Sequence[str] = (),
                contains: Sequence[str] = (), display: str | None = None) -> DataFrame:
    """Keep rows whose ``col`` starts with / contains one of the given texts.

    A pure prefix test: ``zookeeper.connect`` also keeps
    ``zookeeper.connection.timeout.ms``. ``display`` adds the line as
    printed, with every ``=`` turned into ``': '``.
    """
    out = df.where(key_filter(F.col(col), prefixes, contains))
    if display:
        out = out.withColumn(display, F.replace(strip_ws(F.col(col)), F.lit("="), F.lit(": ")))
    return out


def filter_map_keys(df: DataFrame, col: str, prefixes: Sequence[str] = (),
                    contains: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Map form of C1: keep the entries whose key matches (``map_filter``)."""
    return df.withColumn(out or col,
                         F.map_filter(F.col(col), lambda k, v: key_filter(k, prefixes, contains)))


def classify(df: DataFrame, col: str, rules: Sequence[tuple[str, str]], default: str,
             out: str = "class", how: str = "prefix") -> DataFrame:
    """Ordered rules, first match wins (C2). ``how``: prefix, contains or equals."""
    test = {"prefix": lambda c, v: c.startswith(v),
            "contains": lambda c, v: c.contains(v),
            "equals": lambda c, v: c == v}[how]
    expr = None
    for pattern, label in rules:
        cond = test(F.col(col), pattern)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    expr = F.lit(default) if expr is None else expr.otherwise(F.lit(default))
    return df.withColumn(out, expr)


# Placeholder grammar of POSIX-style variable expansion
# (``$NAME`` with NAME of word characters, or anything inside ``${...}``).
PLACEHOLDER_RE = r"\$\w+|\$\{[^}]*\}"
TOKEN_RE = r"\$\w+|\$\{[^}]*\}|[^$]+|\$"


def _placeholder_name(tok: Column) -> Column:
    return F.regexp_replace(tok, r"^\$\{?|\}$", "")


def resolve_placeholders(df: DataFrame, col: str, vars_df: DataFrame,
                         keys: Sequence[str] = (), name: str = "name", value: str = "value",
                         out: str | None = None, row_id: str | None = None) -> DataFrame:
    """Replace ``$NAME`` / ``${NAME}`` from a variables table.

    ``vars_df`` holds ``(*keys, name, value)``: one environment per key (for
    example per allocation), or one for all without ``keys``; a name bound twice
    for one key takes the greatest value, NULL values count as unbound. Unknown
    names keep their text; a NULL text stays NULL.

    No environment is ever gathered: the names that a text uses are exploded
    once each and meet the variables in a join on the keys **and** the name, so
    a key that holds a third of all variables is spread over its names (AQE
    splits a name that very many texts use). What comes back per text is at most
    as long as its own placeholders, by ``row_id`` (a unique column) if there is
    one, so the texts move once, else by the keys and the text itself, so equal
    texts are resolved once.
    """
    out = out or col
    keys = list(keys)
    bound = vars_df.where(F.col(value).isNotNull() & F.col(name).isNotNull()) \
        .groupBy(*[F.col(k) for k in keys], F.col(name).alias("_rl_name")).agg(F.max(value).alias("_rl_value"))
    own = [row_id] if row_id else [*keys, col]
    names = F.array_distinct(F.transform(F.regexp_extract_all(F.col(col), F.lit(PLACEHOLDER_RE), 0), _placeholder_name))
    used = df.select(*dict.fromkeys([*own, *keys, col])).where(F.col(col).contains("$"))
    used = used if row_id else used.dropDuplicates(own)
    used = used.select(*dict.fromkeys([*own, *keys]), F.explode(names).alias("_rl_name"))
    env = join_on_keys(used, bound, [*keys, "_rl_name"]).groupBy(*own).agg(
        F.map_from_entries(F.collect_list(F.struct("_rl_name", "_rl_value"))).alias("_rl_env"))
    rows = join_on_keys(df, env, own, how="left")
    tokens = F.regexp_extract_all(F.col(col), F.lit(TOKEN_RE), 0)
    resolved = F.array_join(F.transform(tokens, lambda t: F.when(
        t.startswith("$") & (F.length(t) > 1),
        F.coalesce(F.try_element_at(F.col("_rl_env"), _placeholder_name(t)), t)).otherwise(t)), "")
    return rows.withColumn(out, F.when(F.col(col).isNotNull(), resolved)).drop("_rl_env")


def overlay_table(base: DataFrame, over: DataFrame, keys: Sequence[str],
                  flag: str | None = "from_over") -> DataFrame:
    """Base rows with same-keyed rows replaced and new rows added (O1).

    A full outer join on the keys; every non-key column takes the overlay's
    value when the key is present there (even if that value is NULL). NULL
    keys match each other.
    """
    keys = list(keys)
    cols = [c for c in base.columns if c not in keys]
    b = base.select(*[F.col(c).alias(f"_rl_b_{c}") for c in [*keys, *cols]])
    o = over.select(*[F.col(c).alias(f"_rl_o_{c}") for c in [*keys, *cols]], F.lit(True).alias("_rl_in_over"))
    j = b.join(o, on=[F.col(f"_rl_b_{k}").eqNullSafe(F.col(f"_rl_o_{k}")) for k in keys], how="full_outer")
    in_over = F.coalesce(F.col("_rl_in_over"), F.lit(False))
    sel = [F.when(in_over, F.col(f"_rl_o_{k}")).otherwise(F.col(f"_rl_b_{k}")).alias(k) for k in keys] + [F.when(in_over, F.col(f"_rl_o_{c}")).otherwise(F.col(f"_rl_b_{c}")).alias(c)
                     for c in cols]
    if flag:
        sel.append(in_over.alias(flag))
    return j.select(*sel)


def overlay_maps(base: Column, over: Column) -> Column:
    """Map form of O1: defaults in ``base``, keys of ``over`` win."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)
