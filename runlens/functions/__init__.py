"""Column-level building blocks (pure native expressions, no UDFs)."""

from runlens.functions.columns import (
    after_first, after_last, before_first, bracket_job_id, decimal_or_null,
    HOSTLIST_ITEM_RE, expand_hostlist, expand_hostlist_item, expand_ranges, first_tokens, int_or_null, is_int_text, json_int, nonblank,
    strip_extension, strip_ws, WHITESPACE,
)
from runlens.functions.ordering import join_on_keys, with_group_position

__all__ = [
    "HOSTLIST_ITEM_RE", "after_first", "after_last", "before_first", "bracket_job_id", "decimal_or_null",
    "expand_hostlist", "expand_hostlist_item", "expand_ranges", "first_tokens", "int_or_null", "is_int_text", "json_int",
    "join_on_keys", "nonblank", "strip_extension", "strip_ws", "with_group_position", "WHITESPACE",
]
