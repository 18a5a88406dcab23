"""DataFrame -> DataFrame operators, each grouped by a run or allocation key."""

from runlens.operators.config import (
    classify, filter_keys, filter_map_keys, overlay_maps, overlay_table, read_key_values,
    resolve_placeholders,
)
from runlens.operators.hosts import (
    apply_defaults, assign_ids, distinct_hosts, expand_hostlist, expand_slots, first_present,
    node_count,
)
from runlens.operators.readiness import (
    barrier_within_deadline, first_outcome, first_seen, readiness_barrier, state_outcome,
    within_deadline,
)
from runlens.operators.recency import latest_by_prefix, newest, phase_durations
from runlens.operators.stats import run_stats, scaling_ratio
from runlens.operators.sweep import expand_grid, missing_cells, missing_phase, missing_runs, sweep_grid
from runlens.operators.text import derive_fields, extract_all, extract_first, json_int, last_match_value

__all__ = [
    "apply_defaults", "assign_ids", "barrier_within_deadline", "classify", "derive_fields", "distinct_hosts", "expand_grid",
    "expand_hostlist", "expand_slots", "extract_all", "extract_first", "filter_keys",
    "filter_map_keys", "first_outcome", "first_present", "first_seen", "json_int",
    "last_match_value", "latest_by_prefix", "missing_cells", "missing_phase", "missing_runs", "newest", "node_count",
    "overlay_maps", "overlay_table", "phase_durations", "read_key_values", "readiness_barrier",
    "resolve_placeholders", "run_stats", "scaling_ratio", "state_outcome", "sweep_grid", "within_deadline",
]
