"""Structured Streaming forms of the readiness operators (E1, E2) and traces."""

from runlens.streaming.readiness import (
    event_stream, latest_versions, run_update_stream, state_partitions, stream_first_outcome,
    stream_first_seen, stream_outcome_table, stream_barrier_table,
)

from runlens.streaming.deadline import (  # noqa: E402
    DeadlineBarrier, stream_deadline_barrier, stream_deadline_table,
)

from runlens.streaming.missing import stream_missing_phase, stream_missing_table  # noqa: E402
from runlens.streaming.outcome import (  # noqa: E402
    StateOutcome, stream_state_outcome, stream_state_outcome_table,
)

from runlens.streaming.fleet import (  # noqa: E402
    JobMerge, MemberBucket, stream_fleet_deadline, stream_fleet_deadline_table,
)

from runlens.streaming.phases import PhaseClock, stream_phase_durations, stream_phase_table  # noqa: E402

__all__ = [
    "PhaseClock", "stream_phase_durations", "stream_phase_table",
    "JobMerge", "MemberBucket", "stream_fleet_deadline", "stream_fleet_deadline_table",
    "StateOutcome", "stream_missing_phase", "stream_missing_table", "stream_state_outcome", "stream_state_outcome_table",
    "DeadlineBarrier", "stream_deadline_barrier", "stream_deadline_table",
    "event_stream", "latest_versions", "run_update_stream", "state_partitions", "stream_first_outcome",
    "stream_first_seen", "stream_outcome_table", "stream_barrier_table",
]
