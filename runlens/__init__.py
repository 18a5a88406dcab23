"""runlens: Spark operators for analysing fleets of cluster runs.

Every operator takes and returns a DataFrame, is grouped by a run or
allocation key, and is built from native Spark expressions, so a single
call covers many runs at once and the plan stays inside whole-stage codegen.
"""

from runlens.session import get_spark, shared_dir, scratch_path

__all__ = ["get_spark", "shared_dir", "scratch_path"]
