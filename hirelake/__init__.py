"""hirelake: job-posting consolidation, entity resolution, filtering and tracking on Spark.

Every public operator takes and returns DataFrames and carries its parameters
explicitly; nothing is collected to the driver except documented small counts
(one number per partition, one number per round).
"""

from hirelake.session import build_session, checkpoint_root, cut_lineage

__all__ = ["build_session", "checkpoint_root", "cut_lineage"]
