"""lagscope: broker offset, consumer-lag and throughput metrics on Spark.

Inputs are snapshot tables (or streams) of partition state, consumer-group
membership and committed offsets; outputs are one long ``metrics`` table and
sink payloads rendered from it.  Everything is expressed with DataFrame
operators so Catalyst plans the work; the only Python in the hot path is the
per-key meter kernel run through ``applyInPandas`` / ``transformWithStateInPandas``.
"""

from lagscope.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
