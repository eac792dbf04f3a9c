"""Partition and topic gauges.

All seven per-partition gauges come from one scan of ``topic_partitions``:
each row is turned wide→long with a single ``explode(array(struct...))``,
and the leader element is dropped where no leader exists.  The partition
count per topic is the one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lagscope import schemas as S
from lagscope.functions.columns import meta, metric_key


def _replicas() -> Column:
    # size(null) is null under ANSI; a missing list counts as empty
    return F.size(F.coalesce(F.col("replicas"), F.array().cast("array<int>")))


def _isr() -> Column:
    return F.size(F.coalesce(F.col("isr"), F.array().cast("array<int>")))


def leader_present() -> Column:
    """``leader_present_filter``: a leader gauge exists only when a leader does."""
    return F.col("leader_id").isNotNull()


def leader_is_preferred() -> Column:
    # get() returns null past the end instead of raising under ANSI
    return (F.when(F.col("leader_id").isNotNull()
                   & (F.get(F.col("replicas"), 0) == F.col("leader_id")), 1)
            .otherwise(0).cast("bigint"))


def under_replicated() -> Column:
    # on the raw lists: a null list makes the comparison null, hence 0
    return (F.when(F.size("isr") < F.size("replicas"), 1).otherwise(0).cast("bigint"))


def partition_gauge_values() -> dict[str, Column]:
    """Gauge name → value expression over one ``topic_partitions`` row."""
    return {
        S.OFFSET_NEWEST: F.col("newest_offset").cast("bigint"),
        S.OFFSET_OLDEST: F.col("oldest_offset").cast("bigint"),
        S.LEADER: F.col("leader_id").cast("bigint"),
        S.REPLICAS: _replicas().cast("bigint"),
        S.IN_SYNC_REPLICAS: _isr().cast("bigint"),
        S.LEADER_IS_PREFERRED: leader_is_preferred(),
        S.UNDER_REPLICATED: under_replicated(),
    }


def _gauge_rows(df: DataFrame, name_col: Column, value_col: Column,
                group=None, partition=None, topic=None, key_parts=()) -> DataFrame:
    return df.select(
        F.lit("gauge").alias("kind"),
        name_col.alias("name"),
        metric_key(*key_parts).alias("key"),
        F.col("scrape_ts").alias("timestamp"),
        meta(group=group, partition=partition, topic=topic).alias("meta"),
        value_col.alias("value"),
    )


def single_partition_gauge(tp: DataFrame, name: str) -> DataFrame:
    """One gauge in long form (e.g. ``offset_newest_gauge``)."""
    value = partition_gauge_values()[name]
    src = tp.where(leader_present()) if name == S.LEADER else tp
    return _gauge_rows(src, F.lit(name), value, partition="partition", topic="topic",
                       key_parts=("topic", "partition"))


def partition_gauges(tp: DataFrame) -> DataFrame:
    """``metric_projection``: all per-partition gauges, long form, one scan."""
    vals = partition_gauge_values()
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in vals.items()])
    exploded = tp.select("scrape_ts", "topic", "partition", F.explode(pairs).alias("g"))
    # the leader element is null exactly when there is no leader
    exploded = exploded.where(F.col("g.value").isNotNull())
    return _gauge_rows(exploded, F.col("g.name"), F.col("g.value"), partition="partition",
                       topic="topic", key_parts=("topic", "partition"))


def topic_partition_gauge(tp: DataFrame) -> DataFrame:
    """Number of partitions per topic at each scrape."""
    counts = tp.groupBy("scrape_ts", "topic").agg(F.count(F.lit(1)).alias("n"))
    return _gauge_rows(counts, F.lit(S.TOPIC_PARTITION), F.col("n").cast("bigint"),
                       topic="topic", key_parts=("topic",))
