"""Change-point snapshots: each series as intervals of unchanged value.

A series that reports the same value at a thousand scrapes is one row, so the
table grows with changes, not with series x instants. ``value`` stands from
``from_us`` (included) to ``to_us`` (excluded; null: still standing), in
microseconds of the epoch. Intervals of a series do not overlap and leave no
gap, as a series that was seen once is reported for ever.

``asof`` answers any set of instants. Instants are grouped into time buckets,
and an interval meets only the buckets that hold instants, through an
equi-join on the bucket; ``append`` adds a later stretch of observations by
reading the open intervals alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SERIES = ["name", "group_id", "topic", "partition"]


def observations(gauges: DataFrame) -> DataFrame:
    """Long gauge rows as ``(series, key, us, value)``."""
    return gauges.select("name", F.col("meta.group").alias("group_id"), F.col("meta.topic").alias("topic"),
                         F.col("meta.partition").alias("partition"), "key",
                         F.unix_micros("timestamp").alias("us"), "value")


def change_points(obs: DataFrame) -> DataFrame:
    """``(series, key, value, from_us, to_us)``. Of several observations of one
    series and instant the largest value counts. One shuffle by series: the
    values of the scrapes before and after are read in one sort order."""
    one = obs.groupBy(*SERIES, "key", "us").agg(F.max("value").alias("value"))
    w = Window.partitionBy(*SERIES).orderBy("us")
    new = one.withColumn("before", F.lag("value").over(w)).where(
        F.col("before").isNull() | (F.col("value") != F.col("before")))
    return new.select(*SERIES, "key", "value", F.col("us").alias("from_us"), F.lead("us").over(w).alias("to_us"))


def append(intervals: DataFrame, later: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(closed, open)``: intervals that are over and those still standing
    after ``later`` observations (none before the last one known). Closed
    intervals of ``intervals`` are not read: the caller keeps them."""
    standing = intervals.where(F.col("to_us").isNull()).select(*SERIES, "key", F.col("from_us").alias("us"), "value")
    merged = change_points(standing.unionByName(later.select(standing.columns)))
    return merged.where(F.col("to_us").isNotNull()), merged.where(F.col("to_us").isNull())


def _bucket(us: Column, width_us: int) -> Column:
    return F.floor(us / width_us)


def asof(intervals: DataFrame, instants: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """``(series, key, value, us)`` at every instant (``us``) from a series'
    first observation on.

    The buckets that hold instants are one row each; an interval is joined
    to those between its ends: buckets are numbered densely, so an interval's
    buckets are a sequence whatever gaps lie between the instants."""
    width = bucket_seconds * 1_000_000
    at = instants.select(F.col("us").cast("bigint").alias("us")).distinct().withColumn("b", _bucket(F.col("us"), width))
    # few rows: one per bucket with instants
    held = at.groupBy("b").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    first, last = at.agg(F.min("b"), F.max("b")).first()
    if first is None:
        return intervals.select(*SERIES, "key", "value", F.col("from_us").alias("us")).limit(0)
    spread = (intervals.where((_bucket(F.col("from_us"), width) <= last)
                              & (F.col("to_us").isNull() | (F.col("to_us") > first * width)))
              .withColumn("b", F.explode(F.sequence(
                  F.greatest(_bucket(F.col("from_us"), width), F.lit(first)),
                  F.least(F.coalesce(_bucket(F.col("to_us"), width), F.lit(last)), F.lit(last))))))
    near = spread.join(held, "b").where((F.col("from_us") <= F.col("hi"))
                                        & (F.col("to_us").isNull() | (F.col("to_us") > F.col("lo"))))
    return (near.drop("lo", "hi").join(at, "b")
            .where((F.col("from_us") <= F.col("us")) & (F.col("to_us").isNull() | (F.col("us") < F.col("to_us"))))
            .select(*SERIES, "key", "value", "us"))
