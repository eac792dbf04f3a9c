"""Input tables derived from the ``events`` table.

``events`` rows become log records (topic = event type, partition =
user_id % 4, offsets numbered in (ts, event_id) order).  Cluster state is then
observed on a tick grid (one scrape every ``interval`` seconds):

* ``topic_partitions``: per (topic, partition) present by tick k, the newest
  offset (records with ts <= t) and oldest retained offset (records with
  ts <= t - 7 days), plus replica / ISR / leader lists from a rule on k + p;
* ``group_listings``, ``group_descriptions``: consumer groups as the log shows
  them: a record is consumed by group (user_id div 4) % 5; a group is listed
  at the ticks that brought it records, by a broker per partition it read,
  and described with one member per partition, assigned the topics the group
  has read there so far; it is rebalancing at a tick that brings it a new
  (topic, partition);
* ``commits``: at those ticks a group commits, for each partition it is
  assigned, the newest offset of some ticks earlier (its number).

The grid covers the log: tick 0 is the interval that holds the first record,
the last tick the first one that sees the last record.  Newest/oldest counts
are built by bucketing each record to the first tick that sees it,
aggregating per (group, series, tick) map-side, then a running sum per
series; ticks without new records are filled by expanding each aggregated
row over the ticks until the next one.  Records are never joined to ticks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lagscope.operators.sequence import number_within_key
from lagscope.session import checkpoint_dir

# ---------------------------------------------------------------------------
# Fixed values of the fixture definition.
# ---------------------------------------------------------------------------
RETENTION_SECONDS = 7 * 86400   # oldest offset = first record younger than 7 days
PARTITIONS_PER_TOPIC = 4        # partition = user_id % 4
PRODUCE_PHASE_SECONDS = 30      # produce ticks sit 30 s after scrape ticks
GROUPS = 5                      # group = (user_id div 4) % 5
CONNECT_GROUP = 4               # speaks the connect protocol, the others consumer
BROKERS = 3                     # partition p is listed by broker p % 3 + 1
INTERVALS = {"H": 3600, "M": 60}   # seconds between scrapes
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Grid:
    name: str
    interval: int      # seconds between scrapes
    ticks: int         # scrapes k = 1..ticks at t0 + k * interval
    t0: int            # tick 0

    def scrape_seconds(self, k: Column) -> Column:
        return F.lit(self.t0) + k * F.lit(self.interval)

    @staticmethod
    def over(events: DataFrame, name: str) -> "Grid":
        """The grid that covers every record; without records it has no tick."""
        iv = INTERVALS[name]
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        lo, hi = events.agg(F.min(us), F.max(us)).first()
        if lo is None:
            return Grid(name, iv, 0, 0)
        t0 = lo // (iv * 1_000_000) * iv
        return Grid(name, iv, max(1, -((t0 * 1_000_000 - hi) // (iv * 1_000_000))), t0)


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def record_base(events: DataFrame) -> DataFrame:
    """(topic, partition, timestamp, event_id, group_id) per event: the log
    before numbering."""
    return events.select(
        F.col("event_type").alias("topic"),
        (F.col("user_id") % PARTITIONS_PER_TOPIC).cast("int").alias("partition"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_id"),
        F.concat(F.lit("g"), F.floor(F.col("user_id") / PARTITIONS_PER_TOPIC) % GROUPS).alias("group_id"),
    )


def build_records(events: DataFrame) -> DataFrame:
    """``records(topic, partition, offset, timestamp)`` with offsets 0, 1, ..."""
    numbered = number_within_key(record_base(events), ["topic", "partition"],
                                 ["timestamp", "event_id"], "offset")
    return numbered.select("topic", "partition", "offset", "timestamp")


def build_series_counts(base: DataFrame, grid: Grid) -> DataFrame:
    """Per (group, topic, partition, tick k): records first seen at k (``dn``)
    and records leaving the 7-day retention at k (``do``).  At most series ×
    groups × ticks rows whatever the log size; it is the only pass over the
    raw log.  Records that outlive the grid leave no ``do`` inside it.

    Records are counted once, by the interval that holds them; as the retention
    is a number of intervals, both ticks of a record follow from it, so only
    the counts are doubled."""
    kept, odd = divmod(RETENTION_SECONDS, grid.interval)
    assert not odd, "the retention is a whole number of intervals"
    # smallest k with t0 + k * interval >= ts
    at = F.ceil((F.unix_micros("timestamp") - F.lit(grid.t0 * 1_000_000)) / F.lit(grid.interval * 1_000_000))
    # map-side partial aggregation: the shuffle carries (series, interval) counts
    counts = (base.select("group_id", "topic", "partition", at.alias("at"))
              .groupBy("group_id", "topic", "partition", "at").agg(F.count(F.lit(1)).alias("n")))
    none = F.lit(0).cast("bigint")
    marks = counts.select("group_id", "topic", "partition", F.explode(F.array(
        F.struct(F.greatest("at", F.lit(1)).alias("k"), F.col("n").alias("dn"), none.alias("do")),
        F.struct(F.greatest(F.col("at") + F.lit(kept), F.lit(1)).alias("k"), none.alias("dn"), F.col("n").alias("do")),
    )).alias("m")).select("group_id", "topic", "partition", "m.*")
    return (marks.where((F.col("dn") > 0) | (F.col("k") <= grid.ticks))
            .groupBy("group_id", "topic", "partition", "k").agg(
                F.sum("dn").alias("dn"), F.sum("do").alias("do")))


def topic_partitions_from_counts(counts: DataFrame, grid: Grid) -> DataFrame:
    """Running sums per series over its (small) count rows; each row then
    covers the ticks up to the series' next row."""
    counts = counts.groupBy("topic", "partition", "k").agg(
        F.sum("dn").alias("dn"), F.sum("do").alias("do"))
    w = Window.partitionBy("topic", "partition").orderBy("k")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.select(
        "topic", "partition", "k",
        F.sum("dn").over(run).alias("newest_offset"),
        F.sum("do").over(run).alias("oldest_offset"),
        F.coalesce(F.lead("k").over(w), F.lit(grid.ticks + 1)).alias("k_next"),
    )
    filled = cum.select(
        "topic", "partition", "newest_offset", "oldest_offset",
        F.explode(F.sequence(F.col("k"), F.col("k_next") - 1)).alias("k"),
    )
    return with_replica_state(filled, grid)


def with_replica_state(df: DataFrame, grid: Grid) -> DataFrame:
    """Replica, ISR and leader columns from the (k + partition) rule."""
    p = F.col("partition")
    kp = F.col("k") + p
    replicas = F.array((p % 3 + 1).cast("int"), ((p + 1) % 3 + 1).cast("int"))
    leader = (F.when(kp % 13 == 0, F.lit(None).cast("int"))
              .when(kp % 11 == 0, replicas[1])
              .otherwise(replicas[0]))
    isr = F.when(kp % 7 == 0, F.array(replicas[0])).otherwise(replicas)
    return df.select(
        F.timestamp_seconds(grid.scrape_seconds(F.col("k"))).alias("scrape_ts"),
        "topic", "partition",
        F.col("oldest_offset").cast("bigint").alias("oldest_offset"),
        F.col("newest_offset").cast("bigint").alias("newest_offset"),
        leader.alias("leader_id"), replicas.alias("replicas"), isr.alias("isr"),
    )


def _scrape_ts(grid: Grid) -> Column:
    return F.timestamp_seconds(grid.scrape_seconds(F.col("k"))).alias("scrape_ts")


def _group_number() -> Column:
    return F.substring("group_id", 2, 9).cast("int")


def _protocol() -> Column:
    return F.when(_group_number() == CONNECT_GROUP, F.lit("connect")).otherwise(F.lit("consumer"))


def build_group_listings(counts: DataFrame, grid: Grid) -> DataFrame:
    """A group is listed at the ticks that brought it records, once by each
    broker that holds one of the partitions it read."""
    return (counts.where(F.col("dn") > 0)
            .select(_scrape_ts(grid), (F.col("partition") % BROKERS + 1).cast("int").alias("broker_id"),
                    "group_id", _protocol().alias("protocol_type")).distinct())


def _assigned(counts: DataFrame, grid: Grid) -> DataFrame:
    """(group_id, k, topic, partition, new): what a group listed at k has read
    by then; groups × ticks × partitions rows at most. A (group, topic,
    partition) is expanded over the ticks from its first one on and meets the
    group's ticks on (group, k), so no group is one key."""
    seen = counts.where(F.col("dn") > 0)
    active = seen.select("group_id", F.col("k").cast("bigint").alias("k")).distinct()
    read = seen.groupBy("group_id", "topic", "partition").agg(F.min("k").cast("bigint").alias("since"))
    ticks = F.sequence(F.col("since"), F.greatest(F.col("since"), F.lit(grid.ticks).cast("bigint")))
    return (read.withColumn("k", F.explode(ticks)).join(active, ["group_id", "k"])
            .select("group_id", "k", "topic", "partition", (F.col("since") == F.col("k")).alias("new")))


def build_group_descriptions(counts: DataFrame, grid: Grid) -> DataFrame:
    """One row per listed group and tick; what is collected is one member's
    topics, then one group's members, the contents of that row."""
    member = (_assigned(counts, grid).groupBy("group_id", "k", "partition")
              .agg(F.array_sort(F.collect_list("topic")).alias("topics"), F.max("new").alias("new")))
    group = member.groupBy("group_id", "k").agg(
        F.array_sort(F.collect_list(F.struct("partition", "topics"))).alias("members"), F.max("new").alias("new"))
    member_of = lambda m: F.struct(
        F.concat_ws("-", F.col("group_id"), F.concat(F.lit("m"), m["partition"])).alias("member_id"),
        F.concat(F.lit("client-m"), m["partition"]).alias("client_id"), F.lit("/127.0.0.1").alias("client_host"),
        F.map_from_arrays(m["topics"], F.array_repeat(F.array(m["partition"]), F.size(m["topics"])))
        .alias("assignment"))
    return group.select(
        _scrape_ts(grid), "group_id",
        F.when(F.col("new"), F.lit("PreparingRebalance")).otherwise(F.lit("Stable")).alias("state"),
        _protocol().alias("protocol_type"), F.transform("members", member_of).alias("members"))


def build_commits(counts: DataFrame, grid: Grid, topic_partitions: DataFrame) -> DataFrame:
    """At each tick it is listed, a group commits the newest offset seen its
    number of ticks earlier (none where the partition had no records yet)."""
    asked = _assigned(counts, grid).select(
        _scrape_ts(grid).alias("commit_ts"), "group_id", "topic", "partition",
        F.timestamp_seconds(grid.scrape_seconds(F.col("k") - _group_number())).alias("src_ts"))
    newest = topic_partitions.select(
        F.col("scrape_ts").alias("src_ts"), "topic", "partition",
        F.col("newest_offset").alias("offset"))
    return asked.join(newest, ["src_ts", "topic", "partition"]).select(
        "commit_ts", "group_id", "topic", "partition", "offset")


class Fixture:
    """All input tables for one scale-factor directory and tick grid."""

    def __init__(self, spark: SparkSession, sf_dir: str, grid: str = "H", events: DataFrame | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.grid_name = grid
        if events is not None:
            self.events = events

    @cached_property
    def grid(self) -> Grid:
        return Grid.over(self.events, self.grid_name)

    @cached_property
    def events(self) -> DataFrame:
        return load_events(self.spark, self.sf_dir)

    @cached_property
    def base(self) -> DataFrame:
        return record_base(self.events)

    @cached_property
    def records(self) -> DataFrame:
        return build_records(self.events)

    @cached_property
    def series_counts(self) -> DataFrame:
        """The single aggregation pass over the log, written once to the
        shared checkpoint folder; every derived table reads it from there."""
        checkpoint_dir(self.spark)
        return build_series_counts(self.base, self.grid).checkpoint(eager=True)

    @cached_property
    def topic_partitions(self) -> DataFrame:
        return topic_partitions_from_counts(self.series_counts, self.grid)

    @cached_property
    def group_listings(self) -> DataFrame:
        return build_group_listings(self.series_counts, self.grid)

    @cached_property
    def group_descriptions(self) -> DataFrame:
        return build_group_descriptions(self.series_counts, self.grid)

    @cached_property
    def commits(self) -> DataFrame:
        return build_commits(self.series_counts, self.grid, self.topic_partitions)
