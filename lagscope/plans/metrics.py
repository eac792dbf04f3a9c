"""End-to-end batch plan: input tables → long ``metrics`` table.

``MetricsJob`` holds the lazily built DataFrames of one run so that a caller
asking for several outputs shares sub-plans (Spark reuses identical
exchanges inside one query; separate actions re-read the inputs).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from lagscope import schemas as S
from lagscope.operators import gauges as G, groups as GR, meters as M, snapshot as SN
from lagscope.operators.meters import ProduceGrid
from lagscope.session import checkpoint_dir
from lagscope.sources.fixtures import Fixture, PRODUCE_PHASE_SECONDS


class MetricsJob:
    def __init__(self, topic_partitions: DataFrame, group_listings: DataFrame,
                 group_descriptions: DataFrame, commits: DataFrame, produce: ProduceGrid,
                 commits_asof: bool = True):
        self.tp = topic_partitions
        self.listings = group_listings
        self.descriptions = group_descriptions
        self.commits = commits
        self.produce = produce
        self.commits_asof = commits_asof

    @classmethod
    def from_fixture(cls, fx: Fixture) -> "MetricsJob":
        g = fx.grid
        produce = ProduceGrid(g.t0 + PRODUCE_PHASE_SECONDS + g.interval, g.interval, g.ticks)
        return cls(fx.topic_partitions, fx.group_listings, fx.group_descriptions, fx.commits, produce)

    # --- gauges at scrape time -------------------------------------------------
    @cached_property
    def partition_gauges(self) -> DataFrame:
        return G.partition_gauges(self.tp)

    @cached_property
    def topic_gauge(self) -> DataFrame:
        return G.topic_partition_gauge(self.tp)

    @cached_property
    def assigned(self) -> DataFrame:
        return GR.assigned_partitions(self.listings, self.descriptions)

    @cached_property
    def committed(self) -> DataFrame:
        """Committed offset per scrape and assigned partition (scrapes ×
        assigned partitions rows).  Written once to the checkpoint folder:
        the group gauges and the group meter both read it."""
        if self.commits_asof:
            df = GR.committed_offset_scan(self.assigned, self.commits)
        else:
            df = GR.group_assignment_join(self.assigned, self.commits)
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)

    @cached_property
    def lags(self) -> DataFrame:
        return GR.lag_rows(self.committed, self.tp)

    @cached_property
    def group_gauges(self) -> DataFrame:
        return GR.group_gauges(self.lags)

    @cached_property
    def gauges(self) -> DataFrame:
        """All ten gauges, long form, at scrape time."""
        return self.topic_gauge.unionByName(self.partition_gauges).unionByName(self.group_gauges)

    # --- meters at produce time ----------------------------------------------
    @cached_property
    def topic_meter(self) -> DataFrame:
        return M.topic_rate_meter(self.tp, self.produce)

    @cached_property
    def group_meter(self) -> DataFrame:
        return M.consumer_group_rate_meter(self.committed, self.produce)

    @cached_property
    def meters(self) -> DataFrame:
        return self.topic_meter.unionByName(self.group_meter)

    # --- registry snapshots -----------------------------------------------------
    @cached_property
    def gauge_snapshot(self) -> DataFrame:
        """``snapshot_asof`` of all gauges, carried on the wide rows they come from."""
        topics = self.tp.groupBy("scrape_ts", "topic").agg(F.count(F.lit(1)).alias("n"))
        partition = ["topic", "partition"]
        return (SN.carry(topics, ["topic"], {"topic": "topic"}, {S.TOPIC_PARTITION: F.col("n")}, self.produce)
                .unionByName(SN.carry(self.tp, partition, {c: c for c in partition},
                                      G.partition_gauge_values(), self.produce))
                .unionByName(SN.carry(self.lags, ["group_id", *partition],
                                      {"group": "group_id", **{c: c for c in partition}},
                                      GR.group_gauge_values(), self.produce)))

    @cached_property
    def metrics(self) -> DataFrame:
        """The ``metrics`` table: every series at every produce instant."""
        return SN.snapshot_union(self.gauge_snapshot, self.meters)
