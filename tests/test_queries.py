"""Every registered query against its independent DuckDB oracle (sf0.001),
plus the entry point and the skew-safe offset numbering."""

import pytest
from pyspark.sql import Window, functions as F

from scripts.check_oracles import compare
from tests.conftest import SF_SMALL

import __spark_entry__ as E
from lagscope.plans import catalog


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["name", "key", "group_id", "topic", "partition", "ts", "value"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_oracle(spark, name):
    res = compare(spark, SF_SMALL, [name], verbose=False)[name]
    assert res[0] is True, res


def test_numbering_with_a_hot_key(spark):
    """A key holding most rows is numbered like row_number(), without one
    task owning the key."""
    from lagscope.operators.sequence import number_within_key
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    base = ev.select(F.when(F.col("user_id") % 10 < 8, F.lit("hot")).otherwise(F.col("event_type"))
                     .alias("topic"), F.lit(0).alias("partition"), "ts", "event_id")
    got = number_within_key(base, ["topic", "partition"], ["ts", "event_id"], "offset")
    ref = base.withColumn("offset", F.row_number().over(
        Window.partitionBy("topic", "partition").orderBy("ts", "event_id")) - 1)
    assert got.exceptAll(ref.select(*got.columns)).count() == 0
    assert got.count() == ref.count()
    # the hot key really is spread over several range partitions
    spread = (base.repartitionByRange(8, "topic", "partition", "ts", "event_id")
              .where(F.col("topic") == "hot").select(F.spark_partition_id()).distinct().count())
    assert spread > 1


def test_whole_log_is_seen_whatever_its_span(spark):
    """Newest offsets at the last scrape add up to the events, also with a
    second copy of the log beyond day 30, and with no event at all."""
    from lagscope.plans.metrics import MetricsJob
    from lagscope.sources.fixtures import Fixture
    for sf in ("sf0.001", "sf0.01"):
        ev = spark.read.parquet(f"/root/testdata/{sf}/events.parquet")
        later = ev.withColumn("ts", F.col("ts") + F.expr("INTERVAL 40 DAYS"))
        for events in (ev, ev.unionByName(later)):
            fx = Fixture(spark, "", "H", events=events)
            tp = fx.topic_partitions
            last = tp.where(F.col("scrape_ts") == tp.agg(F.max("scrape_ts")).first()[0])
            assert last.agg(F.sum("newest_offset")).first()[0] == events.count()
            us = F.unix_micros(F.col("ts").cast("timestamp"))
            lo, hi = events.agg(F.min(us), F.max(us)).first()
            g = fx.grid
            assert g.t0 * 10**6 <= lo and g.t0 * 10**6 > lo - 3600 * 10**6
            assert (g.t0 + g.ticks * 3600) * 10**6 >= hi > (g.t0 + (g.ticks - 1) * 3600) * 10**6
    none = Fixture(spark, "", "H", events=ev.limit(0))
    assert none.grid.ticks == 0 and MetricsJob.from_fixture(none).metrics.count() == 0


@pytest.mark.parametrize("name", ["group_listing_union", "group_description_scan", "stable_consumer_filter"])
def test_groups_follow_the_events(spark, name):
    small, large = (catalog.queries()[name](spark, f"/root/testdata/{sf}") for sf in ("sf0.001", "sf0.01"))
    assert sorted(map(tuple, small.collect())) != sorted(map(tuple, large.collect()))


def test_offset_bounds_with_and_without_numbers(spark):
    from lagscope.operators import offsets as O
    from lagscope.sources.fixtures import Fixture
    fx = Fixture(spark, SF_SMALL, "H")
    assert sorted(map(tuple, O.offset_bounds(fx.records).collect())) == sorted(
        map(tuple, O.unnumbered_offset_bounds(fx.base).collect()))
