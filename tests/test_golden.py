"""Golden rows: the reference's two scrape tests (G1, G2) and the cases it
leaves untested (G3)."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from lagscope import schemas as S
from lagscope.operators import gauges as G, groups as GR

T0 = datetime(2024, 1, 1, 0, 1, tzinfo=timezone.utc)


def tp_frame(spark, rows):
    return spark.createDataFrame([(T0, *r) for r in rows], S.TOPIC_PARTITIONS)


def values(df):
    return {(r["name"], r["key"]): r["value"] for r in df.collect()}


def test_g1_partition_gauges(spark):
    tp = tp_frame(spark, [("my_topic", 0, 0, 1, 1, [1], [1]), ("my_topic", 1, 0, 2, 1, [1], [1])])
    got = values(G.partition_gauges(tp).unionByName(G.topic_partition_gauge(tp)))
    assert got[(S.TOPIC_PARTITION, "my_topic")] == 2
    for p, newest in ((0, 1), (1, 2)):
        k = f"my_topic-{p}"
        assert got[(S.OFFSET_NEWEST, k)] == newest
        assert got[(S.OFFSET_OLDEST, k)] == 0
        assert got[(S.LEADER, k)] == 1
        assert got[(S.REPLICAS, k)] == 1
        assert got[(S.IN_SYNC_REPLICAS, k)] == 1
        assert got[(S.LEADER_IS_PREFERRED, k)] == 1
        assert got[(S.UNDER_REPLICATED, k)] == 0
    assert len(got) == 1 + 2 * 7


def _groups(spark, members, state="Stable", protocol="consumer", group="my_group"):
    listings = spark.createDataFrame([(T0, 1, group, protocol)], S.GROUP_LISTINGS)
    mem = [(f"m{i}", "c", "/h", a) for i, a in enumerate(members)]
    desc = spark.createDataFrame([(T0, group, state, protocol, mem)], S.GROUP_DESCRIPTIONS)
    return listings, desc


def _lags(spark, members, commits, tp_rows, **kw):
    listings, desc = _groups(spark, members, **kw)
    assigned = GR.assigned_partitions(listings, desc)
    c = spark.createDataFrame([(T0, *r) for r in commits], S.COMMITS)
    committed = GR.committed_offset_scan(assigned, c)
    return GR.lag_rows(committed, tp_frame(spark, tp_rows))


def test_g2_group_gauges(spark):
    lags = _lags(spark, [{"my_topic": [0, 1]}],
                 [("my_group", "my_topic", 0, 0), ("my_group", "my_topic", 1, 1)],
                 [("my_topic", 0, 0, 1, 1, [1], [1]), ("my_topic", 1, 0, 2, 1, [1], [1])])
    got = values(GR.group_gauges(lags))
    assert got == {
        (S.GROUP_LAG, "my_group-my_topic-0"): 1, (S.GROUP_LAG, "my_group-my_topic-1"): 1,
        (S.GROUP_LATEST_OFFSET, "my_group-my_topic-0"): 0,
        (S.GROUP_LATEST_OFFSET, "my_group-my_topic-1"): 1,
    }


def test_g3_no_leader_not_preferred_under_replicated_empty(spark):
    tp = tp_frame(spark, [
        ("t", 0, 0, 5, None, [1, 2], [1, 2]),      # no leader
        ("t", 1, 0, 5, 2, [1, 2], [1, 2]),         # leader not preferred
        ("t", 2, 0, 5, 1, [1, 2, 3], [1]),         # under-replicated
        ("t", 3, 0, 5, 1, [], []),                 # empty lists
        ("t", 4, 0, 5, 1, None, None),             # missing lists
    ])
    got = values(G.partition_gauges(tp))
    assert (S.LEADER, "t-0") not in got
    assert got[(S.LEADER_IS_PREFERRED, "t-0")] == 0
    assert got[(S.UNDER_REPLICATED, "t-0")] == 0
    assert got[(S.LEADER_IS_PREFERRED, "t-1")] == 0
    assert got[(S.UNDER_REPLICATED, "t-2")] == 1
    assert got[(S.REPLICAS, "t-3")] == 0 and got[(S.IN_SYNC_REPLICAS, "t-3")] == 0
    assert got[(S.LEADER_IS_PREFERRED, "t-3")] == 0 and got[(S.UNDER_REPLICATED, "t-3")] == 0
    assert got[(S.REPLICAS, "t-4")] == 0 and got[(S.UNDER_REPLICATED, "t-4")] == 0
    assert got[(S.LEADER, "t-4")] == 1


def test_g3_never_committed_and_unknown_topic(spark):
    lags = _lags(spark, [{"t": [0], "ghost": [0]}], [("my_group", "ghost", 0, 42)],
                 [("t", 0, 0, 10, 1, [1], [1])])
    got = {(r["topic"], r["partition"]): (r["committed"], r["lag"]) for r in lags.collect()}
    assert got[("t", 0)] == (-1, 11)
    assert got[("ghost", 0)] == (42, -42)


def test_g3_unstable_and_non_consumer_groups_emit_nothing(spark):
    tp = [("t", 0, 0, 10, 1, [1], [1])]
    assert _lags(spark, [{"t": [0]}], [], tp, state="PreparingRebalance").count() == 0
    assert _lags(spark, [{"t": [0]}], [], tp, protocol="connect").count() == 0


def test_g3_overlapping_members_collapse(spark):
    listings, desc = _groups(spark, [{"t": [0, 1]}, {"t": [1, 2]}])
    parts = sorted(r["partition"] for r in GR.assigned_partitions(listings, desc).collect())
    assert parts == [0, 1, 2]


def test_duplicate_listing_described_once(spark):
    listings = spark.createDataFrame([(T0, 1, "g", "consumer"), (T0, 2, "g", "consumer")],
                                     S.GROUP_LISTINGS)
    desc = spark.createDataFrame([(T0, "g", "Stable", "consumer", [("m", "c", "/h", {"t": [0]})])],
                                 S.GROUP_DESCRIPTIONS)
    assert GR.group_description_scan(listings, desc).count() == 1


def test_asof_commit_picks_latest_before_scrape(spark):
    from datetime import timedelta
    listings, desc = _groups(spark, [{"t": [0]}])
    c = spark.createDataFrame([
        (T0 - timedelta(seconds=30), "my_group", "t", 0, 5),
        (T0, "my_group", "t", 0, 7),                       # same instant: visible
        (T0 + timedelta(seconds=1), "my_group", "t", 0, 9),  # after: not visible
    ], S.COMMITS)
    got = GR.committed_offset_scan(GR.assigned_partitions(listings, desc), c).collect()
    assert [r["committed"] for r in got] == [7]


def test_fixture_checksums_sf0001(spark):
    """FIXTURES.md checksums for grid H at sf0.001."""
    from lagscope.plans.metrics import MetricsJob
    from lagscope.sources.fixtures import Fixture
    fx = Fixture(spark, "/root/testdata/sf0.001", "H")
    k = (F.unix_seconds("scrape_ts") - 1704067200) / 3600
    r = fx.topic_partitions.agg(F.count("*"), F.sum("newest_offset"), F.sum("oldest_offset"),
                                F.sum(F.col("newest_offset") * k).cast("bigint")).first()
    assert tuple(r) == (14099, 372329, 222218, 178001101)
    listed = fx.group_listings.select("scrape_ts", "group_id").distinct()
    seen = fx.events.select(F.ceil((F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200 + F.lit(1e-7)) / 3600),
                            F.floor(F.col("user_id") / 4) % 5).distinct()
    assert abs(listed.count() - seen.count()) <= 2     # records on the very tick
    lags = MetricsJob.from_fixture(fx).lags
    assert lags.count() == 14000


def test_bucketed_asof_matches_brute_force(spark):
    """Random commit/scrape times on one hot partition and a few cold ones."""
    import random
    from datetime import timedelta
    rng = random.Random(7)
    commits, scrapes = [], []
    for p in range(4):
        n = 400 if p == 0 else 5            # partition 0 holds most commits
        for _ in range(n):
            commits.append((T0 + timedelta(seconds=rng.randint(0, 3000)), "g", "t", p,
                            rng.randint(0, 10_000)))
        for _ in range(30):
            scrapes.append((T0 + timedelta(seconds=rng.randint(-100, 3100)), "g", "t", p))
    scrapes = list(set(scrapes))
    a = spark.createDataFrame(scrapes, "scrape_ts timestamp, group_id string, topic string, partition int")
    c = spark.createDataFrame(commits, S.COMMITS)
    got = {(r["scrape_ts"], r["partition"]): r["committed"]
           for r in GR.committed_offset_scan(a, c, bucket_seconds=60).collect()}
    for ts, _g, _t, p in scrapes:
        seen = [(ct, o) for ct, _, _, cp, o in commits if cp == p and ct <= ts]
        # equal commit times: the larger offset
        want = max(seen)[1] if seen else -1
        key = (ts.replace(tzinfo=None), p)
        assert got[key] == want, (ts, p)


def test_equal_commit_times_have_one_answer(spark):
    listings, desc = _groups(spark, [{"t": [0]}])
    assigned = GR.assigned_partitions(listings, desc)
    rows = [(T0, "my_group", "t", 0, 5), (T0, "my_group", "t", 0, 9), (T0, "my_group", "t", 0, 7)]
    for some in (rows, rows[::-1]):
        c = spark.createDataFrame(some, S.COMMITS)
        for scan in (GR.committed_offset_scan, GR.group_assignment_join):
            assert [r["committed"] for r in scan(assigned, c).collect()] == [9]


def test_failure_semantics_negative_delta_and_vanished_series(spark):
    """Topic recreated (offsets drop): negative delta, count goes down.
    Topic vanishes: its gauges keep their last value at later instants."""
    from datetime import timedelta
    from lagscope.operators import meters as M, snapshot as SN
    rows = []
    for i, newest in enumerate([100, 160, 20]):          # recreated at scrape 2
        rows.append((T0 + timedelta(minutes=i), "t", 0, 0, newest, 1, [1], [1]))
    rows.append((T0, "gone", 0, 0, 5, 1, [1], [1]))     # seen once, then vanishes
    tp = spark.createDataFrame(rows, S.TOPIC_PARTITIONS)
    d = {r["scrape_ts"]: r["delta"] for r in
         M.offset_delta(M.topic_offset_sum(tp), M.TOPIC_KEYS).where("topic = 't'").collect()}
    assert sorted(d.values()) == [-140, 60]
    grid = M.ProduceGrid(int(T0.timestamp()) + 30, 60, 5)
    snap = SN.snapshot_asof(G.partition_gauges(tp), grid)
    gone = snap.where("key = 'gone-0' and name = 'kafka_topic_partition_offset_newest'")
    assert sorted(r["value"] for r in gone.collect()) == [5] * 5
    meter = M.meter_snapshots(M.offset_delta(M.topic_offset_sum(tp), M.TOPIC_KEYS), M.TOPIC_KEYS, grid)
    counts = [r["count"] for r in meter.where("topic = 't'").orderBy("produce_ts").collect()]
    assert counts[:2] == [60, -80]


def test_property_lag_plus_committed_is_newest(spark):
    from lagscope.plans.metrics import MetricsJob
    from lagscope.sources.fixtures import Fixture
    job = MetricsJob.from_fixture(Fixture(spark, "/root/testdata/sf0.001", "H"))
    tp = job.tp.select("scrape_ts", "topic", "partition", "newest_offset")
    j = job.lags.join(tp, ["scrape_ts", "topic", "partition"], "left")
    bad = j.where(F.col("lag") + F.col("committed") != F.coalesce("newest_offset", F.lit(0)))
    assert bad.count() == 0


def test_gauges_carried_on_wide_rows_equal_the_asof_of_each_series(spark):
    from lagscope.operators import snapshot as SN
    from lagscope.plans.metrics import MetricsJob
    from lagscope.sources.fixtures import Fixture
    job = MetricsJob.from_fixture(Fixture(spark, "/root/testdata/sf0.001", "H"))
    cols = ["kind", "name", "key", "timestamp", "meta", "value"]
    wide = job.gauge_snapshot.select(*cols)
    each = SN.snapshot_asof(job.gauges, job.produce).select(*cols)
    assert wide.exceptAll(each).count() == each.exceptAll(wide).count() == 0
    assert each.where(F.col("name") == S.LEADER).count() > 0


def test_property_snapshots_never_lose_a_series(spark):
    """Every series is reported at every produce instant from its first
    observation to the end of the grid."""
    from lagscope.plans.metrics import MetricsJob
    from lagscope.sources.fixtures import Fixture
    job = MetricsJob.from_fixture(Fixture(spark, "/root/testdata/sf0.001", "H"))
    g = job.produce
    first = job.gauges.groupBy("name", "key").agg(F.min(F.unix_seconds("timestamp")).alias("t0"))
    expected = first.select("name", "key", F.greatest(
        F.ceil((F.col("t0") - g.start) / g.interval), F.lit(0)).alias("k0")).select(
        "name", "key", (F.lit(g.count) - F.col("k0")).alias("n"))
    got = job.gauge_snapshot.groupBy("name", "key").agg(F.count(F.lit(1)).alias("n"))
    diff = expected.join(got, ["name", "key"], "full").where(
        F.coalesce(expected["n"], F.lit(-1)) != F.coalesce(got["n"], F.lit(-2)))
    assert diff.count() == 0
    assert got.count() == first.count() > 0
