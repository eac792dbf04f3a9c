"""The registry on storage and change-point intervals, against plain versions."""

import random

from pyspark.sql import functions as F

from lagscope.operators import intervals as IV
from lagscope.operators.store import ROW, SERIES, RegistryStore, bucket_of, latest_rows
from lagscope.streaming.jobs import work_dir


def _rows(spark, n, seed):
    """Series of three kinds of identity, with nulls, ties and repeats."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        g, p = rng.choice([None, "g1", "g2"]), rng.choice([None, 0, 1, 2])
        t, name = rng.choice(["t1", "t2", "t3", "t4"]), rng.choice(["lag", "newest"])
        out.append((name, g, t, p, f"{g}-{t}-{p}", rng.randrange(50), rng.randrange(9)))
    return spark.createDataFrame(out, "name string, group_id string, topic string, partition int, key string, "
                                 "s int, value bigint").withColumn(
        "timestamp", F.timestamp_seconds("s")).select(*SERIES, "key", "timestamp", "value")


def _sorted(df):
    return sorted((tuple(r) for r in df.select(*SERIES, "key", "timestamp", "value").collect()), key=repr)


def test_merged_store_equals_recomputation(spark):
    store = RegistryStore(spark, work_dir(spark, "store"), buckets=8, merge_after=3)
    assert store.latest().count() == 0
    everything = spark.createDataFrame([], ROW)
    for i in range(8):
        rows = _rows(spark, 30, i)
        everything = everything.unionByName(rows)
        store.merge(rows, i)
        assert store.merge(_rows(spark, 30, 100 + i), i) == []   # a replay of merge i
        assert _sorted(store.latest()) == _sorted(latest_rows(everything))
    before = _sorted(store.latest())
    store.compact()
    assert {kind for _, kind, _ in store.parts()} == {"base"}
    store.vacuum()
    assert _sorted(store.latest()) == before
    some = everything.where("topic = 't2'").select(*SERIES)
    assert _sorted(store.lookup(some)) == [r for r in before if r[2] == "t2"]


def test_a_merge_touches_its_buckets_alone(spark):
    store = RegistryStore(spark, work_dir(spark, "store"), buckets=16, merge_after=2)
    store.merge(_rows(spark, 200, 1), 0)
    one = _rows(spark, 200, 1).where("name = 'lag' AND topic = 't1' AND partition = 1 AND group_id = 'g1'").limit(1)
    bucket = one.select(bucket_of(16)).first()[0]
    before = store.parts()
    assert store.merge(one.withColumn("timestamp", F.timestamp_seconds(F.lit(99))), 1) == [bucket]
    after = store.parts()
    assert [p for p in after if p[0] != bucket] == [p for p in before if p[0] != bucket]
    assert [kind for b, kind, _ in after if b == bucket] == ["base"]   # it was compacted
    files = store.latest([bucket]).inputFiles()
    assert files and all(f"bucket={bucket}/" in f for f in files)


def test_a_lost_merge_leaves_no_trace(spark, monkeypatch):
    store = RegistryStore(spark, work_dir(spark, "store"), buckets=4)
    store.merge(_rows(spark, 20, 1), 0)
    before, parts = _sorted(store.latest()), store.parts()

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(RegistryStore, "_set", lost)
        try:
            store.merge(_rows(spark, 20, 2), 1)
        except OSError:
            pass
    assert store.parts() == parts and _sorted(store.latest()) == before
    assert store.merge(_rows(spark, 20, 2), 1)   # and can be run again
    store.vacuum()
    assert _sorted(store.latest()) == _sorted(latest_rows(_rows(spark, 20, 1).unionByName(_rows(spark, 20, 2))))


def _brute(obs, instants):
    series = {}
    for *ident, key, us, value in obs:
        at = series.setdefault((*ident, key), {})
        at[us] = max(at.get(us, value), value)
    out = []
    for ident, at in series.items():
        for t in sorted(set(instants)):
            seen = [us for us in at if us <= t]
            if seen:
                out.append((*ident, at[max(seen)], t))
    return sorted(out, key=repr)


def test_intervals_answer_any_instant(spark):
    rng = random.Random(7)
    day = 86_400_000_000
    obs = [("n", rng.choice([None, "g"]), rng.choice("ab"), rng.choice([None, 1]), "k", rng.randrange(40) * day // 4,
            rng.randrange(3)) for _ in range(150)]
    df = spark.createDataFrame(obs, "name string, group_id string, topic string, partition int, key string, "
                               "us bigint, value bigint")
    instants = [rng.randrange(-day, 30 * day) for _ in range(25)] + [0, day, 40 * day]
    want = _brute(obs, instants)
    at = spark.createDataFrame([(t,) for t in instants], "us bigint")

    def rows(whole, **kw):
        return sorted((tuple(r) for r in IV.asof(whole, at, **kw).collect()), key=repr)

    whole = IV.change_points(df)
    assert rows(whole) == want
    assert rows(whole, bucket_seconds=3600) == want
    assert IV.asof(whole, at.limit(0)).count() == IV.asof(whole.limit(0), at).count() == 0
    # appended day by day, reading only what stands
    known, standing = whole.limit(0), whole.limit(0)
    for lo in range(0, 12, 3):
        part = df.where((F.col("us") >= lo * day) & (F.col("us") < (lo + 3) * day))
        closed, standing = IV.append(standing, part)
        standing = standing.checkpoint()
        known = known.unionByName(closed.checkpoint())
    assert rows(known.unionByName(standing)) == want


def test_interval_size_follows_changes(spark):
    df = spark.range(10_000).select(
        F.lit("n").alias("name"), F.lit(None).cast("string").alias("group_id"), F.lit("t").alias("topic"),
        F.lit(0).alias("partition"), F.lit("k").alias("key"), (F.col("id") * 60_000_000).alias("us"),
        F.floor(F.col("id") / 2500).alias("value"))
    assert IV.change_points(df).count() == 4
