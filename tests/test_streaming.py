"""Streams: restarts from a checkpoint, replays of a batch, commits that arrive
late, and writes by several tasks."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from lagscope import schemas as S
from lagscope.operators import meters as M
from lagscope.plans.metrics import MetricsJob
from lagscope.sources.fixtures import Fixture
from lagscope.streaming import jobs as J, pipeline as P

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_meter_stream_survives_restart(spark):
    fx = Fixture(spark, "/root/testdata/sf0.001", "H")
    job = MetricsJob.from_fixture(fx)
    base = J.work_dir(spark, "restart")
    tp = fx.topic_partitions
    landing = J.Landing.over(tp, 6)
    mid = landing.slice_of("scrape_ts") < 3
    open_grid = M.ProduceGrid(job.produce.start, job.produce.interval)

    def run():
        stream = J.read_stream(spark, f"{base}/tp", J.TP_SCHEMA, files_per_trigger=3).withWatermark(
            "scrape_ts", landing.delay)
        J.topic_meter_stream(stream, open_grid, f"{base}/out", f"{base}/ckpt")

    # first half lands, the query runs and stops
    J.land(tp.where(mid), f"{base}/tp", landing)
    run()
    first = spark.read.parquet(f"{base}/out").count()
    assert first > 0
    # the rest lands later; the same query resumes from its checkpoint
    J.land(tp.where(~mid), f"{base}/tp", landing)
    closing = datetime.fromtimestamp(job.produce.end + int(landing.span) + 2, timezone.utc)
    J.land_row(spark, (closing, "closing", 0, 0, 0, 1, [1], [1]), J.TP_SCHEMA, f"{base}/tp")
    run()
    got = spark.read.parquet(f"{base}/out")
    want = M.meter_snapshots(M.offset_delta(M.topic_offset_sum(tp), M.TOPIC_KEYS), M.TOPIC_KEYS, job.produce)

    def norm(df):
        return sorted((r["topic"], r["produce_ts"], r["count"], round(r["rate1"], 9),
                       round(r["rate15"], 9), None if r["rate_mean"] is None else round(r["rate_mean"], 9))
                      for r in df.collect())

    g, w = norm(got), norm(want)
    assert len(g) == len(w) > first
    assert g == w


def test_landing_uses_several_tasks_and_slices_in_order(spark):
    df = spark.range(2000).select(F.timestamp_seconds(F.col("id") * 60).alias("scrape_ts")).repartition(4)
    landing = J.Landing.over(df, 5)
    path = J.land(df, f"{J.work_dir(spark, 'land')}/t", landing)
    back = spark.read.parquet(path)
    assert back.count() == 2000
    files = back.groupBy(F.input_file_name().alias("f")).agg(
        F.min(landing.slice_of("scrape_ts")).alias("lo"), F.max(landing.slice_of("scrape_ts")).alias("hi")).collect()
    assert len(files) >= 15 and all(r.lo == r.hi for r in files)


def test_published_batch_is_written_once(spark):
    root = J.work_dir(spark, "publish")
    J.publish(spark.range(3).toDF("v"), root, 0)
    before = sorted(r[0] for r in spark.read.parquet(f"{root}/batch_id=0").select(F.input_file_name()).distinct().collect())
    J.publish(spark.range(9).toDF("v"), root, 0)     # a replay leaves what is there
    back = spark.read.parquet(f"{root}/batch_id=0")
    assert back.count() == 3
    assert sorted(r[0] for r in back.select(F.input_file_name()).distinct().collect()) == before


def _batch(spark, *minutes):
    return spark.createDataFrame([(T0 + timedelta(minutes=m),) for m in minutes], J.SCRAPE_SCHEMA)


def test_replay_and_late_commits(spark):
    """Batches of scrapes with commits that become visible later than their
    time; each batch run twice gives the same rows, equal to a batch job's."""
    def at(m):
        return T0 + timedelta(minutes=m)
    listings = spark.createDataFrame([(at(m), 1, "g", "consumer") for m in range(1, 7)], S.GROUP_LISTINGS)
    members = [("m", "c", "/h", {"t": [0, 1]})]
    descriptions = spark.createDataFrame([(at(m), "g", "Stable", "consumer", members) for m in range(1, 7)],
                                         S.GROUP_DESCRIPTIONS)
    tp = spark.createDataFrame([(at(m), "t", p, 0, 100 * m, 1, [1], [1]) for m in range(1, 7) for p in (0, 1)],
                               S.TOPIC_PARTITIONS)
    early = [(at(0), "g", "t", 0, 5), (at(2), "g", "t", 1, 7), (at(2), "g", "t", 1, 6)]
    late = (at(3), "g", "t", 0, 50)                   # seen only by the second batch
    out = J.work_dir(spark, "late")
    for n, (minutes, commits) in enumerate([((1, 2, 3), early), ((4, 5), early + [late]), ((6,), early + [late])]):
        for _ in range(2):
            batch = _batch(spark, *minutes)
            _tp, lags, known, hi = J.batch_inputs(batch, n, listings, tp, descriptions,
                                                  spark.createDataFrame(commits, S.COMMITS), f"{out}/_state")
            J.publish(lags, out, n)
            J.save_commit_state(known, f"{out}/_state", n, hi)
    got = {(int((r.scrape_ts.replace(tzinfo=timezone.utc) - T0).total_seconds() // 60), r.partition): r.committed
           for r in spark.read.parquet(f"{out}/batch_id=*").collect()}
    assert got == {**{(m, 0): 5 for m in (1, 2, 3)}, **{(m, 0): 50 for m in (4, 5, 6)},
                   (1, 1): -1, **{(m, 1): 7 for m in range(2, 7)}}
    fs, state = J._path(spark, f"{out}/_state")
    assert sorted(f.getPath().getName() for f in fs.listStatus(state)) == ["batch_id=1", "batch_id=2"]


def test_reads_of_a_batch_are_bounded(spark):
    root = J.work_dir(spark, "bounded")
    fx = Fixture(spark, "/root/testdata/sf0.001", "H")
    fx.topic_partitions.write.parquet(root)
    part = J.between(spark.read.parquet(root), T0, T0 + timedelta(hours=5))
    explain = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString
    plan = explain(part._jdf.queryExecution(), "formatted")
    assert "PushedFilters" in plan and "GreaterThanOrEqual(scrape_ts" in plan and "LessThanOrEqual(scrape_ts" in plan


def test_streams_leave_the_session_as_it_was(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    own = J.stream_session(spark)
    own.conf.set("spark.sql.shuffle.partitions", "3")
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert P.gauge_rows_stream(spark, J.work_dir(spark, "none"), "1 seconds").isStreaming


def test_open_grid_never_ends(spark):
    from lagscope.streaming.processors import _Grid
    g = _Grid(30, 60, None)
    assert g.next_after(1e9) == 30 + 60 * ((10**9 - 30) // 60 + 1)
    assert list(g.between(29, 151)) == [30, 90, 150] and len(g.between(1e9, 1e9 + 600)) == 10


def test_carry_forward_takes_observations_in_any_order(spark):
    """A scrape that arrives after a later one, before the watermark has
    passed it, still reports at its instants."""
    base = J.work_dir(spark, "order")
    at = lambda m: T0 + timedelta(minutes=m)
    value = lambda m: 100 + m
    for m in (3, 0, 2, 1, 30):
        rows = spark.createDataFrame([("g", None, "t", 0, at(m), value(m))], "name string, g string, topic string, "
                                     "partition int, timestamp timestamp, value bigint")
        (rows.select("name", F.struct(F.col("g").alias("group"), "partition", "topic").alias("meta"), "timestamp",
                     "value").coalesce(1).write.mode("append").parquet(f"{base}/g"))
    schema = "name string, meta struct<group: string, partition: int, topic: string>, timestamp timestamp, value bigint"
    stream = J.read_stream(spark, f"{base}/g", schema, files_per_trigger=1).withWatermark("timestamp", "10 minutes")
    grid = M.ProduceGrid(int(T0.timestamp()) + 30, 60)
    J.carry_forward_stream(stream, grid, f"{base}/out", f"{base}/ckpt")
    got = {r["produce_ts"]: r["value"] for r in spark.read.parquet(f"{base}/out").collect()}
    first = T0.replace(tzinfo=None) + timedelta(seconds=30)
    assert [got.get(first + timedelta(minutes=m)) for m in range(6)] == [100, 101, 102, 103, 103, 103]


def test_gauges_of_a_key_are_carried_together_and_start_apart(spark):
    """One state holds all gauges of a partition: each is reported from its own
    first observation on, also where it stops coming or has no value."""
    base = J.work_dir(spark, "together")
    at = lambda m: T0 + timedelta(minutes=m)
    schema = "name string, meta struct<group: string, partition: int, topic: string>, timestamp timestamp, value bigint"
    batches = [[("a", 0, 1), ("b", 0, 10)], [("a", 1, 2), ("c", 1, None)], [("c", 3, 30), ("b", 3, 11)], [("a", 30, 9)]]
    for i, batch in enumerate(batches):
        rows = [(n, (None, p, "t"), at(m), None if v is None else v + (p or 0)) for n, m, v in batch for p in (None, 7)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/g")
    stream = J.read_stream(spark, f"{base}/g", schema, files_per_trigger=1).withWatermark("timestamp", "10 minutes")
    J.carry_forward_stream(stream, M.ProduceGrid(int(T0.timestamp()) + 30, 60), f"{base}/out", f"{base}/ckpt")
    rows = spark.read.parquet(f"{base}/out").where(F.col("produce_ts") < F.lit(at(5))).collect()
    got = {(r["name"], r["partition"], (r["produce_ts"].replace(tzinfo=None) - T0.replace(tzinfo=None)).seconds // 60):
           r["value"] for r in rows}
    want = {"a": [1, 2, 2, 2, 2], "b": [10, 10, 10, 11, 11], "c": [None, None, None, 30, 30]}
    assert got == {(n, p, m): v + (p or 0) for n, vs in want.items() for m, v in enumerate(vs) if v is not None
                   for p in (None, 7)}
    assert len(rows) == len(got)
