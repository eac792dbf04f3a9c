"""Whole scrapes, and commits and scrapes that meet as streams."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from lagscope import schemas as S
from lagscope.operators import groups as GR
from lagscope.streaming import commits as C, gate as GT, jobs as J

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(m):
    return T0 + timedelta(minutes=m)


def test_status_of_scrapes(spark):
    a = spark.createDataFrame([(at(m), i) for m in (1, 2, 3) for i in range(3)], "scrape_ts timestamp, v int")
    b = spark.createDataFrame([(at(1), 0), (at(3), 0), (at(3), 1)], "scrape_ts timestamp, v int")
    promised = spark.createDataFrame(
        [(at(m), s, n) for m in (1, 2, 3) for s, n in (("a", 3), ("b", 1))] + [(at(1), "a", 3), (at(4), "a", 0), (at(5), "c", 1)],
        GT.MANIFEST)
    got = {r.scrape_ts.replace(tzinfo=timezone.utc): (r.sources, r.missing_rows, r.excess_rows, r.complete)
           for r in GT.scrape_status(promised, {"a": a, "b": b}).collect()}
    assert got == {at(1): (2, 0, 0, True), at(2): (2, 1, 0, False), at(3): (2, 0, 1, False),
                   at(4): (1, 0, 0, True), at(5): (1, 1, 0, False)}
    assert GT.complete_scrapes(promised.limit(0), {"a": a}).count() == 0
    assert GT.only(a, GT.complete_scrapes(promised, {"a": a, "b": b})).count() == 3


def test_a_scrape_enters_whole_once_its_file_comes(spark):
    base = J.work_dir(spark, "gate")
    schema = "scrape_ts timestamp, v int"

    def land(name, rows, kind):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{base}/{name}")

    def run():
        m = J.read_stream(spark, f"{base}/manifest", GT.MANIFEST, files_per_trigger=1)
        t = m.sparkSession.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/t")
        GT.gate_stream(m.select("scrape_ts").unionByName(t.select("scrape_ts")),
                       lambda: {"t": spark.read.schema(schema).parquet(f"{base}/t")},
                       lambda: spark.read.schema(GT.MANIFEST).parquet(f"{base}/manifest"), f"{base}/out", f"{base}/ckpt")
        rows = spark.read.schema("scrape_ts timestamp, batch_id bigint").parquet(f"{base}/out").collect()
        return sorted(r.scrape_ts.replace(tzinfo=timezone.utc) for r in rows)

    land("manifest", [(at(1), "t", 2), (at(2), "t", 2)], GT.MANIFEST)
    land("t", [(at(1), 1)], schema)
    land("t", [(at(2), 1), (at(2), 2)], schema)
    assert run() == [at(2)]
    land("t", [(at(1), 2)], schema)          # the file that was missing
    assert run() == [at(1), at(2)]
    land("manifest", [(at(2), "t", 2)], GT.MANIFEST)   # a replayed promise
    assert run() == [at(1), at(2)]


def test_commits_and_scrapes_in_any_order_equal_the_batch_scan(spark):
    """Shuffled arrival over many micro-batches, ties, early and missing commits."""
    rng = random.Random(3)
    asked = sorted({(at(rng.randrange(60)), f"g{rng.randrange(2)}", "t", rng.randrange(3)) for _ in range(120)})
    given = [(at(rng.randrange(60)) + timedelta(seconds=rng.choice([0, 0, 30])), f"g{rng.randrange(2)}", "t",
              rng.randrange(1, 4), rng.randrange(1000)) for _ in range(80)]
    a_schema = "scrape_ts timestamp, group_id string, topic string, partition int"
    want = GR.committed_offset_scan(spark.createDataFrame(asked, a_schema), spark.createDataFrame(given, S.COMMITS))
    base = J.work_dir(spark, "commits")
    rng.shuffle(asked)
    rng.shuffle(given)
    for i in range(4):
        spark.createDataFrame(asked[i::4], a_schema).coalesce(1).write.mode("append").parquet(f"{base}/a")
        spark.createDataFrame(given[i::4], S.COMMITS).coalesce(1).write.mode("append").parquet(f"{base}/c")
    # the closing rows lie behind the watermark's delay
    end = at(200)
    J.land_row(spark, (end, "zz", "zz", 0), a_schema, f"{base}/a")
    J.land_row(spark, (end, "zz", "zz", 0, 0), S.COMMITS, f"{base}/c")
    own = J.stream_session(spark)

    def stream(name, schema, ts):
        return (own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/{name}")
                .withWatermark(ts, "70 minutes"))

    C.committed_stream(stream("a", a_schema, "scrape_ts"), stream("c", S.COMMITS, "commit_ts"),
                       f"{base}/out", f"{base}/ckpt")
    columns = ["scrape_ts", "group_id", "topic", "partition", "committed"]
    got = spark.read.parquet(f"{base}/out").where("topic <> 'zz'")
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert {r.committed for r in got.where("partition = 0").collect()} == {-1}


class _Timers:
    def __init__(self, seconds):
        self.seconds = seconds

    def getCurrentWatermarkInMs(self):
        return self.seconds * 1000


class _Handle:
    """Value state and timers of one key."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, ms):
        self.timers.append(ms)


def test_state_keeps_one_commit_behind_the_watermark(spark):
    import pandas as pd
    handle, proc = _Handle(), C.CommitProcessor(C.KEYS)
    proc.init(handle)
    second = 1_000_000
    for start in range(0, 1000, 100):
        us = [(start + i) * second for i in range(100)]
        b = pd.DataFrame({"us": us + [us[50]], "is_scrape": [False] * 100 + [True], "offset": list(range(start, start + 100)) + [0]})
        out = list(proc.handleInputRows(("g", "t", "0"), iter([b]), _Timers(start)))
        assert [r for o in out for r in o["committed"]] == ([start - 50] if start else [])
        assert handle.value[:3] == ((start - 1) * second, start - 1, True) if start else True
        assert len(handle.value[3]) == 100 and len(handle.value[5]) == 1
    out = list(proc.handleExpiredTimer(("g", "t", "0"), _Timers(5000), None))
    assert [r for o in out for r in o["committed"]] == [950]
    assert handle.value[3:] == ([], [], [])


def test_an_empty_batch_keeps_the_commit_chain(spark):
    commits = spark.createDataFrame([(at(0), "g", "t", 0, 5)], S.COMMITS)
    root = f"{J.work_dir(spark, 'chain')}/_state"
    J.save_commit_state(J.commits_for_batch(spark, commits, root, 0, at(3)), root, 0, at(3))
    # batch 1 had no rows and left no state; batch 2 finds batch 0's, not the whole history
    later = spark.createDataFrame([(at(-600), "g", "t", 1, 9), (at(4), "g", "t", 0, 6)], S.COMMITS)
    known = J.commits_for_batch(spark, later, root, 2, at(5))
    assert sorted((r.partition, r.offset) for r in known.collect()) == [(0, 5), (0, 6)]
