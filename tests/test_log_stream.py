"""The log's stream reader: limits, restarts, gaps and ranges."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lagscope.sources import log_files as L, log_stream as LS
from lagscope.streaming.jobs import stream_session, work_dir


def segment(spark, topic, partition, first, n, files=1):
    df = spark.range(first, first + n).select(
        F.lit(topic).cast("string").alias("topic"), F.lit(partition).cast("int").alias("partition"),
        F.col("id").alias("offset"), F.timestamp_micros(F.col("id") * 1_000_001).alias("timestamp"))
    return df.repartition(files) if files > 1 else df


def keep(out):
    """Every batch is written with its id, so a row read twice stays visible."""
    def per_batch(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/b={batch_id}")
    return per_batch


def start(spark, base, **options):
    stream = LS.read_log_stream(stream_session(spark), f"{base}/log", **options)
    return stream.writeStream.foreachBatch(keep(f"{base}/out")).option("checkpointLocation", f"{base}/ckpt").start()


def seen(spark, base):
    return spark.read.parquet(f"{base}/out").drop("b")


def sizes(spark, base):
    return [r["count"] for r in seen(spark, base).groupBy("batch").count().orderBy("batch").collect()]


def log_rows(df):
    return sorted(map(tuple, df.select("topic", "partition", "offset", "timestamp").collect()), key=repr)


def test_a_limit_holds_over_restarts_and_every_row_comes_once(spark):
    base = work_dir(spark, "t")
    L.append_log(segment(spark, "hot/topic", 0, 0, 900, 3).unionByName(segment(spark, "b", 1, 50, 100))
                 .unionByName(segment(spark, None, None, 7, 23)), f"{base}/log")
    LS.drain(start(spark, base, maxOffsetsPerTrigger=300, maxOffsetsPerTask=70))
    first = sizes(spark, base)
    assert first == [300, 300, 300, 123]
    L.append_log(segment(spark, "hot/topic", 0, 900, 500).unionByName(segment(spark, "new", 2, 1000, 5)), f"{base}/log")
    LS.drain(start(spark, base, maxOffsetsPerTrigger=200, maxOffsetsPerTask=70))
    assert sizes(spark, base) == first + [200, 200, 105]
    LS.drain(start(spark, base, maxOffsetsPerTrigger=200))
    assert sizes(spark, base) == first + [200, 200, 105]
    assert log_rows(seen(spark, base)) == log_rows(L.read_log(spark, f"{base}/log"))


def test_a_batch_that_failed_is_read_again_by_the_same_range(spark):
    base = work_dir(spark, "t")
    L.append_log(segment(spark, "a", 0, 10, 100), f"{base}/log")
    ranges = []

    def start_failing(fail):
        def per_batch(batch, batch_id):
            ranges.append((batch_id, batch.agg(F.min("offset"), F.max("offset"), F.count("*")).first()))
            if fail:
                raise RuntimeError("lost")
            keep(f"{base}/out")(batch, batch_id)
        stream = LS.read_log_stream(stream_session(spark), f"{base}/log", maxOffsetsPerTrigger=40)
        return stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", f"{base}/ckpt").start()

    with pytest.raises(Exception, match="lost"):
        LS.drain(start_failing(True))
    L.append_log(segment(spark, "a", 0, 0, 10), f"{base}/log")      # behind where the folder began
    L.append_log(segment(spark, "a", 0, 110, 30), f"{base}/log")
    LS.drain(start_failing(False))
    assert [(b, tuple(r)) for b, r in ranges] == [
        (0, (10, 49, 40)), (0, (10, 49, 40)), (1, (50, 89, 40)), (2, (90, 129, 40)), (3, (130, 139, 10))]


def test_a_gap_holds_its_folder_until_it_is_filled(spark):
    base = work_dir(spark, "t")
    L.append_log(segment(spark, "a", 0, 0, 10).unionByName(segment(spark, "a", 1, 0, 5)), f"{base}/log")
    L.append_log(segment(spark, "a", 0, 20, 10), f"{base}/log")
    LS.drain(start(spark, base))
    assert seen(spark, base).where("partition = 0").agg(F.max("offset")).first()[0] == 9
    L.append_log(segment(spark, "a", 0, 10, 10), f"{base}/log")
    LS.drain(start(spark, base))
    assert log_rows(seen(spark, base)) == log_rows(L.read_log(spark, f"{base}/log"))


def test_gaps_of_a_compacted_log_are_passed_over(spark):
    base = work_dir(spark, "t")
    for first in (0, 100, 1000):
        L.append_log(segment(spark, "a", 0, first, 10), f"{base}/log")
    LS.drain(start(spark, base, gaps="skip", maxOffsetsPerTrigger=400))
    assert log_rows(seen(spark, base)) == log_rows(L.read_log(spark, f"{base}/log"))
    assert max(sizes(spark, base)) <= 400


def test_a_given_first_offset_waits_for_its_segment(spark):
    base = work_dir(spark, "t")
    L.append_log(segment(spark, "a", 0, 10, 10), f"{base}/log")
    LS.drain(start(spark, base, startingOffset=5))
    L.append_log(segment(spark, "a", 0, 0, 10), f"{base}/log")
    LS.drain(start(spark, base, startingOffset=5))
    assert sorted(r["offset"] for r in seen(spark, base).collect()) == list(range(5, 20))


def test_empty_logs_repeats_and_other_columns(spark):
    base = work_dir(spark, "t")
    LS.drain(start(spark, base))                                    # no folder yet: no batch
    twice = segment(spark, "a", 0, 0, 4)
    L.append_log(twice.unionByName(twice), f"{base}/log")
    L.append_log(segment(spark, "a", 0, 4, 0), f"{base}/log")
    (segment(spark, "x=y", 3, 0, 2).withColumn("folder", F.lit("clash")).withColumn("batch", F.lit(9))
     .write.mode("append").partitionBy("topic", "partition").parquet(f"{base}/log"))
    (segment(spark, "bare", 0, 0, 2).drop("timestamp")
     .write.mode("append").partitionBy("topic", "partition").parquet(f"{base}/log"))
    LS.drain(start(spark, base))
    got = seen(spark, base)
    assert got.columns == ["topic", "partition", "offset", "timestamp", "batch"]
    assert log_rows(got) == log_rows(L.read_log(spark, f"{base}/log")) and got.count() == 12
    assert got.where("topic = 'bare' AND timestamp IS NULL").count() == 2


def test_deleted_segments_and_files_without_statistics_are_named(spark, tmp_path):
    base = work_dir(spark, "t")
    L.append_log(segment(spark, "a", 0, 0, 10), f"{base}/log")
    reader = LS.LogStreamReader({"path": f"{base}/log"})
    assert reader.latestOffset() == {"topic=a/partition=0": [0, 10]}
    with pytest.raises(ValueError, match="topic=a/partition=0 are gone"):
        reader.partitions({}, {"topic=a/partition=0": [0, 11]})
    import pyarrow as pa
    import pyarrow.parquet as pq
    bare = tmp_path / "topic=a" / "partition=0"
    bare.mkdir(parents=True)
    pq.write_table(pa.table({"offset": [1, 2]}), bare / "f.parquet", write_statistics=False)
    with pytest.raises(ValueError, match="no statistics of offset in .*f.parquet"):
        LS.LogStreamReader({"path": str(tmp_path)}).latestOffset()
    with pytest.raises(ValueError, match="wait or skip"):
        LS.LogStreamReader({"path": "/", "gaps": "x"})


def test_tasks_read_ranges_not_folders(spark):
    base = work_dir(spark, "t")
    L.append_log(segment(spark, "a", 0, 0, 1000, 4).unionByName(segment(spark, "b", 0, 0, 10)), f"{base}/log")
    reader = LS.LogStreamReader({"path": f"{base}/log", "maxOffsetsPerTask": "300"})
    parts = reader.partitions({}, reader.latestOffset())
    assert [(p.folder, p.start, p.end) for p in parts] == [
        ("topic=a/partition=0", i, min(1000, i + 300)) for i in (0, 300, 600, 900)] + [("topic=b/partition=0", 0, 10)]
    for p in parts:
        offsets = [o for b in reader.read(p) for o in b.column("offset").to_pylist()]
        assert sorted(offsets) == list(range(p.start, p.end))
    seen_footers = dict(reader.known)
    L.append_log(segment(spark, "b", 0, 10, 10), f"{base}/log")
    reader.latestOffset()
    assert len(reader.known) > len(seen_footers) and all(reader.known[k] is v for k, v in seen_footers.items())


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(max_size=3), st.integers(1, 10**15), max_size=8), st.integers(1, 10**15))
def test_admission_is_exact_and_fair(waiting, limit):
    got = LS.admit(waiting, limit)
    total = sum(waiting.values())
    assert sum(got.values()) == min(limit, total)
    for k, n in waiting.items():
        assert 0 <= got[k] <= n
        if total > limit:
            assert abs(got[k] - limit * n / total) <= 1 + limit * 1e-9


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 10)), max_size=8), st.integers(0, 40))
def test_reach_against_brute_force(spans, start):
    segments = [LS.Segment(a, a + n, "f") for a, n in spans]
    there = {o for a, n in spans for o in range(a, a + n + 1)}
    end = start
    while end in there:
        end += 1
    assert LS.reach(segments, start, False) == end
    assert LS.reach(segments, start, True) == max([start] + [o + 1 for o in there])
