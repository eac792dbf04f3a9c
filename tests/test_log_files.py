"""A log stored by topic and partition: bounds from the files' footers."""

import pytest
from pyspark.sql import functions as F

from lagscope import schemas as S
from lagscope.operators.offsets import offset_bounds
from lagscope.sources import log_files as L
from lagscope.sources.fixtures import Fixture
from lagscope.streaming.jobs import work_dir


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_bounds_come_from_footers_alone(spark):
    records = Fixture(spark, "/root/testdata/sf0.01", "H").records
    root = L.append_log(records, work_dir(spark, "log"))
    got = L.footer_bounds(spark, root)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(offset), MAX(offset)]" in plan
    assert "PushedGroupBy: [topic, partition]" in plan
    assert "timestamp" not in plan   # the scan gives a row per file: keys, minimum and maximum
    assert rows(got) == rows(offset_bounds(records))
    assert L.read_log(spark, root).exceptAll(records.select("offset", "timestamp", "topic", "partition")).count() == 0


def test_appended_segments_move_the_bounds(spark):
    root = work_dir(spark, "log")
    def segment(topic, first, n):
        return spark.range(first, first + n).select(
            F.lit(topic).alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"),
            F.timestamp_seconds("id").alias("timestamp"))
    L.append_log(segment("a", 10, 1000), root)
    L.append_log(segment("b", 5, 1), root)
    assert rows(L.footer_bounds(spark, root)) == [("a", 0, 10, 1010), ("b", 0, 5, 6)]
    L.append_log(segment("a", 1010, 50_000), root)
    assert rows(L.footer_bounds(spark, root)) == [("a", 0, 10, 51_010), ("b", 0, 5, 6)]


def test_nulls_odd_names_and_empty_logs(spark):
    given = [("a", 0, 5, None), ("a", 0, 5, None), ("a", 0, 7, None), ("b", None, 1, None), (None, 2, 3, None),
             ("007", 3, 9, None), ("x/y=z %", 3, 9, None), ("a", 0, -3, None), ("a", 0, 2**62, None)]
    df = spark.createDataFrame(given, S.RECORDS).withColumn("key", F.lit("extra"))
    assert rows(L.footer_bounds(spark, L.append_log(df, work_dir(spark, "log")))) == rows(offset_bounds(df))
    assert rows(L.footer_bounds(spark, L.append_log(df.limit(0), work_dir(spark, "log")))) == []
    with pytest.raises(Exception, match="no offset"):
        L.append_log(spark.createDataFrame([("c", 1, None, None)], S.RECORDS), work_dir(spark, "log"))


def test_the_reader_changes_no_setting_of_the_session(spark):
    before = spark.conf.get("spark.sql.sources.useV1SourceList"), spark.conf.get("spark.sql.parquet.aggregatePushdown")
    L.footer_session(spark)
    assert before == (spark.conf.get("spark.sql.sources.useV1SourceList"),
                      spark.conf.get("spark.sql.parquet.aggregatePushdown"))
