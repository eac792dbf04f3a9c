"""End-to-end live pipeline: scrapes in, rendered metrics out.

    scrape stream ──foreachBatch──▶ gauges/ (all ten gauges per scrape)
    gauges stream ──carry-forward──▶ carry/    (every series at each instant)
    gauges stream ──meter (topic)──▶ m-topic/  (from newest-offset gauges)
    gauges stream ──meter (group)──▶ m-group/  (from latest-offset gauges)
    carry + meters stream ──foreachBatch(render, deliver)──▶ sink

Every stage is a Structured Streaming query with its own checkpoint under
``work``; stages communicate through append-only Parquet folders, so each can
restart independently.  With ``available_now`` the stages run one after the
other to completion (backfill / tests); otherwise they are started together
and run continuously.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lagscope import schemas as S
from lagscope.operators import gauges as G, groups as GR, meters as M
from lagscope.operators.meters import ProduceGrid
from lagscope.sinks import runner as RUN
from lagscope.streaming import jobs as J

GAUGE_SCHEMA = ("kind string, name string, key string, timestamp timestamp, "
                "meta struct<group:string,partition:int,topic:string>, value bigint")


def gauge_batches(scrape_stream: DataFrame, listings: DataFrame, topic_partitions: DataFrame,
                  descriptions: DataFrame, commits: DataFrame, out: str, ckpt: str, available_now: bool = True):
    """All ten gauges for the scrapes of each micro-batch of scrape times."""
    state_root = f"{out}/_commit_state"

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        tp, lags, known, latest = J.batch_inputs(batch, batch_id, listings, topic_partitions, descriptions,
                                                 commits, state_root)
        gauges = (G.topic_partition_gauge(tp).unionByName(G.partition_gauges(tp))
                  .unionByName(GR.group_gauges(lags)))
        J.publish(gauges, out, batch_id)
        J.save_commit_state(known, state_root, batch_id, latest)

    w = scrape_stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", ckpt)
    return J._run(w, available_now)


def gauge_rows_stream(spark: SparkSession, path: str, delay: str) -> DataFrame:
    """The published gauges as a stream with a watermark on the scrape time,
    set before any filter so that every gauge moves it."""
    return (J.stream_session(spark).readStream.schema(GAUGE_SCHEMA).parquet(f"{path}/batch_id=*")
            .withWatermark("timestamp", delay))


def meter_streams(spark: SparkSession, gauges: str, delay: str, grid: ProduceGrid, work: str,
                  available_now: bool = True) -> list:
    """Topic meters from the newest-offset gauges and group meters from the
    latest-offset gauges."""
    # a condition on the event time stays above the watermark
    only = lambda name: F.when(F.col("timestamp").isNotNull(), F.col("name") == name)
    newest = gauge_rows_stream(spark, gauges, delay).where(only(S.OFFSET_NEWEST)).select(
        F.col("meta.topic").alias("topic"), F.col("timestamp").alias("scrape_ts"), "value")
    latest = gauge_rows_stream(spark, gauges, delay).where(only(S.GROUP_LATEST_OFFSET)).select(
        F.col("meta.group").alias("group_id"), F.col("meta.topic").alias("topic"),
        F.col("timestamp").alias("scrape_ts"), "value")
    return [J.meter_stream(newest, M.TOPIC_KEYS, "value", grid, f"{work}/m-topic", f"{work}/ckpt-m-topic",
                           available_now),
            J.meter_stream(latest, M.GROUP_KEYS, "value", grid, f"{work}/m-group", f"{work}/ckpt-m-group",
                           available_now)]


def metric_rows_stream(spark: SparkSession, work: str) -> DataFrame:
    """Carried-forward gauges and meter snapshots as one stream in the
    ``metrics`` layout."""
    spark = J.stream_session(spark)
    carry = spark.readStream.schema(
        "name string, group_id string, topic string, partition int, produce_ts timestamp, value bigint"
    ).parquet(f"{work}/carry")
    gauge_rows = carry.select(
        F.lit("gauge").alias("kind"), "name",
        F.concat_ws("-", "group_id", "topic", F.col("partition").cast("string")).alias("key"),
        F.col("produce_ts").alias("timestamp"),
        F.struct(F.col("group_id").alias("group"), F.col("partition"), F.col("topic")).alias("meta"),
        "value", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("count", "bigint"), ("rate1", "double"), ("rate5", "double"), ("rate15", "double"),
            ("rate_mean", "double"))])
    meter_schema = ("produce_ts timestamp, count bigint, rate1 double, rate5 double, "
                    "rate15 double, rate_mean double")
    topic = spark.readStream.schema("topic string, " + meter_schema).parquet(f"{work}/m-topic")
    group = spark.readStream.schema("group_id string, topic string, " + meter_schema).parquet(
        f"{work}/m-group")
    meters = M.meter_rows(topic, S.TOPIC_RATE, M.TOPIC_KEYS).unionByName(
        M.meter_rows(group, S.GROUP_RATE, M.GROUP_KEYS))
    return gauge_rows.unionByName(meters)


def run_live(spark: SparkSession, scrape_stream: DataFrame, listings: DataFrame, topic_partitions: DataFrame,
             descriptions: DataFrame, commits: DataFrame, grid: ProduceGrid, work: str,
             render: RUN.Render, deliver: RUN.Deliver, on_error: str = "fail",
             on_close=None, available_now: bool = True, delay: str = "0 seconds"):
    """Start every stage (``grid`` without a count goes on for ever); with
    ``available_now``, run them to completion and close the sink.  Returns the
    queries and the sink, whose ``close`` the caller of a continuous run calls
    after its queries have stopped."""
    RUN.register_writer_source(spark)
    sink = RUN.batch_sink(render, deliver, on_error, on_close)
    gauges = f"{work}/gauges"
    queries = [gauge_batches(scrape_stream, listings, topic_partitions, descriptions, commits,
                             gauges, f"{work}/ckpt-gauges", available_now)]
    queries.append(J.carry_forward_stream(gauge_rows_stream(spark, gauges, delay), grid, f"{work}/carry",
                                          f"{work}/ckpt-carry", available_now))
    queries += meter_streams(spark, gauges, delay, grid, work, available_now)
    rows = metric_rows_stream(spark, work)
    RUN.register_writer_source(rows.sparkSession)
    queries.append(J._run(rows.writeStream.foreachBatch(sink)
                          .option("checkpointLocation", f"{work}/ckpt-sink"), available_now))
    if available_now:
        sink.close()
    return queries, sink
