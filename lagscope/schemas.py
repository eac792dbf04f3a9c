"""Input/output schemas and the fixed metric vocabulary."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Metric names must equal the ones downstream dashboards and
# the collectd type file expect, so they are stated here verbatim.
# ---------------------------------------------------------------------------
TOPIC_PARTITION = "kafka_topic_partition"
OFFSET_NEWEST = "kafka_topic_partition_offset_newest"
OFFSET_OLDEST = "kafka_topic_partition_offset_oldest"
LEADER = "kafka_leader_topic_partition"
REPLICAS = "kafka_replicas_topic_partition"
IN_SYNC_REPLICAS = "kafka_in_sync_replicas"
LEADER_IS_PREFERRED = "kafka_leader_is_preferred_topic_partition"
UNDER_REPLICATED = "kafka_under_replicated_topic_partition"
GROUP_LAG = "kafka_consumer_group_lag"
GROUP_LATEST_OFFSET = "kafka_consumer_group_latest_offset"
TOPIC_RATE = "kafka_topic_rate"
GROUP_RATE = "kafka_consumer_group_rate"

GAUGE_NAMES = (
    TOPIC_PARTITION, OFFSET_NEWEST, OFFSET_OLDEST, LEADER, REPLICAS,
    IN_SYNC_REPLICAS, LEADER_IS_PREFERRED, UNDER_REPLICATED, GROUP_LAG,
    GROUP_LATEST_OFFSET,
)
METER_NAMES = (TOPIC_RATE, GROUP_RATE)

# Group filter constants (case-sensitive, as the broker reports them).
STABLE_STATE = "Stable"
CONSUMER_PROTOCOL = "consumer"

# Meter clock: the EWMA ticks every 5 seconds and decays over 1, 5, 15 minutes.
TICK_SECONDS = 5
EWMA_MINUTES = (1, 5, 15)

# Sink labels and defaults.
LOG_METER_LABEL = "offsetMetrics"
LOG_GAUGE_LABEL = "consumerGroupOffsetMetrics"
DEFAULT_TOPIC = "metrics"
DEFAULT_INDEX = "metrics"
DEFAULT_DOC_TYPE = "doc"
DEFAULT_INFLUX_DATABASE = "metrics"
DEFAULT_INFLUX_RETENTION = "default"
DEFAULT_INTERVAL_SECONDS = 60
SINK_QUEUE_DEPTH = 16
# ---------------------------------------------------------------------------

META = T.StructType([
    T.StructField("group", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("topic", T.StringType()),
])

RECORDS = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
])

TOPIC_PARTITIONS = T.StructType([
    T.StructField("scrape_ts", T.TimestampType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("oldest_offset", T.LongType()),
    T.StructField("newest_offset", T.LongType()),
    T.StructField("leader_id", T.IntegerType(), True),
    T.StructField("replicas", T.ArrayType(T.IntegerType())),
    T.StructField("isr", T.ArrayType(T.IntegerType())),
])

GROUP_LISTINGS = T.StructType([
    T.StructField("scrape_ts", T.TimestampType()),
    T.StructField("broker_id", T.IntegerType()),
    T.StructField("group_id", T.StringType()),
    T.StructField("protocol_type", T.StringType()),
])

MEMBER = T.StructType([
    T.StructField("member_id", T.StringType()),
    T.StructField("client_id", T.StringType()),
    T.StructField("client_host", T.StringType()),
    T.StructField("assignment", T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))),
])

GROUP_DESCRIPTIONS = T.StructType([
    T.StructField("scrape_ts", T.TimestampType()),
    T.StructField("group_id", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("protocol_type", T.StringType()),
    T.StructField("members", T.ArrayType(MEMBER)),
])

COMMITS = T.StructType([
    T.StructField("commit_ts", T.TimestampType()),
    T.StructField("group_id", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
])

METRICS = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("meta", META),
    T.StructField("value", T.LongType()),
    T.StructField("count", T.LongType()),
    T.StructField("rate1", T.DoubleType()),
    T.StructField("rate5", T.DoubleType()),
    T.StructField("rate15", T.DoubleType()),
    T.StructField("rate_mean", T.DoubleType()),
])

METRIC_COLUMNS = [f.name for f in METRICS.fields]
