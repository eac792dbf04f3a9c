"""A log stored by (topic, partition), and its bounds from file statistics.

Segments are Parquet files in a folder per topic and partition, each a range of
offsets: records are cut by range over tasks, so a partition that holds a third
of the log becomes many files. The bounds of such a log need no record: the
minimum and maximum of ``offset`` stand in every file's footer, and the reader
takes them from there (aggregate pushdown of the Parquet source); what is
shuffled is a row per file. New segments are appended; a reader that lists the
folder sees their bounds at once.

Defined results: an empty log has no bounds; a null topic or partition is one
of its own (an empty topic counts as null); a record without an offset is no
part of a log and fails the append, before anything is published. Files that
others wrote without statistics fail the reader, which names them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lagscope import schemas as S
from lagscope.operators.offsets import offset_bounds

KEYS = ("topic", "partition")


def append_log(records: DataFrame, root: str) -> str:
    """Add records as segments; rows are sorted by offset inside a file."""
    offset = F.coalesce("offset", F.raise_error(F.lit("a log record has no offset")).cast("bigint"))
    (records.select(*[f.name for f in S.RECORDS.fields]).withColumn("offset", offset)
     .repartitionByRange(*KEYS, "offset").sortWithinPartitions(*KEYS, "offset")
     .write.mode("append").partitionBy(*KEYS).parquet(root))
    return root


def footer_session(spark: SparkSession) -> SparkSession:
    """A session of its own, in which Parquet tables answer minima, maxima and
    counts by folder from their footers."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(
        s for s in spark.conf.get("spark.sql.sources.useV1SourceList").split(",") if s.strip() != "parquet"))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    for k in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(k, spark.conf.get(k))
    return own


def read_log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(S.RECORDS).parquet(root)


def footer_bounds(spark: SparkSession, root: str) -> DataFrame:
    """``offset_bounds`` of the stored log from its files' statistics alone."""
    return offset_bounds(read_log(footer_session(spark), root))
