"""Input tables on storage.

Layout under a root folder: one Parquet table per input, partitioned by the
UTC date of its time column (``scrape_date`` / ``commit_date``), so a job over
a time range reads only the matching folders (partition pruning) and the
remaining timestamp bound is pushed into the Parquet scan.

``records`` follows the columns of Spark's Kafka source (topic, partition,
offset, timestamp), so a ``readStream.format("kafka")`` feed can be written
straight into it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lagscope import schemas as S

# table -> (schema, time column, date partition column)
TABLES = {
    "records": (S.RECORDS, "timestamp", "record_date"),
    "topic_partitions": (S.TOPIC_PARTITIONS, "scrape_ts", "scrape_date"),
    "group_listings": (S.GROUP_LISTINGS, "scrape_ts", "scrape_date"),
    "group_descriptions": (S.GROUP_DESCRIPTIONS, "scrape_ts", "scrape_date"),
    "commits": (S.COMMITS, "commit_ts", "commit_date"),
}


def write_table(df: DataFrame, root: str, name: str, mode: str = "append") -> None:
    """Write one input table partitioned by the date of its time column; a
    day is cut by time over as many tasks as its share of the rows."""
    schema, ts, part = TABLES[name]
    (df.select(*[f.name for f in schema.fields])
     .withColumn(part, F.to_date(ts))
     .repartitionByRange(part, ts)
     .write.mode(mode).partitionBy(part).parquet(f"{root}/{name}"))


def read_table(spark: SparkSession, root: str, name: str, start: datetime | None = None,
               end: datetime | None = None) -> DataFrame:
    """Read one input table, restricted to ``start <= time < end``.

    The date bounds prune partition folders; the exact timestamp bounds are
    pushed down to the Parquet reader."""
    schema, ts, part = TABLES[name]
    full = T.StructType(list(schema.fields) + [T.StructField(part, T.DateType())])
    df = spark.read.schema(full).parquet(f"{root}/{name}")
    if start is not None:
        df = df.where((F.col(part) >= F.lit(start.date())) & (F.col(ts) >= F.lit(start)))
    if end is not None:
        df = df.where((F.col(part) <= F.lit(end.date())) & (F.col(ts) < F.lit(end)))
    return df.drop(part)


def read_inputs(spark: SparkSession, root: str, start: datetime | None = None,
                end: datetime | None = None, commits_from: datetime | None = None) -> dict:
    """The four snapshot inputs of a ``MetricsJob`` for ``[start, end)``.

    Commits are read from ``commits_from`` (default: all history) because the
    committed offset at a scrape is the latest commit at or before it, which
    may predate the range; pass a bound when older commits are known to be
    superseded."""
    return {
        "topic_partitions": read_table(spark, root, "topic_partitions", start, end),
        "group_listings": read_table(spark, root, "group_listings", start, end),
        "group_descriptions": read_table(spark, root, "group_descriptions", start, end),
        "commits": read_table(spark, root, "commits", commits_from, end),
    }


def write_fixture(fx, root: str) -> None:
    """Persist a fixture's inputs in the storage layout (overwrites)."""
    write_table(fx.records, root, "records", "overwrite")
    write_table(fx.topic_partitions, root, "topic_partitions", "overwrite")
    write_table(fx.group_listings, root, "group_listings", "overwrite")
    write_table(fx.group_descriptions, root, "group_descriptions", "overwrite")
    write_table(fx.commits, root, "commits", "overwrite")
