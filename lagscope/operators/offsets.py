"""Scans of partition state and offset bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def topic_partition_scan(tp: DataFrame) -> DataFrame:
    """Topics and their partition ids at each scrape."""
    return tp.select("scrape_ts", "topic", "partition")


def replica_state_scan(tp: DataFrame) -> DataFrame:
    """Leader (nullable), replica list and in-sync list per partition."""
    return tp.select("scrape_ts", "topic", "partition", "leader_id", "replicas", "isr")


def offset_bounds(records: DataFrame) -> DataFrame:
    """Oldest retained and newest (next to write) offset per partition of a log.

    A plain grouped aggregate: partial min/max per task, so a partition that
    holds a large share of the log is still reduced map-side.
    """
    return records.groupBy("topic", "partition").agg(
        F.min("offset").alias("oldest_offset"),
        (F.max("offset") + 1).alias("newest_offset"),
    )


def merge_bounds(bounds: DataFrame) -> DataFrame:
    """Bounds of a log from bounds of its parts."""
    return bounds.groupBy("topic", "partition").agg(
        F.min("oldest_offset").alias("oldest_offset"), F.max("newest_offset").alias("newest_offset"))


def unnumbered_offset_bounds(base: DataFrame) -> DataFrame:
    """The same bounds of a log whose offsets are its rows' ranks from 0: the
    newest is the number of rows.  One partial aggregate; no row is numbered,
    sorted or written."""
    return base.groupBy("topic", "partition").agg(
        F.lit(0).cast("bigint").alias("oldest_offset"), F.count(F.lit(1)).alias("newest_offset"))
