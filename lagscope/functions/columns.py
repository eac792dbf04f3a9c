"""Scalar column builders (all JVM-side expressions, inside codegen)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col_or_null(name: str | Column | None, dtype: str) -> Column:
    if name is None:
        return F.lit(None).cast(dtype)
    return F.col(name) if isinstance(name, str) else name


def meta(group=None, partition=None, topic=None) -> Column:
    """``struct<group, partition, topic>``; absent parts are null."""
    return F.struct(
        col_or_null(group, "string").alias("group"),
        col_or_null(partition, "int").alias("partition"),
        col_or_null(topic, "string").alias("topic"),
    )


def metric_key(*parts: str | Column) -> Column:
    """Sink-visible key: parts joined with '-' (``topic-p``, ``group-topic-p``)."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("-", *[c.cast("string") for c in cols])


def stringify_tags(meta_col: str = "meta") -> Column:
    """Meta struct → ``map<string,string>`` without null entries."""
    m = F.col(meta_col)
    full = F.create_map(
        F.lit("group"), m["group"],
        F.lit("partition"), m["partition"].cast("string"),
        F.lit("topic"), m["topic"],
    )
    return F.map_filter(full, lambda k, v: v.isNotNull())

