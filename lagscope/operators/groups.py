"""Consumer groups: listing, description, assignment, committed offsets, lag.

The chain per scrape is listing → description (stable consumer groups only)
→ exploded assignment (distinct partitions) → committed offset → lag against
the partition's newest offset.  Every step is a set operation keyed on
(scrape_ts, group_id[, topic, partition]); nothing is looked up per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lagscope import schemas as S
from lagscope.functions.columns import meta, metric_key


def group_listing_union(listings: DataFrame) -> DataFrame:
    """Groups listed by any broker at each scrape (a group listed by two
    brokers is described once)."""
    return listings.select("scrape_ts", "group_id").distinct()


def group_description_scan(listings: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Descriptions of the listed groups (equi-join on scrape and group)."""
    return group_listing_union(listings).join(descriptions, ["scrape_ts", "group_id"])


def stable_consumer_filter(descriptions: DataFrame) -> DataFrame:
    """Only groups that are ``Stable`` and speak the ``consumer`` protocol."""
    return descriptions.where((F.col("state") == S.STABLE_STATE)
                              & (F.col("protocol_type") == S.CONSUMER_PROTOCOL))


def assignment_collect(descriptions: DataFrame) -> DataFrame:
    """Partitions assigned to a group's members, each partition once."""
    return (
        descriptions.select("scrape_ts", "group_id", F.explode("members").alias("m"))
        .select("scrape_ts", "group_id", F.explode("m.assignment").alias("topic", "parts"))
        .select("scrape_ts", "group_id", "topic", F.explode("parts").alias("partition"))
        .distinct()
    )


def assigned_partitions(listings: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Listed → described → stable consumer → assigned partitions."""
    return assignment_collect(stable_consumer_filter(group_description_scan(listings, descriptions)))


def group_assignment_join(assigned: DataFrame, commits: DataFrame) -> DataFrame:
    """Committed offsets of assigned partitions when commits are stamped per
    scrape: equi left join; a partition without a commit reads −1.  Commits of
    unassigned partitions never enter (semi-join effect); of several commits
    of one partition and instant the largest offset counts."""
    c = (commits.groupBy(F.col("commit_ts").alias("scrape_ts"), "group_id", "topic", "partition")
         .agg(F.max("offset").alias("committed")))
    return (assigned.join(c, ["scrape_ts", "group_id", "topic", "partition"], "left")
            .select("scrape_ts", "group_id", "topic", "partition",
                    F.coalesce("committed", F.lit(-1).cast("bigint")).alias("committed")))


def committed_offset_scan(assigned: DataFrame, commits: DataFrame,
                          bucket_seconds: int = 60) -> DataFrame:
    """Latest commit at or before each scrape (backward as-of), −1 if none.
    Commits are ordered by (commit_ts, offset), so equal times have one answer.

    Exact and safe when one partition holds a large share of all commits:
    commits are split into time buckets of ``bucket_seconds``.

    * same bucket: scrapes join the commits of their own (partition, bucket)
      on equality and keep the latest with ``commit_ts <= scrape_ts``;
    * earlier buckets: each (partition, bucket) is first reduced to its latest
      commit; a ``last(ignorenulls)`` over these summaries and the scrape rows,
      ordered by bucket with scrapes before the summary of their own bucket,
      gives the latest commit of any earlier bucket.

    The window sees one row per bucket and scrape (bounded by time, not by
    commit volume); the equi-join is keyed by (partition, bucket), so a hot
    partition is spread over many tasks.  No range join.
    """
    keys = ["group_id", "topic", "partition"]
    step = bucket_seconds * 1_000_000
    a = assigned.select("scrape_ts", *keys, F.unix_micros("scrape_ts").alias("s_us"))
    a = a.withColumn("b", F.floor(F.col("s_us") / step))
    c = commits.select(*keys, F.unix_micros("commit_ts").alias("c_us"), "offset")
    c = c.withColumn("b", F.floor(F.col("c_us") / step))

    within = (a.join(c, [*keys, "b"])
              .where(F.col("c_us") <= F.col("s_us"))
              .groupBy("scrape_ts", *keys)
              .agg(F.max(F.struct("c_us", "offset"))["offset"].alias("o_within")))

    summary = c.groupBy(*keys, "b").agg(F.max(F.struct("c_us", "offset"))["offset"].alias("o"))
    rows = a.select(*keys, "b", "scrape_ts", F.lit(None).cast("bigint").alias("o"),
                    F.lit(1).alias("is_scrape")).unionByName(
        summary.select(*keys, "b", F.lit(None).cast("timestamp").alias("scrape_ts"), "o",
                       F.lit(0).alias("is_scrape")))
    w = (Window.partitionBy(*keys).orderBy("b", F.col("is_scrape").desc())
         .rowsBetween(Window.unboundedPreceding, 0))
    earlier = (rows.select(*keys, "scrape_ts", "is_scrape",
                           F.last("o", ignorenulls=True).over(w).alias("o_before"))
               .where(F.col("is_scrape") == 1).drop("is_scrape"))

    return (earlier.join(within, ["scrape_ts", *keys], "left")
            .select("scrape_ts", *keys,
                    F.coalesce("o_within", "o_before", F.lit(-1).cast("bigint")).alias("committed")))


def lag_rows(committed: DataFrame, tp: DataFrame) -> DataFrame:
    """committed ⋈ newest on (scrape, topic, partition), left outer: a topic
    missing from the metadata reads newest 0.  Lag may be negative."""
    newest = tp.select("scrape_ts", "topic", "partition", "newest_offset")
    return (committed.join(newest, ["scrape_ts", "topic", "partition"], "left")
            .select("scrape_ts", "group_id", "topic", "partition", "committed",
                    (F.coalesce("newest_offset", F.lit(0).cast("bigint")) - F.col("committed"))
                    .alias("lag")))


def _group_gauge(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.select(
        F.lit("gauge").alias("kind"), F.lit(name).alias("name"),
        metric_key("group_id", "topic", "partition").alias("key"),
        F.col("scrape_ts").alias("timestamp"),
        meta(group="group_id", partition="partition", topic="topic").alias("meta"),
        F.col(value).cast("bigint").alias("value"),
    )


def consumer_group_lag_gauge(lags: DataFrame) -> DataFrame:
    return _group_gauge(lags, S.GROUP_LAG, "lag")


def consumer_group_latest_offset_gauge(lags: DataFrame) -> DataFrame:
    return _group_gauge(lags, S.GROUP_LATEST_OFFSET, "committed")


def group_gauge_values() -> dict[str, Column]:
    """Gauge name → value expression over one lag row."""
    return {S.GROUP_LAG: F.col("lag"), S.GROUP_LATEST_OFFSET: F.col("committed")}


def group_gauges(lags: DataFrame) -> DataFrame:
    """Both group gauges from one pass over the lag rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in group_gauge_values().items()])
    ex = lags.select("scrape_ts", "group_id", "topic", "partition", F.explode(pairs).alias("g"))
    return ex.select(
        F.lit("gauge").alias("kind"), F.col("g.name").alias("name"),
        metric_key("group_id", "topic", "partition").alias("key"),
        F.col("scrape_ts").alias("timestamp"),
        meta(group="group_id", partition="partition", topic="topic").alias("meta"),
        F.col("g.value").cast("bigint").alias("value"),
    )
