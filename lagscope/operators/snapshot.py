"""Registry view of the metrics: latest value per series and carried-forward
snapshots at produce instants.

A series is identified by (name, group, topic, partition); once seen it is
reported at every later produce instant with its last value, even after its
topic or group disappears.  The as-of is done without joining instants to
observations: each observation covers the produce instants up to the next
observation of its series (``lead``), and expands into exactly those
instants.  Output size is series × instants, the size of the answer.

Gauges of one source row are carried together (``carry``): the window sees the
wide rows, and they become long only after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lagscope.functions.columns import meta, metric_key
from lagscope.operators.meters import ProduceGrid

IDENTITY = ["name", "meta.group", "meta.topic", "meta.partition"]


def _identity_cols():
    return [F.col("name"), F.col("meta.group").alias("_g"), F.col("meta.topic").alias("_t"),
            F.col("meta.partition").alias("_p")]


def registry_latest(gauges: DataFrame) -> DataFrame:
    """Last observed value per series (the registry after the last scrape)."""
    latest = (
        gauges.select(*_identity_cols(), "kind", "key", "meta", "timestamp", "value")
        .groupBy("name", "_g", "_t", "_p")
        .agg(F.max_by(F.struct("kind", "key", "meta", "timestamp", "value"), "timestamp").alias("r"))
    )
    return latest.select("r.kind", "name", "r.key", "r.timestamp", "r.meta", "r.value")


def snapshot_asof(gauges: DataFrame, grid: ProduceGrid) -> DataFrame:
    """Every series ever seen, with its last value, at each produce instant."""
    ident = ["name", "_g", "_t", "_p"]
    obs = gauges.select(*_identity_cols(), "kind", "key", "meta", "value",
                        F.unix_micros("timestamp").alias("us"))
    w = Window.partitionBy(*ident).orderBy("us")
    start_us, step_us = grid.start * 1_000_000, grid.interval * 1_000_000
    # first produce index at or after this observation, and at or after the next one
    first_k = F.greatest(F.ceil((F.col("us") - start_us) / step_us), F.lit(0))
    nxt = F.lead("us").over(w)
    stop_k = F.when(nxt.isNull(), F.lit(grid.count)).otherwise(
        F.least(F.ceil((nxt - start_us) / step_us), F.lit(grid.count)))
    spans = obs.select("kind", "key", "meta", "value", first_k.alias("k0"), stop_k.alias("k1"), *ident)
    spans = spans.where(F.col("k0") < F.col("k1"))
    ticks = spans.select("kind", "name", "key", "meta", "value",
                         F.explode(F.sequence("k0", F.col("k1") - 1)).alias("k"))
    return ticks.select(
        "kind", "name", "key",
        F.timestamp_seconds(F.lit(grid.start) + F.col("k") * grid.interval).alias("timestamp"),
        "meta", "value",
    )


def carry(rows: DataFrame, keys: list[str], parts: dict[str, str], values: dict[str, Column],
          grid: ProduceGrid) -> DataFrame:
    """``snapshot_asof`` of the gauges ``values`` (name -> value) of wide rows,
    one row per ``keys`` and scrape.  ``parts`` names the columns that make the
    key and the meta struct (group, topic, partition).

    A gauge that is null in a row keeps its last value, and is reported from
    its first one on; one window and one shuffle of wide rows carry them all."""
    in_order = Window.partitionBy(*keys).orderBy("_us")
    seen = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start_us, step_us = grid.start * 1_000_000, grid.interval * 1_000_000

    def instant(us: Column) -> Column:   # the first one at or after us; null for null
        k = F.ceil((us - start_us) / step_us)
        return F.when(k < 0, 0).otherwise(k)

    wide = rows.select(*keys, F.unix_micros("scrape_ts").alias("_us"),
                       *[v.alias(f"_v{i}") for i, v in enumerate(values.values())])
    carried = wide.select(
        *keys, instant(F.col("_us")).alias("k0"),
        F.least(F.coalesce(instant(F.lead("_us").over(in_order)), F.lit(grid.count)), F.lit(grid.count)).alias("k1"),
        *[F.last(f"_v{i}", ignorenulls=True).over(seen).alias(f"_v{i}") for i in range(len(values))])
    ticks = carried.where("k0 < k1").select(
        *keys, F.explode(F.sequence("k0", F.col("k1") - 1)).alias("k"), *[f"_v{i}" for i in range(len(values))])
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_v{i}").alias("value"))
                      for i, n in enumerate(values)])
    long = ticks.select(*keys, "k", F.explode(pairs).alias("g")).where(F.col("g.value").isNotNull())
    return long.select(
        F.lit("gauge").alias("kind"), F.col("g.name").alias("name"),
        metric_key(*[parts[p] for p in ("group", "topic", "partition") if p in parts]).alias("key"),
        F.timestamp_seconds(F.lit(grid.start) + F.col("k") * grid.interval).alias("timestamp"),
        meta(**parts).alias("meta"), F.col("g.value").cast("bigint").alias("value"))


def snapshot_union(gauge_snap: DataFrame, meter_snap: DataFrame) -> DataFrame:
    """Gauges and meters of the same produce instants in one batch."""
    return gauge_snap.unionByName(meter_snap, allowMissingColumns=True)
