"""Offset sums, deltas and the two rate meters.

Raw rows are reduced before anything is shuffled by meter key: the per-scrape
sum is a grouped aggregate (partial on the map side), so the meter step sees
one mark per (key, scrape).  A key's history is then bounded by the number of
scrapes (one a minute is 525,600 a year), not by how much data a topic holds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lagscope import schemas as S
from lagscope.functions import ewma
from lagscope.functions.columns import meta, metric_key
from lagscope.session import checkpoint_dir

TOPIC_KEYS = ["topic"]
GROUP_KEYS = ["group_id", "topic"]


@dataclass(frozen=True)
class ProduceGrid:
    """Snapshot instants ``start + k * interval`` for k = 0 .. count-1 (seconds);
    without a count (streams only) they go on for ever."""
    start: int
    interval: int
    count: int | None = None

    @property
    def end(self) -> int:
        return self.start + self.interval * (self.count - 1)


def topic_offset_sum(tp: DataFrame) -> DataFrame:
    """Sum of newest offsets over a topic's partitions, per scrape."""
    return tp.groupBy("scrape_ts", "topic").agg(F.sum("newest_offset").cast("bigint").alias("total"))


def group_offset_sum(committed: DataFrame) -> DataFrame:
    """Sum of committed offsets (−1 counts as −1) per group, topic and scrape."""
    return committed.groupBy("scrape_ts", "group_id", "topic").agg(
        F.sum("committed").cast("bigint").alias("total"))


def offset_delta(sums: DataFrame, keys: list[str]) -> DataFrame:
    """This scrape's sum minus the previous one of the same key.  The first
    scrape of a key only remembers; a key absent at some scrape simply has
    no row, so the next delta spans the gap."""
    w = Window.partitionBy(*keys).orderBy("scrape_ts")
    return (sums.select(*keys, "scrape_ts", "total",
                        (F.col("total") - F.lag("total").over(w)).alias("delta"))
            .where(F.col("delta").isNotNull()))


def meter_count(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Running total of deltas since the meter was created."""
    w = (Window.partitionBy(*keys).orderBy("scrape_ts")
         .rowsBetween(Window.unboundedPreceding, 0))
    return deltas.select(*keys, "scrape_ts", "delta", F.sum("delta").over(w).alias("count"))


def _snapshot_schema(keys: list[str], key_types: dict[str, T.DataType]) -> T.StructType:
    fields = [T.StructField(k, key_types[k]) for k in keys]
    fields += [
        T.StructField("produce_ts", T.TimestampType()),
        T.StructField("count", T.LongType()),
        T.StructField("rate1", T.DoubleType()),
        T.StructField("rate5", T.DoubleType()),
        T.StructField("rate15", T.DoubleType()),
        T.StructField("rate_mean", T.DoubleType()),
    ]
    return T.StructType(fields)


CHUNK_SECONDS = 7 * 86400


def _carry_horizon(ticks_per_chunk: int) -> int:
    """Chunks after which a rate's contribution is below the double range
    (exp(-745) underflows to 0), for the slowest-decaying rate."""
    return int(np.ceil(745.0 / (min(ewma.LAMBDAS) * ticks_per_chunk))) + 1


def meter_snapshots(deltas: DataFrame, keys: list[str], grid: ProduceGrid,
                    chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Meter state (count, rate1/5/15, mean) at every produce instant from the
    meter's first mark on.  The marks (one per key and scrape) are written
    once to the checkpoint folder; the chunked scan below reads them for its
    summaries and its kernel."""
    marks = deltas.select(*keys, "scrape_ts", "delta")
    checkpoint_dir(deltas.sparkSession)
    return meter_snapshots_chunked(marks.checkpoint(eager=True), keys, grid, chunk_seconds)


def meter_snapshots_chunked(deltas: DataFrame, keys: list[str], grid: ProduceGrid,
                            chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """The EWMA is a linear recurrence, so it is evaluated as a parallel scan
    over time chunks instead of one pass per key:

    1. per (key, chunk): plain aggregates give the chunk's count, last mark
       and its rate contribution at the chunk's last tick (all exponents are
       non-positive);
    2. the rate entering chunk c is the sum of earlier chunks' contributions
       decayed to c's start: each summary is exploded into the next few
       chunks only, since older contributions underflow to 0;
    3. count and last mark before each chunk: running sum / max over one row
       per chunk (as-of over summaries and a chunk spine per key);
    4. ``applyInPandas`` per (key, chunk) runs the kernel from that start
       state over the chunk's marks and produce instants.

    No task holds more than one chunk of one key, however long the history.
    """
    C = int(chunk_seconds)
    if C % ewma.TICK_SECONDS:
        raise ValueError("chunk_seconds must be a multiple of the tick")
    tpc = C // ewma.TICK_SECONDS
    horizon = _carry_horizon(tpc)
    key_types = {f.name: f.dataType for f in deltas.schema.fields}
    schema = _snapshot_schema(keys, key_types)
    rates = list(zip(("r1", "r5", "r15"), ewma.LAMBDAS, ewma.ALPHAS))

    marks = deltas.select(*keys, (F.unix_micros("scrape_ts") / 1e6).alias("t"),
                          F.col("delta").alias("d"))
    marks = (marks.withColumn("k", F.floor(F.col("t") / ewma.TICK_SECONDS) + 1)
             .withColumn("c", F.floor(F.col("t") / C)))
    # ``deltas`` is expected to be materialized (see ``meter_snapshots``):
    # the branches below all read it
    firsts = marks.groupBy(*keys).agg(F.min("t").alias("t_first"), F.min("k").alias("k_first"),
                                      F.min("c").alias("c_first"))
    m = marks.join(firsts, keys)

    # 1. chunk summaries at the chunk's end tick E_c = (c + 1) * tpc
    end_tick = (F.col("c") + 1) * tpc
    contrib = []
    for name, lam, alpha in rates:
        w = F.when(F.col("k") == F.col("k_first"), F.lit(1.0)).otherwise(F.lit(alpha))
        contrib.append(F.sum(w * F.col("d") / ewma.TICK_SECONDS
                             * F.exp(-lam * (end_tick - F.col("k")))).alias(name))
    summ = m.groupBy(*keys, "c").agg(F.sum("d").alias("cnt"), F.max("t").alias("t_last"), *contrib)

    # 2. rates entering chunk c (state at tick c * tpc)
    carry = (summ.select(*keys, "c", *[n for n, _, _ in rates],
                         F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("j"))
             .select(*keys, (F.col("c") + F.col("j")).alias("c"),
                     *[(F.col(n) * F.exp(-lam * tpc * (F.col("j") - 1))).alias(n)
                       for n, lam, _ in rates])
             .groupBy(*keys, "c").agg(*[F.sum(n).alias(n) for n, _, _ in rates]))

    # 3. chunk spine per key and count / last mark before each chunk
    c_end = int(np.floor(grid.end / C))
    spine = firsts.select(*keys, "t_first", "k_first",
                          F.explode(F.sequence("c_first", F.greatest("c_first", F.lit(c_end))))
                          .alias("c"))
    u = spine.select(*keys, "c", "t_first", "k_first", F.lit(None).cast("bigint").alias("cnt"),
                     F.lit(None).cast("double").alias("t_last"), F.lit(0).alias("is_summary")) \
        .unionByName(summ.select(*keys, "c", F.lit(None).cast("double").alias("t_first"),
                                 F.lit(None).cast("bigint").alias("k_first"), "cnt", "t_last",
                                 F.lit(1).alias("is_summary")))
    wk = (Window.partitionBy(*keys).orderBy("c", "is_summary")
          .rowsBetween(Window.unboundedPreceding, 0))
    state = (u.select(*keys, "c", "t_first", "k_first", "is_summary",
                      F.sum("cnt").over(wk).alias("count_before"),
                      F.max("t_last").over(wk).alias("t_last_before"))
             .where(F.col("is_summary") == 0).drop("is_summary")
             .join(carry, [*keys, "c"], "left"))

    # 4. kernel per (key, chunk)
    rows = m.select(*keys, "c", "t", "d", F.lit(0).alias("is_state")).unionByName(
        state.select(*keys, "c", F.lit(1).alias("is_state"), "t_first", "k_first",
                     "count_before", "t_last_before", *[n for n, _, _ in rates]),
        allowMissingColumns=True)
    return rows.groupBy(*keys, "c").applyInPandas(chunk_kernel(keys, grid, C, schema), schema=schema)


def chunk_kernel(keys: list[str], grid: ProduceGrid, chunk_seconds: int, schema: T.StructType):
    """Function of one (key, chunk): its marks and the row of the state that
    enters it (``is_state``) to the snapshots at the chunk's instants."""
    start, step, count, tpc = grid.start, grid.interval, grid.count, chunk_seconds // ewma.TICK_SECONDS

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        st = pdf[pdf["is_state"] == 1]
        if st.empty:                       # marks past the last produce chunk
            return pd.DataFrame({f.name: [] for f in schema.fields})
        st = st.iloc[0]
        mk = pdf[pdf["is_state"] == 0].sort_values("t", kind="stable")
        c = int(st["c"])
        lo = max(0, int(np.ceil((c * chunk_seconds - start) / step)))
        hi = min(count, int(np.ceil(((c + 1) * chunk_seconds - start) / step)))
        instants = start + step * np.arange(lo, max(lo, hi), dtype=np.float64)
        if pd.isna(st["count_before"]):
            state0 = None                  # the meter starts in this chunk
        else:
            state0 = ewma.MeterState(
                float(st["t_first"]), int(st["k_first"]), int(st["count_before"]),
                float(st["t_last_before"]), c * tpc,
                *[0.0 if pd.isna(st[n]) else float(st[n]) for n in ("r1", "r5", "r15")])
        cols, _ = ewma.advance(state0, mk["t"].to_numpy(), mk["d"].to_numpy().astype(np.int64),
                               instants)
        n = len(cols["produce"])
        out = {k: np.repeat(st[k], n) for k in keys}
        out["produce_ts"] = pd.to_datetime((cols["produce"] * 1e6).astype("int64"), unit="us", utc=True)
        for col in ("count", "rate1", "rate5", "rate15", "rate_mean"):
            out[col] = cols[col]
        return pd.DataFrame(out)

    return kernel


def meter_rows(snap: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Snapshot rows in the long ``metrics`` layout."""
    group = "group_id" if "group_id" in keys else None
    return snap.select(
        F.lit("meter").alias("kind"), F.lit(name).alias("name"),
        metric_key(*keys).alias("key"),
        F.col("produce_ts").alias("timestamp"),
        meta(group=group, topic="topic").alias("meta"),
        F.lit(None).cast("bigint").alias("value"),
        "count", "rate1", "rate5", "rate15",
        F.when(~F.isnan("rate_mean"), F.col("rate_mean")).alias("rate_mean"),
    )


def topic_rate_meter(tp: DataFrame, grid: ProduceGrid) -> DataFrame:
    deltas = offset_delta(topic_offset_sum(tp), TOPIC_KEYS)
    return meter_rows(meter_snapshots(deltas, TOPIC_KEYS, grid), S.TOPIC_RATE, TOPIC_KEYS)


def consumer_group_rate_meter(committed: DataFrame, grid: ProduceGrid) -> DataFrame:
    deltas = offset_delta(group_offset_sum(committed), GROUP_KEYS)
    return meter_rows(meter_snapshots(deltas, GROUP_KEYS, grid), S.GROUP_RATE, GROUP_KEYS)
