"""Meter history as stored summaries: a new chunk of time reads itself only.

A key's history up to the end of a chunk is one row: its last offset sum, and
the count, first and last mark and three decayed rates of its meter at the
chunk's last tick. These rows form a monoid: a chunk's own summary, made by
plain aggregates, is merged onto the row before it by decaying that row's rates
over the chunk. ``advance`` merges one chunk, ``summaries`` reduces and
merges many at once as a prefix scan, with the same expressions.

Stored under ``chunk=N``, the rows let the next chunk be computed from its own
scrapes and one row per key, and a stream start where batch ended
(``streaming.jobs.meter_stream(initial=...)``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lagscope.functions import ewma
from lagscope.operators import meters as M
from lagscope.operators.meters import ProduceGrid

RATES = tuple(zip(("r1", "r5", "r15"), ewma.LAMBDAS, ewma.ALPHAS))
#: What a state has beside its keys: the last scrape and its sum; null until
#: the first mark: meter creation, count, last mark and the decayed rates.
STATE = ("last_ts timestamp, last_total bigint, t_first double, k_first bigint, count bigint, "
         "t_last double, r1 double, r5 double, r15 double")
_FIELDS = [f.split()[0] for f in STATE.split(", ")]


def _ticks(chunk_seconds: int) -> int:
    if chunk_seconds % ewma.TICK_SECONDS:
        raise ValueError("chunk_seconds must be a multiple of the tick")
    return chunk_seconds // ewma.TICK_SECONDS


def _chunk(chunk_seconds: int) -> Column:
    return F.floor(F.unix_micros("scrape_ts") / (chunk_seconds * 1_000_000))


def _marks(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Marks with their tick; a sum without one before it has a null delta.
    ``sums`` may hold a carried sum per key (``carried``), which marks nothing."""
    w = Window.partitionBy(*keys).orderBy("scrape_ts", F.col("carried").desc())
    return (sums.select("*", (F.col("total") - F.lag("total").over(w)).alias("d"))
            .where(~F.col("carried"))
            .withColumn("t", F.unix_micros("scrape_ts") / 1e6)
            .withColumn("k", F.floor(F.col("t") / ewma.TICK_SECONDS) + 1))


def _summary(marks: DataFrame, by: list[str], end_tick: Column) -> DataFrame:
    """A chunk's own element: as if its first tick were not a meter's first,
    with what must be added if it is (``f*``). A tick's marks are summed first,
    so that the first tick is one row."""
    tick = marks.groupBy(*by, "k").agg(
        F.sum("d").alias("d"), F.min(F.when(F.col("d").isNotNull(), F.col("t"))).alias("t0"),
        F.max(F.when(F.col("d").isNotNull(), F.col("t"))).alias("t1"),
        F.max(F.struct("scrape_ts", "total")).alias("last"))
    x = F.col("d") / ewma.TICK_SECONDS
    marked = F.when(F.col("d").isNotNull(), F.col("k"))
    aggs = [F.max("last").alias("last"), F.sum("d").alias("count"), F.min("t0").alias("t_first"),
            F.min(marked).alias("k_first"), F.max("t1").alias("t_last")]
    for n, lam, alpha in RATES:
        decayed = x * F.exp(-lam * (end_tick - F.col("k")))
        aggs += [F.sum(alpha * decayed).alias(n), F.min_by((1 - alpha) * decayed, marked).alias(f"f{n}")]
    return tick.groupBy(*by).agg(*aggs)


def _merged(before: str, own: str, decay: int) -> list[Column]:
    """State columns of ``own``'s element merged onto state ``before``, whose
    rates lie ``decay`` ticks back."""
    b, o = (lambda c: F.col(f"{before}.{c}")), (lambda c: F.col(f"{own}.{c}"))
    first = b("count").isNull()
    out = [F.coalesce(o("last")["scrape_ts"], b("last_ts")).alias("last_ts"),
           F.coalesce(o("last")["total"], b("last_total")).alias("last_total"),
           F.coalesce(b("t_first"), o("t_first")).alias("t_first"),
           F.coalesce(b("k_first"), o("k_first")).alias("k_first"),
           F.when(first & o("count").isNull(), None)
           .otherwise(F.coalesce(b("count"), F.lit(0)) + F.coalesce(o("count"), F.lit(0))).cast("bigint").alias("count"),
           F.coalesce(o("t_last"), b("t_last")).alias("t_last")]
    for n, lam, _ in RATES:
        new = F.coalesce(o(n), F.lit(0.0)) + F.when(first, F.coalesce(o(f"f{n}"), F.lit(0.0))).otherwise(0.0)
        out.append(F.when(first & o("count").isNull(), None).otherwise(
            F.coalesce(b(n), F.lit(0.0)) * float(ewma.np.exp(-lam * decay)) + new).alias(n))
    return out


def _same(keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"b.{k}").eqNullSafe(F.col(f"o.{k}"))
    return cond


def advance(state: DataFrame, sums: DataFrame, keys: list[str], chunk: int, chunk_seconds: int) -> DataFrame:
    """The state at the end of chunk ``chunk`` from the one at its start and
    the sums ``(keys, scrape_ts, total)`` of the chunk alone."""
    tpc = _ticks(chunk_seconds)
    rows = with_carried(state, sums, keys)
    own = _summary(_marks(rows, keys), keys, F.lit((chunk + 1) * tpc))
    return (state.alias("b").join(own.alias("o"), _same(keys), "full")
            .select(*[F.coalesce(f"b.{k}", f"o.{k}").alias(k) for k in keys], *_merged("b", "o", tpc)))


def with_carried(state: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """A chunk's sums and, before them, the last one of each key."""
    carried = state.select(*keys, F.col("last_ts").alias("scrape_ts"), F.col("last_total").alias("total"),
                           F.lit(True).alias("carried"))
    return sums.select(*keys, "scrape_ts", "total", F.lit(False).alias("carried")).unionByName(carried)


def snapshots(state: DataFrame, sums: DataFrame, keys: list[str], grid: ProduceGrid, chunk: int,
              chunk_seconds: int) -> DataFrame:
    """Meters at the produce instants of chunk ``chunk``, from the state at its
    start and its own sums; a task holds one key's chunk."""
    types = {f.name: f.dataType for f in sums.schema.fields}
    schema = M._snapshot_schema(keys, types)
    marks = _marks(with_carried(state, sums, keys), keys).where(F.col("d").isNotNull())
    both = state.select(*keys).unionByName(sums.select(*keys)).distinct()
    start = (both.alias("o").join(state.where(F.col("count").isNotNull()).alias("b"), _same(keys), "left")
             .select(*[f"o.{k}" for k in keys], F.lit(chunk).alias("c"), F.lit(1).alias("is_state"), "t_first",
                     "k_first", F.col("count").alias("count_before"), F.col("t_last").alias("t_last_before"),
                     "r1", "r5", "r15"))
    rows = marks.select(*keys, F.lit(chunk).alias("c"), "t", "d", F.lit(0).alias("is_state")).unionByName(
        start, allowMissingColumns=True)
    return rows.groupBy(*keys).applyInPandas(M.chunk_kernel(keys, grid, chunk_seconds, schema), schema=schema)


class MeterStore:
    """States under ``root/chunk=N``, each written once."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], chunk_seconds: int = 86_400):
        _ticks(chunk_seconds)
        self.spark, self.root, self.keys, self.chunk_seconds = spark, root.rstrip("/"), keys, chunk_seconds

    def _schema(self) -> str:
        return ", ".join([*(f"{k} string" for k in self.keys), STATE])

    def state(self, chunk: int | None) -> DataFrame:
        """The state at the end of ``chunk`` (None: nothing has happened yet)."""
        if chunk is None:
            return self.spark.createDataFrame([], self._schema())
        return self.spark.read.schema(self._schema()).parquet(f"{self.root}/chunk={chunk}")

    def add(self, sums: DataFrame, chunk: int, after: int | None, grid: ProduceGrid) -> DataFrame:
        """Stores the state of ``chunk``, whose sums are given and which follows
        chunk ``after``, and gives its snapshots. Chunks without sums in
        between would have to be added, too, if they hold produce instants."""
        before = self.state(after)
        (advance(before, sums, self.keys, chunk, self.chunk_seconds)
         .select(*self.keys, *_FIELDS).write.mode("overwrite").parquet(f"{self.root}/chunk={chunk}"))
        return snapshots(before, sums, self.keys, grid, chunk, self.chunk_seconds)
