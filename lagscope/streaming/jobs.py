"""Structured Streaming jobs over landed scrape files.

Input contract: snapshot tables are landed in slices of scrape time, one after
the other, each written by as many tasks as it needs.  The files of a slice
may reach a stream over several triggers, so watermarks trail by the span of a
slice (``Landing.delay``) and the stateful jobs collect a scrape's rows until
the watermark has passed it.  The group pass is driven by a stream of scrape
times.  Every stream runs in a session of its own, so its settings touch no
other; all of them write Parquet with a checkpoint in the cluster's shared
folder and run continuously or with ``availableNow`` (tests, backfills).

* ``gauge_stream``      stateless: the batch gauge projection per row;
* ``lag_stream``        ``foreachBatch``: the batch's scrapes joined with the
                        group tables, published once per batch id;
* ``meter_stream``      ``transformWithStateInPandas`` meters per key;
* ``carry_forward_stream`` all gauges of a key re-emitted at each produce instant;
* ``produce_window_stream`` last value per series per tumbling window.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from lagscope import schemas as S
from lagscope.operators import gauges as G, groups as GR, meters as M
from lagscope.operators.meters import ProduceGrid
from lagscope.session import checkpoint_dir
from lagscope.streaming.processors import CarryForwardProcessor, MeterProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session for one stream.  ``transformWithState`` needs a state store
    with column families (RocksDB), which also keeps keyed state off the JVM
    heap.  A stateful query keeps its number of state partitions for life and
    AQE does not coalesce them, so it is the cluster's task slots, not a batch
    setting."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.shuffle.partitions", str(max(1, spark.sparkContext.defaultParallelism)))
    return own


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    return f"{checkpoint_dir(spark).rstrip('/')}/lagscope-streams/{name}-{uuid.uuid4().hex[:12]}"


@dataclass(frozen=True)
class Landing:
    """Slices of ``span`` seconds of scrape time from ``start`` (epoch) on."""
    start: float
    span: float
    slices: int

    @property
    def delay(self) -> str:
        return f"{int(-(-self.span // 1))} seconds"

    @staticmethod
    def over(df: DataFrame, slices: int, ts_col: str = "scrape_ts") -> "Landing":
        us = F.unix_micros(ts_col)
        lo, hi = df.agg(F.min(us), F.max(us)).first()
        if lo is None:
            return Landing(0.0, 1.0, 0)
        return Landing(lo / 1e6, max(1.0, (hi - lo) / 1e6 / slices), slices)

    def slice_of(self, ts_col: str):
        at = F.floor((F.unix_micros(ts_col) / 1e6 - self.start) / self.span)
        return F.greatest(F.lit(0), F.least(at, F.lit(self.slices - 1)))


def land(df: DataFrame, path: str, landing: Landing, ts_col: str = "scrape_ts") -> str:
    """Append a snapshot table slice by slice, in scrape order, each slice by
    several tasks.  The table is computed once and cut from a checkpoint; file
    modification times follow the slices, the order in which a file stream
    source picks them up."""
    checkpoint_dir(df.sparkSession)
    ready = df.checkpoint(eager=True)
    for i in range(landing.slices):
        ready.where(landing.slice_of(ts_col) == i).write.mode("append").parquet(path)
    return path


def land_row(spark: SparkSession, row: tuple, schema, path: str) -> None:
    """Append one row, such as a closing scrape that moves the watermark."""
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    r = stream_session(spark).readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def _run(writer, available_now: bool = True):
    q = writer.trigger(availableNow=True).start() if available_now else writer.start()
    if available_now:
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
    return q


def gauge_stream(tp_stream: DataFrame, out: str, ckpt: str, available_now: bool = True):
    gauges = G.partition_gauges(tp_stream)
    w = gauges.writeStream.format("parquet").option("checkpointLocation", ckpt).option("path", out)
    return _run(w.outputMode("append"), available_now)


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hp = jvm.org.apache.hadoop.fs.Path(path)
    return hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hp


def _path_exists(spark: SparkSession, path: str) -> bool:
    fs, hp = _path(spark, path)
    return fs.exists(hp)


def publish(df: DataFrame, root: str, batch_id: int) -> None:
    """Make a batch's rows visible under ``batch_id=N`` at once and only once:
    they are written beside, and the folder is renamed.  A replayed batch
    finds its folder and leaves it, so a stream that reads the folders never
    sees a row twice or a file vanish."""
    spark, target = df.sparkSession, f"{root}/batch_id={batch_id}"
    if _path_exists(spark, target):
        return
    staging = f"{root}/_staging-{batch_id}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(staging)
    fs, src = _path(spark, staging)
    if not fs.rename(src, _path(spark, target)[1]):
        raise OSError(f"could not publish {target}")


def _batches(spark: SparkSession, root: str) -> list[int]:
    """Ids of the batches published under ``root``."""
    fs, hp = _path(spark, root)
    names = [f.getPath().getName() for f in fs.listStatus(hp)] if fs.exists(hp) else []
    return [int(n.split("=")[1]) for n in names if n.startswith("batch_id=")]


COMMIT_KEYS = ["group_id", "topic", "partition"]
#: A commit may become visible this long after later ones.
COMMIT_LATENESS_SECONDS = 3600


def commits_for_batch(spark: SparkSession, commits: DataFrame, state_root: str, batch_id: int,
                      latest, lateness: int = COMMIT_LATENESS_SECONDS) -> DataFrame:
    """Commits needed to answer a micro-batch whose latest scrape is ``latest``:
    the latest commit per partition carried by the newest batch before that
    had rows, plus the commits since that batch's horizon less ``lateness``.
    Written to the checkpoint folder so the batch's plans read it once.
    (``streaming.commits`` takes commits as a stream, without a lateness.)"""
    older = [b for b in _batches(spark, state_root) if b < batch_id]
    if older:
        carried = spark.read.parquet(f"{state_root}/batch_id={max(older)}")
        horizon = carried.agg(F.max("horizon")).first()[0]
        since = F.timestamp_seconds(F.unix_seconds(F.lit(horizon)) - lateness)
        columns = ["commit_ts", *COMMIT_KEYS, "offset"]
        fresh = between(commits, since, latest, "commit_ts").select(*columns)
        known = carried.where(F.col("commit_ts").isNotNull()).select(*columns).unionByName(fresh)
    else:
        known = commits.where(F.col("commit_ts") <= F.lit(latest))
    return known.checkpoint(eager=True)


def save_commit_state(known: DataFrame, state_root: str, batch_id: int, latest) -> None:
    """Latest commit per partition up to ``latest``, for the next batch (and a
    row without one, for the horizon).  States before the last two are
    dropped: a batch can only be replayed from its predecessor's."""
    spark = known.sparkSession
    rows = (known.groupBy(*COMMIT_KEYS).agg(F.max(F.struct("commit_ts", "offset")).alias("c"))
            .select(*COMMIT_KEYS, "c.offset", "c.commit_ts"))
    none = spark.range(1).select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    publish(rows.unionByName(none).withColumn("horizon", F.lit(latest).cast("timestamp")), state_root, batch_id)
    for b in sorted(b for b in _batches(spark, state_root) if b <= batch_id)[:-2]:
        fs, old = _path(spark, f"{state_root}/batch_id={b}")
        fs.delete(old, True)


def between(df: DataFrame, lo, hi, ts_col: str = "scrape_ts") -> DataFrame:
    """The rows of a span of time; the bounds reach the scan, and prune
    date folders where the table has them."""
    out = df.where((F.col(ts_col) >= F.lit(lo)) & (F.col(ts_col) <= F.lit(hi)))
    day = ts_col.replace("_ts", "_date")
    if day in df.columns:
        out = out.where((F.col(day) >= F.to_date(F.lit(lo))) & (F.col(day) <= F.to_date(F.lit(hi))))
    return out


def batch_inputs(batch: DataFrame, batch_id: int, listings: DataFrame, topic_partitions: DataFrame,
                 descriptions: DataFrame, commits: DataFrame, state_root: str):
    """Of a batch of scrape times: partition rows and lag rows of its scrapes,
    the commits known to it, its latest scrape."""
    scrapes = batch.select("scrape_ts").distinct()
    lo, hi = batch.agg(F.min("scrape_ts"), F.max("scrape_ts")).first()
    known = commits_for_batch(batch.sparkSession, commits, state_root, batch_id, hi)
    of = lambda df: between(df, lo, hi).join(scrapes, "scrape_ts", "left_semi")
    tp = of(topic_partitions)
    lags = GR.lag_rows(GR.committed_offset_scan(
        GR.assigned_partitions(of(listings), of(descriptions)), known), tp)
    return tp, lags, known, hi


def lag_stream(scrape_stream: DataFrame, listings: DataFrame, topic_partitions: DataFrame,
               descriptions: DataFrame, commits: DataFrame, out: str, ckpt: str, available_now: bool = True):
    """The group pass, driven by the stream of scrape times (each landed after
    that scrape's partition and group tables).

    Per micro-batch N: reads of the tables are bounded by the batch's scrapes;
    committed offsets come from ``commits_for_batch``, so a batch never
    re-reads the commit history.  Rows and the carried commits are published
    once under ``batch_id=N``."""
    state_root = f"{out}/_commit_state"

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        _tp, lags, known, latest = batch_inputs(batch, batch_id, listings, topic_partitions, descriptions,
                                                commits, state_root)
        publish(lags, out, batch_id)
        save_commit_state(known, state_root, batch_id, latest)

    w = scrape_stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", ckpt)
    return _run(w, available_now)


def _meter_schema(keys: list[str], types: dict) -> str:
    cols = [f"{k} {types[k]}" for k in keys]
    cols += ["produce_ts timestamp", "count bigint", "rate1 double", "rate5 double",
             "rate15 double", "rate_mean double"]
    return ", ".join(cols)


def meter_stream(stream: DataFrame, keys: list[str], value_col: str, grid: ProduceGrid,
                 out: str, ckpt: str, available_now: bool = True, initial: DataFrame | None = None,
                 initial_end: float | None = None):
    """Meters keyed by ``keys`` from per-partition rows of each scrape;
    ``stream`` has its watermark on ``scrape_ts``. ``initial``: a state of
    ``operators.meter_store`` at time ``initial_end``, from where on the
    stream's scrapes go on; nothing before it is replayed."""
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    proc = MeterProcessor(keys, value_col, grid.start, grid.interval, grid.count)
    start = None if initial is None else initial.withColumn("end", F.lit(float(initial_end))).groupBy(*keys)
    snaps = (stream.select(*keys, "scrape_ts", value_col)
             .groupBy(*keys)
             .transformWithStateInPandas(proc, _meter_schema(keys, types), "Append", "EventTime", initialState=start))
    w = snaps.writeStream.format("parquet").option("checkpointLocation", ckpt).option("path", out)
    return _run(w.outputMode("append"), available_now)


CARRY_KEYS = ["group_id", "topic", "partition"]


def carry_forward_stream(gauges: DataFrame, grid: ProduceGrid, out: str, ckpt: str,
                         available_now: bool = True):
    """``gauges``: streaming long-form gauge rows (``timestamp`` = scrape time,
    with its watermark).

    All gauges of a (group, topic, partition) share one state and one timer.
    They are grouped with the partition as a string: a nullable integer
    grouping column would reach the Python state handler as a float whenever a
    batch mixes null and non-null partitions (topic-level and partition-level
    gauges), and the state key would not round-trip."""
    flat = gauges.select("name", F.col("meta.group").alias("group_id"),
                         F.col("meta.topic").alias("topic"),
                         F.col("meta.partition").cast("string").alias("partition"),
                         F.col("timestamp").alias("scrape_ts"), "value")
    proc = CarryForwardProcessor(CARRY_KEYS, grid.start, grid.interval, grid.count)
    schema = ("group_id string, topic string, partition string, name string, "
              "produce_ts timestamp, value bigint")
    snaps = (flat.groupBy(*CARRY_KEYS)
             .transformWithStateInPandas(proc, schema, "Append", "EventTime")
             .withColumn("partition", F.col("partition").cast("int")))
    w = snaps.writeStream.format("parquet").option("checkpointLocation", ckpt).option("path", out)
    return _run(w.outputMode("append"), available_now)


def produce_window(gauges: DataFrame, seconds: int) -> DataFrame:
    """Last value of each series in each tumbling window of ``seconds``
    (batch or streaming; streaming needs a watermark on ``timestamp``)."""
    return (gauges.groupBy(F.window("timestamp", f"{seconds} seconds").alias("w"), "name", "key")
            .agg(F.max(F.struct("timestamp", "value"))["value"].alias("value"))
            .select(F.col("w.start").alias("window_start"), "name", "key", "value"))


def produce_window_stream(gauges: DataFrame, seconds: int, out: str, ckpt: str,
                          available_now: bool = True):
    agg = produce_window(gauges, seconds)
    w = agg.writeStream.format("parquet").option("checkpointLocation", ckpt).option("path", out)
    return _run(w.outputMode("append"), available_now)


def topic_meter_stream(tp_stream: DataFrame, grid: ProduceGrid, out: str, ckpt: str, **kw):
    return meter_stream(tp_stream, M.TOPIC_KEYS, "newest_offset", grid, out, ckpt, **kw)


TP_SCHEMA = S.TOPIC_PARTITIONS
SCRAPE_SCHEMA = "scrape_ts timestamp"
