"""Sink delivery: ``foreachBatch`` runner and writers.

``batch_sink(render, deliver)`` returns the function handed to
``writeStream.foreachBatch``: each micro-batch of metric rows is rendered
(a projection, on the executors) and delivered.  Error policy:

* ``on_error="fail"`` (default): the exception propagates, the query stops
  and restarts from its checkpoint, so a batch is never lost;
* ``on_error="drop"``: log and drop the batch, then continue (the behaviour of
  a fire-and-forget metrics daemon).

Writers deliver from the executors (``DataFrame.write`` / a Python data
source), never by collecting a batch on the driver.
"""

from __future__ import annotations

import importlib
import logging
from typing import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceStreamWriter, DataSourceWriter,
                                    WriterCommitMessage)
from pyspark.sql.types import (DoubleType, LongType, MapType, StringType, StructField, StructType,
                               TimestampType)

from lagscope import schemas as S

log = logging.getLogger("lagscope.sinks")

Render = Callable[[DataFrame], DataFrame]
Deliver = Callable[[DataFrame, int], None]


class BatchSink:
    """The function handed to ``foreachBatch``, and its end: ``close`` runs the
    hook once, after the last batch."""

    def __init__(self, render: Render, deliver: Deliver, on_error: str, on_close: Callable[[], None] | None):
        if on_error not in ("fail", "drop"):
            raise ValueError("on_error must be 'fail' or 'drop'")
        self.render, self.deliver, self.on_error, self.on_close = render, deliver, on_error, on_close

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        try:
            self.deliver(self.render(batch), batch_id)
        except Exception:  # noqa: BLE001 - policy decides
            if self.on_error == "drop":
                log.exception("sink batch %s dropped", batch_id)
                return
            raise

    def close(self) -> None:
        hook, self.on_close = self.on_close, None
        if hook is not None:
            hook()

    def __enter__(self) -> "BatchSink":
        return self

    def __exit__(self, *_exc) -> None:
        self.close()


def batch_sink(render: Render, deliver: Deliver, on_error: str = "fail",
               on_close: Callable[[], None] | None = None) -> BatchSink:
    return BatchSink(render, deliver, on_error, on_close)


# --- deliveries -------------------------------------------------------------------

def text_delivery(path: str) -> Deliver:
    """The single string column of a rendered batch as text files of the
    folder ``batch_id=N``; a batch delivered again replaces its folder."""
    def deliver(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").text(f"{path}/batch_id={batch_id}")
    return deliver


def ndjson_delivery(path: str) -> Deliver:
    """Bulk NDJSON: action line followed by document line for every metric, in
    a folder per batch."""
    def deliver(df: DataFrame, batch_id: int) -> None:
        lines = df.select(F.explode(F.array("action", "document")).alias("line"))
        # explode keeps the pair order within a row; rows stay in one task
        lines.write.mode("overwrite").text(f"{path}/batch_id={batch_id}")
    return deliver


def kafka_delivery(bootstrap_servers: str, **options: str) -> Deliver:
    """``(topic, value)`` rows through Spark's Kafka sink (connector jar required)."""
    def deliver(df: DataFrame, batch_id: int) -> None:
        w = df.write.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers)
        for k, v in options.items():
            w = w.option(k, v)
        w.save()
    return deliver


def writer_delivery(target: str, **options: str) -> Deliver:
    """Hand writer records to a user function ``module:function`` on the
    executors; ``options`` are passed to it as keyword arguments."""
    def deliver(df: DataFrame, batch_id: int) -> None:
        w = df.write.format(MetricWriterDataSource.name()).option("writer", target).option("batch_id", batch_id)
        for k, v in options.items():
            w = w.option(k, v)
        w.mode("append").save()
    return deliver


# --- custom writer as a Python data source ------------------------------------------

WRITER_SCHEMA = StructType([
    StructField("kind", StringType()), StructField("name", StringType()),
    StructField("timestamp", TimestampType()),
    StructField("meta", MapType(StringType(), StringType())),
    StructField("value", LongType()), StructField("count", LongType()),
    StructField("rate1", DoubleType()), StructField("rate5", DoubleType()),
    StructField("rate15", DoubleType()), StructField("rate_mean", DoubleType()),
])


def resolve(target: str) -> Callable[[Iterator[Row]], object]:
    mod, _, fn = target.partition(":")
    return getattr(importlib.import_module(mod), fn)


class _Commit(WriterCommitMessage):
    def __init__(self, n: int, token: object = None):
        self.n, self.token = n, token


def _two_phase(plugin: object) -> bool:
    return hasattr(plugin, "stage") and hasattr(plugin, "commit")


def _finish(options: dict, messages: list, batch_id: int | None, phase: str) -> None:
    """Second phase, on the driver: the tokens of the tasks that count (a
    failed or repeated attempt's token is in no message)."""
    plugin = resolve(options["writer"])
    if _two_phase(plugin) and hasattr(plugin, phase):
        rest = {k: v for k, v in options.items() if k not in ("writer", "batch_id")}
        if batch_id is None:
            batch_id = int(options["batch_id"]) if "batch_id" in options else None
        getattr(plugin, phase)([m.token for m in messages if m is not None], batch_id, **rest)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.options = options
        self.target = options["writer"]
        self.kwargs = {k: v for k, v in options.items() if k not in ("writer", "batch_id")}

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        seen = [0]

        def counted():
            for r in iterator:
                seen[0] += 1
                yield r
        plugin = resolve(self.target)
        if _two_phase(plugin):
            token = plugin.stage(counted(), **self.kwargs)
            return _Commit(seen[0], token)
        plugin(counted(), **self.kwargs)
        return _Commit(seen[0])

    def commit(self, messages) -> None:
        _finish(self.options, messages, None, "commit")

    def abort(self, messages) -> None:
        _finish(self.options, messages, None, "abort")


class _StreamWriter(DataSourceStreamWriter):
    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        return _Writer(self.options).write(iterator)

    def commit(self, messages, batchId) -> None:
        _finish(self.options, messages, batchId, "commit")

    def abort(self, messages, batchId) -> None:
        _finish(self.options, messages, batchId, "abort")


class MetricWriterDataSource(DataSource):
    """``df.write.format("lagscope_writer").option("writer", "pkg.mod:fn")``.

    ``fn(rows, **options)`` receives an iterator of writer records (one call
    per partition, on the executor holding it): name, timestamp, meta as
    strings, and either ``value`` or ``count`` + rates, plus the other write
    options.  The metric key is not passed on.

    A function delivers as it goes, so a task that is run twice delivers
    twice. For exactly-once delivery the target is an object with two phases:
    ``stage(rows, **options)`` on the executor puts a partition's records where
    no reader sees them and returns a token (plain data); ``commit(tokens,
    batch_id, **options)`` on the driver makes the tokens of the tasks that
    count visible, at once and once per batch id; ``abort(tokens, batch_id,
    **options)``, if there is one, throws them away.
    """

    @classmethod
    def name(cls) -> str:
        return "lagscope_writer"

    def schema(self):
        return WRITER_SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(dict(self.options))


def register_writer_source(spark) -> None:
    """Make the writer known to a session; sessions may share their sources."""
    try:
        spark.dataSource.register(MetricWriterDataSource)
    except AnalysisException as e:
        if e.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise


KNOWN_SINKS = ("log", "kafka", "elasticsearch", "collectd", "influxdb", "writer")


def renderer(name: str, **kw) -> Render:
    """Sink name → rendering projection; an unknown name is an error."""
    from lagscope.sinks import render as R
    table = {
        "log": R.log_lines,
        "kafka": lambda df: R.kafka_json(df, kw.get("topic", S.DEFAULT_TOPIC)),
        "elasticsearch": lambda df: R.elasticsearch_docs(df, kw.get("index", S.DEFAULT_INDEX)),
        "collectd": lambda df: R.collectd_lines(df, kw.get("hostname", "localhost"),
                                                kw.get("interval", S.DEFAULT_INTERVAL_SECONDS)),
        "influxdb": R.influx_lines,
        "writer": R.writer_records,
    }
    if name not in table:
        raise ValueError(f"unknown sink {name!r}; known: {', '.join(KNOWN_SINKS)}")
    return table[name]
