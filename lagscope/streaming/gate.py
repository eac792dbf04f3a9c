"""Atomic scrapes: a scrape enters the metrics whole or not at all.

A scraper writes, beside the rows of its tables, a manifest: for every scrape
and source the number of rows that source gave. Files land in any order. A
scrape is complete when every source that its manifest names has exactly the
rows it promised; until then none of its rows is used, so a scrape that broke
off midway changes no gauge, and one whose last file comes late enters at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lagscope.streaming.jobs import _path, _run, between, publish

MANIFEST = "scrape_ts timestamp, source string, rows bigint"


def scrape_manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """The manifest of whole tables: ``(scrape_ts, source, rows)``."""
    counts = [t.groupBy("scrape_ts").agg(F.count("*").alias("rows")).select("scrape_ts", F.lit(s).alias("source"), "rows")
              for s, t in tables.items()]
    return reduce(DataFrame.union, counts)


def scrape_status(manifest: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``(scrape_ts, sources, missing_rows, excess_rows, complete)`` of every
    scrape of the manifest. Counts are summed before the shuffle, and one
    equi-join on (scrape, source) compares them; a source that is no key of
    ``tables`` can't be complete. Of several promises for one source the
    largest counts, so that a replayed manifest changes nothing."""
    promised = manifest.groupBy("scrape_ts", "source").agg(F.max("rows").alias("rows"))
    there = scrape_manifest(tables).withColumnRenamed("rows", "there")
    both = promised.join(there, ["scrape_ts", "source"], "left").withColumn("there", F.coalesce("there", F.lit(0)))
    return (both.groupBy("scrape_ts").agg(
        F.count("*").alias("sources"), F.sum(F.greatest(F.col("rows") - F.col("there"), F.lit(0))).alias("missing_rows"),
        F.sum(F.greatest(F.col("there") - F.col("rows"), F.lit(0))).alias("excess_rows"))
        .withColumn("complete", (F.col("missing_rows") == 0) & (F.col("excess_rows") == 0)))


def complete_scrapes(manifest: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``(scrape_ts)`` of the complete scrapes."""
    return scrape_status(manifest, tables).where("complete").select("scrape_ts")


def only(df: DataFrame, scrapes: DataFrame) -> DataFrame:
    """The rows of the given scrapes."""
    return df.join(scrapes, "scrape_ts", "left_semi")


def gate_stream(arrivals: DataFrame, read_tables, read_manifest, out: str, ckpt: str, available_now: bool = True):
    """Publishes each scrape time under ``out/batch_id=N`` once it is complete.

    ``arrivals``: a stream of the scrape times of landed files, of the
    manifest and of any table. Only scrapes that a batch has touched can have
    become complete, so a batch reads the tables between its first and last
    one (``read_tables()`` and ``read_manifest()`` give them afresh) and no
    others. What was published is looked up among the published scrape times
    of the same span; a scrape is never published twice."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select("scrape_ts").distinct()
        lo, hi = batch.agg(F.min("scrape_ts"), F.max("scrape_ts")).first()
        if lo is None:
            return
        of = lambda df: only(between(df, lo, hi), touched)
        ready = complete_scrapes(of(read_manifest()), {s: of(t) for s, t in read_tables().items()})
        fs, root = _path(batch.sparkSession, out)
        if fs.exists(root) and any(f.getPath().getName() != f"batch_id={batch_id}" and f.isDirectory()
                                   and f.getPath().getName().startswith("batch_id=") for f in fs.listStatus(root)):
            before = batch.sparkSession.read.schema("scrape_ts timestamp, batch_id bigint").parquet(out)
            ready = ready.join(between(before.where(F.col("batch_id") != batch_id), lo, hi), "scrape_ts", "left_anti")
        publish(ready, out, batch_id)

    return _run(arrivals.writeStream.foreachBatch(per_batch).option("checkpointLocation", ckpt), available_now)
