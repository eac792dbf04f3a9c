"""The registry as a merged store: latest value per series, kept on storage.

The store has a base and deltas, both split into buckets by a hash of the
series (name, group, topic, partition). A scrape is merged by writing its own
latest values as a delta; a bucket whose deltas have grown to ``merge_after``
is compacted: its base and deltas become its next base. Buckets that a scrape
does not touch are neither read nor written.

Files are never changed in place. A state of the store is a manifest, one row
per part (bucket, kind, path); a change writes its parts first and then the
next manifest, numbered, whose success marker makes the state visible. A job
that is lost midway leaves parts that no manifest names. Merges are numbered by the
writer (a batch id), and the manifest holds the last number, so a replayed
merge changes nothing. One writer at a time is assumed,
as with any single sink; readers may come at any time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SERIES = ["name", "group_id", "topic", "partition"]
ROW = "name string, group_id string, topic string, partition int, key string, timestamp timestamp, value bigint"
MANIFEST = "bucket int, kind string, path string"
Part = tuple[int, str, str]


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*SERIES), F.lit(buckets)).cast("int")


def latest_rows(rows: DataFrame) -> DataFrame:
    """Per series the row of the latest time; of equal times the largest value."""
    return (rows.groupBy(*SERIES)
            .agg(F.max(F.struct("timestamp", "value", "key")).alias("r"))
            .select(*SERIES, "r.key", "r.timestamp", "r.value"))


def flat(gauges: DataFrame) -> DataFrame:
    """Long gauge rows in the store's columns."""
    return gauges.select("name", F.col("meta.group").alias("group_id"), F.col("meta.topic").alias("topic"),
                         F.col("meta.partition").alias("partition"), "key", "timestamp", "value")


class RegistryStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, merge_after: int = 8):
        self.spark, self.root, self.buckets, self.merge_after = spark, root.rstrip("/"), buckets, merge_after

    # --- manifests -----------------------------------------------------------
    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        hp = jvm.org.apache.hadoop.fs.Path(path)
        return hp.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hp

    def _versions(self) -> list[int]:
        fs, root = self._fs(f"{self.root}/manifest")
        if not fs.exists(root):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(root)]
        found = [int(n[2:]) for n in names if n.startswith("v=")]
        return sorted(v for v in found if fs.exists(self._fs(f"{self.root}/manifest/v={v}/_SUCCESS")[1]))

    def _state(self) -> tuple[int, list[Part]]:
        """Last merge, and the (bucket, kind, path) of the current parts: a few
        rows a bucket."""
        versions = self._versions()
        if not versions:
            return -1, []
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v={versions[-1]}").collect()
        return (max(int(r.path) for r in rows if r.kind == "last"),
                sorted(tuple(r) for r in rows if r.kind != "last"))

    def parts(self) -> list[Part]:
        return self._state()[1]

    def _set(self, last: int, parts: list[Part]) -> None:
        version = (self._versions() or [0])[-1] + 1
        (self.spark.createDataFrame([*parts, (-1, "last", str(last))], MANIFEST).coalesce(1)
         .write.mode("overwrite").parquet(f"{self.root}/manifest/v={version}"))

    # --- reading ---------------------------------------------------------------
    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], ROW)
        return self.spark.read.schema(ROW).parquet(*[f"{self.root}/{p}" for p in paths])

    def latest(self, buckets: list[int] | None = None) -> DataFrame:
        """The latest row of every series (of the given buckets)."""
        return latest_rows(self._read([p for b, _, p in self.parts() if buckets is None or b in buckets]))

    def lookup(self, series: DataFrame) -> DataFrame:
        """The latest rows of the given series, from their buckets alone."""
        touched = [r[0] for r in series.select(bucket_of(self.buckets)).distinct().collect()]
        on = [F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")) for c in SERIES]
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        wanted = series.select(*SERIES).distinct().alias("s")
        return self.latest(touched).alias("r").join(wanted, cond, "left_semi")

    # --- writing ---------------------------------------------------------------
    def _write(self, rows: DataFrame, name: str) -> list[int]:
        """Writes rows by bucket under ``name``; the buckets written."""
        path = f"{self.root}/{name}"
        (rows.withColumn("bucket", bucket_of(self.buckets)).repartition("bucket")
         .write.partitionBy("bucket").parquet(path))
        fs, hp = self._fs(path)
        names = [f.getPath().getName() for f in fs.listStatus(hp)]
        return sorted(int(n[7:]) for n in names if n.startswith("bucket="))

    def merge(self, rows: DataFrame, number: int) -> list[int]:
        """Merges rows (``flat`` columns) as delta ``number``; returns the
        buckets touched. Numbers rise; one that was merged changes nothing."""
        last, parts = self._state()
        if number <= last:
            return []
        name = f"delta/{uuid.uuid4().hex}"
        touched = self._write(latest_rows(rows), name)
        parts += [(b, "delta", f"{name}/bucket={b}") for b in touched]
        full = [b for b in touched if sum(x[0] == b and x[1] == "delta" for x in parts) >= self.merge_after]
        self._set(number, self._compacted(parts, full) if full else parts)
        return touched

    def compact(self, buckets: list[int] | None = None) -> None:
        """Makes one base of each bucket (of all with a delta)."""
        last, parts = self._state()
        self._set(last, self._compacted(parts, buckets or sorted({b for b, kind, _ in parts if kind == "delta"})))

    def _compacted(self, parts: list[Part], buckets: list[int]) -> list[Part]:
        name = f"base/{uuid.uuid4().hex}"
        done = self._write(latest_rows(self._read([p for b, _, p in parts if b in buckets])), name)
        return [x for x in parts if x[0] not in buckets] + [(b, "base", f"{name}/bucket={b}") for b in done]

    def vacuum(self) -> None:
        """Deletes parts and manifests that the current state does not name."""
        versions = self._versions()
        named = {p.rsplit("/", 1)[0] for _, _, p in self.parts()}
        for v in versions[:-1]:
            fs, hp = self._fs(f"{self.root}/manifest/v={v}")
            fs.delete(hp, True)
        for kind in ("delta", "base"):
            fs, hp = self._fs(f"{self.root}/{kind}")
            for f in fs.listStatus(hp) if fs.exists(hp) else ():
                if f"{kind}/{f.getPath().getName()}" not in named:
                    fs.delete(f.getPath(), True)
