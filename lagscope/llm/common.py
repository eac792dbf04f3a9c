"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lagscope.session import checkpoint_dir

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder of ``spark.checkpoint.dir``."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names built on ``names`` that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def fold(key: Column, n: int) -> Column:
    """``crc32`` of the key as text, modulo ``n``; -1 for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % n, F.lit(-1))


def unit(*key: Column | str, seed: int = 11) -> Column:
    """A reproducible number in [0, 1) for the key."""
    return F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 11) / F.lit(float(1 << 53))


def bounded_sample(df: DataFrame, key: str, label: str, per_class: int,
                   max_classes: int | None = 64, seed: int = 11) -> DataFrame:
    """At most ``per_class`` rows of each of the ``max_classes`` commonest
    values of ``label`` (None: of every value), the same ones on every run:
    the rows with the smallest hashes of ``key``.

    Counts every row of each class first (only the label column is read), so
    a class is thinned by its own rate before the exact cut, and the window
    sees about ``2 * per_class`` rows of a class however common it is."""
    counts = (df.where(F.col(label).isNotNull()).groupBy(label).count()
              .orderBy(F.desc("count"), label))
    counts = (counts if max_classes is None else counts.limit(max_classes)).collect()
    if not counts:
        return df.limit(0)
    rate = F.create_map(*[F.lit(x) for r in counts
                          for x in (r[0], min(1.0, (1.5 * per_class + 20) / r[1]))])
    u, rank = fresh(df, "u", "rank")
    return (df.withColumn(u, unit(key, seed=seed))
            .where(F.col(u) < F.coalesce(F.element_at(rate, F.col(label)), F.lit(0.0)))
            .withColumn(rank, F.row_number().over(Window.partitionBy(label).orderBy(u, key)))
            .where(F.col(rank) <= per_class).drop(u, rank))


def prefix_sum(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str],
               value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group that come
    before the row by (``bucket``, then ``order``).

    Group columns must not be null. A group's rows are summed per bucket first; the running sum over a whole
    group sees one row per bucket, and the rows themselves are only sorted
    within a bucket, so a group of any size spreads over the cluster."""
    start, part = fresh(df, "start", "part")
    per_bucket = df.groupBy(*group, bucket).agg(F.sum(value).alias(part))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select(
        *[F.col(c).alias(f"{start}_{c}") for c in (*group, bucket)],
        F.coalesce(F.sum(part).over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    rows = df.withColumn(part, F.coalesce(F.sum(value).over(within), F.lit(0)))
    cond = F.lit(True)
    for c in (*group, bucket):
        cond = cond & (rows[c] == F.col(f"{start}_{c}"))
    # the rows are already dealt out by these keys; they must never be
    # broadcast, however few a plan takes them for
    return rows.hint("merge").join(starts, cond).select(
        *[rows[c] for c in df.columns], (F.col(part) + F.col(start)).alias(out))
