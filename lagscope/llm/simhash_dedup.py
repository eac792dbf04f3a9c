"""Near-duplicate groups by SimHash and covering locality-sensitive hashing.

Fingerprint: 64 bits; a bit is set if over half the shingle hashes have it.
Two fingerprints within ``radius`` bits are linked; groups are the connected
components of the links.

Covering masks: every bit gets a non-zero vector of ``radius + 1`` bits, and
mask ``v`` keeps the bits whose vector has an odd product with ``v``. At most
``radius`` differing bits span less than the whole space, so some ``v`` is
orthogonal to all their vectors: that mask hides every differing bit, and the
pair meets in that mask's table. No pair within the radius can be missed.

A bucket of such a table can still be large, as near copies crowd together.
The hidden bits of its mask are therefore cut into blocks of at most four,
and the bucket is split once for every choice of ``radius`` blocks, clearing
them: a pair within the radius agrees after clearing the blocks it differs
in. A split bucket holds fingerprints that differ in ``4 * radius`` bits at
most, so 2 ** (4 * radius) different ones (256 for radius 2) by construction,
whatever the input. That bound, not a cap, is why one may be compared inside
a task. Exact copies share one fingerprint row all along.

Defined results: a null or empty text, or one of white space, has fingerprint
zero and is linked like any other. Repeated rows share a class. A null id
takes part in the links; a class without any id has a null ``component_id``.
An empty table gives an empty result. Columns are taken by name, the rest of
the input is not read."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from lagscope.llm.common import fresh, settle
from lagscope.llm.components import components

BITS = 64
SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of the whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, ASCII space
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[:n - 1] + 1)).tolist()
    stops = (ends[shingle - 1:] if len(words) >= shingle else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[i:j], SEED) for i, j in zip(starts, stops)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):  # a long text in bounded memory
        part = h[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 3) -> Column:
    """Column of signed 64-bit fingerprints."""
    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))
    return of(df[text])


def covering_masks(radius: int) -> list[int]:
    """The 2 ** (radius + 1) - 1 masks over 64 bits."""
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << bit for bit in range(BITS)
                if ((bit % vectors + 1) & v).bit_count() % 2) for v in range(1, vectors + 1)]


def split_masks(mask: int, radius: int) -> list[int]:
    """What stays of a fingerprint in each split of a bucket of ``mask``."""
    hidden = [b for b in range(BITS) if not mask >> b & 1]
    blocks = [sum(1 << b for b in hidden[i:i + 4]) for i in range(0, len(hidden), 4)]
    full = (1 << BITS) - 1
    return [full & ~sum(c) for c in combinations(blocks, min(radius, len(blocks)))]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _spanning(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the values within ``radius`` bits."""
    x = np.unique(values.view(np.uint64))
    left, out = x, []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.bitwise_count(left[:, None] ^ front[None, :]) <= radius
            hit = near.any(axis=1)
            out += zip(front[near[hit].argmax(axis=1)].view(np.int64).tolist(),
                       left[hit].view(np.int64).tolist())
            front, left = left[hit], left[~hit]
    return out


def links(prints: DataFrame, fp: str = "fp", radius: int = 2) -> DataFrame:
    """``(a, b)``: links that connect exactly what all links within ``radius``
    bits connect, among the different values of ``fp``."""
    masks = covering_masks(radius)
    rows = prints.select(F.col(fp).alias("fp")).distinct()
    tables = rows.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for t, m in enumerate(masks)])).alias("x")).select("fp", "x.t", "x.key")
    met = (tables.groupBy("t", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
           .where("lo < hi").select("t", "key"))
    splits = F.array(*[F.array(*[F.lit(_signed(m)) for m in split_masks(mask, radius)])
                       for mask in masks])
    split = (tables.join(met, ["t", "key"])
             .select("fp", "t", F.posexplode(F.element_at(splits, F.col("t") + 1)).alias("s", "m"))
             .groupBy("t", "s", F.col("fp").bitwiseAND(F.col("m")).alias("rest"))
             .agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1).select("fps"))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([e for v in b["fps"] for e in _spanning(np.asarray(v, np.int64), radius)],
                               columns=["a", "b"])

    return split.mapInPandas(near, "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3,
                    radius: int = 2) -> DataFrame:
    """``(id, fp, component_id)``, one row for each row of ``df``;
    ``component_id`` is the smallest id of the row's class."""
    prints = settle(df.select(F.col(id_col).alias("id"), fingerprints(df, text, shingle).alias("fp")))
    return classes(prints, radius)


def classes(prints: DataFrame, radius: int = 2) -> DataFrame:
    """As ``near_duplicates``, from stored ``(id, fp)`` rows."""
    first = prints.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(links(prints, "fp", radius))
    of = (first.join(roots, first["fp"] == roots["node"], "left")
          .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = of.join(least, "root").select(F.col("fp").alias("k"), "component_id")
    return prints.join(by_print, prints["fp"] == by_print["k"], "left").select("id", "fp", "component_id")


def op4(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id")


def stage(documents: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """Keeps one document of each class: the one with the smallest id, rows
    without an id after all others, and one of rows that are equal."""
    key, rank, pick = fresh(documents, "key", "rank", "pick")
    # an id that orders rows of a class; equal rows have equal ids
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                     F.xxhash64(*[F.col(c) for c in documents.columns]).alias("row"))
    keyed = documents.withColumn(key, order)
    kept = (near_duplicates(keyed, key, "text", shingle, radius)
            .where(F.col("id") == F.col("component_id"))
            .groupBy("id").agg(F.count("*").alias(rank)))
    rows = keyed.join(kept.withColumnRenamed("id", pick), F.col(key) == F.col(pick))
    once = rows.where(F.col(rank) == 1)
    more = (rows.where(F.col(rank) > 1)
            .withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(key)))
            .where(F.col(rank) == 1))
    return once.unionByName(more).select(*documents.columns)
