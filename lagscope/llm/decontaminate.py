"""Benchmark decontamination by greedy string tiling.

Texts are sequences of lower-cased words; in scripts that are written without
spaces every character is a word. A document and a benchmark item
are compared if they share a seed, a run of ``MIN_MATCH`` words, or the whole
item where it has fewer. The compared
pair is tiled: the longest matches among unmarked words are found by Karp-
Rabin hashes and marked, again and again, until none of ``MIN_MATCH`` words
(or of the whole short item) is left. A length is tried by hashing its runs
on both sides, and the longest one is found by halving, so time and memory are
linear in both texts for each length of a tile, however often words repeat.
The share of the item's words under tiles is its coverage, wherever
and in whatever order the pieces stand in the document; an item with
``MIN_COVERAGE`` or more has leaked into the document.

Seeds: the item seeds set bits of a map of fixed size, the only thing that is
broadcast; a document seed that misses it is dropped where it is read, the
rest meet the item seeds in an exact join. An item of ``n`` words that is
covered has ``k = ceil(MIN_COVERAGE * n / MIN_MATCH)`` seed positions or more
in the document, so its ``k - 1`` positions with the commonest seeds need not
be joined: any pair that counts still meets in another seed. Common passages
thus make no pairs, and no pair is lost.

Defined results: texts without words match nothing; an item of less than
``MIN_MATCH`` words is found where it stands whole. Repeated rows and items are reported one
by one, with null ids if they have null ids. Equal longest matches are marked
in document order, then item order. Empty tables give an empty result.
Columns are taken by name; others are not read."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from lagscope.llm.common import fresh, settle, table

MIN_MATCH = 5
MIN_COVERAGE = 0.8
#: Bits of the map of item seeds, as a power of two: 8 MB.
MAP_BITS = 26

_WORDS = re.compile(r"[^\W_]+")
#: Scripts without spaces between words (Thai, Lao, Myanmar,
#: Khmer, kana, Han).
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
                       "\uf900-\ufaff\U00020000-\U0003ffff]")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def words(text: str | None) -> list[str]:
    found = _WORDS.findall(text.lower()) if text else []
    if found and _UNSPACED.search(text):
        found = [p for w in found for p in (_UNSPACED.sub(r" \g<0> ", w).split() if _UNSPACED.search(w) else (w,))]
    return found


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-cased words."""
    found = words(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def rolling(x: np.ndarray, m: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``m`` words, modulo 2 ** 64."""
    n = max(0, len(x) - m + 1)
    h = np.zeros(n, np.uint64)
    for i in range(m):
        h = h * np.uint64(_BASE) + x[i:i + n]
    return h


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    low = np.uint64((1 << MAP_BITS) - 1)
    return (mixed >> np.uint64(64 - MAP_BITS)).astype(np.int64), (mixed & low).astype(np.int64)


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.cumprod(out)


class _Runs:
    """Hashes of the runs of one text, of any length, over unmarked words."""

    def __init__(self, x: np.ndarray):
        self.x, self.free = x, np.ones(len(x), bool)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * _powers(_BASE, len(x)))))
        self.shift = _powers(_INVERSE, len(x) + 1)
        self.used = np.zeros(len(x) + 1, np.int64)

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the unmarked runs of ``size`` words."""
        at = np.flatnonzero(self.used[size:] == self.used[:len(self.used) - size])
        return at, (self.sums[at + size] - self.sums[at]) * self.shift[at]

    def mark(self, at: int, size: int) -> None:
        self.free[at:at + size] = False

    def settle(self) -> None:
        self.used = np.concatenate(([0], np.cumsum(~self.free)))


def _shared(doc: _Runs, item: _Runs, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(document starts, their hashes, item starts, their sorted hashes) of the
    runs of ``size`` words that both have; None without any."""
    i, hi = doc.of(size)
    j, hj = item.of(size)
    if not len(i) or not len(j):
        return None
    order = np.argsort(hj, kind="stable")
    j, hj = j[order], hj[order]
    both = hj[np.minimum(np.searchsorted(hj, hi), len(hj) - 1)] == hi
    return (i[both], hi[both], j, hj) if both.any() else None


def tile(doc: np.ndarray, item: np.ndarray, m: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (document start, item start, length), longest first."""
    a, b, tiles = _Runs(doc), _Runs(item), []
    most = min(len(doc), len(item))
    while most >= m and (found := _shared(a, b, m)):
        low, size = m, most  # a run of ``low`` words is shared
        if (whole := _shared(a, b, most)):
            low, found = most, whole
        while size - low > 1:
            half = (low + size) // 2
            if (longer := _shared(a, b, half)):
                low, found = half, longer
            else:
                size = half
        size, (i, hi, j, hj) = low, found
        starts = np.searchsorted(hj, hi, "left").tolist()
        ends = np.searchsorted(hj, hi, "right").tolist()
        after: dict[int, int] = {}  # places of a run that are marked stay so
        before, last = len(tiles), -1
        for at, lo, up in zip(i.tolist(), starts, ends):
            if at < last:
                continue
            k = after.get(lo, lo)
            while k < up and not b.free[j[k]:j[k] + size].all():
                k += 1
            after[lo] = k
            # equal hashes are checked word by word
            while k < up and not (b.free[j[k]:j[k] + size].all()
                                  and np.array_equal(doc[at:at + size], item[j[k]:j[k] + size])):
                k += 1
            if k < up:
                a.mark(at, size)
                b.mark(int(j[k]), size)
                tiles.append((at, int(j[k]), size))
                last = at + size
        a.settle()
        b.settle()
        most = size - 1
        if len(tiles) > before and not b.free.any():
            break
    return tiles


def _least(n: int, m: int) -> int:
    """Words of a seed of an item of ``n`` words."""
    return min(max(n, 1), m)


def _item_seeds(benchmark: DataFrame, m: int) -> DataFrame:
    """``(item, seed, times, n)`` by item row."""
    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for item, text in zip(b["item"], b["text"]):
                x = tokens(text)
                if not len(x):
                    continue
                found, times = np.unique(rolling(x, _least(len(x), m)).view(np.int64), return_counts=True)
                out += [(item, s, t, len(x)) for s, t in zip(found.tolist(), times.tolist())]
            yield pd.DataFrame(out, columns=["item", "seed", "times", "n"])

    return benchmark.select("item", "text").mapInPandas(
        seeds, "item bigint, seed bigint, times long, n long")


def _seed_map(seeds: DataFrame) -> np.ndarray:
    """The map of item seeds: at most 2 ** (MAP_BITS - 6) rows reach the driver."""
    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.concatenate(_bits(b["seed"].to_numpy(np.int64).view(np.uint64)))
            yield pd.DataFrame({"w": at >> 6, "b": (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)})

    rows = (seeds.select("seed").mapInPandas(words, "w bigint, b bigint")
            .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas())
    bits = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    bits[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).view(np.uint64)
    return bits


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
                  item_col: str = "item_id", item_text: str = "text", m: int = MIN_MATCH,
                  min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """``(id, item_id, coverage, n_tiles, longest, tiles)`` of every document
    row and benchmark row of which ``min_coverage`` or more is in the
    document."""
    spark = df.sparkSession
    id_type = dict(df.dtypes)[id_col]
    items = settle(benchmark.select(F.monotonically_increasing_id().alias("item"),
                                    F.col(item_col).cast("string").alias("item_id"),
                                    F.col(item_text).alias("item_text")))
    seeds = settle(_item_seeds(items.withColumnRenamed("item_text", "text"), m))
    bits = spark.sparkContext.broadcast(_seed_map(seeds))
    short = [r.n for r in seeds.where(F.col("n") < m).select("n").distinct().collect()]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, t in zip(b["id"], b["text"]):
                x = tokens(t)
                h = np.concatenate([rolling(x, size) for size in (m, *short)])
                one, two = _bits(h)
                hit = _has(bits.value, one)
                if hit.any():
                    h = h[hit][_has(bits.value, two[hit])]
                    if len(h):
                        out.append((key, t, np.unique(h.view(np.int64)).tolist()))
            yield pd.DataFrame(out, columns=["id", "text", "seeds"])

    found = settle(df.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))
                   .where(F.col("text").isNotNull())
                   .mapInPandas(scan, "id string, text string, seeds array<bigint>")
                   .withColumn("row", F.monotonically_increasing_id()))
    bits.destroy()
    hits = found.select("row", F.explode("seeds").alias("seed"))
    common = hits.groupBy("seed").agg(F.count("*").alias("df"))
    k = F.greatest(F.ceil(F.col("n") * min_coverage / m), F.lit(1))
    above = (Window.partitionBy("item").orderBy(F.desc("df"), "seed")
             .rowsBetween(Window.unboundedPreceding, 0))
    rare = (seeds.join(common, "seed")
            .withColumn("spent", F.sum("times").over(above)).where(F.col("spent") >= k)
            .select("seed", "item"))
    pairs = (hits.join(rare, "seed").select("row", "item").distinct()
             .join(items, "item").join(found.select("row", "id", "text"), "row")
             .select("id", "text", "item_id", "item_text"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, t, item, it in zip(b["id"], b["text"], b["item_id"], b["item_text"]):
                y = tokens(it)
                tiles = tile(tokens(t), y, _least(len(y), m))
                coverage = sum(x[2] for x in tiles) / len(y)
                if coverage >= min_coverage:
                    out.append((key, item, coverage, len(tiles), tiles[0][2],
                                [dict(zip(("doc_start", "item_start", "length"), x)) for x in tiles]))
            yield pd.DataFrame(out, columns=["id", "item_id", "coverage", "n_tiles", "longest", "tiles"])

    item_type = dict(benchmark.dtypes)[item_col]
    return pairs.mapInPandas(
        compare, "id string, item_id string, coverage double, n_tiles long, longest long, "
        "tiles array<struct<doc_start: long, item_start: long, length: long>>").withColumns(
        {"id": F.col("id").cast(id_type), "item_id": F.col("item_id").cast(item_type)})


def op5(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(documents, benchmark).select(
        F.col("id").alias("doc_id"), "item_id", "coverage", "n_tiles", "longest")


def stage(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Drops the documents that a benchmark item has leaked into."""
    key, = fresh(documents, "key")
    cols = [F.col(c) for c in documents.columns]
    keyed = documents.withColumn(key, F.concat(F.hex(F.xxhash64(F.lit(1), *cols)),
                                               F.hex(F.xxhash64(F.lit(2), *cols))))
    leaked = settle(contamination(keyed, benchmark, key).select(F.col("id").alias(key)).distinct())
    return keyed.join(leaked, key, "left_anti").select(*documents.columns)
