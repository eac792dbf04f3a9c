"""Phrase collocation mining with HAT-trie counting.

Phrases are runs of words inside a piece of text. A task counts them in a
HAT-trie: a shallow trie over word ids whose leaves are hash containers; a
container that grows past ``BURST`` entries bursts into a trie node with a
container for each next word, and when the trie holds more than ``HELD``
entries its largest subtrees are spilled whole, as sorted runs. Runs are
shuffled by prefix and merged in Spark. A prefix is the first word, or as many
words as it takes until the phrase so far is not one of the few that hold
1/256 of all words, so a hot word or word pair is no single partition.

Phrases grow by a word at a time. A phrase of ``k`` words that occurs
``MIN_COUNT`` times has two parts of ``k - 1`` words that do, so a round reads
only places whose parts set a bit in a map of at most 8 MB, which is all that
is broadcast. A false bit costs a count that the threshold removes; nothing is
lost, and counts are exact. The first round also writes the texts as word ids
into the shared folder. Ids are 64-bit hashes; two words of one id end the job
with an error instead of a wrong count. Up to ``NARROW`` frequent words, whose
hashes fill 8 MB at most, are broadcast and numbered, and ids have 4 bytes;
more of them keep their hashes, 8 bytes wide, on the same path.

Per language: ``n`` counts words, ``f`` occurrences of a phrase, overlaps
included. A candidate's score is the least over its cuts of
``floor(1000 * f * n / (f(first) * f(rest)))``.

Defined results: a null text is empty; texts without words give nothing;
null languages are ``und``, together with rows that say so. Repeated rows
count each time. Ties go by score, frequency, phrase; the first shortest cut
wins among equal ones. An empty table gives an empty result. Columns are taken
by name; others are not read. Texts are read whole, in pieces of
``CHUNK`` words in memory."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import batched, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lagscope.llm.common import settle
from lagscope.session import checkpoint_dir

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
#: Entries of a hash container before it bursts.
BURST = 8192
#: Entries that a task's trie holds before subtrees are spilled.
HELD = 500_000
#: Entries of a run that travel in one row.
ROW = 1000
#: Words that a task turns into phrases at once.
CHUNK = 400_000
#: Words that are written as ids at once.
BLOCK = 100_000
#: A prefix with one of so many parts of all words is split by its next word.
HEAVY = 256
#: Parts of a language where its total meets its phrases.
SALTS = 64
#: Frequent words that are numbered: 8 bytes each reach every task.
NARROW = 1 << 20
#: Bits of a map of frequent phrases, as powers of two: up to 8 MB.
LEAST_BITS, MOST_BITS = 12, 26
UNDETERMINED = "und"

#: Products of counts pass 64 bits; decimals of no places divide exactly.
_SCORE = ("CAST(1000 AS decimal(4,0)) * CAST(a AS decimal(19,0)) * CAST(n AS decimal(19,0)) "
          "div (CAST(l AS decimal(19,0)) * CAST(r AS decimal(19,0)))")

_BREAKS = bytes(range(0x0A, 0x0E)) + b".,;:!?"
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t" + _BREAKS,
                        bytes(range(97, 123)) + b" " + b"\n" * len(_BREAKS))
#: The same for words whatever piece they are in.
_SPACE = bytes.maketrans(b"\n", b" ")
#: A break among words; folded words have no capitals.
_BREAK = b"A"
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    """Word -> place among the words met, 0 for a break."""

    def __init__(self):
        super().__init__({_BREAK: 0})
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        self.new.append(word)
        return place


def _id(word: str) -> Column:
    return F.when(F.xxhash64(word) == 0, 1).otherwise(F.xxhash64(word))


class HatTrie:
    """Counts keys made of words of ``width`` bytes. ``spill`` yields sorted
    runs."""

    class Node(dict):
        """Next word -> node or container; a container is a plain dict."""

    def __init__(self, burst: int = BURST, held: int = HELD, width: int = 8):
        self.root, self.burst, self.held, self.width = HatTrie.Node(), burst, held, width
        self.sizes: Counter[bytes] = Counter()
        self.entries = 0

    def add(self, first: bytes, rest: list[bytes], times: list[int]) -> None:
        """Adds keys ``first + rest[i]``, ``times[i]`` each."""
        if first not in self.root:
            self.root[first] = {}
        new = self._put(self.root, first, rest, times)
        self.sizes[first] += new
        self.entries += new

    def _put(self, parent: dict, at: bytes, rest: list[bytes], times: list[int]) -> int:
        here, width = parent[at], self.width
        if type(here) is HatTrie.Node:
            new, groups = 0, {}
            for r, t in zip(rest, times):
                rs, ts = groups.setdefault(r[:width], ([], []))
                rs.append(r[width:])
                ts.append(t)
            for word, (rs, ts) in groups.items():
                if word not in here:
                    here[word] = {}
                new += self._put(here, word, rs, ts)
            return new
        before, get = len(here), here.get
        for r, t in zip(rest, times):
            here[r] = get(r, 0) + t
        new = len(here) - before
        if len(here) > self.burst and len(rest[0]) > width:
            node = HatTrie.Node()
            for r, t in here.items():
                node.setdefault(r[:width], {})[r[width:]] = t
            parent[at] = node
        return new

    def _run(self, here: dict, prefix: bytes, out: list) -> None:
        if type(here) is HatTrie.Node:
            for word in sorted(here):
                self._run(here[word], prefix + word, out)
        else:
            out += [(prefix + r, here[r]) for r in sorted(here)]

    def spill(self, down_to: int) -> Iterator[list[tuple[bytes, int]]]:
        """Largest subtrees first, each whole and sorted, until at most
        ``down_to`` entries are held."""
        for first, size in self.sizes.most_common():
            if self.entries <= down_to:
                break
            out: list[tuple[bytes, int]] = []
            self._run(self.root.pop(first), first, out)
            del self.sizes[first]
            self.entries -= size
            yield out

    def full(self) -> bool:
        return self.entries > self.held


class FrequentMap:
    """Two bits for every frequent phrase of a language; may have more."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @staticmethod
    def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        low = np.uint64((1 << bits) - 1)
        return (mixed >> np.uint64(64 - bits)).astype(np.int64), (mixed & low).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        def bit(at):
            return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
        one, two = self.places(h, self.bits)
        return bit(one) & bit(two)


def _salt(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def _grams(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` ids, and whether it has no break in it."""
    n = max(0, len(x) - k + 1)
    h, whole = np.zeros(n, np.uint64), np.ones(n, bool)
    for i in range(k):
        h = h * _BASE + x[i:i + n]
        whole &= x[i:i + n] != 0
    return h, whole


def _frequent_map(spark: SparkSession, frequent: DataFrame, width: int):
    """Broadcast ``FrequentMap`` of ``(lang, key)``, words of ``width`` bytes;
    the map's size follows the rows up to ``MOST_BITS``, and only the map
    reaches the driver."""
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * frequent.count()).bit_length()))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = np.frombuffer(b"".join(b["key"]), f">u{width}").astype(np.uint64).reshape(len(b), -1)
            salts = {lang: _salt(lang) for lang in b["lang"].unique()}
            h = reduce(lambda a, i: a * _BASE + i, ids.T, np.zeros(len(b), np.uint64))
            h ^= np.array([salts[lang] for lang in b["lang"]], np.uint64)
            at = np.concatenate(FrequentMap.places(h, bits))
            yield pd.DataFrame({"w": at >> 6, "b": (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)})

    rows = (frequent.select("lang", "key").mapInPandas(words, "w bigint, b bigint")
            .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas())
    held = np.zeros(1 << (bits - 6), np.uint64)
    held[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).view(np.uint64)
    return spark.sparkContext.broadcast(FrequentMap(bits, held))


def _texts(df: DataFrame, text: str, lang: str) -> DataFrame:
    return df.where(F.length(F.col(text)) > 0).select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UNDETERMINED)).alias("lang"),
        F.col(text).cast("binary").alias("text"))


def _count_words(texts: DataFrame) -> DataFrame:
    """``(lang, word, n)`` runs; a null word holds a language's total."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter[bytes]] = {}
        totals: Counter[str] = Counter()

        def spill(lang: str) -> pa.RecordBatch:
            counts = held.pop(lang)
            words, times = pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())
            order = pc.array_sort_indices(words)
            return pa.record_batch([pa.array([lang] * len(words), pa.string()), words.take(order), times.take(order)], schema)

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                counts = held.setdefault(lang, Counter())
                words = text.as_py().translate(_FOLD).translate(_SPACE).split()
                counts.update(words)
                totals[lang] += len(words)
                if sum(map(len, held.values())) > HELD:
                    yield spill(max(held, key=lambda x: len(held[x])))
        for lang in list(held):
            yield spill(lang)
        yield pa.record_batch([pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.binary()),
                               pa.array(list(totals.values()), pa.int64())], schema)

    return texts.mapInArrow(runs, "lang string, word binary, n bigint")


def _number(x: np.ndarray, numbered: np.ndarray) -> np.ndarray:
    """Place of each hash among the numbered ones, from 1; 0 if it is none."""
    at = np.minimum(np.searchsorted(numbered, x), max(0, len(numbered) - 1))
    return np.where(numbered[at] == x, at + 1, 0).astype(np.uint64) if len(numbered) else np.zeros_like(x)


def _encode(texts: DataFrame, frequent, numbered, width: int) -> DataFrame:
    """``(lang, ids)``: each text's word ids as bytes, 0 where a phrase ends."""
    schema = pa.schema([("lang", pa.string()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[_Ids, np.ndarray]] = {}

        def coded(lang: str, places: list[int], ends: list[int]) -> pa.RecordBatch:
            ids, codes = known[lang]
            if ids.new:
                x = np.array([xxhash.xxh64_intdigest(w, 42) or 1 for w in ids.new], np.uint64)  # as in _id
                x[~frequent.value.has(x ^ _salt(lang))] = 0
                codes = np.concatenate((codes, x if numbered is None else _number(x, numbered.value)))
                ids.new = []
                known[lang] = ids, codes
            x = codes[places]
            near = x != 0
            pair = near[1:] & near[:-1]
            kept = np.concatenate((pair, [False])) | np.concatenate(([False], pair))
            x[~kept] = 0
            stays = kept | np.concatenate(([False], kept[:-1]))  # one break after each run
            upto = np.cumsum(stays)[np.array(ends) - 1]
            cuts = np.unique(np.concatenate(([0], upto))) * width  # texts without phrases go
            rows = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [
                None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(x[stays].astype(f"<u{width}"))])
            return pa.record_batch([pa.array([lang] * len(rows), pa.string()), rows], schema)

        def flush(held: dict[str, tuple[list[int], list[int]]]) -> Iterator[pa.RecordBatch]:
            for lang, (places, ends) in held.items():
                yield coded(lang, places, ends)
            held.clear()
            if sum(len(ids) for ids, _ in known.values()) > HELD:
                known.clear()

        for b in batches:
            held: dict[str, tuple[list[int], list[int]]] = {}
            words = 0
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                if lang not in known:
                    known[lang] = _Ids(), np.zeros(1, np.uint64)
                places, ends = held.setdefault(lang, ([], []))
                found = text.as_py().translate(_FOLD).replace(b"\n", b" " + _BREAK + b" ").split()
                places += map(known[lang][0].__getitem__, found)
                places.append(0)
                ends.append(len(places))
                words += len(found)
                if words > BLOCK:
                    yield from flush(held)
                    words = 0
            yield from flush(held)

    return texts.mapInArrow(run, "lang string, ids binary")


def _count_phrases(coded: DataFrame, k: int, frequent, heavy: list[set[tuple[str, bytes]]],
                   width: int) -> DataFrame:
    """``(lang, prefix, rests, times)`` runs of phrases of ``k`` words whose
    parts of ``k - 1`` words are in ``frequent``: what follows the prefix, end
    to end, and how often each occurs."""
    schema = pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("rests", pa.binary()),
                        ("times", pa.list_(pa.int64()))])

    def prefix(lang: str, key: bytes) -> bytes:
        at = width
        while at < len(key) and (lang, key[:at]) in heavy[at // width - 1]:
            at += width
        return key[:at]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, HatTrie] = {}

        def sent(lang: str, spilled: Iterator[list[tuple[bytes, int]]]) -> Iterator[pa.RecordBatch]:
            """A row for each prefix of a run, in parts of a bounded size."""
            starts: list[bytes] = []
            rests: list[bytes] = []
            ends, times = [0], []

            def packed() -> pa.RecordBatch:
                return pa.record_batch([
                    pa.array([lang] * len(starts), pa.string()), pa.array(starts, pa.binary()),
                    pa.array(rests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(times, pa.int64()))], schema)

            for run in spilled:
                first = run[0][0][:width]
                for start, group in (groupby(run, lambda e: prefix(lang, e[0])) if (lang, first) in heavy[0]
                                     else ((first, run),)):
                    for part in batched(group, ROW):
                        at = len(start)
                        starts.append(start)
                        rests.append(b"".join([key[at:] for key, _ in part]))
                        times += [n for _, n in part]
                        ends.append(len(times))
                if len(starts) > ROW:
                    yield packed()
                    starts, rests, ends, times = [], [], [0], []
            if starts:
                yield packed()

        def count(lang: str, x: np.ndarray) -> None:
            h, whole = _grams(x, k - 1)
            part = whole.copy()
            if k > 2:
                part[whole] = frequent.value.has(h[whole] ^ _salt(lang))
            at = np.flatnonzero(part[:-1] & part[1:])
            if not len(at):
                return
            whole_hash = h[at] * _BASE + x[at + k - 1]
            order = np.argsort(whole_hash, kind="stable")
            rows_ = np.stack([x[at[order] + i] for i in range(k)], axis=1)
            new = np.concatenate(([True], (rows_[1:] != rows_[:-1]).any(axis=1)))
            start = np.flatnonzero(new)
            times = np.diff(np.concatenate((start, [len(at)])))
            keys = rows_[start].astype(f">u{width}")
            by_first = np.argsort(keys[:, 0], kind="stable")
            raw, times = keys[by_first].tobytes(), times[by_first].tolist()
            first = keys[by_first, 0]
            cuts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1], [True])))
            trie, size = tries.setdefault(lang, HatTrie(width=width)), width * k
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                trie.add(raw[a * size:a * size + width],
                         [raw[i * size + width:(i + 1) * size] for i in range(a, z)], times[a:z])

        def flush(held: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for lang, xs in held.items():
                x = np.concatenate(xs)
                for at in range(0, len(x), CHUNK):  # neighbouring chunks share k - 1 places
                    count(lang, x[at:at + CHUNK + k - 1])
                if tries.get(lang) and tries[lang].full():
                    yield from sent(lang, tries[lang].spill(HELD // 2))
            while sum(t.entries for t in tries.values()) > HELD:
                lang = max(tries, key=lambda t: tries[t].entries)
                yield from sent(lang, tries[lang].spill(tries[lang].entries // 2))
            held.clear()

        held: dict[str, list[np.ndarray]] = {}
        words = 0
        for b in batches:
            for lang, ids in zip(b.column("lang").to_pylist(), b.column("ids")):
                x = np.frombuffer(ids.as_py(), f"<u{width}").astype(np.uint64)
                held.setdefault(lang, []).append(x)
                words += len(x)
                if words > CHUNK:
                    yield from flush(held)
                    words = 0
        yield from flush(held)
        for lang, trie in tries.items():
            yield from sent(lang, trie.spill(0))

    return coded.mapInArrow(runs, "lang string, prefix binary, rests binary, times array<bigint>")


def _merged(runs: DataFrame, k: int, word: int) -> DataFrame:
    """``(lang, key, f)`` of the runs; a prefix's runs meet in one partition."""
    width = word * k - F.octet_length("prefix")
    return (runs.repartition("lang", "prefix")
            .select("lang", "prefix", "rests", F.posexplode("times").alias("i", "n"))
            .select("lang", "prefix", F.substring("rests", F.col("i") * width + 1, width).alias("rest"), "n")
            .groupBy("lang", "prefix", "rest").agg(F.sum("n").alias("f"))
            .select("lang", F.concat("prefix", "rest").alias("key"), "f"))


def phrase_counts(df: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
                  max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """``(totals, words, phrases, width)``: ``(lang, n)``; ``(lang, key, word, f)`` of
    the words with ``min_count`` or more occurrences; ``(lang, key, k, f)`` of
    all phrases of up to ``max_words`` words with as many, where ``key`` is the
    words' ids, ``width`` bytes each."""
    spark = df.sparkSession
    texts = _texts(df, text, lang)
    runs = _count_words(texts)
    counted = settle(runs.repartition("lang", _id("word")).withColumn("id", _id("word"))
                     .groupBy("lang", "id", "word").agg(F.sum("n").alias("f"))
                     .groupBy("lang", "id").agg(F.sum("f").alias("f"), F.count("word").alias("words"),
                                                F.max("word").alias("word"))
                     .where((F.col("f") >= min_count) | (F.col("words") != 1)))
    if counted.where(F.col("words") > 1).limit(1).count():
        raise ValueError("two words share a 64-bit id")
    totals = counted.where(F.col("words") == 0).select("lang", F.col("f").alias("n"))
    words = counted.where(F.col("words") == 1).select(
        "lang", "id", F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("key"), F.col("word").cast("string").alias("word"), "f")
    frequent = _frequent_map(spark, words, 8)
    ids = words.select("id").distinct()
    numbered, width = None, 8
    if ids.count() <= NARROW:
        numbered, width = spark.sparkContext.broadcast(np.sort(ids.toPandas()["id"].to_numpy(np.int64).view(np.uint64))), 4

        @F.pandas_udf("binary")
        def number(ids: pd.Series) -> pd.Series:
            at = _number(ids.to_numpy(np.int64).view(np.uint64), numbered.value)
            return pd.Series([int(i).to_bytes(4, "big") for i in at], dtype=object)

        words = settle(words.withColumn("key", number("id")))
    every = totals.agg(F.sum("n")).first()[0] or 0
    least = max(min_count, every // HEAVY)

    def heavies(phrases: DataFrame) -> set[tuple[str, bytes]]:
        # at most HEAVY rows, as occurrences of one length add up to all words
        return {(r.lang, bytes(r.key)) for r in phrases.where(F.col("f") > least).select("lang", "key").collect()}

    found, heavy = [words.select("lang", "key", F.lit(1).alias("k"), "f")], [heavies(words)]
    folder = f"{checkpoint_dir(spark)}/phrases-{uuid.uuid4().hex}"
    _encode(texts, frequent, numbered, width).write.parquet(folder, compression="zstd")
    coded = spark.read.schema("lang string, ids binary").parquet(folder)
    for k in range(2, max_words + 1):
        phrases = settle(_merged(_count_phrases(coded, k, frequent, heavy, width), k, width)
                         .where(F.col("f") >= min_count).select("lang", "key", F.lit(k).alias("k"), "f"))
        frequent.destroy()
        found.append(phrases)
        heavy.append(heavies(phrases))
        frequent = _frequent_map(spark, phrases, width)
        if phrases.isEmpty():
            break
    frequent.destroy()
    if numbered is not None:
        numbered.destroy()
    return totals, words, reduce(DataFrame.union, found), width


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
                 max_words: int = MAX_WORDS, percent: int = 100) -> DataFrame:
    """``(lang, phrase, a, l, r, n, score)`` of every candidate that is not
    inside a longer one with ``percent`` of its occurrences or more."""
    totals, words, phrases, width = phrase_counts(df, text, lang, min_count, max_words)
    candidates = phrases.where(F.col("k") > 1).select("lang", "key", "k", F.col("f").alias("a"))
    part = phrases.select("lang", F.col("key").alias("part"), F.col("f"))
    cuts = (candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
            .withColumn("first", F.expr(f"substring(key, 1, {width} * cut)"))
            .withColumn("rest", F.expr(f"substring(key, {width} * cut + 1)"))
            .join(part.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
            .join(part.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
            .withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
            .join(totals.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))),
                  ["lang", "salt"])
            .withColumn("score", F.expr(_SCORE)))
    scored = cuts.groupBy("lang", "key", "k", "a", "n").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    inner = (candidates.where(F.col("k") > 2)
             .withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
             .withColumn("at", F.explode(F.expr("sequence(0, k - size)")))
             .groupBy("lang", F.expr(f"substring(key, {width} * at + 1, {width} * size)").alias("key"))
             .agg(F.max("a").alias("longer")))
    kept = (scored.join(inner, ["lang", "key"], "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
            .select("lang", "key", "k", "a", "n", "best"))
    spelled = (kept.withColumn("i", F.explode(F.expr("sequence(0, k - 1)")))
               .withColumn("part", F.expr(f"substring(key, {width} * i + 1, {width})"))
               .join(words.select("lang", F.col("key").alias("part"), "word"), ["lang", "part"])
               .groupBy("lang", "key", "a", "n", "best")
               .agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("words")))
    return spelled.select("lang", F.array_join("words.word", " ").alias("phrase"), "a",
                          F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n",
                          F.col("best.score").alias("score"))


def op13(documents: DataFrame, top: int = TOP) -> DataFrame:
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (collocations(documents).withColumn("rank", F.row_number().over(by).cast("long"))
            .where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


ORACLE_SQL = f"""
WITH RECURSIVE pieces AS (
  SELECT lang, row_number() OVER () AS piece, p
  FROM (SELECT coalesce(lang, '{UNDETERMINED}') AS lang,
               unnest(regexp_split_to_array(
                 translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[.,;:!?\\x0A-\\x0D]')) AS p
        FROM documents WHERE text IS NOT NULL)
), split AS (
  SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split WHERE len(w) > 0
), totals AS (
  SELECT lang, count(*) AS n FROM starts GROUP BY lang
), phrases AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM starts, (SELECT unnest(range(1, {MAX_WORDS} + 1)) AS k) WHERE i + k - 1 <= len(w)
  GROUP BY ALL HAVING count(*) >= {MIN_COUNT}
), candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM phrases WHERE k > 1
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, t.n, cut, l.f AS l, r.f AS r,
         (1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c JOIN totals t USING (lang)
  JOIN phrases l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN phrases r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ')
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT DISTINCT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, a
  FROM (SELECT *, unnest(range(1, k - size + 2)) AS i
        FROM (SELECT *, unnest(range(2, k)) AS size FROM candidates))
), kept AS (
  SELECT * FROM scored s WHERE NOT EXISTS (
    SELECT 1 FROM inside x WHERE x.lang = s.lang AND x.phrase = s.phrase AND 100 * x.a >= 100 * s.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= {TOP}
"""
