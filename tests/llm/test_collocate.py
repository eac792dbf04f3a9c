import random
import re
from collections import Counter, defaultdict

import pytest

from lagscope.llm import collocate as C
from tests.llm.helpers import clashing, odd_documents, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=None):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inner = {q[i:i + s] for q, b in kept.items() for s in range(2, len(q)) for i in range(len(q) - s + 1)
                 if b >= counts[q[i:i + s]]}
        scored = []
        for p, a in kept.items():
            if p not in inner:
                score, cut = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        out += [(lang, r, p.decode(), -a, l, x, n[lang], -s) for r, (s, a, p, l, x) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def mined(df, least, **names):
    got = C.collocations(df, min_count=least, **names).collect()
    out = []
    for lang in {r.lang for r in got}:
        one = sorted((r for r in got if r.lang == lang), key=lambda r: (-r.score, -r.a, r.phrase.encode()))
        out += [(lang, i, r.phrase, r.a, r.l, r.r, r.n, r.score) for i, r in enumerate(one, 1)]
    return sorted(out)


def test_table_against_brute_force(spark):
    docs = table(spark, "documents", "sf0.01")
    got = sorted(tuple(r) for r in C.op13(docs).collect())
    assert got and got == brute(((r.lang, r.text) for r in docs.select("lang", "text").collect()), 100, 2000)


@pytest.mark.parametrize("seed", range(3))
def test_bursts_spills_and_chunks(spark, monkeypatch, seed):
    """Tiny limits, so that every container bursts and every chunk spills;
    one run with words that are too many to be numbered."""
    rng = random.Random(seed)
    words = ["a", "B", "c", "Ä", "ä", "d-e", "x.y", "f"]
    texts = [(rng.choice(["en", None, "und", "fr"]),
              "".join(rng.choice(words) + rng.choice(["  ", " ", "\t", " ", ". ", "\n", "!"]) for _ in range(rng.randrange(60))))
             for _ in range(400)]
    for name, value in (("BURST", 3), ("HELD", 20), ("CHUNK", 7), ("ROW", 2), ("HEAVY", 4), ("NARROW", 100 if seed else 0)):
        monkeypatch.setattr(C, name, value)
    df = spark.createDataFrame(texts, "lang string, text string").repartition(5)
    assert mined(df, 12) == brute(texts, 12)


def test_trie_runs_are_whole_and_sorted():
    rng = random.Random(1)
    trie, want = C.HatTrie(burst=4, held=50), Counter()
    got = Counter()
    for _ in range(300):
        first = bytes([rng.randrange(4)]) * 8
        rest = sorted({bytes([rng.randrange(5)]) * 8 + bytes([rng.randrange(6)]) * 8 for _ in range(9)})
        trie.add(first, rest, [2] * len(rest))
        want.update({first + r: 2 for r in rest})
        if trie.full():
            for run in trie.spill(10):
                assert run == sorted(run) and len({k[:8] for k, _ in run}) == 1
                got.update(dict(run))
            assert trie.entries <= 10
    for run in trie.spill(0):
        got.update(dict(run))
    assert got == want and trie.entries == 0 and not trie.root


def test_exact_beyond_64_bits(spark):
    a, n, l, r = 987_654_321_987, 123_456_789_123_456, 123_456, 7_654_321
    got = spark.sql(f"SELECT {C._SCORE} AS s FROM VALUES ({a}L, {n}L, {l}L, {r}L) AS t(a, n, l, r)").first().s
    assert got == 1000 * a * n // (l * r)


def test_edges(spark):
    odd = odd_documents(spark)
    texts = [(r.lang, r.text) for r in odd.collect()]
    assert mined(odd, 2) == mined(clashing(odd), 2) == brute(texts, 2)
    assert C.op13(odd.limit(0)).count() == 0
    assert C.op13(odd).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    ties = spark.createDataFrame([("en", "p q. r s. t u")] * 3 + [(None, None)], "lang string, text string")
    assert [x[2] for x in mined(ties, 3)] == ["p q", "r s", "t u"]


def test_one_id_for_two_words_is_an_error(spark, monkeypatch):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("en", "a a b b")], "lang string, text string")
    monkeypatch.setattr(C, "_id", lambda word: F.when(F.col(word).isNotNull(), F.lit(7)))
    with pytest.raises(ValueError, match="share"):
        C.collocations(df, min_count=1)


class Task:
    """Rows of one task, without Spark."""

    def __init__(self, rows):
        import pyarrow as pa
        self.batches = [pa.record_batch([pa.array([lang for lang, _ in part]), pa.array([text.encode() for _, text in part])],
                                        ["lang", "text"]) for part in rows]

    def mapInArrow(self, run, schema):
        return [tuple(r.values()) for b in run(iter(self.batches)) for r in b.to_pylist()]


class Every:
    """Takes every word but ``rare`` for frequent; keeps how many were asked for."""
    asked = 0

    def has(self, h):
        self.asked += len(h)
        return h != C.np.uint64(C.xxhash.xxh64_intdigest(b"rare", 42)) ^ C._salt("en")


@pytest.mark.parametrize("block, held", [(100_000, 500_000), (3, 500_000), (3, 2)])
def test_words_are_looked_up_once_a_task(monkeypatch, block, held):
    monkeypatch.setattr(C, "BLOCK", block, raising=False)
    monkeypatch.setattr(C, "HELD", held)
    texts = ["a b, C a b", "rare", "", "a rare b c rare a", "A\tb\n\n.c", ";"] * 3
    every = Every()
    broadcast = type("B", (), {"value": every})
    got = C._encode(Task([[("en", t) for t in texts[:7]], [("en", t) for t in texts[7:]]]), broadcast, None, 8)
    names = {C.xxhash.xxh64_intdigest(w, 42): w.decode() for w in (b"a", b"b", b"c")} | {0: "."}
    coded = [" ".join(names[int(i)] for i in C.np.frombuffer(ids, "<u8")) for _, ids in got]
    assert coded == ["a b . c a b .", "b c .", "a b ."] * 3   # phrases only, each with a break behind it
    if held > 2:
        assert every.asked == 4   # a, b, c and rare
