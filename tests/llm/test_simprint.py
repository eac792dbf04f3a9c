import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagscope.llm import simprint as S
from tests.llm.helpers import clashing, odd_documents, table


def check(docs):
    rows = sorted(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect(),
                  key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.text.encode()))
    prints = [S.fingerprint(r.text) for r in rows]
    want = []
    for i, r in enumerate(rows):
        j = (i + 1) % len(rows)
        half = len(r.text) // 2
        new = r.text[:len(r.text) - half] + rows[j].text[:half]
        fp = S.fingerprint(new)
        within = (sum(S.likeness(prints[i], p) >= 1 - S.RADIUS / S.BITS for p in prints) - 1
                  if r.doc_id is not None and r.doc_id % 100 == 0 else None)
        want.append((r.doc_id, len(r.text), hashlib.sha256(new.encode()).hexdigest(), S.to_hex(prints[i]),
                     S.to_hex(fp), S.likeness(prints[i], fp), S.likeness(prints[i], prints[j]), within))
    got = S.op6(docs)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
                           "near_next", "n_within"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    return want


def test_table_against_brute_force(spark):
    rows = check(table(spark, "documents", "sf0.01").repartition(9))
    assert sum(r[5] > r[6] for r in rows) >= 0.97 * len(rows)


def test_edges(spark):
    odd = odd_documents(spark)
    check(odd)
    check(clashing(odd).withColumn("doc_id", F.col("doc_id") * 100))
    check(odd.limit(1))
    assert S.op6(odd.limit(0)).count() == 0


def test_votes_by_hand():
    """Equal weights: the bits that over half the terms' hashes have."""
    one = S.fingerprint("only")
    assert (S.fingerprint(" only ") == one).all() and (S.fingerprint("") == 0).all()
    a, b, c = (S.fingerprint(t) for t in ("a b", "b c", "c d"))
    assert (S.fingerprint("a b c d") == ((a & b) | (a & c) | (b & c))).all()
    # a pair that occurs three times outvotes two others: 1 + ln 3 > 2
    assert (S.fingerprint("a b x a b y a b") != S.fingerprint("a b")).any()


@pytest.mark.parametrize("radius,blocks", [(0, 4), (3, 4), (7, 8), (5, 8)])
def test_search_finds_everything_in_the_radius(spark, radius, blocks):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, (6, S.WORDS)).astype(np.uint64)
    rows = [b.copy() for b in base]
    for b in base:
        for k in range(1, 12):
            x = b.copy()
            for bit in rng.choice(S.BITS, k, replace=False):
                x[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
            rows.append(x)
    signed = [r.view(np.int64).tolist() for r in rows]
    index = spark.createDataFrame([(s, 1) for s in signed], "fp array<bigint>, n long")
    queries = spark.createDataFrame([(s,) for s in signed[:6] + signed[:2]], "fp array<bigint>")
    got = {(tuple(r["query"]), tuple(r.fp), r.distance) for r in S.search(queries, index, radius, blocks).collect()}
    d = lambda x, y: int(np.bitwise_count(x ^ y).sum())
    assert got == {(tuple(signed[i]), tuple(signed[j]), d(rows[i], rows[j])) for i in range(6)
                   for j in range(len(rows)) if d(rows[i], rows[j]) <= radius}


def test_default_search_is_exact_far_out(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, S.WORDS).astype(np.uint64)
    rows = []
    for k in (0, 8, 20, 30, 39, 40, 41, 41, 41, 42, 43, 60):
        x = base.copy()
        for bit in rng.choice(S.BITS, k, replace=False):
            x[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        rows.append((x.view(np.int64).tolist(), 1))
    # three bits in all blocks but one with two: the least that one block shows
    x = base.copy()
    for t, (start, _, _) in enumerate(S.block_plan(S.RADIUS, S.BLOCKS)):
        for bit in range(start, start + 3 - (t == 5)):
            x[bit // 64] ^= np.uint64(1) << np.uint64(63 - bit % 64)
    rows.append((x.view(np.int64).tolist(), 1))
    index = spark.createDataFrame(rows, "fp array<bigint>, n long")
    got = sorted(r.distance for r in S.search(index.limit(1), index).collect())
    assert got == [0, 8, 20, 30, 39, 40, 41, 41, 41, 41]


def test_near_copies_are_found_and_named(spark):
    """One word in a hundred replaced; exact copies share a fingerprint."""
    import random
    rng = random.Random(2)
    words = [f"w{k}" for k in range(3000)]
    docs, want = [], {}
    for k in range(20):
        text = [rng.choice(words) for _ in range(rng.choice((60, 200, 600)))]
        near = list(text)
        for i in rng.sample(range(len(text)), max(1, len(text) // 100)):
            near[i] = "changed"
        docs += [(100 * k, " ".join(text)), (100 * k + 1, " ".join(near)), (100 * k + 2, " ".join(near))]
        want[100 * k] = {100 * k, 100 * k + 1, 100 * k + 2}
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found, of = S.members(df)
    asked = of.where("doc_id % 100 = 0").select(F.col("fp").alias("query"), F.col("doc_id").alias("q"))
    got = {}
    for q, doc in found.join(asked, "query").join(of, "fp").select("q", "doc_id").collect():
        got.setdefault(q, set()).add(doc)
    assert got == want
    assert {r.doc_id: r.n_within for r in S.op6(df).collect() if r.doc_id % 100 == 0} == dict.fromkeys(want, 2)
