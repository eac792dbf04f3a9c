import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from lagscope.llm import simhash_dedup as S
from tests.llm.helpers import clashing, odd_documents, table


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(pairs):
    """(id, fp) rows to (id, fp, smallest id of the class)."""
    root = list(range(len(pairs)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, j in combinations(range(len(pairs)), 2):
        if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 2 and find(i) != find(j):
            root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(pairs):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((k, f, least.get(find(i))) for i, (k, f) in enumerate(pairs)), key=repr)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_in_the_radius(radius):
    masks = S.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for bits in combinations(range(64), radius):
        change = sum(1 << b for b in bits)
        hiding = [m for m in masks if not m & change]
        assert hiding
        if radius < 3:
            assert all(any(not s & change for s in S.split_masks(m, radius)) for m in hiding)


def test_table_against_brute_force(spark):
    docs = table(spark, "documents", "sf0.01")
    got = sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in S.op4(docs).collect()), key=repr)
    assert got == brute_classes([(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()])


def test_crowded_near_copies(spark):
    """Chains of fingerprints one or two bits apart, crowded in few buckets."""
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 1 << 62))
    values = {base}
    while len(values) < 500:
        v = sorted(values)[int(rng.integers(0, len(values)))]
        for b in rng.choice(12, int(rng.integers(1, 4)), replace=False):
            v ^= 1 << int(b) * 5
        values.add(v)
    pairs = [(i, v) for i, v in enumerate(sorted(values))] + [(1000 + i, int(x)) for i, x in
                                                              enumerate(rng.integers(0, 1 << 62, 200))]
    prints = spark.createDataFrame(pairs, "id bigint, fp bigint")
    assert sorted(map(tuple, S.classes(prints).collect()), key=repr) == brute_classes(pairs)


def test_edges(spark):
    odd = odd_documents(spark)
    got = sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in S.op4(odd).collect()), key=repr)
    assert got == brute_classes([(r.doc_id, brute_fingerprint(r.text)) for r in odd.collect()])
    assert S.op4(odd.limit(0)).count() == 0


def test_stage_keeps_one_of_each_class(spark):
    odd = clashing(odd_documents(spark))
    kept = S.stage(odd)
    assert kept.columns == odd.columns
    # ids 1, 2, 3 and the null text are one class; equal rows stay once; no id is no reason to go
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [
        (False, 1), (False, 4), (False, 5), (False, 6), (False, 7), (False, 8), (True, 0)]
    docs = table(spark, "documents")
    classes = {r.component_id for r in S.op4(docs).collect()}
    assert sorted(r.doc_id for r in S.stage(docs).collect()) == sorted(classes)
    none = odd.where("doc_id IS NULL")
    assert S.stage(none).count() == 2
