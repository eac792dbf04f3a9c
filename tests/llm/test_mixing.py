import re
from collections import defaultdict

from lagscope.llm import mixing as M
from tests.llm.helpers import clashing, odd_documents, table


def brute_targets(sizes):
    """Share by weight, cut at three times the size, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = dict.fromkeys(order, 0.0), set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            for s in free:
                target[s] = left * weight[s] / total
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            free.discard(s)
            left -= target[s]
    return target


def check(docs, got):
    size = lambda t: len(re.findall("[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r.doc_id, r.source, size(r.text)) for r in docs.collect()), key=repr) == sorted(
        ((r.doc_id, r.source, r["size"]) for r in got), key=repr)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    target = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
    for s, t in target.items():
        assert t - 1.001 <= taken[s] <= t + 1e-6


def test_targets_and_words_taken(spark):
    for docs in (table(spark, "documents"), table(spark, "documents", "sf0.01"), odd_documents(spark)):
        check(docs, M.stage(docs).collect())


def test_reruns_agree_whatever_the_partitions(spark):
    docs = table(spark, "documents")
    assert sorted(M.op7(docs).collect()) == sorted(M.op7(docs.repartition(7)).collect())


def test_schedule_is_evenly_spread(spark):
    shares = spark.createDataFrame([("a", 60.0, 0.0), ("b", 30.0, 60.0), (None, 10.0, 90.0)],
                                   "source string, target double, cum double")
    slots = M.schedule(shares, 10).collect()
    assert sorted(r.slot for r in slots) == list(range(1024))
    by = defaultdict(list)
    for r in sorted(slots, key=lambda r: r.slot):
        by[r.source].append(r)
    for source, share in (("a", 0.6), ("b", 0.3), (None, 0.1)):
        assert [r.rank for r in by[source]] == list(range(len(by[source])))
        for n in range(64, 1025, 64):   # every stretch of the mix holds its share
            assert abs(sum(r.slot < n for r in by[source]) - share * n) <= 8


def test_edges(spark):
    odd = clashing(odd_documents(spark))
    got = M.stage(odd)
    assert got.columns == odd.columns + ["_size", "source_size", "target", "taken"]
    assert got.count() == odd.count()
    assert M.op7(odd.limit(0)).count() == 0
    none = odd.where("doc_id IN (1, 2, 3)")
    assert [(r.target, r.taken) for r in M.op7(none).collect()] == [(0.0, 0)] * none.count()


def test_word_count(spark):
    from pyspark.sql import functions as F
    texts = [None, "", "a", " a  b\t\n\x0b\x0c\rc ", "  x y", "é😀 b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(M.word_count(F.col("t"))).collect()] == [
        len(re.findall("[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_the_mixture_holds_the_words_taken(spark):
    from pyspark.sql import functions as F
    docs = table(spark, "documents")
    pieces = M.mixture(docs, M.word_count(F.col("text")), block_words=256).collect()
    taken = {(r.source, r.doc_id): r for r in M.mix(docs, M.word_count(F.col("text")), block_words=256).collect()}
    words, per_slot, streams = defaultdict(int), defaultdict(int), defaultdict(list)
    for p in pieces:
        assert 0 <= p["first"] and p["first"] + p.words <= taken[p.source, p.id]["size"]
        words[p.source, p.id] += p.words
        per_slot[p.source, p.slot] += p.words
        streams[p.source].append(p)
    assert words == {k: r.taken for k, r in taken.items() if r.taken}
    assert len({slot for _, slot in per_slot}) == len(per_slot)   # a slot has one source
    for source, found in streams.items():
        slots = [n for (s, _), n in per_slot.items() if s == source]
        assert max(slots) - min(slots) <= 2
        end = 0
        for p in sorted(found, key=lambda p: (p.slot, p["at"])):   # slots take the stream block by block
            assert p["at"] == end
            end += p.words


def test_slots_are_bounded_however_small_a_source_is(spark):
    rows = [(i, "a" if i % 2 else "b", 1000) for i in range(1000)] + [(5000, "tiny", 1), (5001, None, 40)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, words bigint")
    from pyspark.sql import functions as F
    placed, slots = M._place(df, F.col("words"), "doc_id", "source", 1024, 17)
    by = defaultdict(list)
    for r in slots.collect():
        by[r.slot_source[1:] or None].append(r)
    total = 1_000_041
    assert sum(map(len, by.values())) <= total / 1024 + 16 * 2
    assert len(by["tiny"]) == len(by[None]) == 16
    numbers = [r.slot for rs in by.values() for r in rs]
    assert len(set(numbers)) == len(numbers)
    for rs in by.values():   # ranks follow the order of the mix
        rs.sort(key=lambda r: r.slot)
        assert [r.slot_rank for r in rs] == list(range(len(rs)))
    end = max(numbers)
    places = [r.slot / end for r in by["tiny"]]
    assert all(abs((b - a) - 1 / 16) < 0.01 for a, b in zip(places, places[1:]))
    got = M.mix(df, F.col("words")).collect()
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r["size"]
    target = brute_targets({"a": 500_000, "b": 500_000, "tiny": 1, None: 40})
    assert all(t - 1.001 <= taken[s] <= t + 1e-6 for s, t in target.items())
