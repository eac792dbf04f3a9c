import random
import re

from hypothesis import given, settings, strategies as st

from lagscope.llm import decontaminate as D
from tests.llm.helpers import clashing, odd_documents, table


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute_tiles(a, b, m):
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best, found = m, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best:
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if all(free_a[i:i + best]) and all(free_b[j:j + best]):
                free_a[i:i + best] = free_b[j:j + best] = [False] * best
                out.append((i, j, best))


def brute(docs, items):
    out = []
    for d in docs:
        for i in items:
            a, b = words(d.text), words(i.text)
            if len(b) >= 5 and set(zip(b, b[1:], b[2:], b[3:], b[4:])) & set(zip(a, a[1:], a[2:], a[3:], a[4:])):
                tiles = brute_tiles(a, b, 5)
                if sum(t[2] for t in tiles) / len(b) >= 0.8:
                    out.append((d.doc_id, i.item_id, len(tiles)))
    return sorted(out, key=repr)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abc"), max_size=15))
def test_tiling(a, b):
    got = D.tile(D.tokens(" ".join(a)), D.tokens(" ".join(b)), 3)
    assert [tuple(map(int, t)) for t in got] == brute_tiles(a, b, 3)


def test_tables_against_brute_force(spark):
    docs, items = table(spark, "documents"), table(spark, "benchmark")
    got = sorted(((r.doc_id, r.item_id, r.n_tiles) for r in D.op5(docs, items).collect()), key=repr)
    assert got and got == brute(docs.collect(), items.collect())


def test_reordered_and_partial_passages(spark):
    rng = random.Random(5)
    item = [f"w{rng.randrange(10_000)}" for _ in range(40)]
    around = [f"x{rng.randrange(10_000)}" for _ in range(200)]
    text = lambda *parts: " ".join(w for p in parts for w in p)
    docs = spark.createDataFrame([
        (1, text(around, item, around)), (2, text(item[20:], around, item[:20])),
        (3, text(around, item[:30], around)), (4, text(item[:33], around)),
        (5, text(around)), (6, text(item).upper().replace(" ", ", ")), (None, text(item)), (6, text(item))],
        "doc_id bigint, text string")
    items = spark.createDataFrame([(1, text(item)), (2, None), (3, ""), (4, "a b c"), (None, text(item)), (1, text(item))],
                                  "item_id bigint, text string")
    got = sorted({(r.doc_id, r.item_id) for r in D.op5(docs, items).collect()}, key=repr)
    hit = [1, 2, 4, 6, None]
    assert got == sorted(((d, i) for d in hit for i in (1, None)), key=repr)
    assert D.op5(docs, items).count() == 6 * 3
    kept = D.stage(clashing(docs), items)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5] and kept.columns == clashing(docs).columns


def test_edges(spark):
    odd, items = odd_documents(spark), table(spark, "benchmark")
    assert D.op5(odd, items).count() == 0
    assert D.stage(odd, items).count() == odd.count()
    assert D.op5(odd.limit(0), items).count() == D.op5(odd, items.limit(0)).count() == 0


def test_common_seeds_lose_no_pair(spark):
    """A passage that every document and item has stands in for a hot seed."""
    hot = " ".join(f"h{i}" for i in range(6))
    items = spark.createDataFrame([(i, f"{hot} " + " ".join(f"i{i}w{k}" for k in range(14))) for i in range(8)],
                                  "item_id bigint, text string")
    texts = [r.text for r in items.orderBy("item_id").collect()]
    docs = spark.createDataFrame([(d, f"{hot} and more" if d % 3 else f"{hot} {texts[d % 8]}") for d in range(60)],
                                 "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.item_id, r.n_tiles) for r in D.op5(docs, items).collect()), key=repr)
    assert got == brute(docs.collect(), items.collect()) and len(got) == 20


def test_short_items_and_scripts_without_spaces(spark):
    docs = spark.createDataFrame([(1, "he said forty two is it"), (2, "forty, TWO"), (3, "two forty"),
                                  (4, "他说" "今天天气很好我们去公园" "散步"), (5, "今天天气不好"), (6, "ภาษาไทยไม่มีการเว้นวรรค"),
                                  (7, "公園今天天气很好我们去玩")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "Forty two"), (2, "今天天气很好我们去公园"), (3, "ไม่มีการเว้นวรรค"), (4, "absent")],
                                  "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id) for r in D.op5(docs, items).collect())
    assert got == [(1, 1), (2, 1), (4, 2), (6, 3), (7, 2)]


def test_tiling_is_linear_in_memory():
    import tracemalloc
    x, y = D.tokens("a " * 200_000), D.tokens("a " * 2000)
    tracemalloc.start()
    assert [tuple(t) for t in D.tile(x, y)] == [(0, 0, 2000)]
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
