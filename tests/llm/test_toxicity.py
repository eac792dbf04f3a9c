import random

from pyspark.sql import functions as F

from lagscope.llm import toxicity as T
from tests.llm.helpers import clashing, odd_documents, table


def test_held_out_labels(spark):
    docs, labels = table(spark, "documents", "sf0.1"), table(spark, "labels", "sf0.1")
    model = T.fit(docs, labels.where("doc_id % 3 <> 0"))
    rows = (T.score(docs.join(labels.where("doc_id % 3 = 0").select("doc_id"), "doc_id", "left_semi"), model)
            .withColumnRenamed("toxic", "p").join(labels.withColumnRenamed("doc_id", "id"), "id").collect())
    toxic, clean = [r.p for r in rows if r.toxic], [r.p for r in rows if not r.toxic]
    assert sum(p >= 0.5 for p in toxic) >= 0.85 * len(toxic)
    assert sum(p >= 0.5 for p in clean) <= 0.01 * len(clean)


def test_chain_order_and_edges(spark):
    docs, labels = table(spark, "documents", "sf0.01"), table(spark, "labels", "sf0.01")
    model = T.fit(docs, labels)
    n = len(model.terms)
    assert [len(w) for w, _ in model.models] == [n, n + 1, n + 2]   # later models see the earlier ones
    odd = clashing(odd_documents(spark))
    got = T.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.toxic < 0.5 for r in got)
    assert len({r.toxic for r in got if r.id in (1, 2, 3)}) == 1
    assert T.op1(odd.limit(0), labels).count() == 0
    assert {r.toxic for r in T.op1(odd, labels.limit(0)).collect()} == {0}
    assert {r.score for r in T.op1(odd, labels.limit(0)).collect()} == {0.0}


def test_word_beginnings_generalise(spark):
    rng = random.Random(2)
    clean = ["".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(200)]
    text = lambda bad: " ".join(rng.choices(clean, k=60) + bad)
    rows = [(i, text([f"zurk{rng.choice(clean)}"]) if i % 4 == 0 else text([])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    labels = labels.union(spark.createDataFrame([(None, 1), (5, None), (4, 1)], "doc_id bigint, toxic int"))
    model = T.fit(docs, labels)
    assert model.predict("quiet words zurkqqq here")[-1] >= 0.5 > model.predict("quiet words here")[-1]


def test_only_copies_are_learned_once():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 9))) for _ in range(300)]
    texts = [" ".join(["sharedlongword", *rng.choices(vocabulary, k=80)]) for _ in range(500)]
    kin = [T._kin(T.words(t), t) for t in texts]
    assert len(set(kin)) == 500   # unrelated texts stay apart, though they share a rare long word
    near = 0
    for t, k in zip(texts, kin):
        assert T._kin(T.words(t), t) == k
        changed = t.split()
        changed[rng.randrange(80)] = "other"
        near += T._kin(T.words(" ".join(changed)), t) == k
    assert near >= 350
    assert T._kin([], "1 2 3") != T._kin([], "1 2 4") and T._kin([], "") == T._kin([], None)


def test_terms_are_chosen_without_the_fold(spark):
    """Against a count by hand: what a fold's choice holds does not change with that fold's rows."""
    rng = random.Random(5)
    rows = [(f"w{rng.choice('abcdefgh') * 3} " + ("bad" if i % 3 == 0 else "good") + f" {chr(97 + i % 26) * 7}",
             int(i % 3 == 0), i % 3 if i % 7 else 1) for i in range(300)]
    def choice(rows, folds):
        sample = spark.createDataFrame(rows, "text string, label int, fold int")
        sizes = {}
        for _, y, f in rows:
            sizes[y, f] = sizes.get((y, f), 0) + 1
        return T._marked(T._term_counts(sample), sizes, folds)
    for f in range(3):
        others = [g for g in range(3) if g != f]
        got = choice(rows, others)
        flipped = [(t, 1 - y if g == f else y, g) for t, y, g in rows]
        assert got.equals(choice(flipped, others))
        inside = [(set(x for w in T.words(t) for x in T.terms(w)), y) for t, y, g in rows if g != f]
        n1, n0 = sum(y for _, y in inside), sum(1 - y for _, y in inside)
        want = set()
        for term in set().union(*(ts for ts, _ in inside)):
            p, q = (sum(1 for ts, y in inside if y == c and term in ts) for c in (1, 0))
            share = (p + q) / (n1 + n0)
            z = (p / n1 - q / n0) / ((share * (1 - share) * (1 / n1 + 1 / n0)) + 1e-12) ** 0.5
            if p >= T.MIN_ROWS and z >= T.MIN_Z:
                want.add(term)
        assert set(got["term"]) == want


def test_text_ids(spark):
    docs, labels = (table(spark, n, "sf0.001").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
                    for n in ("documents", "labels"))
    got = T.op1(docs, labels)
    assert got.count() == docs.count() and dict(got.dtypes)["doc_id"] == "string"
