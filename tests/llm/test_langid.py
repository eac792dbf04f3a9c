import zlib

from lagscope.llm import langid
from tests.llm.helpers import clashing, odd_documents, rows, table


def test_held_out_accuracy(spark):
    docs = table(spark, "documents", "sf0.01")
    got = {r.doc_id: r for r in langid.op9(docs).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(got) == docs.count() and all(got[r.doc_id].held_out for r in held)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.98 * len(held)


def test_families_come_first_and_edges(spark):
    model = langid.fit(table(spark, "documents", "sf0.01"))
    assert model.families == {"germanic": ("de", "en"), "romance": ("es", "fr")}
    assert set(model.machines) == {("", "germanic", "romance"), ("germanic", "de", "en"), ("romance", "es", "fr")}
    for text in (None, "", " \n", "123 ## 4"):
        assert model.predict(text) == ("und", 0.0)
    odd = odd_documents(spark)
    got = odd.select("doc_id", langid.identify(odd, model).alias("p")).select("doc_id", "p.*")
    assert got.count() == odd.count()
    assert all(0 <= r.score <= 1 for r in got.collect())


def test_nothing_to_learn(spark):
    docs = table(spark, "documents")
    assert langid.fit(docs.limit(0)).predict("the words") == ("und", 0.0)
    assert langid.op9(docs.limit(0)).count() == 0


def test_stage_keeps_clean_rows_and_columns(spark):
    docs = clashing(table(spark, "documents", "sf0.01"))
    odd = clashing(odd_documents(spark))
    kept = langid.stage(docs.unionByName(odd))
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.select("text").collect()]
    assert kept.join(docs, "doc_id", "left_semi").count() >= 0.99 * docs.count()
    assert None not in ids and "" not in ids and "12345 ### 678" not in ids
    assert rows(kept.select("text").where("text = 'x y z'")) == [("x y z",)] * 2


def test_every_language_is_learned_however_many(spark):
    """70 labels; the six rarest have fewer rows than any other."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def text(k, row):
        a, b, c = letters[k % 26], letters[(k // 26 * 7 + k + 1) % 26], letters[(k * 5 + 3) % 26]
        return " ".join((a + b + c) * (1 + (row + i) % 3) for i in range(12))

    labels = [f"x{k:02}" for k in range(70)]
    docs = spark.createDataFrame([(100 * k + row, text(k, row), label) for k, label in enumerate(labels)
                                  for row in range(4 if k < 64 else 3)], "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    assert sorted(x for members in model.families.values() for x in members) == labels
    assert [model.predict(text(k, 1))[0] for k in range(64, 70)] == labels[64:]
