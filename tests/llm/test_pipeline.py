from pyspark.sql import functions as F

import corpus_pipeline as P
from lagscope.llm import decontaminate, langid, mixing, queries, simhash_dedup
from tests.llm.helpers import clashing, odd_documents, table

SF = "/root/testdata/sf0.01"


def test_stages_follow_each_other(spark):
    # ids of their own: two classes with one smallest id could not be told apart below
    odd = odd_documents(spark).withColumn("doc_id", F.col("doc_id") + 1_000_000)
    docs = table(spark, "documents", "sf0.01").unionByName(odd)
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "secret_scan",
                                        "mix_sources"]
    seen = [docs]
    for _, stage in P.STAGES:
        made = stage(spark, seen[-1], SF)
        seen.append(spark.createDataFrame(made.collect(), made.schema))
        if len(seen) < len(P.STAGES) + 1:
            assert seen[-1].columns == docs.columns
    start, known, unique, clean, masked, mixed = [s.count() for s in seen]
    assert start > known > unique > clean == masked == mixed
    # every decision by the operator on the stage's own input
    model = langid.fit(docs.where("lang IS NOT NULL"))
    keep = sum(lang != "und" and p >= 0.3 for lang, p in (model.predict(r.text) for r in docs.collect()))
    assert known == keep
    assert unique == len({r.component_id for r in simhash_dedup.op4(seen[1]).collect() if r.component_id is not None}
                         ) + sum(r.doc_id is None for r in seen[2].collect())
    leaked = {r.doc_id for r in decontaminate.op5(seen[2], table(spark, "benchmark", "sf0.01")).collect()}
    assert leaked and {r.doc_id for r in seen[3].collect()} == {r.doc_id for r in seen[2].collect()} - leaked
    want = {(r.doc_id, r.source): r.taken for r in mixing.mix(seen[4], mixing.word_count(seen[4]["text"])).collect()}
    assert {(r.doc_id, r.source): r.taken for r in seen[5].collect()} == want


def test_run_and_empty(spark):
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken"]
    assert out.count() > 800
    docs = clashing(odd_documents(spark)).limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_every_operator_is_registered():
    names = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert names == list(range(1, 14))
