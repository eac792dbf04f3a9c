import math
import zlib

from lagscope.llm import quality as Q
from tests.llm.helpers import clashing, odd_documents, table


def test_held_out_labels(spark):
    docs, labels = table(spark, "documents", "sf0.1"), table(spark, "labels", "sf0.1")
    got = {r.doc_id: r for r in Q.op2(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(g.held_out for g, _ in held)
    assert sum(g.predicted == q for g, q in held) >= 0.98 * len(held)
    assert all(g.predicted == int(g.score >= 0.3) and 0 <= g.score <= 1 for g in got.values())


def test_column_equals_the_rules_by_hand(spark):
    docs, labels = table(spark, "documents", "sf0.01"), table(spark, "labels", "sf0.01")
    rules = Q.fit(docs, labels)
    assert 0 < len(rules.rules) < 60 and len(rules.explain()) == len(rules.rules)
    for d in docs.unionByName(odd_documents(spark)), :
        got = sorted((r.id is None, r.id or 0, round(r.score, 9)) for r in Q.score(d, rules).collect())
        want = []
        for r in d.collect():
            x, z = Q.statistics(r.text), rules.bias
            for conditions, w in rules.rules:
                z += w * all(x[f] <= at if below else x[f] > at for f, below, at in conditions)
            want.append((r.doc_id is None, r.doc_id or 0, round(1 / (1 + math.exp(-z)), 9)))
        assert got == sorted(want)


def test_edges(spark):
    odd, labels = clashing(odd_documents(spark)), table(spark, "labels", "sf0.01")
    docs = table(spark, "documents", "sf0.01")
    assert Q.statistics(None) == Q.statistics("") == Q.statistics(" \n") == (0.0,) * len(Q.STATISTICS)
    for some, score in ((labels.limit(0), 0.5), (labels.where("quality = 1"), 1.0), (labels.where("quality = 0"), 0.0)):
        got = Q.score(odd, Q.fit(docs, some)).collect()
        assert len(got) == odd.count() and all(abs(r.score - score) < 1e-6 for r in got)
    assert Q.op2(docs.limit(0), labels).count() == 0
