import math

import numpy as np
import pytest

from lagscope.llm import whitening as W
from tests.llm.helpers import table

ROWS = "vec_id bigint, embedding array<float>"


def brute(rows, k=4):
    """{id: [(component, n, deviation, |whitened|, explained)]} by numpy."""
    x = {i: [math.floor(256 * float(c)) for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array(fit, float) - np.array(sums) / n
    cov = z.T @ z / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return {i: [(c + 1, n, sum((n * a - s) ** 2 for a, s in zip(v, sums)),
                 abs(float((np.array(v) - np.array(sums) / n) @ q[:, c])) / math.sqrt(e[c]), e[c] / np.trace(cov))
                for c in range(k) if e[c] > 1e-12 * np.trace(cov)] for i, v in x.items()}


def check(got, want):
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert by.keys() == want.keys()
    for i, rows in by.items():
        rows.sort(key=lambda r: r.component)
        assert [(r.component, r.n, r.deviation) for r in rows] == [w[:3] for w in want[i]]
        for r, w in zip(rows, want[i]):
            assert abs(abs(r.whitened) - w[3]) < 1e-9 and abs(r.explained - w[4]) < 1e-12
            assert r.identity_error < 1e-9


def test_table_against_numpy(spark):
    t = table(spark, "embeddings", "sf0.01")
    check(W.op11(t).collect(), brute([(r.vec_id, r.embedding) for r in t.collect()]))


def test_edges(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(np.float32(c)) for c in rng.standard_normal(6)]) for i in range(40)]
    same = [(100 + i, good[0][1]) for i in range(60)]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6),
           (903, [float("inf")] + [0.0] * 5), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame(good + same + bad, ROWS)
    got = W.op11(df).collect()
    check(got, brute(good + same))
    assert {r.n for r in got} == {40}
    more = df.selectExpr("*", "7 as x", "8 as n", "9 as id", "1 as component", "2 as vector")
    check(W.op11(more).collect(), brute(good + same))
    null = W.op11(df.selectExpr("cast(null as bigint) vec_id", "embedding")).collect()
    assert len(null) == 400 and {r.vec_id for r in null} == {None}


def test_few_dimensions_and_no_variance(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)], ROWS)
    got = W.op11(df).collect()  # one direction varies
    assert sorted(r.component for r in got) == [1] * 5 and all(abs(r.explained - 1) < 1e-12 for r in got)
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], ROWS)
    assert W.op11(one).count() == 0 and W.op11(df.limit(0)).count() == 0
    assert W.op11(df).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_exact_far_from_zero(spark):
    """Sums beyond exact doubles, deviations beyond 64 bits."""
    rows = [(i, [1e15 + 8 * i, float(i % 3)]) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    x = {i: [math.floor(256 * c) for c in v] for i, v in rows}
    s = [sum(c) for c in zip(*x.values())]
    got = {r.vec_id: r.deviation for r in W.op11(df).collect()}
    assert got == {i: sum((6 * a - t) ** 2 for a, t in zip(v, s)) for i, v in x.items()}
    far = spark.createDataFrame([(i, [(-1) ** i * 3e38, float(i)]) for i in range(4)], ROWS)
    assert {r.deviation for r in W.op11(far).collect()} == {None}


@pytest.mark.parametrize("d, rank", [(1, 1), (2, 2), (6, 2), (40, 40), (150, 60)])
def test_solver(d, rank):
    b = np.random.default_rng(d).standard_normal((d, rank))
    a = b @ b.T
    values, q = W.jacobi_davidson(lambda u: a @ u, d, 4, np.trace(a))
    want = np.linalg.eigvalsh(a)[::-1][:4]
    assert np.allclose(values, want, atol=1e-11 * want[0]) and np.allclose(q.T @ q, np.eye(len(values)), atol=1e-12)
    assert np.linalg.norm(a @ q - q * values, axis=0).max() < 1e-11 * want[0]


def test_solver_with_equal_eigenvalues():
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((30, 30)))[0]
    a = q @ np.diag([9.0] * 5 + [8.9999999] * 5 + [1.0] * 20) @ q.T
    values, v = W.jacobi_davidson(lambda u: a @ u, 30, 4, np.trace(a))
    assert np.allclose(values, 9.0, atol=1e-12) and np.linalg.norm(a @ v - v * values) < 1e-11


def test_minres():
    rng = np.random.default_rng(3)
    mats = [(m + m.T) / 2 for m in rng.standard_normal((3, 12, 12))]
    b = rng.standard_normal((12, 3))
    x = W.minres(lambda z: np.stack([m @ z[:, i] for i, m in enumerate(mats)], axis=1), b, 40)
    assert all(np.linalg.norm(m @ x[:, i] - b[:, i]) < 1e-6 for i, m in enumerate(mats))
