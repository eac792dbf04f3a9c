"""Meter kernel: G4 worked example, closed form = recurrence, incremental =
one-shot, long histories without overflow, and the Spark wrapper."""

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lagscope.functions import ewma


def snap(t, d, T):
    cols, _ = ewma.advance(None, np.array(t, float), np.array(d), np.array([T], float))
    if len(cols["produce"]) == 0:
        return None
    return {k: v[0] for k, v in cols.items()}


def test_g4_worked_example():
    t, d = [60, 120], [60, -30]
    assert snap(t, d, 30) is None
    s = snap(t, d, 60)
    assert s["count"] == 60 and s["rate1"] == 0 and math.isnan(s["rate_mean"])
    s = snap(t, d, 65)
    assert s["count"] == 60 and s["rate1"] == pytest.approx(12) and s["rate_mean"] == pytest.approx(12)
    s = snap(t, d, 120)
    assert s["count"] == 30
    assert s["rate1"] == pytest.approx(12 * math.exp(-55 / 60))
    assert s["rate_mean"] == pytest.approx(0.5)
    s = snap(t, d, 125)
    assert s["rate1"] == pytest.approx(12 * math.exp(-1) - 6 * (1 - math.exp(-1 / 12)))
    assert s["rate_mean"] == pytest.approx(30 / 65)


def closed_form(t, d, T):
    """Reference evaluation straight from the definition (tests only)."""
    t = np.asarray(t, float)
    d = np.asarray(d, float)
    k = np.floor(t / ewma.TICK_SECONDS) + 1
    K = np.floor(T / ewma.TICK_SECONDS)
    kf = k.min()
    out = []
    for lam, alpha in zip(ewma.LAMBDAS, ewma.ALPHAS):
        m = k <= K
        w = np.where(k == kf, 1.0, alpha)
        out.append(float(np.sum((w * d / ewma.TICK_SECONDS * np.exp(-lam * (K - k)))[m])))
    seen = t <= T
    count = float(d[seen].sum())
    elapsed = max(t[seen].max(), ewma.TICK_SECONDS * K) - t.min()
    mean = count / elapsed if elapsed > 0 else float("nan")
    return count, out[0], out[1], out[2], mean


marks = st.lists(st.tuples(st.integers(0, 4000), st.integers(-500, 500)), min_size=1, max_size=60)


@settings(max_examples=150, deadline=None)
@given(marks, st.integers(0, 5000))
def test_closed_form_equals_recurrence(ms, extra):
    ms = sorted(set(ms), key=lambda x: x[0])
    t = np.array([m[0] for m in ms], float) + 1e9
    d = np.array([m[1] for m in ms])
    T = t.max() + extra
    got = snap(t, d, T)
    count, r1, r5, r15, mean = closed_form(t, d, T)
    assert got["count"] == count
    for a, b in ((got["rate1"], r1), (got["rate5"], r5), (got["rate15"], r15)):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-12)
    assert (math.isnan(got["rate_mean"]) and math.isnan(mean)) or got["rate_mean"] == pytest.approx(mean)


@settings(max_examples=100, deadline=None)
@given(marks, st.integers(1, 5))
def test_incremental_equals_one_shot(ms, parts):
    ms = sorted(set(ms), key=lambda x: x[0])
    t = np.array([m[0] for m in ms], float) + 1e9
    d = np.array([m[1] for m in ms])
    produce = np.arange(t.min() - 100, t.max() + 200, 37.0)
    full, _ = ewma.advance(None, t, d, produce)
    # split marks and instants into consecutive chunks, carrying state
    cuts = np.linspace(t.min() - 1, t.max() + 201, parts + 1)
    state, rows = None, {k: [] for k in full}
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        m = (t > lo) & (t <= hi)
        p = produce[(produce > lo) & (produce <= hi)]
        cols, state = ewma.advance(state, t[m], d[m], p)
        for k in rows:
            rows[k].extend(cols[k])
    for k in full:
        np.testing.assert_allclose(np.array(rows[k], float), np.asarray(full[k], float),
                                   rtol=1e-9, atol=1e-12, equal_nan=True)


def test_long_history_no_overflow():
    # one mark a minute for 30 days: exp(+lambda t) would overflow after ~12 h
    t = np.arange(0, 30 * 86400, 60, dtype=float) + 1.7e9
    d = np.full(len(t), 7)
    cols, _ = ewma.advance(None, t, d, np.array([t[-1] + 60]))
    for r in ("rate1", "rate5", "rate15"):
        assert np.isfinite(cols[r]).all()
    assert cols["rate15"][0] == pytest.approx(7 / 60, rel=0.05)


def test_spark_meter_matches_kernel(spark):
    from datetime import datetime, timezone
    from lagscope.operators import meters as M
    rows = [(datetime.fromtimestamp(1704067200 + s, tz=timezone.utc), "t", v)
            for s, v in ((0, 100), (60, 160), (120, 130))]
    sums = spark.createDataFrame(rows, "scrape_ts timestamp, topic string, total bigint")
    deltas = M.offset_delta(sums, ["topic"])
    grid = M.ProduceGrid(1704067200 + 30, 5, 30)
    out = {r["produce_ts"].timestamp(): r for r in M.meter_snapshots(deltas, ["topic"], grid).collect()}
    assert min(out) == 1704067200 + 60
    r = out[1704067200 + 125]
    assert r["count"] == 30
    assert r["rate1"] == pytest.approx(12 * math.exp(-1) - 6 * (1 - math.exp(-1 / 12)))


def _per_key(deltas, keys, grid):
    """One kernel pass over each key's whole history, on the driver."""
    out = {}
    pdf = deltas.toPandas().sort_values("scrape_ts", kind="stable")
    for key, g in pdf.groupby(keys):
        t = g["scrape_ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
        first = max(0, math.ceil((t[0] - grid.start) / grid.interval))
        instants = grid.start + grid.interval * np.arange(first, grid.count, dtype=float)
        cols, _ = ewma.advance(None, t, g["delta"].to_numpy(), instants)
        for i, at in enumerate(cols["produce"]):
            out[(*key, int(at))] = [cols[c][i] for c in ("count", "rate1", "rate5", "rate15", "rate_mean")]
    return out


@pytest.mark.parametrize("chunk", [6 * 3600, 7 * 86400])
def test_chunked_scan_equals_one_pass(spark, chunk):
    """30 days of hourly scrapes in short and long chunks: the parallel scan
    gives the one-pass kernel's values (chunk boundaries, gaps, first chunk)."""
    from lagscope.operators import meters as M
    from lagscope.plans.metrics import MetricsJob
    from lagscope.sources.fixtures import Fixture
    job = MetricsJob.from_fixture(Fixture(spark, "/root/testdata/sf0.001", "H"))
    d = M.offset_delta(M.group_offset_sum(job.committed), M.GROUP_KEYS).checkpoint()
    want = _per_key(d, M.GROUP_KEYS, job.produce)
    got = {(r.group_id, r.topic, int(r.s)): [r["count"], r.rate1, r.rate5, r.rate15, r.rate_mean]
           for r in M.meter_snapshots(d, M.GROUP_KEYS, job.produce, chunk)
           .selectExpr("*", "unix_seconds(produce_ts) AS s").collect()}
    assert got.keys() == want.keys() and len(got) > 1000
    for k, v in want.items():
        np.testing.assert_allclose(np.array(got[k], float), np.array(v, float), rtol=1e-9, atol=1e-15, equal_nan=True)
