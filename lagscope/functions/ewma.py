"""Rate-meter kernel: count, 1/5/15-minute decayed rates and mean rate.

A meter is marked with deltas d_i at times t_i (seconds).  Its clock ticks
every 5 s on the epoch grid; a mark at t belongs to tick k = floor(t/5) + 1
(the first tick after it).  On each tick the per-second rate of that tick's
marks, x = sum(d)/5, updates ``rate += alpha * (x - rate)`` with
``alpha = 1 - exp(-5 / (60 * N))``; the meter's first tick sets ``rate = x``.
A snapshot at T sees ticks k <= floor(T/5), count = sum of d_i with
t_i <= T, and mean = count / (max(last mark <= T, 5*floor(T/5)) - first mark),
undefined when that span is 0.

Between marks the rate only decays, so the state changes at mark ticks only:
S_j = S_{j-1} * exp(-lam * (k_j - k_{j-1})) + c_j with lam = 5/(60N) and
c_j = w_j * D_j / 5.  The recurrence is evaluated in blocks whose exponents
stay below ``_MAX_EXP`` (no overflow however long the history).

The same ``advance`` runs once per key over a whole history (batch,
``applyInPandas``) or per micro-batch from carried state (streaming).
"""

from __future__ import annotations

from dataclasses import dataclass, astuple

import numpy as np

from lagscope.schemas import EWMA_MINUTES, TICK_SECONDS

_MAX_EXP = 600.0
LAMBDAS = tuple(TICK_SECONDS / (60.0 * n) for n in EWMA_MINUTES)
ALPHAS = tuple(1.0 - np.exp(-lam) for lam in LAMBDAS)


@dataclass
class MeterState:
    t_first: float      # time of the first mark (meter creation)
    k_first: int        # tick of the first mark (initialising tick)
    count: int          # sum of all deltas so far
    t_last: float       # time of the latest mark
    k_last: int         # tick of the latest mark
    s1: float           # rates right after tick k_last, N = 1, 5, 15
    s5: float
    s15: float

    def as_tuple(self):
        return astuple(self)


def decayed_sums(ticks: np.ndarray, c: np.ndarray, lam: float) -> np.ndarray:
    """S_j = sum_{i<=j} c_i * exp(-lam * (ticks_j - ticks_i)), ticks ascending."""
    out = np.empty(len(c), dtype=np.float64)
    carry, carry_k = 0.0, ticks[0] if len(ticks) else 0
    start, n = 0, len(c)
    span = _MAX_EXP / lam
    while start < n:
        base = ticks[start]
        end = int(np.searchsorted(ticks, base + span, side="right"))
        rel = (ticks[start:end] - base).astype(np.float64)
        e = np.exp(lam * rel)
        out[start:end] = (np.cumsum(c[start:end] * e) / e
                          + carry * np.exp(-lam * (ticks[start:end] - carry_k)))
        carry, carry_k = out[end - 1], ticks[end - 1]
        start = end
    return out


def advance(state: MeterState | None, t: np.ndarray, d: np.ndarray,
            produce: np.ndarray) -> tuple[dict, MeterState | None]:
    """Apply new marks (t ascending, all after ``state.t_last``) and evaluate
    snapshots at ``produce`` instants (ascending).  Instants before the
    meter's first mark are skipped.  Returns (columns, new state)."""
    t = np.asarray(t, dtype=np.float64)
    d = np.asarray(d, dtype=np.int64)
    produce = np.asarray(produce, dtype=np.float64)
    if state is None and len(t) == 0:
        return _empty(), None
    k = np.floor(t / TICK_SECONDS).astype(np.int64) + 1
    t_first = state.t_first if state else float(t[0])
    k_first = state.k_first if state else int(k[0])
    base_count = state.count if state else 0

    uk, inv = np.unique(k, return_inverse=True)
    dsum = np.bincount(inv, weights=d.astype(np.float64), minlength=len(uk)) if len(uk) else np.zeros(0)
    carry = [state.s1, state.s5, state.s15] if state else None
    ticks = np.concatenate([[state.k_last], uk]) if state else uk
    sums = []
    for i, (lam, alpha) in enumerate(zip(LAMBDAS, ALPHAS)):
        w = np.where(uk == k_first, 1.0, alpha)
        c = w * dsum / TICK_SECONDS
        if state:
            c = np.concatenate([[carry[i]], c])
        sums.append(decayed_sums(ticks, c, lam) if len(ticks) else np.zeros(0))

    produce = produce[produce >= t_first]
    cum = base_count + np.cumsum(d)
    K = np.floor(produce / TICK_SECONDS).astype(np.int64)
    j = np.searchsorted(ticks, K, side="right") - 1
    seen = j >= 0
    jj = np.where(seen, j, 0)
    rates = []
    for lam, s in zip(LAMBDAS, sums):
        if len(s) == 0:
            rates.append(np.zeros(len(produce)))
            continue
        rates.append(np.where(seen, s[jj] * np.exp(-lam * (K - ticks[jj])), 0.0))
    i = np.searchsorted(t, produce, side="right") - 1
    has = i >= 0
    ii = np.where(has, i, 0)
    count = np.where(has, cum[ii] if len(cum) else 0, base_count).astype(np.int64)
    t_last = np.where(has, t[ii] if len(t) else 0.0, state.t_last if state else t_first)
    elapsed = np.maximum(t_last, TICK_SECONDS * K.astype(np.float64)) - t_first
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(elapsed > 0, count / np.where(elapsed > 0, elapsed, 1.0), np.nan)

    if len(t):
        new_state = MeterState(t_first, k_first, int(cum[-1]), float(t[-1]), int(ticks[-1]),
                               float(sums[0][-1]), float(sums[1][-1]), float(sums[2][-1]))
    else:
        new_state = state
    cols = {"produce": produce, "count": count, "rate1": rates[0], "rate5": rates[1],
            "rate15": rates[2], "rate_mean": mean}
    return cols, new_state


def _empty() -> dict:
    z = np.zeros(0)
    return {"produce": z, "count": np.zeros(0, dtype=np.int64), "rate1": z, "rate5": z,
            "rate15": z, "rate_mean": z}
