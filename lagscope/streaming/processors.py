"""Keyed stateful processors for ``transformWithStateInPandas``.

Both processors run in event-time mode on a stream watermarked on
``scrape_ts``.  A produce instant T is emitted for a key once the watermark
has passed T, so every mark/observation at or before T is known.  Rows that
arrive after T was emitted but belong to an earlier scrape are late and
ignored.  Observations newer than the
last emitted instant are kept as a short pending list in state; an
event-time timer at the next instant makes a key emit even when it receives
no more rows (a vanished topic keeps reporting its last value).

``MeterProcessor`` sums the rows of each scrape per key, turns successive
sums into deltas and folds them with the same kernel as batch
(``lagscope.functions.ewma.advance``).  ``CarryForwardProcessor`` re-emits the
last values of all gauges of one partition (or topic, or group partition) at
each instant, from one state and one timer.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, LongType, StringType, StructField,
                               StructType)

from lagscope.functions import ewma

def _schema(spec: str) -> StructType:
    """``"a bigint, b array<double>"`` → StructType, built without a session
    (state schemas are also constructed on Python workers)."""
    types = {"bigint": LongType(), "double": DoubleType(), "boolean": BooleanType(), "string": StringType()}
    fields = []
    for part in spec.split(","):
        name, typ = part.split()
        if typ.startswith("array<"):
            fields.append(StructField(name, ArrayType(types[typ[6:-1]])))
        else:
            fields.append(StructField(name, types[typ]))
    return StructType(fields)


METER_STATE = _schema(
    "prev_sum bigint, last_final double, last_emitted double, has_meter boolean, "
    "t_first double, k_first bigint, count bigint, t_last double, k_last bigint, "
    "s1 double, s5 double, s15 double, pend_t array<double>, pend_d array<bigint>, "
    "ps_t array<double>, ps_v array<bigint>")

CARRY_STATE = _schema(
    "last_emitted double, names array<string>, folded array<double>, folded_values array<bigint>, "
    "pend_names array<string>, pend_t array<double>, pend_v array<bigint>")


class _Grid:
    def __init__(self, start: float, interval: float, count: int | None):
        """``count`` None: the grid has no end."""
        self.start, self.interval = float(start), float(interval)
        self.count = np.inf if count is None else int(count)
        self.end = self.start + self.interval * (self.count - 1)

    def between(self, lo: float, hi: float) -> np.ndarray:
        """Instants T with lo < T <= hi."""
        lo = max(lo, self.start - self.interval)
        hi = min(hi, self.end)
        if hi < self.start:
            return np.zeros(0)
        k0 = max(0, int(np.floor((lo - self.start) / self.interval)) + 1)
        k1 = int(min(self.count - 1, np.floor((hi - self.start) / self.interval)))
        if k1 < k0:
            return np.zeros(0)
        return self.start + self.interval * np.arange(k0, k1 + 1, dtype=np.float64)

    def next_after(self, t: float) -> float | None:
        t = max(t, self.start - self.interval)
        k = max(0, int(np.floor((t - self.start) / self.interval)) + 1)
        return self.start + self.interval * k if k < self.count else None


def _key_values(key) -> list:
    """Grouping-key values as plain Python values.  Keys built from a pandas
    batch can carry an integer column as float (when the batch also holds
    nulls) or numpy scalars; the output schema needs int / None."""
    out = []
    for v in key:
        if isinstance(v, np.generic):
            v = v.item()
        if isinstance(v, float):
            v = None if np.isnan(v) else int(v)
        out.append(v)
    return out


def _seconds(series: pd.Series) -> np.ndarray:
    """Epoch seconds of a timestamp column (microsecond resolution)."""
    return pd.to_datetime(series, utc=True).dt.as_unit("us").astype("int64").to_numpy() / 1e6


class MeterProcessor(StatefulProcessor):
    """Meter per key: ``value_col`` summed per scrape, deltas marked.

    Rows of one scrape may arrive over several micro-batches; partial sums
    are accumulated per scrape and a scrape is final (turned into a delta)
    only once the watermark has passed it.  Rows for an already final scrape
    are late and dropped.
    """

    def __init__(self, keys: list[str], value_col: str, start: float, interval: float,
                 count: int | None):
        self.keys, self.value_col = keys, value_col
        self.grid = _Grid(start, interval, count)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("meter", METER_STATE)

    def _load(self):
        if self.state.exists():
            return list(self.state.get())
        return [None, -np.inf, -np.inf, False, None, None, None, None, None, None, None, None,
                [], [], [], []]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Starts from a row of ``operators.meter_store`` (state at the end of
        a chunk, with ``end`` its time): as if its scrapes had come in and
        every instant before ``end`` had been reported."""
        r = initialState.iloc[0]
        end = float(r["end"])
        st = self._load()
        st[0], st[1] = int(r["last_total"]), float(_seconds(initialState["last_ts"])[0])
        reported = self.grid.between(-np.inf, np.nextafter(end, -np.inf))
        st[2] = float(reported[-1]) if len(reported) else -np.inf
        if not pd.isna(r["count"]):
            st[3] = True
            st[4:12] = [float(r["t_first"]), int(r["k_first"]), int(r["count"]), float(r["t_last"]),
                        int(end // ewma.TICK_SECONDS), float(r["r1"]), float(r["r5"]), float(r["r15"])]
        self.state.update(tuple(st))
        nxt = self.grid.next_after(st[2])
        if nxt is not None:
            self.handle.registerTimer(int(round(nxt * 1000)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        st = self._load()
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf["_t"] = _seconds(pdf["scrape_ts"])
        sums = pdf.groupby("_t", sort=True)[self.value_col].sum()
        partial = dict(zip(st[14] or [], st[15] or []))
        for t, v in sums.items():
            if t <= st[1]:
                continue          # scrape already final: late rows
            partial[float(t)] = partial.get(float(t), 0) + int(v)
        order = sorted(partial)
        st[14], st[15] = order, [partial[t] for t in order]
        yield from self._emit(key, st, timerValues.getCurrentWatermarkInMs() / 1000.0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        st = self._load()
        yield from self._emit(key, st, timerValues.getCurrentWatermarkInMs() / 1000.0)

    def _finalize(self, st, wm: float) -> None:
        """Scrapes at or before the watermark become marks (delta to the previous sum)."""
        ps_t, ps_v = list(st[14] or []), list(st[15] or [])
        pend_t, pend_d = list(st[12] or []), list(st[13] or [])
        keep_t, keep_v = [], []
        for t, v in zip(ps_t, ps_v):
            if t > wm:
                keep_t.append(t)
                keep_v.append(v)
                continue
            if st[0] is not None:
                pend_t.append(t)
                pend_d.append(int(v) - int(st[0]))
            st[0], st[1] = int(v), t
        st[12], st[13], st[14], st[15] = pend_t, pend_d, keep_t, keep_v

    def _emit(self, key, st, wm: float) -> Iterator[pd.DataFrame]:
        self._finalize(st, wm)
        ticks = self.grid.between(st[2], wm)
        out = None
        if len(ticks):
            pend_t = np.asarray(st[12] or [], dtype=np.float64)
            pend_d = np.asarray(st[13] or [], dtype=np.int64)
            upto = ticks[-1]
            fold = pend_t <= upto
            core = ewma.MeterState(*st[4:12]) if st[3] else None
            cols, core = ewma.advance(core, pend_t[fold], pend_d[fold], ticks)
            if core is not None:
                st[3] = True
                st[4:12] = list(core.as_tuple())
            st[12], st[13] = pend_t[~fold].tolist(), pend_d[~fold].tolist()
            st[2] = float(upto)
            n = len(cols["produce"])
            if n:
                out = {k: [v] * n for k, v in zip(self.keys, _key_values(key))}
                out["produce_ts"] = pd.to_datetime((cols["produce"] * 1e6).astype("int64"), unit="us", utc=True)
                for c in ("count", "rate1", "rate5", "rate15", "rate_mean"):
                    out[c] = cols[c]
        self.state.update(tuple(st))
        nxt = self.grid.next_after(max(st[2], wm))
        if nxt is not None:
            self.handle.registerTimer(int(round(nxt * 1000)))
        if out is not None:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


class CarryForwardProcessor(StatefulProcessor):
    """Last value of every gauge of one key at every produce instant after the
    gauge is first seen.

    The gauges of a key come from one scrape row, so they share a state and a
    timer: the carried values by name, and the observations that wait for the
    instant that reports them. Observations may come in any order as long as
    the watermark has not passed them; of two with the same name and time the
    later to arrive counts, and one without a value is none."""

    def __init__(self, keys: list[str], start: float, interval: float, count: int | None):
        self.keys = keys
        self.grid = _Grid(start, interval, count)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("carry", CARRY_STATE)

    def _load(self):
        """``(last emitted instant, {name: (time, value)}, {name: {time: value}})``."""
        if not self.state.exists():
            return -np.inf, {}, {}
        last, names, folded_t, folded_v, pend_names, pend_t, pend_v = self.state.get()
        pending: dict = {}
        for n, t, v in zip(pend_names, pend_t, pend_v):
            pending.setdefault(n, {})[t] = v
        return last, dict(zip(names, zip(folded_t, folded_v))), pending

    def handleInputRows(self, key, rows, timerValues):
        last, carried, pending = self._load()
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf = pdf[pdf["value"].notna() & pdf["scrape_ts"].notna()]
        for n, t, v in zip(pdf["name"], _seconds(pdf["scrape_ts"]), pdf["value"]):
            if n not in carried or t > carried[n][0]:   # newer than the value that stands
                pending.setdefault(n, {})[float(t)] = int(v)
        yield from self._emit(key, last, carried, pending, timerValues.getCurrentWatermarkInMs() / 1000.0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._emit(key, *self._load(), timerValues.getCurrentWatermarkInMs() / 1000.0)

    def _emit(self, key, last, carried, pending, wm: float):
        ticks = self.grid.between(last, wm)
        names, at, values = [], [], []
        if len(ticks):
            last = float(ticks[-1])
            for n in list(dict.fromkeys([*carried, *pending])):
                waiting = pending.pop(n, {})
                times = np.array(sorted(waiting), dtype=np.float64)
                # the carried value stands before the first waiting observation
                vals = np.array([carried[n][1] if n in carried else 0, *[waiting[t] for t in times]], dtype=np.int64)
                j = np.searchsorted(times, ticks, side="right")
                seen = (j > 0) | (n in carried)
                names += [n] * int(seen.sum())
                at.append(ticks[seen])
                values.append(vals[j[seen]])
                if j[-1]:
                    carried[n] = (float(times[j[-1] - 1]), int(vals[j[-1]]))
                if j[-1] < len(times):
                    pending[n] = {float(t): waiting[t] for t in times[j[-1]:]}
        waits = [(n, t, v) for n, some in pending.items() for t, v in some.items()]
        self.state.update((float(last), list(carried), [t for t, _ in carried.values()], [v for _, v in carried.values()],
                           [n for n, _, _ in waits], [t for _, t, _ in waits], [v for _, _, v in waits]))
        nxt = self.grid.next_after(max(last, wm))
        if nxt is not None and (carried or waits):
            self.handle.registerTimer(int(round(nxt * 1000)))
        if names:
            out = {k: [v] * len(names) for k, v in zip(self.keys, _key_values(key))}
            out["name"] = names
            out["produce_ts"] = pd.to_datetime((np.concatenate(at) * 1e6).astype("int64"), unit="us", utc=True)
            out["value"] = np.concatenate(values)
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass
