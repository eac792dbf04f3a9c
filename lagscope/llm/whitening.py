"""Embedding whitening by a Jacobi-Davidson eigensolver.

Vectors are turned into whole numbers ``x = floor(256 * c)``; the fit list has
each different vector once. Its covariance is never formed: the solver sees it
through products with a few vectors at a time, one distributed pass each over
the centred fit list. The leading eigenpairs are found by Rayleigh-Ritz in a
growing subspace; the subspace is expanded with solutions of the projected
correction equations, solved by some steps of MINRES that run in lockstep for
all wanted pairs, so that a pass serves all of them. A pair is locked when its
residual is at rounding level, checked with a fresh product; the solver ends
when all are, and raises an error if they never are.

Bounded memory: the fit list is written to the shared folder in blocks and
read as a stream; a pass sends one small sum of each task to the driver, and
the tasks are as many as the cluster runs at once. The driver holds vectors of
the embedding's length only.

Defined results: a vector that is null or has a null or non-finite entry is
dropped, as is one whose length is not the commonest (of equally common ones
the longest). Entries beyond 64 bits after scaling are held at the limit.
Repeated vectors count once in the fit and get equal rows; null ids are kept.
Components without variance (eigenvalue below 1e-12 of the total) do not
exist, so a table of equal vectors, or an empty one, gives no rows.
``deviation`` is null where it does not fit 64 bits. Columns are taken by
name; others are not read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lagscope.llm.common import settle

COMPONENTS = 4
SCALE = 256
#: Rows of a stored block, at most.
BLOCK = 4096
#: Pairs sought beyond the wanted ones, so that the last gap is a wide one.
GUARD = 4
#: Steps of MINRES for one correction.
INNER = 4
#: Columns of the subspace before it is restarted.
WIDEST = 48
MAX_OUTER = 300
#: A residual counts as rounding error at so many units of it.
UNITS = 64

Product = Callable[[np.ndarray], np.ndarray]


def minres(apply: Product, b: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of ``apply(x) = b`` after ``steps`` steps of
    MINRES, for each column of ``b`` with a symmetric operator of its own;
    ``apply`` takes and gives all columns at once."""
    tiny = np.finfo(float).tiny
    x = w = w2 = np.zeros_like(b)
    beta = np.linalg.norm(b, axis=0)
    r1, r2, y = b, b, b
    old, dbar, eps, phibar = np.zeros_like(beta), np.zeros_like(beta), np.zeros_like(beta), beta.copy()
    cs, sn, live = -np.ones_like(beta), np.zeros_like(beta), beta > 0
    least = 1e-12 * beta
    for step in range(steps):
        v = y / np.where(live, beta, 1.0)
        y = apply(np.where(live, v, 0.0))
        if step:
            y = y - beta / np.where(old > 0, old, 1.0) * r1
        alpha = (v * y).sum(axis=0)
        y = y - alpha / np.where(live, beta, 1.0) * r2
        r1, r2, old = r2, y, beta
        beta = np.linalg.norm(y, axis=0)
        was, delta, gbar = eps, cs * dbar + sn * alpha, sn * dbar - cs * alpha
        eps, dbar = sn * beta, -cs * beta
        gamma = np.maximum(np.hypot(gbar, beta), tiny)
        cs, sn = gbar / gamma, beta / gamma
        phi, phibar = cs * phibar, sn * phibar
        w1, w2 = w2, w
        w = np.where(live, (v - was * w1 - delta * w2) / gamma, 0.0)
        x = x + np.where(live, phi * w, 0.0)
        live = live & (beta > least) & (np.abs(phibar) > least)
        if not live.any():
            break
    return x


def _against(t: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span ``t`` beside the orthonormal ``bases``."""
    out = np.zeros((len(t), 0))
    for c in t.T:
        size = np.linalg.norm(c)
        if not np.isfinite(size) or size == 0:
            continue
        c = c / size
        for _ in range(3):
            for q in (*bases, out):
                c = c - q @ (q.T @ c)
            size = np.linalg.norm(c)
            if size < 1e-10:
                break
            c = c / size
        else:
            out = np.hstack([out, c[:, None]])
    return out


def jacobi_davidson(product: Product, d: int, wanted: int, trace: float,
                    seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their eigenvectors, of
    the symmetric positive operator of ``d`` dimensions behind ``product``."""
    wanted = min(wanted, d)
    width = min(d, wanted + GUARD)
    tolerance = UNITS * np.finfo(float).eps * np.sqrt(d)
    locked, values = np.zeros((d, 0)), []
    v = _against(np.random.default_rng(seed).standard_normal((d, width)))
    av = product(v)
    top = 0.0
    for _ in range(MAX_OUTER):
        h = v.T @ av
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        top = max(top, theta[0])
        if top <= 1e-12 * max(trace, np.finfo(float).tiny):
            break
        n = min(v.shape[1], wanted - len(values) + GUARD)
        u, au = v @ s[:, :n], av @ s[:, :n]
        r = au - u * theta[:n]
        r -= locked @ (locked.T @ r)
        sizes = np.linalg.norm(r, axis=0)
        done = 0
        while done < min(n, wanted - len(values)) and sizes[done] <= tolerance * top:
            done += 1
        if done:
            # products that were carried through rotations are checked afresh
            fresh = product(u[:, :done])
            rest = fresh - u[:, :done] * theta[:done]
            rest -= locked @ (locked.T @ rest)
            good = 0
            while good < done and np.linalg.norm(rest[:, good]) <= 4 * tolerance * top:
                good += 1
            locked, values = np.hstack([locked, u[:, :good]]), values + theta[:good].tolist()
            if len(values) >= wanted:
                break
            keep = s[:, good:]
            v, av = v @ keep, av @ keep
            if not good:  # what the rotations lost is computed again
                v = _against(v, locked)
                av = product(v)
            if not v.shape[1]:
                v = _against(np.random.default_rng(seed + len(values)).standard_normal((d, width)), locked)
                av = product(v)
            if good:
                continue
            sizes, n = sizes[:0], 0
        if n:
            if v.shape[1] + n > min(WIDEST, d):
                keep = min(2 * width, v.shape[1])
                v, av = v @ s[:, :keep], av @ s[:, :keep]
            open_ = np.flatnonzero(sizes > tolerance * top)

            def project(z: np.ndarray) -> np.ndarray:
                z = z - locked @ (locked.T @ z)
                return z - u[:, open_] * (u[:, open_] * z).sum(axis=0)

            def corrected(z: np.ndarray) -> np.ndarray:
                z = project(z)
                return project(product(z) - z * theta[open_])

            t = minres(corrected, -project(r[:, open_]), INNER)
        else:
            t = np.random.default_rng(seed + 1).standard_normal((d, width))
        new = _against(t, locked, v)
        if not new.shape[1]:  # nothing new in these directions
            new = _against(np.random.default_rng(_ + 100).standard_normal((d, width)), locked, v)
        if new.shape[1]:
            v, av = np.hstack([v, new]), np.hstack([av, product(new)])
    else:
        raise RuntimeError("the eigenpairs did not reach rounding level")
    return np.array(values), locked


@dataclass(frozen=True)
class Whitening:
    """``x`` is whitened by ``(x - sums / n) @ vectors / sqrt(values)``."""
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        # whole part and rest apart, as sums may be beyond exact doubles
        return np.array([s // self.n + (s % self.n) / self.n for s in self.sums], float)


def scaled(df: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``df`` without the rows to be dropped, with ``x array<bigint>`` added."""
    ok = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(
        vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))))
    length = ok.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (ok.where(F.size(vector) == (length[0] if length else 0))
            .withColumn("x", F.transform(vector, lambda c: F.floor(c.cast("double") * scale))))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(rows: DataFrame) -> DataFrame:
    """``(rows, width, data)``: different vectors, packed."""
    schema = pa.schema([("rows", pa.int64()), ("width", pa.int64()), ("data", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                x = _matrix(b.column("x").slice(at, BLOCK))
                kind = next((t for t in ("<i2", "<i4") if len(x) and (x == x.astype(t)).all()), "<i8")
                yield pa.record_batch([[len(x)], [int(kind[2])], [x.astype(kind).tobytes()]], schema=schema)

    tasks = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    return settle(rows.select("x").distinct().coalesce(tasks)
                  .mapInArrow(pack, "rows bigint, width bigint, data binary"))


def _read(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    for n, width, data in zip(*(b.column(c).to_pylist() for c in ("rows", "width", "data"))):
        yield np.frombuffer(data, f"<i{width}").reshape(n, -1).astype(np.int64)


def _totals(blocks: DataFrame) -> tuple[int, list[int]]:
    """Rows and the sum of each dimension, exact."""
    schema = pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, 0
        for b in batches:
            for x in _read(b):
                n += len(x)
                small = x.dtype == np.int64 and np.abs(x.astype(float)).max() < 2.0 ** 48
                sums = sums + (x.sum(axis=0) if small else x.astype(object).sum(axis=0)).astype(object)
        if n:
            yield pa.record_batch([pa.array([n]), pa.array([[str(s) for s in sums]])], schema=schema)

    parts = blocks.mapInArrow(run, "n bigint, sums array<string>").collect()
    sums = [[int(s) for s in p.sums] for p in parts]
    return sum(p.n for p in parts), [sum(c) for c in zip(*sums)]


def _summed(blocks: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """Sum over the blocks of ``f``, in the order of the tasks."""
    schema = pa.schema([("part", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for x in _read(b):
                y = f(x)
                held = y if held is None else held + y
        if held is not None:
            yield pa.record_batch([pa.array([held.tobytes()])], schema=schema)

    parts = [np.frombuffer(r.part, float) for r in blocks.mapInArrow(run, "part binary").collect()]
    return reduce(np.add, parts) if parts else None


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Learns from the ``x`` of ``scaled`` rows; None without a row."""
    blocks = _blocks(rows)
    n, sums = _totals(blocks)
    if not n:
        return None
    model = Whitening(n, sums, np.zeros(0), np.zeros((len(sums), 0)), 0.0, 0.0)
    mean, d = model.mean, len(sums)

    def product(u: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            z = x - mean
            return (z.T @ (z @ u)).ravel()
        return _summed(blocks, part).reshape(d, -1) / n

    trace = float(_summed(blocks, lambda x: ((x - mean) ** 2).sum(keepdims=True).ravel())[0]) / n
    if not trace > 0:
        return None
    values, vectors = jacobi_davidson(product, d, components, trace)
    real = values > 1e-12 * trace
    values, vectors = values[real], vectors[:, real]
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]

    def white(x: np.ndarray) -> np.ndarray:
        return (x - mean) @ vectors / np.sqrt(values)

    k = len(values)
    center = _summed(blocks, lambda x: white(x).sum(axis=0)) / n
    spread = _summed(blocks, lambda x: ((white(x) - center).T @ (white(x) - center)).ravel()) / n
    return Whitening(n, sums, values, vectors, trace, float(np.abs(spread.reshape(k, k) - np.eye(k)).max()))


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n * x - S) ** 2, exact."""
    most = n * max(int(x.max()), -int(x.min()), 0) + max(map(abs, sums)) if x.size else 0
    if x.shape[1] * most * most < 1 << 62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    out = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [v if v < 1 << 63 else None for v in out.tolist()]


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``
    for every remaining row and component."""
    id_type = dict(df.dtypes)[id_col]
    rows = scaled(df.select(F.col(id_col).alias("id"), F.col(vector).alias("vector")), "vector").select("id", "x")
    model = fit(rows, components)
    schema = (f"id {id_type}, component int, n bigint, deviation bigint, whitened double, "
              "explained double, identity_error double")
    if model is None:
        return df.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x = _matrix(part.column("x"))
                m = len(x)
                white = (x - model.mean) @ model.vectors / np.sqrt(model.values)
                each = np.repeat(np.arange(m), k)
                yield pa.record_batch([
                    part.column("id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array(_deviation(x, model.n, model.sums), pa.int64()).take(pa.array(each)),
                    pa.array(white.ravel()), pa.array(np.tile(model.values / model.trace, m)),
                    pa.array(np.full(m * k, model.identity_error))],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op11(embeddings: DataFrame) -> DataFrame:
    return whiten(embeddings).withColumnRenamed("id", "vec_id")
