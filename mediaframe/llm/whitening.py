"""Whitening of embeddings by a bidiagonal qd solver.

Each task reduces its centred rows block by block to one triangular factor; factors meet sixteen at a
time until one is left. On it, of the size of the dimensions, the driver does the rest: Householder
reflections make it bidiagonal, dqds finds its singular values to high relative accuracy, and twisted
factorisations the vectors of its squared form, which the reflections carry back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

EPS = float(np.finfo(float).eps)
CELLS = 1 << 20  # numbers of a block of rows
FAN_IN = 16


# --- singular values and vectors of one triangular factor

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, superdiagonal and the right reflections of a Householder bidiagonalisation."""
    a = np.array(r, float)
    d, right = a.shape[1], []

    def reflection(x: np.ndarray) -> np.ndarray:
        v, size = x.copy(), np.linalg.norm(x)
        if size == 0 or not np.any(x[1:]):
            return np.zeros(len(x))
        v[0] += np.copysign(size, x[0])
        return v / np.linalg.norm(v)

    for k in range(d):
        v = reflection(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        v = reflection(a[k, k + 1:])
        a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
        right.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squared singular values, falling, of the bidiagonal matrix whose squared diagonal is q and whose
    squared superdiagonal is e. Sweeps of the differential quotient-difference transform with shifts,
    which only adds, multiplies and divides positive numbers but for the shift; so small values are as
    accurate as large ones. A shift that goes below the least value is tried again smaller, then as none."""
    small, floor = (16 * EPS) ** 2, float(max(np.max(q, initial=0), np.max(e, initial=0))) * EPS ** 4
    found, blocks = [], [([float(x) for x in q], [float(x) for x in e], 0.0)]
    while blocks:
        q, e, shift = blocks.pop()
        sweeps = 0
        while True:
            n = len(q)
            if n == 0:
                break
            if n == 1:
                found.append(q[0] + shift)
                break
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= floor or e[i] <= small * (shift + min(q[i], q[i + 1]))), None)
            if cut is not None:
                blocks += [(q[:cut + 1], e[:cut], shift), (q[cut + 1:], e[cut + 1:], shift)]
                break
            if n == 2:
                large = (q[0] + q[1] + e[0] + ((q[0] - q[1] + e[0]) ** 2 + 4 * e[0] * q[1]) ** 0.5) / 2
                found += [large + shift, (q[1] / large * q[0] if large else 0.0) + shift]
                break
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            large = (q[-2] + q[-1] + e[-1] + ((q[-2] - q[-1] + e[-1]) ** 2 + 4 * e[-1] * q[-1]) ** 0.5) / 2
            tau = q[-2] / large * q[-1] if large else 0.0
            for step in (tau * (1 - 4 * EPS), tau / 2, tau / 16, 0.0):
                made = _sweep(q, e, step)
                if made:
                    q, e = made
                    shift += step
                    break
            sweeps += 1
            if sweeps > 200 * n:
                raise ArithmeticError("dqds does not converge")
    return np.sort(np.array(found))[::-1]


def _sweep(q: list[float], e: list[float], tau: float) -> tuple[list[float], list[float]] | None:
    d, q2, e2 = q[0] - tau, [], []
    for i in range(len(e)):
        if d < 0:
            return None
        top = d + e[i]
        ratio = q[i + 1] / top if top else 0.0
        q2.append(top)
        e2.append(e[i] * ratio)
        d = d * ratio - tau
    return None if d < 0 else ([*q2, d], e2)


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """The unit eigenvector at `value` of the squared bidiagonal matrix (diagonal a, superdiagonal b): its
    factorisations from the top and from the bottom meet where their common pivot is least."""
    n, q, e, ab, least = len(a), a * a, b * b, a[:-1] * b, EPS * EPS * max(value, EPS ** 4 * float(np.max(a * a)), 1e-200)
    s, top, p, low = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        top[i] = s[i] + q[i] or least
        s[i + 1] = e[i] * s[i] / top[i] - value
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        low[i + 1] = e[i] + p[i + 1] or least
        p[i] = p[i + 1] * q[i] / low[i + 1] - value
    k = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -ab[i] / top[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -ab[i] / low[i + 1] * z[i]
    return z / np.linalg.norm(z)


def right_directions(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and as columns the right singular vectors of the triangular factor r.
    Values that agree to 1e-9 share a space of which any orthonormal vectors are returned."""
    a, b, right = bidiagonal(r)
    d, values, vectors = len(a), [], []
    split = [0, *(i + 1 for i in range(d - 1) if abs(b[i]) <= EPS * (abs(a[i]) + abs(a[i + 1]))), d]
    for i, j in zip(split, split[1:], strict=False):
        block = dqds(a[i:j] ** 2, b[i:j - 1] ** 2)
        zs = [twisted(a[i:j], b[i:j - 1], x) for x in block]
        k = 0
        while k < len(block):
            m = k + 1
            while m < len(block) and block[m - 1] - block[m] <= 1e-9 * block[m - 1]:
                m += 1
            if m > k + 1:  # one pivot can't tell them apart: inverse iteration of the whole space
                full = np.diag(a[i:j]) + np.diag(b[i:j - 1], 1)
                shift = block[k] * (1 + 1e-7) if block[k] else -EPS * block[0] or -1.0
                apart, x = full.T @ full - np.eye(j - i) * shift, np.random.default_rng(1).standard_normal((j - i, m - k))
                for _ in range(3):
                    x = np.linalg.qr(np.linalg.solve(apart, x))[0]
                zs[k:m] = list(x.T)
            k = m
        near = np.flatnonzero(block[:-1] - block[1:] > 1e-3 * block[:-1]) + 1
        for group in np.split(np.arange(len(block)), near):
            if len(group) > 1:  # vectors of close values are right to 1e-16 over their distance: make them orthogonal
                for k, z in zip(group, np.linalg.qr(np.array([zs[g] for g in group]).T)[0].T, strict=True):
                    zs[k] = z
        values += block.tolist()
        vectors += [np.concatenate([np.zeros(i), z, np.zeros(d - j)]) for z in zs]
    order = np.argsort(-np.array(values), kind="stable")
    v = np.array(vectors)[order].T
    for k in range(d - 1, -1, -1):
        v[k + 1:] -= 2 * np.outer(right[k], right[k] @ v[k + 1:])
    return np.sqrt(np.maximum(np.array(values)[order], 0)), v


# --- the distributed part

@dataclass(frozen=True)
class Whitening:
    """Of n fitted vectors: exact sums of the fixed-point entries, directions as columns by falling
    variance, those variances, and the sum of all."""

    scale: float
    offset: int
    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.trace


def matrices(column: pa.Array, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and rows, in blocks, of the lists that are not null and hold finite numbers that fit;
    of one size only, or of each size."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    offsets = np.asarray(column.offsets, np.int64)
    flat = np.asarray(pc.fill_null(column.values.cast(pa.float64()), float("nan")))
    for d in [size] if size is not None else np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        step = max(1, CELLS // d)
        for k in range(0, len(rows), step):
            part = rows[k:k + step]
            m = flat[offsets[part][:, None] + np.arange(d)]
            good = (np.abs(m) < 2.0 ** 56).all(axis=1)  # false for NaN and infinity
            if good.any():
                yield part[good], m[good]


def fixed(m: np.ndarray, scale: float, offset: int) -> np.ndarray:
    return np.floor(scale * m).astype(np.int64) + offset


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, in whole numbers; Python's own where 64 bits are not enough."""
    wide = int(np.abs(x).max(initial=0)) * n >= 1 << 61
    return x.astype(object) * n - sums.astype(object) if wide else x * n - sums.astype(np.int64)


def tree_fold(parts: DataFrame, combine: Callable[[list[bytes]], bytes]) -> bytes | None:
    """One payload from a table (run, payload), of which sixteen neighbouring runs meet at a time."""
    last = parts.agg(F.max("run")).first()[0]
    if last is None:
        return None

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("run")
        return pd.DataFrame({"run": [int(rows["run"].iloc[0]) // FAN_IN], "payload": [combine(list(rows["payload"]))]})

    while last > 0:
        last //= FAN_IN
        parts = parts.groupBy(F.floor(F.col("run") / F.lit(FAN_IN)).alias("to")).applyInPandas(lambda rows: meet(rows[["run", "payload"]]), "run long, payload binary")
    return bytes(parts.first().payload)


def _sums(rows: DataFrame, scale: float, offset: int) -> tuple[int, int, np.ndarray] | None:
    """The size that most vectors have (ties: the largest), their number and exact sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for b in batches:
            for _, m in matrices(b.column(0)):
                x = fixed(m, scale, offset)
                e = seen.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
                e[0] += len(x)
                e[1] = e[1] + (x.astype(object) if int(np.abs(x).max()) >= 1 << 40 else x).sum(axis=0)
        for d, (n, s) in seen.items():
            yield pa.RecordBatch.from_pydict({"dims": pa.array([d], pa.int32()), "n": [n], "sums": pa.array([[Decimal(int(v)) for v in s]], pa.list_(pa.decimal128(38, 0)))})

    parts = stage(rows.select("vector").mapInArrow(run, "dims int, n long, sums array<decimal(38,0)>"), "sums")
    best = parts.groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if best is None:
        return None
    each = parts.filter(F.col("dims") == best.dims).select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros(best.dims, object)
    for r in each:
        sums[r["at"]] = int(r["v"])
    return best.dims, best.n, sums


def _only(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector"))


def _stacked(payloads: list[bytes], d: int) -> bytes:
    return np.linalg.qr(np.vstack([np.frombuffer(p).reshape(-1, d) for p in payloads]), mode="r").tobytes()


def fit_whitening(vectors: DataFrame, vector_col: str = "embedding", components: int = 32, scale: float = 64.0, offset: int = 1_000_000) -> Whitening | None:
    """The whitening of all vectors, after each entry c became the whole number floor(scale * c) + offset.

    Vectors that are null or hold null, non-finite or too large entries (from 2 ** 56 on) are left out, as
    are those of another size than most have; empty ones too. Directions along which nothing varies are
    left out. None if no vector is left, or all are equal. Two passes over the data; what reaches the
    driver is one sum and one triangular factor of the size of the dimensions."""
    rows = vectors.select(F.col(f"`{vector_col}`").alias("vector"))
    fitted = _sums(rows, scale, offset)
    if fitted is None:
        return None
    d, n, sums = fitted

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for b in batches:
            for _, m in matrices(b.column(0), d):
                y = centred(fixed(m, scale, offset), n, sums).astype(float) / n
                r = np.linalg.qr(np.vstack([r, y]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_pydict({"run": [TaskContext.get().partitionId()], "payload": [r.tobytes()]})

    parts = stage(rows.mapInArrow(factor, "run long, payload binary"), "factors")
    payload = tree_fold(parts, lambda p: _stacked(p, d))
    r = np.vstack([np.frombuffer(payload).reshape(-1, d), np.zeros((d, d))])[:d]
    values, directions = right_directions(r)
    variances = values ** 2 / n
    told = variances > (64 * d * EPS) ** 2 * variances[0]
    k = min(components, int(told.sum()))
    if not k:
        return None
    return Whitening(scale, offset, n, tuple(sums), directions[:, :k].copy(), variances[:k].copy(), float(variances.sum()))


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, deviation, whitened (one number for each direction) for each vector that fits the model.
    deviation, the sum over dimensions of (n * x - sum) ** 2, is exact, or null if 64 bits can't hold it."""
    told = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = told.value
        sums, to = np.array(m.sums, object), m.directions / np.sqrt(m.variances)
        for b in batches:
            for rows, block in matrices(b.column(1), len(sums)):
                c = centred(fixed(block, m.scale, m.offset), m.n, sums)
                wide = c.dtype == object or float(np.abs(c).max()) ** 2 * len(sums) >= 2.0 ** 62
                exact = ((c.astype(object) if wide else c) ** 2).sum(axis=1).tolist()
                w = (c.astype(float) / m.n) @ to
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([x if x < 1 << 63 else None for x in exact], pa.int64()), lists], names=[b.schema.names[0], "deviation", "whitened"])

    rows = _only(vectors, id_col, vector_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>").withColumnRenamed("id", id_col)


def _moments(payloads: list[bytes], k: int) -> bytes:
    """Number, means and centred products of several parts from those of each."""
    n, mean, m2 = 0.0, np.zeros(k), np.zeros((k, k))
    for p in payloads:
        x = np.frombuffer(p)
        n2, mean2, m22 = x[0], x[1:1 + k], x[1 + k:].reshape(k, k)
        apart = mean2 - mean
        m2 = m2 + m22 + np.outer(apart, apart) * (n * n2 / (n + n2))
        mean, n = mean + apart * (n2 / (n + n2)), n + n2
    return np.concatenate([[n], mean, m2.ravel()]).tobytes()


def covariance(rows: DataFrame, column: str, k: int) -> np.ndarray:
    """The covariance (divisor n) of a column of k numbers: blocks are centred before they are multiplied."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            for _, w in matrices(b.column(0), k):
                mean = w.mean(axis=0)
                parts = [_moments([*parts, np.concatenate([[float(len(w))], mean, ((w - mean).T @ (w - mean)).ravel()]).tobytes()], k)]
        if parts:
            yield pa.RecordBatch.from_pydict({"run": [TaskContext.get().partitionId()], "payload": parts})

    payload = tree_fold(stage(rows.select(F.col(column).alias("v")).mapInArrow(run, "run long, payload binary"), "moments"), lambda p: _moments(p, k))
    x = np.frombuffer(payload)
    return x[1 + k:].reshape(k, k) / x[0]


def whitened_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """One row for each vector that is fitted and each component, numbered from 1 by falling variance: id,
    component, n, deviation, whitened, explained, and identity_error, the largest absolute entry of the
    covariance of `whitened` minus the identity, measured on the rows that are returned.

    What is left out and why: see `fit_whitening`. Null and repeated ids are ordinary rows; other columns
    are not looked at. An empty table, or one whose vectors are all equal, gives no rows."""
    model = fit_whitening(vectors, vector_col, components, scale, offset)
    kind = vectors.select(f"`{id_col}`").schema[0].dataType.simpleString()
    if model is None:
        return vectors.sparkSession.createDataFrame([], f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    done = stage(whiten(vectors, model, id_col, vector_col), "whitened")
    k = len(model.variances)
    error = float(np.abs(covariance(done, "whitened", k) - np.eye(k)).max())
    shares = F.array(*[F.lit(float(x)) for x in model.explained])
    return (done.select(F.col(f"`{id_col}`"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select(F.col(f"`{id_col}`"), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                    F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error")))
