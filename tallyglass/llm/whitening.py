"""Whitening of embeddings by cyclic Jacobi rotations of their covariance.

Entries become whole numbers, so equal vectors are equal wherever they are computed. The fit list holds each distinct vector once; its
sums are exact, and its scatter about the mean is a sum over tasks of small matrices. The driver turns the covariance by symmetric
rotations, pair after pair, until every off-diagonal entry is nothing beside its two diagonal ones, which
gives small eigenvalues too in full precision. The matrix that is left, a column a component, goes out to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

SCALE = 256
COMPONENTS = 4
_SAFE = float(2**62)
#: Bytes an entry takes in a key; a vector takes the fewest that hold all its entries.
_WIDTHS = (2, 4, 8)


@dataclass
class Fit:
    """What whitening needs of the vectors of one length."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray  #: all eigenvalues, falling
    vectors: np.ndarray  #: a column a component
    identity_error: float | None = None

    @property
    def whole(self) -> np.ndarray:
        """Which components have spread beyond rounding."""
        return self.values > self.values[:1].sum() * len(self.values) * np.finfo(float).eps

    def whitener(self, components: int) -> np.ndarray:
        """Columns to project centred vectors on; a component without spread has NaN."""
        k = min(components, len(self.values))
        return self.vectors[:, :k] / np.sqrt(np.where(self.whole[:k], self.values[:k], np.nan))


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix without negative eigenvalues.

    A sweep meets every pair of rows once, in rounds of pairs that don't touch each other and are turned together. It ends once
    no entry is more than rounding beside the root of the product of its diagonal entries. The largest entry of a vector is positive.
    """
    a, d = np.array(matrix, dtype=np.float64), len(matrix)
    v = np.eye(d)
    even = d + d % 2
    ring = np.arange(even)
    for _ in range(sweeps):
        turned = False
        for _ in range(even - 1):
            p, q = ring[: even // 2], ring[::-1][: even // 2]
            p, q = np.minimum(p, q), np.maximum(p, q)
            p, q = p[q < d], q[q < d]
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
            x, y, off = a[p, p], a[q, q], a[p, q]
            open_ = np.abs(off) > np.finfo(float).eps * np.sqrt(np.maximum(x, 0) * np.maximum(y, 0))
            if not open_.any():
                continue
            turned = True
            p, q, x, y, off = p[open_], q[open_], x[open_], y[open_], off[open_]
            with np.errstate(over="ignore"):
                cot = (y - x) / (2 * off)
                t = np.where(cot < 0, -1.0, 1.0) / (np.abs(cot) + np.hypot(cot, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            for m in (a, v):
                left, right = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            above, below = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * above - s[:, None] * below, s[:, None] * above + c[:, None] * below
            a[p, p], a[q, q], a[p, q], a[q, p] = x - t * off, y + t * off, 0, 0
        if not turned:
            break
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    v = v[:, order]
    if d:
        v = v * np.where(v[np.abs(v).argmax(0), np.arange(d)] < 0, -1.0, 1.0)
    return values[order], v


def _quantised(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, whole-number vectors) for each length of vector in a column of arrays, without those that hold a null or non-finite entry.

    What is beyond a long becomes the nearest long, as in Spark's floor.
    """
    n = len(column)
    offsets = column.offsets.to_numpy().astype(np.int64)
    first, last = (int(offsets[0]), int(offsets[-1])) if n else (0, 0)
    flat = column.values.slice(first, last - first)
    entries = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])  # a null is NaN here
    starts, ends = offsets[:-1] - first, offsets[1:] - first
    valid = column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[starts])
    lengths = ends - starts
    for d in np.unique(lengths[valid]):
        rows = np.flatnonzero(valid & (lengths == d))
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(scale * entries[starts[rows][:, None] + np.arange(d)])
            whole = np.where(x >= 2.0**63, 2**63 - 1, np.where(x < -(2.0**63), -(2**63), np.where(np.abs(x) < 2.0**63, x, 0).astype(np.int64)))
        yield rows, whole.astype(np.int64)


def _keys(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors grouped by the width they need: (which, the vectors as narrow integers)."""
    if not x.size:
        yield np.arange(len(x)), x.astype("<i2")
        return
    low, high = x.min(1), x.max(1)
    width = np.select([(low >= -(1 << 8 * w - 1)) & (high < 1 << 8 * w - 1) for w in _WIDTHS[:-1]], _WIDTHS[:-1], _WIDTHS[-1])
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        yield which, x[which].astype(f"<i{w}")


def distinct(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The fit list: rows (dims, key) for each distinct whole-number vector, its entries as bytes. Written to the shared folder.

    Batches and map tasks drop what repeats before anything is exchanged, so copies of one vector cost a row a task.
    """
    small_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _quantised(batch.column(0), scale):
                for _, k in _keys(x):
                    found = sorted({r.tobytes() for r in k})
                    yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]] * len(found), pa.int32()), pa.array(found, pa.binary())], ["dims", "key"])

    rows = vectors.select(F.col(vector).alias("v")).where("v is not null").mapInArrow(run, "dims int, key binary")
    return materialize(rows.distinct(), "fit-list")


def _decoded(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Vectors of a batch of (dims, key), those of one length and width together."""
    dims = batch.column(0).to_numpy()
    keys = batch.column(1).to_pylist()
    size = np.array([len(k) for k in keys], dtype=np.int64)
    for d, b in {*zip(dims.tolist(), size.tolist(), strict=True)}:
        data = b"".join(keys[i] for i in np.flatnonzero((dims == d) & (size == b)))
        if d:
            yield np.frombuffer(data, dtype=f"<i{b // d}").reshape(-1, d).astype(np.int64)


def _apart(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: longs where those hold it, else Python's integers."""
    if not x.size:
        return x
    if n * float(max(abs(int(x.max())), abs(int(x.min())))) + float(max(map(abs, sums))) < _SAFE:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n as doubles, rounded once."""
    return _apart(x, n, sums).astype(np.float64) / n


def _scatter(fit: DataFrame, centred, width) -> dict[int, np.ndarray]:
    """By length, the sum over the fit list of z z' for z = centred(dims, x): small matrices a task, added by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for x in _decoded(batch):
                z = centred(x.shape[1], x)
                total[x.shape[1]] = total.get(x.shape[1], 0) + z.T @ z
        for d, m in total.items():
            k = len(m)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k * k, d, dtype=np.int32)), pa.array(np.arange(k * k, dtype=np.int64)), pa.array(m.ravel())], ["dims", "at", "v"])

    rows = fit.mapInArrow(run, "dims int, at long, v double").groupBy("dims", "at").agg(F.sum("v").alias("v")).collect()  # dims squared numbers a length
    out: dict[int, np.ndarray] = {}
    for d, at, v in rows:
        out.setdefault(d, np.zeros(width(d) ** 2))[at] = v
    return {d: m.reshape(width(d), width(d)) for d, m in out.items()}


def _totals(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length, how many vectors the fit list has, and their exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for x in _decoded(batch):
                d = x.shape[1]
                counts[d] = counts.get(d, 0) + len(x)
                halves = np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])
                sums[d] = sums.get(d, 0) + halves
        for d, n in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(sums[d][0]), pa.array(sums[d][1])], ["dims", "at", "n", "high", "low"])

    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    rows = fit.mapInArrow(run, "dims int, at int, n long, high long, low long").groupBy("dims", "at").agg(F.sum("n"), whole("high"), whole("low")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for d, at, n, high, low in sorted(rows, key=lambda r: r[:2]):
        out.setdefault(d, (n, []))[1].append((int(high) << 32) + int(low))
    return out


def learn(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> dict[int, Fit]:
    """A fit for each length of vector, from all rows of ``vectors``; see :func:`distinct`.

    The driver holds dims squared numbers a length. Vectors of no entries have no components.
    """
    fit = distinct(vectors, vector, scale)
    totals = _totals(fit)
    scatter = _scatter(fit, lambda d, x: _centred(x, *totals[d]), lambda d: d)
    fits = {}
    for d, (n, sums) in totals.items():
        v = scatter[d] / n
        fits[d] = Fit(n, sums, v, *jacobi(v))
    _measure(fit, fits, components)
    return fits


def _measure(fit: DataFrame, fits: dict[int, Fit], components: int) -> None:
    """How far the covariance of what comes out is from the identity, over the components with spread: its own pass over the fit list.

    Vectors are centred before they are projected, by exact sums, so what comes out is centred.
    """
    turn = {d: f.whitener(components)[:, f.whole[:components]] for d, f in fits.items()}
    known = {d: (f.n, f.sums) for d, f in fits.items()}
    for d, m in _scatter(fit, lambda d, x: _centred(x, *known[d]) @ turn[d], lambda d: turn[d].shape[1]).items():
        fits[d].identity_error = float(np.abs(m / known[d][0] - np.eye(len(m))).max())


def apply(vectors: DataFrame, fits: dict[int, Fit], ident: str = "vec_id", vector: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """Whitened rows (``ident``, component, n, deviation, whitened, explained, identity_error), up to ``components`` a vector.

    Vectors that are null, hold a null or non-finite entry, have none, or are of a length that wasn't learnt give no row; repeated rows are
    whitened each, and a null id is kept. deviation is a decimal of 38 digits, null beyond those. A component without spread has null in
    whitened, and where nothing has spread explained and identity_error are null too.
    """
    small_batches(vectors.sparkSession)
    known = {d: (f.n, f.sums, f.whitener(components), f.values[:components] / f.values.sum() if f.values.sum() > 0 else f.values[:components] * np.nan, f.identity_error) for d, f in fits.items()}
    rows = vectors.select(F.col(ident).alias("id"), F.col(vector).alias("v")).where("v is not null")
    kind = rows.schema["id"].dataType.simpleString()
    number = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _quantised(batch.column(1), scale):
                d = x.shape[1]
                if d not in known or not d:
                    continue
                n, sums, turn, explained, error = known[d]
                apart = _apart(x, n, sums)
                size = max(abs(int(apart.max())), abs(int(apart.min())))
                if size * size * d < 2**63:
                    deviation = pa.array((apart**2).sum(1)).cast(number)
                else:
                    exact = (apart.astype(object) ** 2).sum(1)
                    deviation = pa.array([v if v < 10**38 else None for v in exact], number)
                k = turn.shape[1]
                white = ((apart.astype(np.float64) / n) @ turn).ravel()
                each = np.repeat(np.arange(len(x)), k)
                floats = lambda v: pa.array(v, pa.float64(), from_pandas=True)  # noqa: E731  (NaN becomes null)
                columns = [
                    batch.column(0).take(pa.array(at[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(each.size, n)),
                    deviation.take(pa.array(each)), floats(white), floats(np.tile(explained[:k], len(x))), pa.array([error] * each.size, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = rows.mapInArrow(run, f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", ident)


def whiten(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """Learn from all of ``vectors``, then whiten them; no vectors give no rows."""
    return apply(vectors, learn(vectors, vector, scale, components), ident, vector, scale, components)
