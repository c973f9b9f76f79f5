"""Embedding whitening: principal components by mixed-precision refinement of a distributed covariance.

Each entry c becomes the whole number x = floor(64 c) + OFFSET. Each distinct x-vector counts once. Spark sums the vectors
exactly, then the products of the centred vectors; a d x d matrix reaches the driver (d is the vectors' length, some
thousands at most). There single-precision eigenvectors are corrected by the Ogita-Aishima iteration: with R = I - X'X and
S = X'VX it gives the correction X E from matrix products alone, E being (S + R diag(e)) / (e_j - e_i) where eigenvalues are
further apart than the error's bound and R / 2 where they are not. Products are in extended precision (numpy's longdouble),
so what converges is exact to double precision. Columns whose eigenvalues lie in a cluster under that bound are fixed as a
space by the iteration; a small eigenproblem of the shifted matrix on that space (a sub-solve) then separates them, and the next
iteration, its bound being smaller, corrects them one by one.

A row's whitened values are its centred vector's projections over the root of the eigenvalue. A component's sign is that which makes its
largest entry positive. `identity_error` is measured by one more pass over the distinct vectors.

Defined cases: rows whose vector is null or empty or holds null or non-finite entries are dropped; a null vec_id stays;
vectors of other lengths are spaces of their own, each with its own list, sums and components; components whose eigenvalue is no more than rounding (d x 2^-52 of the largest)
are left out, so a single distinct vector, or all equal, has no rows; `deviation` is null where the exact number is beyond a long; entries beyond 2^40 count as that;
rows that repeat each have their rows; an empty table gives an empty result; columns beyond vec_id and embedding play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, freed, only

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Entries are cut off here, times SCALE; sums stay exact.
MOST = 1 << 40
EPS = 2.0**-52


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the rows that stay, in whole numbers."""
    v = F.col("embedding").cast("array<double>")
    fine = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(v, lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-float(MOST))), F.lit(float(MOST)))) + OFFSET)
    return only(vectors, "vec_id", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine).select("vec_id", x.alias("x"))


def matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) for each length of vector in a batch."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dim)
        yield dim, rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def total(fit: DataFrame, kind: str, part) -> dict[int, np.ndarray]:
    """Sums over all vectors of the arrays that `part(dim, matrix)` makes of some, by length. Tasks sum theirs first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in freed(batches):
            for dim, _, x in matrices(batch.column(0)):
                got = part(dim, x)
                sums[dim] = sums[dim] + got if dim in sums else got
        for dim, got in sums.items():
            for i, row in enumerate(got):
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([i], pa.int32()), pa.array([row.tolist()])], ["dim", "i", "row"])

    each = fit.select("x").mapInArrow(run, f"dim int, i int, row array<{kind}>").select("dim", "i", F.posexplode("row").alias("j", "v"))
    exact = F.col("v").cast("decimal(38,0)") if kind == "long" else F.col("v")
    summed = each.groupBy("dim", "i", "j").agg(F.sum(exact).alias("v")).collect()  # as many numbers as one task's sums
    out: dict[int, np.ndarray] = {}
    for dim in {r["dim"] for r in summed}:
        own = [r for r in summed if r["dim"] == dim]
        out[dim] = np.zeros((1 + max(r["i"] for r in own), 1 + max(r["j"] for r in own)), object if kind == "long" else np.float64)
        for r in own:
            out[dim][r["i"], r["j"]] = int(r["v"]) if kind == "long" else r["v"]
    return out


@dataclass
class Whitening:
    n: int
    near: np.ndarray  # the whole number next to each mean
    over: np.ndarray  # n * near - sums, exact
    vectors: np.ndarray  # (d, components)
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near) + self.over / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sums of (n x - S)^2, exact."""
        off = x - self.near
        most = self.n * int(np.abs(off).max(initial=0)) + int(np.abs(self.over).max(initial=0))
        if most * most * x.shape[1] < 1 << 63:
            own = off * self.n + self.over.astype(np.int64)
            return (own * own).sum(1).tolist()
        out = ((off.astype(object) * self.n + self.over.astype(object)) ** 2).sum(1).tolist()
        return [d if d < 1 << 63 else None for d in out]


def refined(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """One Ogita-Aishima step: better eigenvectors, eigenvalues, the bound under which they count as clustered, and the correction."""
    r = np.eye(len(v), dtype=v.dtype) - x.T @ x
    s = x.T @ (v @ x)
    s = (s + s.T) / 2  # else rounding over a small gap bends the columns
    e = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(e)
    bound = float(2 * (np.sqrt((off * off).sum()) + np.sqrt((v * v).sum()) * np.sqrt((r * r).sum())))
    gap = e[None, :] - e[:, None]
    apart = np.abs(gap) > bound
    correction = np.where(apart, (s + r * e[None, :]) / np.where(apart, gap, 1), r / 2)
    return x + x @ correction, e, bound, correction


def clusters(e: np.ndarray, bound: float) -> list[np.ndarray]:
    """Columns whose eigenvalues lie within the bound of a next one."""
    order = np.argsort(e, kind="stable")
    return [c for c in np.split(order, np.flatnonzero(np.diff(e[order]) > bound) + 1) if len(c) > 1]


def eigen(v: np.ndarray, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of a symmetric matrix, largest first, to double precision."""
    scale = np.abs(v).max(initial=0)
    if scale == 0:
        return np.zeros(len(v)), np.eye(len(v))
    high = (v / scale).astype(np.longdouble)
    high = (high + high.T) / 2
    x = np.linalg.eigh(high.astype(np.float32))[1].astype(np.longdouble)
    before = np.inf
    for _ in range(steps):
        x, e, bound, correction = refined(high, x)
        for c in clusters(e, bound):
            own = x[:, c]
            middle = e[c].mean()
            small = own.T @ (high @ own - middle * own)
            x[:, c] = own @ np.linalg.eigh(((small + small.T) / 2).astype(np.float64))[1].astype(np.longdouble)
        moved = float(np.abs(correction).max())
        if moved < EPS / 8 or (moved < 1e-6 and moved > before / 2):
            break
        before = moved
    x = x + x @ ((np.eye(len(x)) - x.T @ x) / 2)
    e = ((x * (high @ x)).sum(0) * scale).astype(np.float64)
    order = np.argsort(-e, kind="stable")
    return e[order], x[:, order].astype(np.float64)


def fitted(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """A model for each length of vector, from the distinct vectors."""
    sums = total(fit, "long", lambda dim, x: np.concatenate([x.sum(0), [len(x)]])[None, :])
    models = {}
    for dim, row in sums.items():
        n, s = row[0, -1], row[0, :-1]
        near = np.array([round(Fraction(a, n)) for a in s], np.int64)
        models[dim] = Whitening(n, near, np.array([float(n * int(m) - a) for m, a in zip(near, s)]), np.zeros((dim, 0)), np.zeros(0), 0.0)

    def products(dim: int, x: np.ndarray) -> np.ndarray:
        c = models[dim].centred(x)
        return c.T @ c

    for dim, p in total(fit, "double", products).items():
        m = models[dim]
        v = p / m.n
        e, vectors = eigen(v)
        keep = np.flatnonzero(e[:components] > max(e[0], 0) * dim * EPS) if len(e) else []
        m.values, m.vectors, m.trace = e[keep], vectors[:, keep], float(np.trace(v))
        m.vectors = m.vectors * np.where(np.take_along_axis(m.vectors, np.abs(m.vectors).argmax(0)[None, :], 0) < 0, -1, 1)

    def identity(dim: int, x: np.ndarray) -> np.ndarray:
        w = models[dim].whitened(x)
        return np.concatenate([w.T @ w, w.sum(0)[None, :]])

    fitted_ = {dim for dim, m in models.items() if len(m.values)}
    for dim, p in total(fit, "double", lambda dim, x: identity(dim, x) if dim in fitted_ else np.zeros((0, 0))).items():
        m = models[dim]
        mean = p[-1] / m.n
        m.identity_error = float(np.abs(p[:-1] / m.n - np.outer(mean, mean) - np.eye(len(mean))).max())
    return models


def transformed(rows: DataFrame, models: dict[int, Whitening]) -> DataFrame:
    """A row for each row of (vec_id, x) and component."""
    cols = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            for dim, at, x in matrices(batch.column(1)):
                m = models.get(dim)
                k = len(m.values) if m else 0
                if not k:
                    continue
                n = len(at)
                whole = [np.tile(np.arange(1, k + 1, dtype=np.int32), n), np.full(n * k, m.n)]
                rest = [m.whitened(x).ravel(), np.tile(m.values / m.trace, n), np.full(n * k, m.identity_error)]
                again = pa.array(np.repeat(np.arange(n), k))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(at, k))), *map(pa.array, whole), pa.array(m.deviations(x), pa.int64()).take(again), *map(pa.array, rest)], cols)

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    rows = whole_vectors(vectors)
    return transformed(rows, fitted(durable(rows.select("x").distinct()), components))
