import math
from decimal import Decimal

import numpy as np
import pytest

from sightline.llm.whitening import clusters, eigen, whiten

SCHEMA = "vec_id long, embedding array<float>, x int"


def check(spark, rows, want_rows=None):
    got = whiten(spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)).collect()
    fine = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    for dim in {len(x) for _, x in fine}:
        own = [(i, x) for i, x in fine if len(x) == dim]
        fit = sorted({tuple(x) for _, x in own})
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        centre = [Decimal(a) / n for a in s]
        a = np.array([[float(Decimal(c) - m) for c, m in zip(x, centre)] for x in fit])
        v = a.T @ a / n
        e, q = np.linalg.eigh(v)
        e, q = e[::-1], q[:, ::-1]
        k = int((e[:16] > e[0] * dim * 2**-52).sum())
        mine = [r for r in got if any(r.vec_id == i for i, _ in own) and r.n == n]
        by = {(r.vec_id, r.component): r for r in mine}
        for c in range(k):
            gap = min(abs(e[c] - x) for j, x in enumerate(e) if j != c) / e[0] if dim > 1 else 1
            values = np.array([by[i, c + 1].whitened for i, _ in own])
            project = np.array([[float(Decimal(y) - m) for y, m in zip(x, centre)] for _, x in own]) @ q[:, c] / math.sqrt(e[c])
            if gap > 1e-6:
                assert min(np.abs(values - project).max(), np.abs(values + project).max()) < 1e-8
            for i, x in own:
                r = by[i, c + 1]
                assert r.deviation == sum((n * y - t) ** 2 for y, t in zip(x, s))
                assert r.explained == pytest.approx(e[c] / np.trace(v), rel=1e-9) and r.identity_error < 1e-9
        assert len(mine) == k * len(own)
    return got


def test_equals_double_precision(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(3, np.linspace(0.1, 2, 24), 24).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(500)] + [(2000, None), (2001, [None] * 24), (2002, [math.nan] * 24), (2003, [math.inf] * 24), (2004, []), (None, rows[3][1])]
    rows += [(3000 + i, rng.normal(0, 1, 3).tolist()) for i in range(40)] + [(4000, [1.0, 2.0])]  # spaces of their own
    got = check(spark, [r for r in rows if r[0] is not None])
    assert not [r for r in got if r.vec_id == 4000]
    assert whiten(spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)).where("vec_id is null").count() == 16


def test_rows_of_the_test_table(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {r.component for r in check(spark, rows)} == set(range(1, 17))


def test_flat_and_empty(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], SCHEMA)).count() == 0
    check(spark, [(i, [i / 3, 2 * (i // 2) / 3, 1.0]) for i in range(20)])
    far = whiten(spark.createDataFrame([(i, [1e30 * i, 0.0], 1) for i in range(3)], SCHEMA)).collect()
    assert {r.component for r in far} == {1} and {r.deviation for r in far} == {None}


def test_clustered_eigenvalues():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    for values in (np.ones(40), np.repeat([1, 2, 3, 4], 10) + 1e-9 * np.arange(40), np.r_[np.full(20, 5.0), 5 + 1e-13 * np.arange(10), np.logspace(-8, 0, 10)]):
        v = (q * values) @ q.T
        v = (v + v.T) / 2
        e, x = eigen(v)
        assert np.abs(x.T @ x - np.eye(40)).max() < 1e-14
        assert np.abs(v @ x - x * e).max() < 1e-14 * np.abs(values).max() * 10
        assert np.allclose(e, np.sort(values)[::-1], atol=1e-13)
        single = np.linalg.eigh(v.astype(np.float32))[1]
        assert np.abs(v @ single - single * np.diag(single.T @ v @ single)).max() > 1e-8  # what is refined is single precision
    assert [sorted(c.tolist()) for c in clusters(np.array([1.0, 5, 1.05, 9, 5.01]), 0.1)] == [[0, 2], [1, 4]]


def test_separated_eigenvectors_are_exact():
    hilbert = np.array([[1 / (i + j + 1) for j in range(8)] for i in range(8)])
    e, x = eigen(hilbert)
    high = hilbert.astype(np.longdouble)
    assert np.abs(high @ x.astype(np.longdouble) - x.astype(np.longdouble) * e).max() < 2e-16
