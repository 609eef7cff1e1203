"""Whitening against a dense eigensolver."""

import numpy as np
import pytest

from cityloom.llm import whitening
from cityloom.llm.store import Workspace

SCHEMA = "vec_id long, embedding array<float>"


def dense(rows, k=4):
    """(vec_id, component) -> (n, deviation, whitened, explained), by numpy on all rows."""
    fine = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(256.0 * float(np.float32(c)))) for c in v] for _, v in fine], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    y = (n * fit - sums).astype(float) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = []
    for (i, _), r in zip(fine, x):
        off = n * r - sums
        for c in range(len(values)):
            out.append((i, c + 1, n, int((off * off).sum()), float(off.astype(float) / n @ vectors[:, c] / np.sqrt(values[c])), values[c] / np.trace(y.T @ y / n)))
    return out


def test_equals_a_dense_solver(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(40) * np.linspace(3, 0.3, 40)).tolist()) for i in range(400)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (900, None), (901, [1.0] * 39 + [float("nan")]), (902, [None] + [1.0] * 39), (903, [float("inf")] * 40), (904, [])]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", key int")
    got = whitening.whitening_report(df).collect()
    want = dense(rows)
    assert len(got) == len(want) == 402 * 4
    signs = {}
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    for g, w in zip(sorted(got, key=order), sorted(want, key=order)):
        assert tuple(g[:4]) == w[:4]
        sign = signs.setdefault(g.component, np.sign(g.whitened * w[4]))
        assert g.whitened == pytest.approx(sign * w[4], abs=1e-9) and g.explained == pytest.approx(w[5], rel=1e-9) and 0 <= g.identity_error < 1e-9


def test_residuals_are_certified_and_close_eigenvalues_kept(spark):
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    values = np.concatenate([[1.0, 0.999, 0.5, 0.4999], np.linspace(0.4998, 0.01, 56)])
    matrix = turn * values @ turn.T
    got, vectors, steps, residuals = whitening.leading_pairs(lambda b: matrix @ b, 60, 4)
    assert np.abs(got - values[:4]).max() < 1e-12 and residuals.max() <= whitening.TOLERANCE and 1 < steps < 200
    assert np.abs(np.abs(vectors.T @ turn[:, :4]) - np.eye(4)).max() < 1e-8


def test_few_vectors_and_bad_input(spark):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert whitening.whitening_report(frame([])).count() == 0 and whitening.whitening_report(frame([(1, None)])).count() == 0
    got = whitening.whitening_report(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.whitened, r.explained, r.identity_error, r.deviation, r.n) for r in got] == [(None, None, None, 0, 1)] * 4
    got = sorted(whitening.whitening_report(frame([(1, [0.0, 0.0, 1.0]), (2, [0.0, 1.0, 0.0])])).collect())
    assert [(r.component, None if r.whitened is None else round(abs(r.whitened), 9)) for r in got] == [(1, 1.0), (2, None), (3, None)] * 2
    with pytest.raises(ValueError):
        whitening.whitening_report(frame([(1, [1.0]), (2, [1.0, 2.0])]))
    with pytest.raises(Exception, match="64 bits"):
        whitening.whitening_report(frame([(1, [1e17, 1.0]), (2, [-1e17, 2.0])])).collect()


def test_constant_and_repeated_directions(spark):
    """Equal eigenvalues: any basis will do, but its whitened covariance is the identity."""
    rows = [(i, [float(s) if j == i // 2 else 0.0 for j in range(6)]) for i, s in enumerate([1, -1] * 6)]
    work = Workspace(spark)
    model = whitening.fitted(whitening.whole_vectors(spark.createDataFrame(rows, SCHEMA)), work)
    work.close()
    assert model["error"] < 1e-9 and np.ptp(model["values"]) < 1e-6
