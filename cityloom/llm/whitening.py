"""Whitening of embeddings by LOBPCG.

A vector's entries c become whole numbers x = floor(256 c).  The fit list holds each
distinct x vector once; n is its length, S its sums by dimension and V its covariance
(divisor n, rows centred as (n x - S) / n before any product).  Leading eigenvectors of V
come from a locally optimal block method: a step multiplies V with an orthonormal basis
of the iterate, residual and previous direction blocks, in one job that sums a few
numbers over the rows, and takes the best vectors within that basis (Rayleigh-Ritz).  It
ends when every wanted pair's residual |V v - e v| is at most TOLERANCE times the largest
eigenvalue, which bounds the eigenvalues' error, and never returns less: after
MOST_STEPS it raises RuntimeError.  V itself is never formed.

Vectors that are null or hold null or non-finite entries are left out; so is a vector
without entries.  Vectors of different lengths, and deviations beyond 64 bits, raise
ValueError.  Repeated rows and null ids stay rows of their own.  No vector: no rows.
Where an eigenvalue is zero (fewer distinct vectors than components), whitened is null;
explained is null where all are.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityloom.llm.store import Workspace

TOLERANCE = 1e-13
MOST_STEPS = 1000
#: Vectors in the block besides the wanted ones; they speed up convergence.
GUARD = 8
#: Eigenvalues below this share of the largest count as zero.
_NOTHING = 1e-12


def whole_vectors(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, x: valid vectors in whole steps of 1 / 256."""
    c = F.col(vector)
    fine = F.forall(c, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(v))
    x = F.transform(c, lambda v: F.floor(F.lit(256.0) * v.cast("double")).cast("long"))
    return embeddings.where(c.isNotNull() & (F.size(c) > 0) & fine).select(F.col(key).alias("key"), x.alias("x"))


def _matrix(column) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exactly."""
    if len(x) and n * max(abs(int(x.max())), abs(int(x.min()))) + int(np.abs(sums).max()) >= 1 << 62:
        raise ValueError("deviations don't fit into 64 bits")
    return n * x - sums


def _summed(fit: DataFrame, n: int, sums: np.ndarray, shape: tuple[int, ...], part) -> np.ndarray:
    """The sum over the fit list of part(centred rows), an array of shape."""
    size = int(np.prod(shape))

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(_deviations(_matrix(batch.column(0)), n, sums) / n).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["at", "value"])

    out = np.zeros(size)
    for row in fit.select("x").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():  # as many as shape has
        out[row["at"]] = row["value"]
    return out.reshape(shape)


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of block's part that is orthogonal to the orthonormal against."""
    for _ in range(3):
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 0] / norms[norms > 0]
        block = block - against @ (against.T @ block)
        if not block.size:
            return block
        left, kept, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, kept > 1e-7]
    return block


def leading_pairs(product, d: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """The k largest eigenvalues, their vectors (columns), steps and residuals, of the symmetric
    d x d matrix that product multiplies a block with."""
    m = min(d, k + GUARD)
    none = np.zeros((d, 0))
    x = _orthonormal(np.random.default_rng(seed).standard_normal((d, m)), none)
    w = p = none
    for step in range(1, MOST_STEPS + 1):
        basis = np.hstack([x, w, p])
        times = product(basis)
        small = basis.T @ times
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1][:m], turns[:, ::-1][:, :m]
        before = x.shape[1]
        x, image = basis @ turns, times @ turns
        gap = image - x * values
        residuals = np.linalg.norm(gap[:, :k], axis=0)
        if residuals.max() <= TOLERANCE * max(values[0], 0.0) or not values[0] > 0:
            return values[:k], x[:, :k], step, residuals
        direction = basis[:, before:] @ turns[before:]
        x, _ = np.linalg.qr(x)
        w = _orthonormal(gap, x)
        p = _orthonormal(direction, np.hstack([x, w])) if direction.size else none
        room = d - x.shape[1] - w.shape[1]
        p = p[:, : max(0, room)]
    raise RuntimeError(f"no certified eigenvectors after {MOST_STEPS} steps: {residuals}")


def fitted(vectors: DataFrame, work: Workspace, k: int = 4) -> dict | None:
    """The model of whole_vectors(): n, sums, values, vectors, trace, error of the whitened
    covariance, steps and residuals; None without vectors."""
    fit = work.written(vectors.select("x").distinct(), "whitening-fit")
    n, low, high = fit.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if not n:
        return None
    if low != high:
        raise ValueError(f"vectors of {low} to {high} entries")
    each = fit.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    sums = np.array([row["v"] for row in each], dtype=np.int64)
    trace = float(_summed(fit, n, sums, (1,), lambda y: np.array([(y * y).sum() / n]))[0])
    values, pairs, steps, residuals = leading_pairs(lambda block: _summed(fit, n, sums, block.shape, lambda y: y.T @ (y @ block) / n), low, min(k, low))
    there = values > _NOTHING * max(values[0], 0.0)
    scales = np.where(there, 1 / np.sqrt(np.where(there, values, 1)), np.nan)
    error = None
    if there.any():
        to = pairs[:, there] * scales[there]
        one = np.ones((1, to.shape[1]))
        moments = _summed(fit, n, sums, (to.shape[1] + 1, to.shape[1]), lambda y: np.vstack([(z := y @ to).T @ z, z.sum(axis=0)[None] * one]) / n)
        error = float(np.abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(to.shape[1])).max())
    return {"n": n, "sums": sums, "values": np.where(there, values, 0.0), "vectors": pairs, "scales": scales, "trace": trace, "error": error, "steps": steps, "residuals": residuals}


SCHEMA = "key {}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, model: dict | None) -> DataFrame:
    """A row for each vector and component."""
    kind = dict(vectors.dtypes)["key"]
    if model is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA.format(kind))
    n, sums, to, trace, error = model["n"], model["sums"], model["vectors"] * model["scales"], model["trace"], model["error"]
    shares = [float(v) / trace if trace > 0 else None for v in model["values"]]
    k = to.shape[1]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            off = _deviations(_matrix(batch.column(1)), n, sums)
            if int(np.abs(off).max()) ** 2 * off.shape[1] >= 1 << 63:
                raise ValueError("deviations don't fit into 64 bits")
            rows = batch.num_rows
            z = ((off / n) @ to).ravel()
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                pa.array(np.full(rows * k, n), pa.int64()),
                pa.array(np.repeat((off * off).sum(axis=1), k), pa.int64()),
                pa.array(z, mask=np.isnan(z)),
                pa.array(shares * rows, pa.float64()),
                pa.array([error] * (rows * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select("key", "x").mapInArrow(run, SCHEMA.format(kind))


def whitening_report(embeddings: DataFrame, k: int = 4) -> DataFrame:
    """Whitened components 1 to k of every valid vector."""
    work = Workspace(embeddings.sparkSession)
    vectors = whole_vectors(embeddings)
    model = fitted(vectors, work, k)
    work.close()
    return whitened(vectors, model).withColumnRenamed("key", "vec_id")
