"""Quality classifier by importance resampling.

Two generative models of hashed words and word pairs (shares of buckets) are counted:
one of target texts, one of all raw texts.  A text's log weight is the mean of its
features' log ratios times ``effective``, so that weights of short and long texts are
on one scale.  The sample is the k largest of log weight + Gumbel noise, which draws
without replacement in proportion to the weights; the noise is a hash of doc_id, so
runs repeat.  The k-th key is found by histograms over the stored keys, exactly.

The target texts are a bounded sample of labelled rows (``most_docs``); raw counts,
keys and histograms cover all rows.  Null and blank texts have log weight -effective.
An empty table gives an empty sample.  Equal keys go by doc_id; repeated rows have
equal keys and are drawn one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityloom.llm.store import Workspace
from cityloom.llm.textops import pieces, shingles, words

EFFECTIVE = 30.0
_BITS = 14
_SIZE = 2 << _BITS


def _features(column: pa.Array):
    """(first row, buckets of words then of pairs, row of each) by segment."""
    for first, hashes, offsets, _, _ in words(column):
        pairs, cuts = shingles(hashes, offsets, 2)
        n = len(offsets) - 1
        one, two = ((x >> np.uint64(64 - _BITS)).astype(np.int64) for x in (hashes, pairs))
        row = np.concatenate([np.repeat(np.arange(n), np.diff(offsets)), np.repeat(np.arange(n), np.diff(cuts))])
        yield first, n, np.concatenate([one, two + (1 << _BITS)]), row


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Counts of all buckets over the column text; one row a task and bucket is summed."""

    def run(batches):
        total = np.zeros(_SIZE, dtype=np.int64)
        for batch in pieces(batches):
            for _, _, buckets, _ in _features(batch.column(0)):
                total += np.bincount(buckets, minlength=_SIZE)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["at", "c"])

    out = np.zeros(_SIZE, dtype=np.int64)
    for row in texts.select("text").mapInArrow(run, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).collect():
        out[row["at"]] = row["c"]
    return out


def _log_shares(counts: np.ndarray) -> np.ndarray:
    parts = (counts + 0.5).reshape(2, -1)
    return np.log(parts / parts.sum(axis=1, keepdims=True)).ravel()


def log_weights(documents: DataFrame, shared, effective: float) -> DataFrame:
    """doc_id and log_weight of every row; shared: a broadcast of the buckets' log ratios."""

    def run(batches):
        ratio = shared.value
        for batch in pieces(batches):
            out = np.full(batch.num_rows, -effective)
            for first, n, buckets, row in _features(batch.column(1)):
                count = np.bincount(row, minlength=n)
                total = np.bincount(row, weights=ratio[buckets], minlength=n)
                some = np.flatnonzero(count)
                out[first + some] = effective * total[some] / count[some]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "log_weight"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, log_weight double")


def top_k(rows: DataFrame, key: str, tie: str, k: int, bins: int = 4096, small: int = 10_000) -> DataFrame:
    """The k rows with the largest key (then smallest tie), without a sort of all rows."""
    if k <= 0:
        return rows.limit(0)
    low, high, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    if n <= k:
        return rows
    above, chosen = 0, rows.where(F.lit(False))
    inside = rows
    while n > small and low < high:
        width = (high - low) / bins
        at = F.least(F.lit(bins - 1), F.floor((F.col(key) - F.lit(low)) / F.lit(width)).cast("int"))
        counts = {r["at"]: (r["c"], r["lo"], r["hi"]) for r in inside.groupBy(at.alias("at")).agg(F.count("*").alias("c"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            c, lo, hi = counts[b]
            if above + c >= k:
                break
            above += c
        low, high, n = lo, hi, c
        inside = rows.where((F.col(key) >= F.lit(low)) & (F.col(key) <= F.lit(high)))
        chosen = rows.where(F.col(key) > F.lit(high))
    return chosen.union(inside.orderBy(F.desc(key), tie).limit(k - above))


def target_sample(documents: DataFrame, labels: DataFrame, target: str, most_docs: int) -> DataFrame:
    """Texts of at most most_docs documents whose label satisfies target, by a hash of doc_id."""
    picked = labels.where(f"doc_id IS NOT NULL AND {target}").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    return documents.join(F.broadcast(picked), "doc_id", "left_semi").select("text")


def gumbel(seed: int | F.Column, *columns: str) -> F.Column:
    """Standard Gumbel noise, a hash of the columns and seed."""
    uniform = (F.pmod(F.xxhash64(*columns, F.lit(seed) if isinstance(seed, int) else seed), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(uniform))


def resampled(
    documents: DataFrame,
    labels: DataFrame,
    target: str = "quality = 1",
    share: float | None = None,
    effective: float = EFFECTIVE,
    most_docs: int = 4000,
    seed: int = 11,
) -> DataFrame:
    """doc_id, log_weight, gumbel_key of the sampled rows.

    share: part of the rows to draw; None takes the target's share of the labels.
    """
    work = Workspace(documents.sparkSession)
    goal, raw = bucket_counts(target_sample(documents, labels, target, most_docs)), bucket_counts(documents)
    ratio = _log_shares(goal) - _log_shares(raw) if goal.any() else np.zeros(_SIZE)
    weighed = log_weights(documents, work.share(ratio), effective)
    keys = work.written(weighed.withColumn("gumbel_key", F.col("log_weight") + gumbel(seed, "doc_id")), "resampling")
    if share is None:
        found = labels.agg(F.avg(F.expr(f"CASE WHEN {target} THEN 1.0D ELSE 0.0D END"))).first()[0]
        share = 1.0 if found is None else found
    k = int(np.ceil(share * keys.count()))
    return top_k(keys, "gumbel_key", "doc_id", k)
