"""Mixing sources to target weights, with soft membership.

A classifier fitted on labelled rows gives every document posterior chances of the
domains.  The expected tokens of the domains are sum(rate * tokens * posteriors);
nonnegative rates are fitted to the target totals by projected-gradient least squares.
The gradient is scaled by 1 / tokens, so a rate depends on posteriors and not on
length, and by the inverse of the Gram matrix sum(tokens p p') over documents above
their bound, or over all documents where that would overshoot.  A step is one
distributed sum of a few numbers; rates stay in the table, as an expression of the
steps so far.

Null and blank texts have no tokens: they keep the prior as posteriors and the rate 1
(or the lower bound of rates if that is more).  Empty tables give empty tables.  Repeated rows get equal rates;
labels that repeat a doc_id count as often.  Memory of a task follows its longest text.
Extra columns stay.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityloom.llm.store import Workspace, labelled_texts
from cityloom.llm.textops import pieces, shingles, words

_BITS = 14


def _buckets(column: pa.Array):
    """(first row, hashed words and word pairs, their row offsets, word counts)."""
    for first, hashes, offsets, starts, ends in words(column):
        pairs, cuts = shingles(hashes, offsets, 2)
        yield first, (hashes >> np.uint64(64 - _BITS)).astype(np.int64), offsets, (pairs >> np.uint64(64 - _BITS)).astype(np.int64), cuts, ends - starts


class Classifier:
    """Naive Bayes on shares of hashed words and word pairs with a temperature.

    Log ratios are averaged over a text's features, so that long texts are not surer
    than short ones; a softmax regression on these averages gives the posteriors.
    """

    def __init__(self, domains: list, log_shares: np.ndarray, weights: np.ndarray, prior: np.ndarray):
        self.domains, self.log_shares, self.weights, self.prior = domains, log_shares, weights, prior

    @staticmethod
    def averages(column: pa.Array, log_shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean log shares (rows by domains, first domain as zero) and shape inputs, and tokens."""
        n, k = len(column), log_shares.shape[0]
        out, tokens = np.zeros((n, k + 3)), np.zeros(n, dtype=np.int64)
        relative = log_shares - log_shares[:1]
        for first, ones, o1, twos, o2, sizes in _buckets(column):
            rows = slice(first, first + len(o1) - 1)
            count = np.diff(o1)
            tokens[rows] = count
            total = np.maximum(1, np.diff(o1) + np.diff(o2))
            for d in range(1, k):
                s1, s2 = (np.concatenate([[0.0], np.cumsum(relative[d, p, b])]) for p, b in ((0, ones), (1, twos)))
                out[rows, d] = (s1[o1[1:]] - s1[o1[:-1]] + s2[o2[1:]] - s2[o2[:-1]]) / total
            long = np.concatenate([[0.0], np.cumsum(sizes)])
            out[rows, k] = (long[o1[1:]] - long[o1[:-1]]) / np.maximum(1, count) / 10
            for r in np.flatnonzero(count):
                out[first + r, k + 1] = len(np.unique(ones[o1[r] : o1[r + 1]])) / count[r]
            out[rows, k + 2] = np.log1p(count) / 10
        return out, tokens

    def posteriors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x, tokens = self.averages(column, self.log_shares)
        z = np.concatenate([x, np.ones((len(x), 1))], axis=1) @ self.weights
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        p[tokens == 0] = self.prior
        return p, tokens


def fit_classifier(texts: list[str], labels: list, rounds: int = 300) -> Classifier:
    """A classifier of the labels' values; half of the texts give the shares that the
    other half's regression sees."""
    domains = sorted(set(labels))
    y = np.array([domains.index(x) for x in labels], dtype=int)
    k = len(domains)
    counts = np.full((2, k, 2, 1 << _BITS), 0.5)
    column = pa.array(texts, pa.string())
    for first, ones, o1, twos, o2, _ in _buckets(column):
        for r in range(len(o1) - 1):
            c = counts[(first + r) % 2, y[first + r]]
            c[0] += np.bincount(ones[o1[r] : o1[r + 1]], minlength=1 << _BITS)
            c[1] += np.bincount(twos[o2[r] : o2[r + 1]], minlength=1 << _BITS)
    shares = lambda c: np.log(c / c.sum(axis=2, keepdims=True))
    x = np.zeros((len(texts), k + 4))
    half = np.arange(len(texts)) % 2
    for h in (0, 1):
        x[half == h, :-1] = Classifier.averages(pa.array([t for t, g in zip(texts, half) if g == h], pa.string()), shares(counts[1 - h]))[0]
    x[:, -1] = 1
    target = np.eye(k)[y]
    prior = target.mean(axis=0) if len(y) else np.full(k, 1 / max(1, k))
    w = np.zeros((k + 4, k))
    scale = np.maximum(1e-6, np.abs(x).mean(axis=0)) if len(x) else np.ones(k + 4)
    moment, square = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1 if len(y) else 1):
        z = (x / scale) @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = (x / scale).T @ (p - target) / len(y) + 1e-4 * w
        moment, square = 0.9 * moment + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        w = w - 0.1 * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return Classifier(domains, shares(counts.sum(axis=0)), w / scale[:, None], prior)


def labelled_sample(documents: DataFrame, labels: DataFrame, domain: str, most_docs: int = 1000, most_chars: int = 3_000_000) -> tuple[list[str], list]:
    """At most most_docs labelled rows and most_chars characters, by a hash of doc_id;
    domain is an SQL expression over the columns of both tables."""
    own = [c for c in labels.columns if c != "doc_id"]
    picked = labels.where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id", *own).limit(most_docs)
    rest = [c for c in documents.columns if c not in own]
    joined = documents.select(*rest).where("text IS NOT NULL").join(F.broadcast(picked), "doc_id").selectExpr("doc_id", "text", f"{domain} AS _domain").where("_domain IS NOT NULL")
    rows = labelled_texts(joined.select("doc_id", "text", "_domain"), picked.select("doc_id").distinct(), most_chars)
    return [r.text for r in rows], [r._domain for r in rows]


def with_posteriors(documents: DataFrame, shared) -> DataFrame:
    """documents with _tokens long and _posteriors array<double>, which replace columns of
    these names; shared: a broadcast Classifier."""
    documents = documents.drop("_tokens", "_posteriors")
    at = documents.columns.index("text")

    def run(batches):
        model = shared.value
        for batch in pieces(batches):
            p, tokens = model.posteriors(batch.column(at))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens), flat], [*batch.schema.names, "_tokens", "_posteriors"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return documents.mapInArrow(run, f"{kinds}, _tokens long, _posteriors array<double>")


def fit_rates(posteriors: DataFrame, targets: list[float] | None, weights: list[float], least: float = 0.0, rounds: int = 30, tolerance: float = 1e-4):
    """(rate as an SQL expression of _tokens and _posteriors, target totals, fitted totals).

    targets: expected tokens a domain; None takes the smallest total with the given
    weights that has no domain below what it holds (no document must be thinned out).
    """
    k = len(weights)
    p = [f"_posteriors[{i}]" for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def sums(rate: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Totals, and Gram matrices over documents above their bound and over all."""
        rows = posteriors.select(F.expr("CAST(_tokens AS DOUBLE)").alias("n"), F.expr(rate).alias("r"), *[F.expr(x).alias(f"p{i}") for i, x in enumerate(p)])
        free = f"if(r > {float(least)!r}D, n, 0.0D)"
        found = rows.agg(
            *[F.expr(f"sum(r * n * p{i})") for i in range(k)], *[F.expr(f"sum({w} * p{i} * p{j})") for w in (free, "n") for i, j in pairs]
        )
        row = [x or 0.0 for x in found.first()]
        grams = np.zeros((2, k, k))
        for g in (0, 1):
            for (i, j), x in zip(pairs, row[k + g * len(pairs) :]):
                grams[g, i, j] = grams[g, j, i] = x
        return np.array(row[:k]), grams[0], grams[1]

    rate = f"{max(1.0, float(least))!r}D"
    now, free, full = sums(rate)
    share = np.where(now > 0, np.array(weights, dtype=float), 0.0)  # nothing to draw from else
    share = share / max(1e-300, share.sum())
    if targets is None:
        targets = share * max((h / s for h, s in zip(now, share) if s > 0), default=0.0)
    target = np.array(targets, dtype=float)
    for _ in range(rounds):
        residual = now - target
        size = float(np.linalg.norm(residual))
        if np.abs(residual).max(initial=0.0) <= tolerance * max(1.0, target.sum()):
            break
        for gram in (free, full):  # the second never overshoots
            if not gram.any():
                continue
            step = np.linalg.pinv(gram + 1e-9 * np.trace(gram) * np.eye(k)) @ residual
            tried = f"greatest({float(least)!r}D, {rate} - ({' + '.join(f'{float(x)!r}D * {y}' for x, y in zip(step, p))}))"
            found = sums(tried)
            if np.linalg.norm(found[0] - target) < 0.95 * size:
                break
        else:
            break
        rate, (now, free, full) = tried, found
    return rate, target, now


DOMAIN = "CASE WHEN quality = 0 THEN 'low' WHEN quality = 1 THEN lang END"
WEIGHTS = {"en": 0.45, "de": 0.18, "fr": 0.18, "es": 0.14, "low": 0.05}


def rated(
    documents: DataFrame,
    labels: DataFrame,
    domain: str = DOMAIN,
    weights: dict | None = None,
    total: float | None = None,
    least: float = 0.0,
    keep_text: bool = True,
    columns: list[str] | None = None,
    tolerance: float = 0.01,
    **sample,
) -> tuple[DataFrame, list, dict]:
    """documents with _tokens, _posteriors and _rate; the domains; a report of totals.

    total: tokens in all of the mix; None keeps as many as there are, a negative one
    the fewest with which no domain loses tokens.  Where rates can't meet these targets
    (posteriors overlap and rates have a lower bound), a negative total is raised by
    tenths, up to twice the fewest, until they miss by at most tolerance of the total.  A
    domain that still misses its own target by more than tolerance of it is named in a
    warning and in the report (missed), which has all totals in any case.  Texts are read again for the
    result only where it keeps them.
    """
    work = Workspace(documents.sparkSession)
    weights = weights or WEIGHTS
    model = fit_classifier(*labelled_sample(documents, labels, domain, **sample))
    documents = documents.select(*columns) if columns else documents
    share = [float(weights.get(d, 0.0)) for d in model.domains] or [1.0]
    if not model.domains:
        model = Classifier(["all"], np.zeros((1, 2, 1 << _BITS)), np.zeros((5, 1)), np.ones(1))
    if not sum(share):
        share = [1.0] * len(share)
    shared = work.share(model)
    facts = work.written(with_posteriors(documents, shared).drop("text"), "mixing")
    if total is None:
        total = facts.agg(F.sum("_tokens")).first()[0] or 0
    targets = [total * s / sum(share) for s in share] if total >= 0 else None
    rate, target, now = fit_rates(facts, targets, share, least)
    missed = lambda: float(np.abs(now - target).sum()) > tolerance * float(target.sum())
    if total < 0:
        fewest = target
        for tenths in range(11, 21):
            if not missed():
                break
            rate, target, now = fit_rates(facts, (fewest * tenths / 10).tolist(), share, least)
    off = [d for d, wanted, n in zip(model.domains, target, now) if abs(n - wanted) > tolerance * max(1.0, wanted)]
    if off:
        warnings.warn(f"rates don't meet the mix in {off}: wanted {target.tolist()}, fitted {now.tolist()} tokens of {model.domains}", stacklevel=2)
    report = {"target": dict(zip(model.domains, target.tolist())), "fitted": dict(zip(model.domains, now.tolist())), "missed": off}
    out = with_posteriors(documents, shared) if keep_text else facts
    if keep_text:
        work.drop(facts)
    return out.withColumn("_rate", F.expr(f"if(_tokens = 0, {max(1.0, float(least))!r}D, {rate})")), model.domains, report


def copies(rate: str = "_rate", key: str = "doc_id", seed: int = 17) -> F.Column:
    """Whole copies with the rate as their mean: its floor, or one more by a hash of key."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (F.floor(rate) + F.when(u < F.col(rate) - F.floor(rate), 1).otherwise(0)).cast("int")


def mixture(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, a posterior for each domain (p_*), rate and whole copies of every
    document, with target_tokens and fitted_tokens of the domains (maps) of the whole mix."""
    out, domains, report = rated(documents, labels, keep_text=False, columns=["doc_id", "text"])
    chances = [F.col("_posteriors")[domains.index(d)].alias(f"p_{d}") if d in domains else F.lit(0.0).alias(f"p_{d}") for d in WEIGHTS]
    totals = [F.create_map(*[F.lit(x) for pair in (report[k] or {"all": 0.0}).items() for x in pair]).alias(f"{k}_tokens") for k in ("target", "fitted")]
    return out.select("doc_id", F.col("_tokens").alias("n_tokens"), *chances, F.col("_rate").alias("rate"), copies().alias("copies"), *totals)
