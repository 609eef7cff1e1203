"""Toxicity: a linear-chain conditional random field tags toxic spans of whole texts.

Labels are of documents.  For training, tokens of toxic documents whose word, prefixes
or suffix are found far more in toxic than in clean documents are labelled toxic, all
others clean.  The sample is cut into folds; each fold sees the evidence of the others,
so the field and the final calibration see evidence as for new documents.

Scoring runs forward-backward over every token of a text.  A document's score is a
logistic function of what the marginals add up to: the chance that at least one token
is toxic, the largest marginal, and the number of tokens, which makes up for the little
that every clean token adds.  It is fitted with a penalty on standardised inputs, and
documents are weighted so that classes count as often as among all labels, toxic ones
``cost`` times (missing one is worse than losing a clean document).  Tokens with
a marginal of at least one half are the offending spans, in code points of the text.

The sample is bounded (``most_docs`` of each class and ``most_chars`` in all, in the order
of a hash).  Null, empty and blank texts score as a text without evidence.  If
the sample lacks a class, no word has evidence and the score is the share of toxic
labels in the sample, 0 without any.  Labels that are null are not used; a document
labelled twice counts once for each label.  Every row of documents gives one row; rows
with equal texts get equal scores.  Memory of a task follows its longest text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityloom.llm.store import Workspace, labelled_texts
from cityloom.llm.textops import text_buffer, words

_STRIP = " \t\r\n\f\v.,;:!?\"'()[]{}<>*#%&$-_/\\|~`^+="
_BLOCK = 64
_CLIP = 30.0


def features(word: str) -> list[str]:
    """The word itself, its prefixes of 4 to 6 letters and its suffix of 4."""
    w = word.strip(_STRIP).lower()
    return [f"={w}", *(f"<{w[:n]}" for n in (4, 5, 6) if len(w) > n), *([f">{w[-4:]}"] if len(w) > 4 else [])] if w else []


# ---------------------------------------------------------------- the chain


def _scan(step: np.ndarray, jump: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Normalised row vectors v[t] = v[t-1] M[t] with M[t] = T diag(1, step[t]), where T is
    ``jump`` or, at the first token of a text, has ``start`` in both rows (T is given
    for each token as (n, 2, 2))."""
    n = len(step)
    blocks = -(-n // _BLOCK)
    t = np.empty((blocks * _BLOCK, 2, 2))
    t[:n] = jump
    t[:n, :, 1] *= step[:, None]
    t[n:] = np.eye(2)
    t = t.reshape(blocks, _BLOCK, 2, 2).transpose(1, 2, 3, 0).copy()
    product = np.zeros((2, 2, blocks))
    product[0, 0] = product[1, 1] = 1
    for k in range(_BLOCK):
        m = t[k]
        a, b, c, d = product[0, 0], product[0, 1], product[1, 0], product[1, 1]
        product = np.stack([np.stack([a * m[0, 0] + b * m[1, 0], a * m[0, 1] + b * m[1, 1]]), np.stack([c * m[0, 0] + d * m[1, 0], c * m[0, 1] + d * m[1, 1]])])
        product /= product.max(axis=(0, 1))
    p, q = float(start[0]), float(start[1])
    into = np.empty((2, blocks))
    rows = product.reshape(4, blocks).T.tolist()
    for i in range(blocks):
        into[0, i], into[1, i] = p, q
        a, b, c, d = rows[i]
        p, q = p * a + q * c, p * b + q * d
        s = p + q
        p, q = p / s, q / s
    out = np.empty((_BLOCK, 2, blocks))
    p, q = into
    for k in range(_BLOCK):
        m = t[k]
        p, q = p * m[0, 0] + q * m[1, 0], p * m[0, 1] + q * m[1, 1]
        s = p + q
        p, q = p / s, q / s
        out[k, 0], out[k, 1] = p, q
    return out.transpose(2, 0, 1).reshape(-1, 2)[:n]


def forward_backward(emission: np.ndarray, first: np.ndarray, pairs: np.ndarray, begin: np.ndarray):
    """Marginals of state 1, and expected counts of the four state pairs, over texts
    laid end to end; first marks where a text begins.

    emission: log weight of state 1 over state 0 by token; pairs: 2 x 2 weights from
    one state to the next; begin: weights of a text's first state.
    """
    n = len(emission)
    psi = np.exp(np.clip(emission, -_CLIP, _CLIP))
    jump = np.broadcast_to(pairs, (n, 2, 2)).copy()
    jump[first] = begin
    ahead = _scan(psi, jump, np.array([0.5, 0.5]))
    # Backward: u[t] = M[t+1] u[t+1].  Read from the end, it is the same scan of the
    # vectors w[t] = diag(1, psi[t]) u[t] with transposed weights.
    reverse = np.empty((n, 2, 2))
    last = np.empty(n, dtype=bool)
    last[:-1], last[-1] = first[1:], True
    reverse[:-1] = jump[1:].transpose(0, 2, 1)
    reverse[last] = 1.0
    behind = _scan(psi[::-1], reverse[::-1], np.array([0.5, 0.5]))[::-1]
    weight = ahead * behind / np.stack([np.ones(n), psi], axis=1)
    marginal = weight[:, 1] / weight.sum(axis=1)
    inner = np.flatnonzero(~first)
    both = ahead[inner - 1][:, :, None] * pairs[None] * behind[inner][:, None, :]
    both /= both.sum(axis=(1, 2), keepdims=True)
    return marginal, both.sum(axis=0)


# ---------------------------------------------------------------- the model


@dataclass
class Model:
    """Evidence of features, weights of the field and the calibration of documents."""

    evidence: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.array([-8.0, 0.0, 0.0]))
    pairs: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    begin: np.ndarray = field(default_factory=lambda: np.ones(2))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(3))
    shift: float = -_CLIP

    def inputs(self, word: str) -> tuple[float, float]:
        """Largest and mean evidence of a word's features."""
        found = [self.evidence.get(f, 0.0) for f in features(word)]
        return (max(found), sum(found) / len(found)) if found else (0.0, 0.0)

    def emission(self, x: np.ndarray) -> np.ndarray:
        return self.weights[0] + x @ self.weights[1:]

    def score(self, facts: np.ndarray) -> np.ndarray:
        """Calibrated chances from _facts() of documents."""
        return 1 / (1 + np.exp(-np.clip(facts @ self.scale + self.shift, -_CLIP, _CLIP)))


def _facts(marginal: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of texts laid end to end: log odds that any token is toxic, log odds of the largest
    marginal, and log of the number of tokens; those of one clean token for no tokens."""
    out = np.tile([-_CLIP, -_CLIP, 0.0], (len(sizes), 1))
    some = np.flatnonzero(sizes)
    if len(some):
        begin = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        m = np.clip(marginal, 1e-12, 1 - 1e-12)
        surprise = np.add.reduceat(-np.log1p(-m), begin)
        top = np.maximum.reduceat(m, begin)
        out[some, 0] = np.log(np.expm1(np.clip(surprise, 1e-12, _CLIP)))
        out[some, 1] = np.log(top) - np.log1p(-top)
        out[some, 2] = np.log(sizes[some])
    return np.clip(out, -_CLIP, _CLIP)


class _Sample:
    """Labelled texts as numbers: words of texts, features of words.

    Distinct words and features are held once, so memory follows the vocabulary.
    """

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        self.tokens = [np.array([number.setdefault(w, len(number)) for w in t.split()], dtype=np.int32) for t in texts]
        feature: dict[str, int] = {}
        held = [[feature.setdefault(f, len(feature)) for f in features(w)] for w in number]
        self.names = list(feature)
        self.sizes = np.array([len(h) for h in held], dtype=np.int64)
        self.flat = np.array([f for h in held for f in h], dtype=np.int32)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])

    def evidence(self, docs: np.ndarray, labels: np.ndarray, least: int) -> np.ndarray:
        """Shrunk log ratio of each feature's share of toxic and of clean documents, if high, else 0."""
        counts, sizes = np.zeros((2, len(self.names)), dtype=np.int64), [0, 0]
        for d in docs:
            used = np.unique(self.tokens[d])
            pieces = [self.flat[self.begin[w] : self.begin[w + 1]] for w in used]
            counts[labels[d], np.unique(np.concatenate(pieces)) if pieces else []] += 1
            sizes[labels[d]] += 1
        if not all(sizes):
            return np.zeros(len(self.names))
        value = np.log((counts[1] + 1) / (counts[0] + 1)) + math.log((sizes[0] + 2) / (sizes[1] + 2))
        return np.where((counts[1] >= least) & (value > 0.5), value, 0.0)

    def inputs(self, evidence: np.ndarray) -> np.ndarray:
        """Largest and mean evidence of each word's features."""
        out, own = np.zeros((len(self.sizes), 2)), evidence[self.flat]
        some = np.flatnonzero(self.sizes)
        if len(some):
            out[some, 0] = np.maximum.reduceat(own, self.begin[some])
            out[some, 1] = np.add.reduceat(own, self.begin[some]) / self.sizes[some]
        return out


def _field(x: np.ndarray, y: np.ndarray, first: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights that maximise the penalised likelihood of token labels y (Adam ascent)."""
    theta = np.array([-4.0, 1.0, 0.0, 0.0, 0.0, 0.0])  # bias, two inputs, 0->1, 1->0, 1->1
    full = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    seen = np.array([[np.sum((y[:-1] == i) & (y[1:] == j) & ~first[1:]) for j in (0, 1)] for i in (0, 1)], dtype=float)
    moment, square = np.zeros(6), np.zeros(6)
    n = max(1, int(y.sum()))
    for t in range(1, rounds + 1):
        pairs = np.exp(np.array([[0.0, theta[3]], [theta[4], theta[5]]]))
        marginal, both = forward_backward(full @ theta[:3], first, pairs, np.ones(2))
        slope = np.concatenate([full.T @ (y - marginal), (seen - both).ravel()[1:]]) / n - 1e-3 * theta
        moment = 0.9 * moment + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        theta = theta + 0.25 * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return theta[:3], np.exp(np.array([[0.0, theta[3]], [theta[4], theta[5]]])), np.ones(2)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """Scales and shift of a penalised logistic fit: Newton steps on standardised inputs,
    halved until the loss falls.  Scales have no sign against their meaning (the first
    two inputs don't lower a score)."""
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    a = np.concatenate([(x - mean) / spread, np.ones((len(x), 1))], axis=1)
    penalty = ridge * np.append(np.ones(x.shape[1]), 1e-6)
    free = np.ones(a.shape[1], dtype=bool)

    def loss(w: np.ndarray) -> float:
        return float(weight @ np.logaddexp(0, np.where(y > 0, -1, 1) * (a @ w)) + 0.5 * penalty @ w**2)

    while True:
        w = np.zeros(a.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -_CLIP, _CLIP)))
            slope = (a.T @ (weight * (p - y)) + penalty * w)[free]
            curve = (a.T @ (a * (weight * p * (1 - p))[:, None]) + np.diag(penalty))[np.ix_(free, free)]
            step, now, size = np.zeros(len(w)), loss(w), 1.0
            step[free] = np.linalg.solve(curve, slope)
            while loss(w - size * step) > now and size > 1e-6:
                size /= 2
            w = w - size * step
            if size * np.abs(step).max() < 1e-8:
                break
        wrong = np.flatnonzero((w[:2] < 0) & free[:2])
        if not len(wrong):
            break
        free[wrong] = False
    scale = w[:-1] / spread
    return scale, float(w[-1] - mean @ scale)


def fit(texts: list[str], labels: list[int], totals: tuple[int, int] | None = None, least: int = 2, most_tokens: int = 150_000, folds: int = 5, cost: float = 5.0) -> Model:
    """A model from whole labelled texts (see the module's text); totals: how many labels
    of either class there are in all; cost: how many clean documents wrongly called toxic
    are as bad as a toxic one that is missed.

    The field's weights come from the first documents up to most_tokens tokens, the
    evidence and the calibration from all.
    """
    model = Model()
    labels = np.asarray(labels, dtype=int)
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        model.shift = math.log(max(share, 1e-12) / max(1 - share, 1e-12))
        return model
    sample = _Sample(texts)
    of = np.arange(len(texts)) % folds
    parts = [sample.inputs(sample.evidence(np.flatnonzero(of != h), labels, least)) for h in range(folds)]

    def rows(d: int) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of a document's tokens by the other folds' evidence, and their labels: at
        most a third off the document's strongest evidence, and clear by itself."""
        x = parts[of[d]][sample.tokens[d]]
        return x, (x[:, 0] >= max(1.5, 0.67 * x[:, 0].max(initial=0.0))) if labels[d] else np.zeros(len(x), dtype=bool)

    used = [d for d in range(len(texts)) if len(sample.tokens[d])]
    some, held = [], 0
    for d in used:
        if held < most_tokens:
            some.append(d)
            held += len(sample.tokens[d])
    x, y = (np.concatenate(v) for v in zip(*(rows(d) for d in some))) if some else (np.zeros((0, 2)), np.zeros(0, dtype=bool))
    if not y.any():
        model.shift = math.log(labels.mean() / (1 - labels.mean()))
        return model
    model.weights, model.pairs, model.begin = _field(x, y.astype(float), _firsts([len(sample.tokens[d]) for d in some]))
    facts = _facts(np.zeros(0), np.zeros(len(texts), dtype=np.int64))
    sizes = np.array([len(sample.tokens[d]) for d in used])
    for part in np.split(np.arange(len(used)), np.flatnonzero(np.diff(np.cumsum(sizes) // 50_000)) + 1):  # bounded arrays
        x = np.concatenate([rows(used[i])[0] for i in part])
        marginal, _ = forward_backward(model.emission(x), _firsts(sizes[part].tolist()), model.pairs, model.begin)
        facts[[used[i] for i in part]] = _facts(marginal, sizes[part])
    counts = np.bincount(labels, minlength=2)
    share = np.array(totals if totals and min(totals) > 0 else counts) / counts * np.array([1.0, cost])
    model.scale, model.shift = _logistic(facts, labels.astype(float), (share / (share @ counts) * len(labels))[labels])
    final = sample.evidence(np.arange(len(texts)), labels, least)
    model.evidence = {sample.names[i]: float(final[i]) for i in np.flatnonzero(final)}
    return model


def _firsts(sizes: list[int]) -> np.ndarray:
    first = np.zeros(sum(sizes), dtype=bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    return first


def labelled_sample(documents: DataFrame, labels: DataFrame, most_docs: int = 1000, most_chars: int = 4_000_000) -> tuple[list[str], list[int], tuple[int, int]]:
    """Texts and labels of at most most_docs documents of each class, most_chars characters
    in all, and how many usable labels of either class there are.

    Only rows whose crc32 of doc_id modulo 5 is not 0 are taken; they come in the
    order of a hash, so the sample doesn't depend on the layout of files.
    """
    usable = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1) AND crc32(CAST(doc_id AS STRING)) % 5 <> 0").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    totals = usable.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    rows = []
    for v in (0, 1):  # half of the characters for each class
        picked = usable.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
        rows += labelled_texts(documents.select("doc_id", "text"), picked, most_chars // 2)
    rows.sort(key=lambda r: (r.doc_id, r.toxic))
    return [r.text for r in rows], [r.toxic for r in rows], tuple(totals)


# ---------------------------------------------------------------- scoring


def _spans(text: bytes, starts: np.ndarray, ends: np.ndarray, p: np.ndarray) -> list[dict]:
    out = []
    at = chars = 0
    for a, b, v in zip(starts.tolist(), ends.tolist(), p.tolist()):
        chars += len(text[at:a].decode("utf-8", "replace"))
        size = len(text[a:b].decode("utf-8", "replace"))
        out.append({"start": chars, "end": chars + size, "p": v})
        at, chars = b, chars + size
    return out


class Scorer:
    """Scores columns of texts; the inputs of words met before are kept by hash."""

    def __init__(self, model: Model, most_kept: int = 400_000):
        self.model, self.most = model, most_kept
        self.known = np.zeros(0, dtype=np.uint64)
        self.value = np.zeros((0, 2))

    def _inputs(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        old = self.known[at] == distinct if len(self.known) else np.zeros(len(distinct), dtype=bool)
        values = np.zeros((len(distinct), 2))
        values[old] = self.value[at[old]]
        raw = data.tobytes()
        for i in np.flatnonzero(~old):
            values[i] = self.model.inputs(raw[starts[where[i]] : ends[where[i]]].decode("utf-8", "replace"))
        if len(self.known) > self.most:
            self.known, self.value = distinct, values
        elif not old.all():
            known = np.concatenate([self.known, distinct[~old]])
            by = np.argsort(known)
            self.known, self.value = known[by], np.concatenate([self.value, values[~old]])[by]
        return values[back]

    def score(self, column: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
        n = len(column)
        facts, spans = _facts(np.zeros(0), np.zeros(n, dtype=np.int64)), [[] for _ in range(n)]
        data, byte_offsets = text_buffer(column)
        for row, hashes, offsets, starts, ends in words(column):
            if not len(hashes):
                continue
            base = int(byte_offsets[row])
            part = data[base : int(byte_offsets[row + len(offsets) - 1])]
            x = self._inputs(hashes, part, starts, ends)
            first = np.zeros(len(hashes), dtype=bool)
            first[offsets[:-1][np.diff(offsets) > 0]] = True
            marginal, _ = forward_backward(self.model.emission(x), first, self.model.pairs, self.model.begin)
            facts[row : row + len(offsets) - 1] = _facts(marginal, np.diff(offsets))
            hot = np.flatnonzero(marginal >= 0.5)
            owner = np.searchsorted(offsets, hot, side="right") - 1
            for r in np.unique(owner):
                mine = hot[owner == r]
                lo = int(byte_offsets[row + r])
                text = data[lo : int(byte_offsets[row + r + 1])].tobytes()
                spans[row + r] = _spans(text, starts[mine] + base - lo, ends[mine] + base - lo, marginal[mine])
        return self.model.score(facts), spans


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def tagged(documents: DataFrame, model: Model) -> DataFrame:
    """documents with _score double and _spans array<struct<start, end, p>>, which replace
    columns of these names."""
    shared = Workspace(documents.sparkSession).share(model)
    documents = documents.drop("_score", "_spans")

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            score, spans = scorer.score(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(spans, _SPAN)], [*batch.schema.names, "_score", "_spans"])

    at = documents.columns.index("text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return documents.mapInArrow(run, f"{kinds}, _score double, _spans array<struct<start:int,end:int,p:double>>")


def scored_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans for every row of documents."""
    model = fit(*labelled_sample(documents, labels))
    held_out = F.coalesce(F.expr("crc32(CAST(doc_id AS STRING)) % 5 = 0"), F.lit(False))
    return tagged(documents.select("doc_id", "text"), model).select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("_score").alias("score"),
        F.when(F.col("_score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.col("_spans").alias("spans"),
    )
