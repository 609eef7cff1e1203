"""Removal of repeated strings against a plain search."""

import hashlib
import random

import numpy as np
import pytest

from cityloom.llm import suffixes

DOCS = "doc_id long, text string"


def plain(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, by a dictionary of windows."""
    first = {}
    raw = [(float("inf") if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in raw:
        for i in range(len(b) - length + 1):
            first[b[i : i + length]] = min(first.get(b[i : i + length], (float("inf"), 1 << 60)), (d, i))
    out = []
    for (doc, _), (d, b) in zip(rows, raw):
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (d, i):
                gone[i : i + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone[:-1]])
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _check(spark, rows, length=100, parts=3):
    docs = spark.createDataFrame([(*r, 0) for r in rows], DOCS + ", pid int").repartition(parts)
    got = suffixes.deduplicated(docs, length).selectExpr("doc_id", "n_bytes", "aggregate(spans, 0L, (n, s) -> n + s.end - s.start)", "size(spans)", "sha2(kept, 256)").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain(rows, length)))


def _texts(rng, n, vocabulary=3000):
    words = [f"w{i}" if i % 7 else f"ü{i}" for i in range(vocabulary)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.choice([12, 25, 60]))) for _ in range(12)]
    out = []
    for _ in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(50))) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(passages))
        if rng.random() < 0.3:
            cut = rng.choice(passages)
            parts.append(cut[rng.randrange(40) :][: rng.randrange(90, 260)])
        out.append("\n".join(parts))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_plain_search(spark, seed):
    rng = random.Random(seed)
    texts = _texts(rng, 60)
    texts += [rng.choice(texts) for _ in range(15)] + [texts[0] + " " + texts[1]]
    rows = list(enumerate(texts)) + [(200, None), (201, ""), (202, "short"), (None, texts[3]), (None, texts[3]), (7, texts[7]), (7, texts[8]), (-5, texts[9])]
    _check(spark, rows)


def test_low_alphabets_edges_and_lengths(spark):
    rng = random.Random(9)
    texts = ["a" * n for n in (99, 100, 101, 350)] + ["ab" * 120, "x" * 99 + "y" + "x" * 99]
    texts += ["".join(rng.choice("ab") for _ in range(300)) for _ in range(6)]
    base = "".join(rng.choice("abcdefghij ") for _ in range(500))
    texts += [base[:250], base[100:350], base[201:420], base[250:], "".join(map(chr, range(1, 128))) * 3]
    _check(spark, list(enumerate(texts)))
    _check(spark, list(enumerate(texts)), length=40)


def test_common_lines_are_split(spark, monkeypatch):
    """A line among other texts in all of them: different slices of one anchor."""
    monkeypatch.setattr(suffixes, "MANY", 3)
    monkeypatch.setattr(suffixes, "MANY_A_CLASS", 0)
    rng = random.Random(4)
    line = "".join(rng.choice("abcdefghij") for _ in range(80))
    texts = ["".join(rng.choice("klmnopqr ") for _ in range(150)) + line + "".join(rng.choice("klmnopqr ") for _ in range(150)) for _ in range(40)]
    texts += [texts[0][100:330], texts[1][120:300] + texts[2][60:], texts[3]]
    _check(spark, list(enumerate(texts)))


def test_long_text_crosses_blocks_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_BLOCK", 700)
    monkeypatch.setattr(suffixes, "_SYMBOLS", 500)
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    _check(spark, [(1, long), (2, long[300:2500]), (3, "z" + long[650:760]), (4, long + long[:900])])
    assert suffixes.suffix_report(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh"])
def test_common_prefixes_equal_a_sort(alphabet):
    rng = random.Random(len(alphabet))
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(12)]
    pieces = base + [x[: rng.randrange(1, 120)] for x in base] + [x[rng.randrange(5) :] + "a" for x in base]
    symbols = np.array([s for p in pieces for s in [*(ord(c) for c in p), 0]], dtype=np.uint16)
    ends = np.cumsum([len(p) + 1 for p in pieces])
    rest = np.repeat(ends, [len(p) + 1 for p in pieces]) - np.arange(len(symbols))
    order, common = suffixes.common_prefixes(symbols, rest, 70)
    text = lambda i: symbols[i : i + rest[i] - 1].tolist()
    assert sorted(range(len(symbols)), key=lambda i: (text(i), i)) == order.tolist()
    for b in range(1, len(order)):
        x, y = text(order[b - 1]), text(order[b])
        same = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert (common[b] == 255) == (same >= 70), (b, same, common[b])
        if 4 <= same < 70:
            assert common[b] == same
