"""The training-data operators against brute force, round trips and edge cases."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cityloom.llm import chat, decontam, jaccard, lines, media, mixing, resampling, store, tokens, toxicity, warc

DOCS = "doc_id long, text string"
DATA = "/root/testdata/sf0.001"


def _words(n, rng, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# ---------------------------------------------------------------- media


@given(st.binary(max_size=3000))
@settings(max_examples=60, deadline=None)
def test_png_round_trip(data):
    payload = media.padded(data)
    assert len(payload) % 192 == 0 and payload[: len(data)] == data and set(payload[len(data) :]) <= {32}
    image = media.encode(payload)
    assert media.decode(image).tobytes() == payload


def test_png_filters_and_damage():
    import struct

    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (5, 12), dtype=np.uint8)
    raw = b""
    for y, kind in enumerate((0, 1, 2, 3, 4)):
        line = rows[y].astype(int)
        left = np.concatenate([[0] * 3, line[:-3]])
        up = rows[y - 1].astype(int) if y else np.zeros(12, int)
        corner = np.concatenate([[0] * 3, up[:-3]])
        p = left + up - corner
        paeth = [a if abs(q - a) <= abs(q - b) and abs(q - a) <= abs(q - c) else b if abs(q - b) <= abs(q - c) else c for a, b, c, q in zip(left, up, corner, p)]
        guess = (0, left, up, (left + up) // 2, np.array(paeth))[kind]
        raw += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    image = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (media.decode(image).reshape(5, 12) == rows).all()
    broken = bytearray(image)
    broken[40] ^= 1
    with pytest.raises(ValueError):
        media.decode(bytes(broken))


def test_document_media(spark):
    docs = spark.createDataFrame([(1, "a", 0), (2, None, 1), (3, "", 2), (4, "a", 3), (None, "ü" * 500, 4)], DOCS + ", key int")
    got = {r.doc_id: r for r in media.document_media(docs).collect()}
    assert got[1].payload_sha256 == hashlib.sha256(media.padded(b"a")).hexdigest()
    assert got[2][1:] == got[3][1:] and got[1][1:] == got[4][1:]
    assert got[None].n_bytes == 1000 and got[None].payload_bytes == 1152
    assert got[1].tail_crc32 == zlib.crc32(b" " * 16)


def test_media_feature_equals_a_direct_transform():
    rng = np.random.default_rng(4)
    samples = media.decode(media.encode(media.padded(rng.integers(0, 256, 5000, dtype=np.uint8).tobytes())))
    h, w = samples.shape[:2]
    grey = samples.mean(axis=2)

    def pooled(v, n):
        edges = np.linspace(0, len(v), n + 1)
        out = []
        for a, b in zip(edges, edges[1:]):
            lo = min(int(np.floor(a)), len(v) - 1)
            out.append(v[lo : max(int(np.ceil(b)), lo + 1)].mean(axis=0))
        return np.array(out)

    small = pooled(pooled(grey, 32).T, 32).T
    low = [sum(small[y, x] * math.cos(math.pi * (y + 0.5) * i / 32) * math.cos(math.pi * (x + 0.5) * j / 32) for y in range(32) for x in range(32)) for i in range(8) for j in range(8)]
    low = np.round(low, 6)
    assert (h, w) == (27, 64) and media.low_frequency_hash(samples) == np.packbits(low > np.median(low[1:])).tobytes().hex()


# ---------------------------------------------------------------- chat


@given(st.text(alphabet="<[/\\|]INSTs>ab\n", max_size=60))
@settings(max_examples=200, deadline=None)
def test_escaping_is_reversible(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not re.search(r"<\||</?s>|\[/?INST\]", out)


def test_log_is_folded(spark):
    events = spark.createDataFrame(
        [
            (1, 0, 0, "delta", "user", "hi"),
            (1, 1, 1, "delta", "assistant", "he"),
            (1, 2, 1, "delta", None, "llo"),
            (1, 3, 2, "delta", "user", "more"),
            (1, 4, 1, "regenerate", None, None),
            (1, 5, 1, "delta", "assistant", "new "),
            (1, 6, 1, None, None, "one"),
            (1, 7, 0, "edit", None, "hello"),
            (None, 0, 0, "delta", None, None),
        ],
        "conv_id long, seq long, msg long, kind string, role string, text string",
    )
    rows = sorted(chat.rendered(events).collect(), key=lambda r: (r.conv_id or 0, r.turn))
    assert [chat.parse(r.formatted) for r in rows] == [("", ""), ("user", "hello"), ("assistant", "new one")]
    assert (rows[2].loss_start, rows[2].loss_end) == (len("<|user|>hello<|end|>") + len("<|assistant|>"), len("<|user|>hello<|end|><|assistant|>new one"))


def test_chat_query_edges(spark):
    turns = spark.createDataFrame([(5, 0, "a|%\n", None), (5, 1, "assistant", "x</s>"), (5, 1, "assistant", "x</s>"), (6, 0, None, "")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.formatted_conversations(turns).collect()}
    assert set(got) == {-1, 5, 6}
    assert got[5].n_turns == 3 and got[5].loss_chars == 10
    assert got[5].loss_sha256 == hashlib.sha256(b"x</s>x</s>").hexdigest()
    assert got[5].turns_sha256 == hashlib.sha256(b"a|%\n\n\nassistant\nx</s>\nassistant\nx</s>\n").hexdigest()
    assert chat.formatted_conversations(turns.limit(0)).count() == 1


# ---------------------------------------------------------------- archives


def test_archives_with_magic_in_payloads(spark):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    pages = [(i, f"http://x/{i}", fake * (i % 4) + f"page {i}" * (i % 7)) for i in range(60)] + [(60, None, None), (61, "u\r\nv", ""), (62, "w", fake * 400)]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    got = {r.page_id: r for r in warc.page_archives(df).collect()}
    assert set(got) == {p[0] for p in pages}
    first = {}
    for i, _, html in pages:
        data = (html or "").encode()
        first.setdefault(data, i)
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), warc.digest32(data))
        assert (r.record_type, r.refers_to) == (("response", None) if first[data] == i else ("revisit", first[data]))


def _forged(length: str) -> str:
    return f"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {length}\r\n\r\nabc\r\n\r\n"


def _brute_pages(rows):
    least = {}
    for i, _, html in rows:
        if i is not None:
            data = (html or "").encode()
            least[data] = min(i, least.get(data, i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = data in least and i != least[data]
        out.append((i, len(data), warc.digest32(data), "revisit" if again else "response", least[data] if again else None))
    return sorted(out, key=repr)


def test_archives_of_odd_pages(spark):
    rows = [(i, "u", _forged(n)) for i, n in enumerate(["\u00b2", "9" * 5000, "9" * 20, "1000000000000", "007", "", "-1", "5 "])]
    rows += [(20, "http://x/" + "y" * 1_000_000, "after a long address"), (21, "v", "x\r\nWARC/1.0\r\n" + "no colon " * 30_000), (22, "v", "WARC/1.0\r\nA: b\r\n c: d\r"), (23, "v", "WARC/1.0\r\n")]
    rows += [(None, "a", "of nobody"), (None, "a", "same"), (1, "b", "same"), (1, "b", "same"), (5, None, "same"), (5, "c", "same"), (5, "c", "other"), (6, "c", "other"), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in warc.page_archives(df).collect()), key=repr)
    assert got == _brute_pages(rows)
    assert warc.page_archives(df.limit(0)).count() == 0


def test_small_splits_and_damage(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u" * (40 * (i % 40)), f"WARC/1.0\r\n {i} " * (9 if i % 7 else 900)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    path = f"file://{tmp_path}/warc"
    work = store.Workspace(spark)
    warc.write_archives(warc.with_digests(pages, work), path)
    for size in (1000, 9000):
        assert sorted(r.payload_bytes for r in warc.read_archives(spark, path, work, split_bytes=size).collect()) == sorted(len(r.html) for r in pages.collect())
    for name in [f for f in os.listdir(tmp_path / "warc") if f.startswith("part")]:
        with open(tmp_path / "warc" / name, "ab") as f:
            f.write(b"WARC/1.0\r\ncut off")
    with pytest.raises(ValueError):
        warc.read_archives(spark, path, work)


# ---------------------------------------------------------------- Jaccard join


def _brute(docs, k=3, num=90, den=100):
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    docs, base = [], [_words(rng.randrange(30, 150), rng, 300) for _ in range(6)]
    for i in range(150):
        w = list(base[i % 6])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(_words(1, rng) + ["w1"])
        docs.append((i, " ".join(w) if i % 5 else " ".join(w).upper()))
    docs += [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "ONE\ttwo"), (205, "one"), (206, "x " * 3000)]
    df = spark.createDataFrame(docs, DOCS).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.component_report(df.withColumn("node", F.lit("clash"))).collect()}
    assert got == _brute(docs)


def test_repeated_and_null_ids(spark):
    text = " ".join(str(i) for i in range(50))
    df = spark.createDataFrame([(4, text), (4, text), (None, text), (9, text + " more"), (4, "other words here now")], DOCS)
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.component_report(df).collect()), key=repr)
    assert got == sorted([(4, 48, 4), (4, 48, 4), (0, 48, None), (9, 49, 4), (4, 2, 4)], key=repr)
    assert jaccard.component_report(df.limit(0)).count() == 0


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in store.components(edges, store.Workspace(spark)).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_long_shuffled_chain_is_one_component(spark):
    names = np.random.default_rng(4).permutation(3000)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(names, names[1:])], "a long, b long")
    got = store.components(edges, store.Workspace(spark)).collect()
    assert len(got) == 3000 and {r.component for r in got} == {0}


def test_components_of_random_graphs(spark):
    rng = random.Random(12)
    for n, m in ((60, 40), (60, 58), (200, 150)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(n, n + i) for i in range(1, 30)]
        label = {x: x for e in edges if e[0] != e[1] for x in e}
        for _ in label:
            for a, b in edges:
                if a != b:
                    label[a] = label[b] = min(label[a], label[b])
        got = {r.node: r.component for r in store.components(spark.createDataFrame(edges, "a long, b long"), store.Workspace(spark)).collect()}
        assert got == label


def test_patterned_words_and_shared_names(spark):
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a  # hashes by polynomials modulo a power of two can't tell these apart
    rng = random.Random(8)
    docs = [(1, a), (2, b), (3, f"x {a} y"), (4, f"x {b} y"), (5, f"x {a} y")]
    for i in range(60):
        w = _words(12, random.Random(i % 20), 9)
        docs.append((10 + i, " ".join(w + ([rng.choice("pq")] if i > 40 else []))))
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    want = _brute(docs)
    for bits in (63, 4):  # with 4 bits, many classes share a first name
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked_components(df, name_bits=bits).select("doc_id", "n_shingles", "component_id").collect()}
        assert got == want


def test_common_ngrams_are_spread(spark, monkeypatch):
    monkeypatch.setattr(store, "MOST_KEYS", 0)  # and nothing fits a bit set
    calls = []
    plain = store.spread_join

    def spy(rows, facts, key, hot, how="inner"):
        hot = rows.select(*key).distinct()  # all keys are hot
        calls.append(key)
        return plain(rows, facts, key, hot, how)

    for module in (jaccard, lines, warc):
        monkeypatch.setattr(module, "spread_join", spy)
    rng = random.Random(14)
    base = [_words(40, rng, 100) for _ in range(3)]
    docs = []
    for i in range(50):
        w = list(base[i % 3])
        w[rng.randrange(40)] = "other"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.component_report(df).collect()} == _brute(docs)
    kept = {r.doc_id for r in jaccard.one_of_each(df).collect()}
    assert kept == {i for i, (_, c) in _brute(docs).items() if c == i}
    text = [(i, f"line one\nline two\nown {i}") for i in range(9)]
    assert sum(r._removed_chunks for r in lines.deduplicated(spark.createDataFrame(text, DOCS)).collect()) == 8
    pages = spark.createDataFrame([(i, "u", "same") for i in range(9)], "page_id long, url string, html string")
    assert sorted(r.refers_to for r in warc.page_archives(pages).collect() if r.refers_to is not None) == [0] * 8
    assert len(calls) >= 5


def test_rows_without_or_with_shared_ids_go_by_their_text(spark):
    text = " ".join(str(i) for i in range(50))
    rows = [(4, text), (4, text), (None, text), (9, text), (4, "other words here now"), (None, "alone in this table"), (7, None), (7, None), (8, "")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], DOCS + ", node int")
    got = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(df).collect()), key=repr)
    assert got == sorted([(4, text), (4, "other words here now"), (None, "alone in this table"), (7, None), (7, None), (8, "")], key=repr)
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in decontam.decontaminated(df, items).collect()), key=repr)
    assert got == sorted([r for r in rows if r[1] != text], key=repr)


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 5000}" for i in range(400_000))  # longer than a segment of the kernels
    docs = spark.createDataFrame([(1, long), (2, long + " tail"), (3, "short text")], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.component_report(docs).collect()}
    assert got == {1: (5000, 1), 2: (5001, 1), 3: (1, 3)}
    item = spark.createDataFrame([(1, "so " + " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    assert {r.doc_id for r in decontam.contaminated(docs, item).collect()} == {1, 2}
    assert {r.doc_id for r in lines.line_report(docs).collect()} == {1, 2, 3}


# ---------------------------------------------------------------- toxicity


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    e, pairs = rng.normal(size=9), np.exp(rng.normal(size=(2, 2)))
    first = np.array([1, 0, 0, 0, 1, 1, 0, 0, 0], bool)
    got, both = toxicity.forward_backward(e, first, pairs, np.ones(2))
    total, want, counts = 0.0, np.zeros(9), np.zeros((2, 2))
    for path in itertools.product((0, 1), repeat=9):
        w = np.exp(sum(x for x, s in zip(e, path) if s))
        for t in range(1, 9):
            w *= 1 if first[t] else pairs[path[t - 1], path[t]]
        total += w
        want += w * np.array(path)
        for t in range(1, 9):
            if not first[t]:
                counts[path[t - 1], path[t]] += w
    assert np.allclose(got, want / total) and np.allclose(both, counts / total)


def _toxic(rng, n):
    out = []
    for i in range(n):
        w = _words(rng.randrange(20, 60), rng, 500)
        bad = i % 3 == 0
        if bad:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(["vilewort", "vilename", "grotbag"])
        out.append((i, " ".join(w), int(bad)))
    return out


def test_toxicity_held_out_accuracy(spark):
    rows = _toxic(random.Random(5), 400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "vilewort " * 3000)], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (901, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored_documents(docs, labels).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert np.mean([p == y for p, y in held]) > 0.95
    assert got[900].predicted == got[901].predicted == 0 and got[902].predicted == 1
    text = dict((i, t) for i, t, _ in rows)
    spans = [text[i][s.start : s.end] for i in got if i in text for s in got[i].spans]
    assert spans and all(s in ("vilewort", "vilename", "grotbag") for s in spans)


def test_calibration_is_finite_on_separable_data():
    x = np.array([[-9.0, -9.0, 3.0]] * 50 + [[8.0, 7.0, 3.5]] * 50)
    scale, shift = toxicity._logistic(x, np.repeat([0.0, 1.0], 50), np.ones(100))
    assert np.isfinite(shift) and (np.abs(scale * x.std(axis=0)) < 5).all() and scale[0] >= 0  # per standard deviation


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_toxicity_of_sample_data(spark):
    d = "/root/testdata/sf0.1"
    documents, labels = store.table(spark, d, "documents"), store.table(spark, d, "labels")
    rows = toxicity.scored_documents(documents, labels).select("doc_id", "held_out", "score", "predicted").join(labels, "doc_id", "left").join(documents.select("doc_id", F.length("text").alias("n")), "doc_id").collect()
    held = [(r.predicted, r.toxic) for r in rows if r.held_out and r.toxic is not None]
    hit = sum(p and t for p, t in held)
    assert hit / sum(p for p, _ in held) >= 0.85 and hit / sum(t for _, t in held) >= 0.85
    assert len({r.score for r in rows}) > 100 and sum(r.n or 0 for r in rows if r.predicted) < 0.15 * sum(r.n or 0 for r in rows)
    print("held out:", hit, "hits", sum(p and not t for p, t in held), "false", sum(t and not p for p, t in held), "missed of", len(held))


def test_labelled_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, "a" * 10)] * 500 + [(2, "b" * 5000), (3, "c" * 30), (4, None), (5, "d" * 40)], DOCS)
    picked = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4, 5)], "doc_id long, toxic int")
    rows = store.labelled_texts(docs, picked, 60)
    assert 0 < sum(len(r.text) for r in rows) <= 60 and len({r.doc_id for r in rows}) == len(rows)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.scored_documents(docs, none).collect()] == [(pytest.approx(0.0, abs=1e-6), 0)]
    assert toxicity.scored_documents(docs.limit(0), none).count() == 0


# ---------------------------------------------------------------- decontamination


def test_alignment_equals_full_table():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b = rng.integers(0, 4, 12).astype(np.uint64), rng.integers(0, 4, 18).astype(np.uint64)
        h = np.zeros((13, 19), int)
        for i in range(12):
            for j in range(18):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontam.align(a, b)[0] == h.max()


def test_contamination(spark):
    rng = random.Random(9)
    items = [(i, " ".join(_words(30, rng))) for i in range(8)] + [(8, "two words"), (9, None), (10, "")]
    docs = [(i, " ".join(_words(200, rng))) for i in range(40)]
    edited = items[1][1].split()
    edited[4], edited[15] = "changed", "other"
    docs += [(50, f"{docs[0][1]} {items[0][1].upper()} end"), (51, " ".join(_words(20, rng) + edited + ["tail"])), (52, "so two words, then"), (53, None), (54, ""), (None, items[2][1])]
    df = spark.createDataFrame(docs, DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect()}
    assert got == {(50, 0), (51, 1), (52, 8), (None, 2)}
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench, block_chars=300).collect()} == got
    assert decontam.contaminated(df.limit(0), bench).count() == 0
    assert decontam.contaminated(df, bench.limit(0)).count() == 0


# ---------------------------------------------------------------- mixing and resampling


def test_contamination_equals_alignment_of_all_pairs(spark):
    rng = random.Random(15)
    items = [(i, " ".join(_words(n, rng, 300))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 9, 16, 16, 20, 30, 40, 59])]
    docs = []
    for i in range(300):
        item = items[rng.randrange(len(items))][1].split()
        rate, copy = rng.choice((0.1, 0.15, 0.2, 0.25, 0.3)), []
        for at, w in enumerate(item):
            kind = rng.choice("rrdi") if rng.random() < rate else ""
            copy += {"": [w], "r": [f"new{at}"], "d": [], "i": [w, f"put{at}"]}[kind]
        if i % 10 == 0:
            copy = [f"new{at}" if at % 5 == 4 else w for at, w in enumerate(item)]
        docs.append((i, " ".join(_words(rng.randrange(0, 60), rng, 300) + copy + _words(rng.randrange(0, 60), rng, 300))))
    want = {}
    for i, text in docs:
        for o, item in items:
            score = decontam.align(np.array(item.split()), np.array(text.split()))[0] / (2 * len(item.split())) if text else 0
            if score >= 0.5:
                want[i, o] = score
    got = decontam.contaminated(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.score for r in got} == want and len(got) == len(want) > 200


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    rows = spark.createDataFrame([(int(n), [float(y) for y in x]) for n, x in zip(rng.integers(1, 500, 300), p)], "_tokens long, _posteriors array<double>")
    rate, target, now = mixing.fit_rates(rows, [20000.0, 30000.0, 5000.0], [1, 1, 1])
    assert np.allclose(now, target, rtol=1e-3)
    assert rows.select(F.min(F.expr(rate))).first()[0] >= 0
    _, target, now = mixing.fit_rates(rows, None, [0.5, 0.3, 0.2], least=1.0)
    assert (now >= 0.99 * target).all()


def test_mixture_edges(spark):
    docs = spark.createDataFrame([(i, ("aa bb cc " if i % 2 else "dd ee ff ") * 9, "en" if i % 2 else "de") for i in range(60)] + [(90, None, "en"), (91, "", "de")], DOCS + ", lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in mixing.mixture(docs, labels).collect()}
    assert len(got) == 62 and got[90].rate == got[91].rate == 1.0 and got[90].n_tokens == 0
    assert got[41].p_en > 0.9 and got[42].p_de > 0.9
    total = lambda a: sum(r.rate * r.n_tokens * r[a] for r in got.values())
    assert total("p_en") / total("p_de") == pytest.approx(0.45 / 0.18, rel=0.02)
    assert mixing.mixture(docs.limit(0), labels).count() == 0


def test_top_k_equals_a_sort(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), (F.pmod(F.hash("id"), F.lit(700)) / 7).alias("x"))
    want = {(r.doc_id, r.x) for r in rows.orderBy(F.desc("x"), "doc_id").limit(1234).collect()}
    assert {(r.doc_id, r.x) for r in resampling.top_k(rows, "x", "doc_id", 1234, bins=8, small=10).collect()} == want
    assert resampling.top_k(rows, "x", "doc_id", 0).count() == 0 and resampling.top_k(rows, "x", "doc_id", 9999).count() == 3000


def test_resampling_prefers_the_target(spark):
    docs = spark.createDataFrame([(i, " ".join(_words(40, random.Random(i), 50)) if i % 4 else "junk % % " * 20) for i in range(200)] + [(500, None), (501, "")], DOCS).withColumn("log_weight", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(100)], "doc_id long, quality int")
    got = {r.doc_id for r in resampling.resampled(docs, labels).collect()}
    assert len(got) == int(np.ceil(0.75 * 202)) and sum(1 for i in got if i < 500 and i % 4 == 0) <= 2
    assert resampling.resampled(docs.limit(0), labels).count() == 0
    assert resampling.resampled(docs, labels.limit(0)).count() == 202
    twice = docs.union(docs)
    assert len(resampling.resampled(twice, labels).collect()) == int(np.ceil(0.75 * 404))


def test_resampling_weights_equal_brute_force(spark):
    import math
    from collections import Counter

    rng = random.Random(2)
    texts = {i: " ".join(_words(rng.randrange(0, 30), rng, 15 if i % 2 else 25)) for i in range(40)} | {40: None, 41: "one"}
    docs = spark.createDataFrame(list(texts.items()), DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")

    def features(text):  # the operator's buckets of words and of word pairs, counted by hand
        w = (text or "").split()
        one = [next(resampling._features(pa.array([x])))[2].tolist()[0] for x in w]
        pair = [next(resampling._features(pa.array([f"{a} {b}"])))[2].tolist()[2] for a, b in zip(w, w[1:])] or ([next(resampling._features(pa.array([w[0]])))[2].tolist()[1]] if w else [])
        return one + pair

    found = {i: features(t) for i, t in texts.items()}
    raw, goal = Counter(f for v in found.values() for f in v), Counter(f for i, v in found.items() if i % 2 and i < 40 for f in v)

    def share(counts, f):
        half = range(1 << 14) if f < 1 << 14 else range(1 << 14, 2 << 14)
        return (counts[f] + 0.5) / (sum(c for g, c in counts.items() if g in half) + 0.5 * (1 << 14))

    got = {r.doc_id: r for r in resampling.resampled(docs, labels, share=1.0, effective=20.0, seed=3).collect()}
    for i, v in found.items():
        want = 20.0 * sum(math.log(share(goal, f) / share(raw, f)) for f in v) / len(v) if v else -20.0
        assert got[i].log_weight == pytest.approx(want, abs=1e-9)
    noise = {r.doc_id: r.g for r in docs.select("doc_id", resampling.gumbel(3, "doc_id").alias("g")).collect()}
    assert all(r.gumbel_key == pytest.approx(r.log_weight + noise[i]) for i, r in got.items())
    want = sorted(got, key=lambda i: (-got[i].gumbel_key, i))[:21]
    assert {r.doc_id for r in resampling.resampled(docs, labels, share=0.5, effective=20.0, seed=3).collect()} == set(want)


def test_gumbel_draws_follow_the_weights(spark):
    weights = [1.0, 2.0, 3.0, 6.0]
    rows = spark.createDataFrame([(i, float(np.log(w))) for i, w in enumerate(weights)], "doc_id long, w double")
    seeds = spark.range(6000).select(F.col("id").alias("seed"))
    keyed = rows.crossJoin(seeds).select("seed", "doc_id", (F.col("w") + resampling.gumbel(F.col("seed"), "doc_id")).alias("key"))
    first = {r.d: r["count"] for r in keyed.groupBy("seed").agg(F.max_by("doc_id", "key").alias("d")).groupBy("d").count().collect()}
    for i, w in enumerate(weights):
        assert first[i] / 6000 == pytest.approx(w / 12, abs=0.02)


# ---------------------------------------------------------------- lines


def _brute_lines(docs, spread=lines.SPREAD, least=2, windows=False):
    seen, places = {}, {}
    rows = sorted({(i is None, i or 0, t) for i, t in docs if t})
    for row in rows:
        found, parts = lines.units(row[2].encode(), spread, least, 50, windows)
        places[row] = (len(parts), [(b"\n".join(parts[a : a + n]), a, n) for a, n in found])
        for body, a, n in places[row][1]:
            seen.setdefault(body, []).append((row, a, n))
    out = []
    for i, text in docs:
        row = (i is None, i or 0, text)
        if not text:
            out.append((i, text))
            continue
        size, found = places[row]
        gone, held = np.zeros(size, bool), np.zeros(size, bool)
        for body, a, n in found:
            if len(seen[body]) > 1:
                (held if seen[body][0] == (row, a, n) else gone)[a : a + n] = True
        parts = text.split("\n")
        parts = [x + "\n" for x in parts[:-1]] + parts[-1:] * bool(parts[-1])
        out.append((i, "".join(x for x, g, h in zip(parts, gone, held) if h or not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("windows", [False, True])
def test_line_dedup_equals_brute_force(spark, windows):
    rng = random.Random(6)
    shared = ["\n".join(" ".join(_words(5, rng, 50)) for _ in range(12)) for _ in range(4)]
    docs = []
    for i in range(60):
        own = "\n".join(" ".join(_words(4, rng)) for _ in range(rng.randrange(1, 9)))
        docs.append((i, own + "\n" + shared[i % 4] + "\n" + own[::-1]))
    docs += [(100, None), (101, ""), (102, "\n\n\n"), (103, "single"), (104, "\n\n\n"), (5, docs[5][1]), (5, "own\nwords"), (None, docs[7][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], DOCS + ", place string").repartition(3)
    got = [(r.doc_id, r.text) for r in lines.deduplicated(df, windows=windows).collect()]
    assert sorted(got, key=repr) == _brute_lines(docs, windows=windows)
    assert sum(len(t or "") for _, t in got) < 0.8 * sum(len(t or "") for _, t in docs)
    assert lines.line_report(df.limit(0)).count() == 0


def test_passages_of_any_length_go(spark):
    rng = random.Random(31)
    sizes = (1, 2, 4, 6)
    shared = {m: [" ".join(_words(60 if m == 1 else 20, rng)) for _ in range(m)] for m in sizes}
    docs = [(i, "\n".join([" ".join(_words(8, rng)) for _ in range(3)] + shared[sizes[i % 4]] + [" ".join(_words(8, rng)) for _ in range(3)])) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "a\na\na"), (103, "b\nc\n"), (104, "c\nd\ne"), (105, "b\nc\nd"), (106, "short"), (107, "short"), (None, "b\nc")]
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    got = {r.doc_id: r for r in lines.deduplicated(df, windows=True).collect()}
    for i in range(40):
        own = docs[i][1].split("\n")
        want = docs[i][1] if i < 4 else "\n".join(own[:3] + own[-3:])
        assert (got[i].text, got[i]._removed_chunks) == (want, int(i >= 4))
    assert [got[i].text for i in range(100, 108)] == [None, "", "a\na\n", "b\nc\n", "c\nd\ne", "", "short", "short"] and got[None].text == ""
    kept = {r.doc_id: r.kept_chars for r in lines.line_report(df).collect()}
    again = {r.doc_id: r for r in lines.deduplicated(df).collect()}
    assert kept[4] == len(again[4].text) and kept[7] == len(again[7].text)


def test_chunks_find_passages_of_few_lines(spark):
    """Recall of planted passages by chunks alone: nearly all lines of each length go, no others."""
    rng = random.Random(12)
    docs, planted = [], {}
    for m in (2, 4, 6, 20):
        for k in range(60):
            passage = [" ".join(_words(6, rng)) for _ in range(m)]
            for _ in range(2):
                own = [[" ".join(_words(7, rng)) for _ in range(rng.randrange(4))] for _ in range(2)]
                planted[len(docs)] = (m, sum(map(len, own)))
                docs.append((len(docs), "\n".join(own[0] + passage + own[1])))
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    left = {r.doc_id: len(r.text.splitlines()) for r in lines.deduplicated(df, long_line=0).collect()}
    gone = {m: 0 for m in (2, 4, 6, 20)}
    for i, (m, own) in planted.items():
        assert own <= left[i] <= own + m and (i % 2 or left[i] == own + m)  # first places stay whole
        gone[m] += own + m - left[i]
    assert all(n >= 0.8 * 60 * m for m, n in gone.items()) and all(gone[m] >= 0.93 * 60 * m for m in (4, 6, 20)), gone
    assert sum(gone.values()) >= 0.95 * 60 * 32


def test_units_with_other_bytes_stay(spark, monkeypatch):
    docs = [(i, f"same start {i % 2}\nsecond line {i % 2}") for i in range(6)]
    df = spark.createDataFrame(docs, DOCS)
    monkeypatch.setattr(lines, "_DIGEST", {"digest_size": 16, "key": b"k"})
    assert sum(r._removed_chunks for r in lines.deduplicated(df).collect()) == 4

    class Weak:  # all bodies share a digest
        @staticmethod
        def blake2b(data, digest_size=16, **_):
            return hashlib.blake2b(b"", digest_size=digest_size) if digest_size == 16 else hashlib.blake2b(data, digest_size=digest_size)

    monkeypatch.setattr(lines, "hashlib", Weak)
    assert sum(r._removed_chunks for r in lines.deduplicated(df).collect()) == 0


def test_boundaries_survive_shifts():
    rng = random.Random(8)
    body = [" ".join(_words(6, rng)).encode() for _ in range(200)]
    pieces = []
    for text in (body, [b"put in front", *body]):
        edges = lines.chunks(text)
        pieces.append({tuple(text[a:b]) for a, b in zip(edges, edges[1:])})
    assert len(pieces[0]) > 30 and len(pieces[0] & pieces[1]) >= len(pieces[0]) - 2


# ---------------------------------------------------------------- tokens


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")
def test_shards_hold_every_token_once(spark, tmp_path):
    docs = [(i, f"document {i} " * (i % 50)) for i in range(120)] + [(500, None), (501, ""), (502, "long text " * 4000)]
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    layout = tokens.Layout(length=64, per_shard=16)
    rows = tokens.materialised(df, layout, f"file://{tmp_path}/shards").collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    coder = tokens.Tokenizer(tokens.vocabulary(spark, tokens.VOCABULARY))
    want = {i: np.frombuffer(coder.encode(t or ""), dtype="<u2").tolist() for i, t in docs}
    assert sum(len(x) + 1 for x in want.values()) <= 64 * len(rows) <= sum(len(x) + 1 for x in want.values()) + 64 * 3
    for r in rows:
        with open(tmp_path / "shards" / tokens.shard_name(r.shard), "rb") as f:
            f.seek(r.offset)
            ids = np.frombuffer(f.read(128), dtype="<u2").tolist()
        assert r.offset == (r.slot % 16) * 128 and sum(ids) == r.id_sum
        for doc, a, b in zip(r.doc_ids, r.starts, [*r.starts[1:], 64]):
            piece = ids[a:b]
            while piece and piece[-1] == tokens.END:
                piece.pop()
            assert "".join(map(chr, piece)) in "".join(map(chr, want[doc]))
    later = tokens.read_shards(spark, f"file://{tmp_path}/shards", len(rows), layout, first=20).collect()
    crc = {r.slot: r.crc for r in rows}
    assert sorted(r.slot for r in later) == list(range(20, len(rows))) and all(crc[r.slot] == r.crc for r in later)
    assert tokens.materialised(df.limit(0), layout).count() == 0


@given(st.integers(1, 5000), st.integers(0, 2**64))
@settings(max_examples=40, deadline=None)
def test_permutation_is_a_bijection(size, key):
    assert sorted(tokens.permuted(np.arange(size), size, key).tolist()) == list(range(size))


# ---------------------------------------------------------------- pipeline


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = store.table(spark, DATA, "documents").withColumn("_score", F.lit("own")).withColumn("toxic", F.lit(5)).withColumn("_copy", F.lit(1.5))
    names = docs.columns
    step, work = {}, store.Workspace(spark)
    for name, stage in p.STAGES[:-1]:
        docs = work.written(stage(spark, docs, DATA), "test-stage")
        step[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == names and docs.where("_score <> 'own' OR toxic <> 5 OR _copy <> 1.5").count() == 0
    toxic = {r.doc_id for r in store.table(spark, DATA, "labels").where("toxic = 1").collect()}
    assert len(toxic & set(step["toxicity"])) <= 0.2 * len(toxic)
    texts = [(r.doc_id, r.text) for r in store.table(spark, DATA, "documents").collect() if r.doc_id in set(step["toxicity"])]
    assert sorted(step["near duplicates"]) == sorted(i for i, (_, c) in _brute(texts, 5, 80, 100).items() if c == i)
    assert set(step["mixing"]) == set(step["decontamination"]) and len(step["mixing"]) > len(step["decontamination"])
    none = store.table(spark, DATA, "documents").limit(0)
    for name, stage in p.STAGES:
        assert stage(spark, none, DATA).count() == 0, name
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", None, 0), (7, "", "en", None, 0), (8, "plain words here", None, "s", 3)], none.schema)
    for name, stage in p.STAGES:
        assert stage(spark, odd, DATA).count() >= 1, name


def test_pipeline_drops_copies_from_similarity_of_four_fifths_on(spark):
    import corpus_pipeline as p

    rng = random.Random(21)
    docs = []
    for i in range(24):
        w = _words((1 + i % 4) * rng.randrange(36, 64), rng)
        docs.append((i, " ".join(w)))
        edited = list(w)
        for at in range(0, len(w) - 5, len(w) // (1 + i % 4)):
            edited[at + 2] = f"edit{i}x{at}"
        docs.append((100 + i, " ".join(edited)))
    shares = []
    for i in range(24):
        sets = []
        for text in (docs[2 * i][1], docs[2 * i + 1][1]):
            w = text.split()
            sets.append([{tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for k in (5, 3)])
        shares.append([len(x & y) / len(x | y) for x, y in zip(*sets)])
    assert sum(0.8 <= five < 0.9 and three < 0.9 for five, three in shares) >= 3 and any(five < 0.8 for five, _ in shares)
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    got = {r.doc_id for r in p.one_of_each_group(spark, df, DATA).collect()}
    assert got == {i for i, (_, c) in _brute(docs, 5, 80, 100).items() if c == i}


def test_pipeline_near_duplicates_of_sample_data(spark):
    import corpus_pipeline as p

    docs = store.table(spark, DATA, "documents")
    want = {i for i, (_, c) in _brute([(r.doc_id, r.text) for r in docs.collect()], 5, 80, 100).items() if c == i}
    assert {r.doc_id for r in p.one_of_each_group(spark, docs, DATA).collect()} == want
