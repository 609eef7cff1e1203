"""Fill-in-middle cuts against a plain tokeniser."""

import hashlib
import random
import re

import pytest

from cityloom.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    """n, form, prefix_chars, middle_chars, output."""
    text = text or ""
    units = TOKEN.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def _texts(rng):
    alphabet = ["a", "bc", " ", "  ", "\n", "\t", "ü", "😀", "x\x0b", "\r\n", "<", "P>", " ", "\x1c", "$1"]
    out = [None, "", " ", "\n\n", "word", " word ", "<P> held", "a <S", "😀 😀😀 ", "x" * 50 + " " * 50]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_equals_a_plain_tokeniser(spark, chunk):
    rows = [(i, t, i) for i, t in enumerate(_texts(random.Random(chunk)))] + [(None, "no id at all", 0), (None, "no id at all", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_a int").withColumnRenamed("row_a", "n")  # extra columns may clash
    out = infill.transformed(docs, chunk=chunk)
    got = out.select("*", infill.restored().alias("back")).collect()
    want = sorted((str((d, *plain(d, t), t or "")) for d, t, _ in rows))
    assert sorted(str((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back)) for r in got) == want


def test_long_text_and_empty_table(spark):
    rng = random.Random(3)
    text = "".join(rng.choice(["word", " ", "\n", "ü"]) for _ in range(300_000)) + "z" * 200_000
    rows = [(d, text) for d in range(12)]
    got = {r.doc_id: r for r in infill.infill_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        n, form, a, b, out = plain(d, t)
        assert got[d][1:5] == (n, form, a, b)
        assert got[d].output_sha256 == hashlib.sha256(out.encode()).hexdigest() and got[d].restored_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert infill.infill_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
