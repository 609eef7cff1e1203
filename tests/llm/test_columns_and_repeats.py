"""Extra columns with the operators' own names, and repeated rows, at the smallest scale."""

import os

import pytest
from pyspark.sql import functions as F

from cityloom.llm import chat, decontam, infill, jaccard, lines, media, mixing, resampling, suffixes, tokens, toxicity, warc, whitening
from cityloom.llm.store import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

NAMES = ["row_a", "row_b", "_row_a", "_row_b", "_maybe", "_id", "gone", "held", "key", "n", "pid", "bucket", "kind", "_score", "score", "slot", "data", "media", "_hex", "low", "high", "cut", "x", "at", "seq", "msg", "digest", "place", "component", "node", "count", "_salt", "_hot"]

OPERATORS = {
    "toxicity": ("documents", "labels", toxicity.scored_documents),
    "chat": ("conversations", None, chat.formatted_conversations),
    "resampling": ("documents", "labels", resampling.resampled),
    "lines": ("documents", None, lines.line_report),
    "warc": ("pages", None, warc.page_archives),
    "decontam": ("documents", "benchmark", decontam.contaminated),
    "mixing": ("documents", "labels", mixing.mixture),
    "tokens": ("documents", None, tokens.materialised),
    "media": ("documents", None, media.document_media),
    "jaccard": ("documents", None, jaccard.component_report),
    "suffixes": ("documents", None, suffixes.suffix_report),
    "infill": ("documents", None, infill.infill_report),
    "whitening": ("embeddings", None, whitening.whitening_report),
}


def _result(spark, name, change):
    main, other, f = OPERATORS[name]
    args = [change(table(spark, DATA, main))] + ([table(spark, DATA, other)] if other else [])
    return f(*args)


def _rows(df):
    shown = [F.round(c, 9).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes]
    return sorted(map(str, df.select(*shown).collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(spark, name):
    plain = _rows(_result(spark, name, lambda df: df))
    more = _rows(_result(spark, name, lambda df: df.withColumns({n: F.lit("clash") for n in NAMES if n not in df.columns})))
    assert plain and more == plain


def test_repeated_rows_stay_and_are_treated_alike(spark):
    """Every row three times: as many rows out, and equal ones equal."""
    thrice = lambda df: df.union(df).union(df)
    for name, key in (("toxicity", "doc_id"), ("media", "doc_id"), ("infill", "doc_id"), ("suffixes", "doc_id"), ("lines", "doc_id")):
        once, more = _result(spark, name, lambda df: df), _result(spark, name, thrice)
        counts = {r[key]: (r["n"], r["kinds"]) for r in more.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*more.columns)).alias("kinds")).collect()}
        assert set(counts.values()) == {(3, 1)} and len(counts) == once.count(), name
    texts = table(spark, DATA, "documents")
    once, more = tokens.materialised(texts).count(), tokens.materialised(thrice(texts)).count()
    assert 3 * once - 20 <= more <= 3 * once + 20  # sequences, but for the last of each task
