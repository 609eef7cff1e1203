"""Mixing says which domains miss their targets."""

import warnings

import pytest

from cityloom.llm import mixing


def _tables(spark):
    texts = {"en": "the house and the tree of a man", "de": "das haus und der baum von einem mann"}
    rows = [(i, f"{texts['en' if i % 2 else 'de']} {i}", "en" if i % 2 else "de") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(i, 1, 0) for i in range(0, 80)], "doc_id long, quality int, toxic int")


def test_a_target_below_what_must_stay_is_named(spark):
    docs, labels = _tables(spark)
    with pytest.warns(UserWarning, match="'de'"):
        _, _, report = mixing.rated(docs, labels, weights={"en": 0.95, "de": 0.05}, total=700.0, least=1.0)
    assert "de" in report["missed"] and report["fitted"]["de"] > 1.01 * report["target"]["de"]


def test_met_targets_are_silent(spark):
    docs, labels = _tables(spark)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        _, _, report = mixing.rated(docs, labels, weights={"en": 0.7, "de": 0.3})
    assert report["missed"] == [] and set(report["target"]) == {"en", "de"}
