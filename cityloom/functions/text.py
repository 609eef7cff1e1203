"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(text: Column, default: str = "roi") -> Column:
    slug = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(default))


def clean_text(text: Column) -> Column:
    """Without byte-order marks in front and without white space around."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿+", ""), r"^\s+|\s+$", "")


def list_tokens(text: Column, lists: str = ",") -> Column:
    """Items of a value like "['a', 'b']" in lower case; null, blank and nan have none.
    lists: the characters that separate items."""
    whole = F.regexp_replace(F.lower(text), r"^\s+|\s+$", "")
    bare = F.regexp_replace(F.nullif(whole, F.lit("nan")), r"^[\[\]]+|[\[\]]+$", "")
    items = F.transform(F.split(bare, f"[{lists}]"), lambda x: F.regexp_replace(x, r"^[\s\[\]]*['\"]*|['\"]*[\s\[\]]*$", ""))
    return F.coalesce(F.array_remove(items, ""), F.array().cast("array<string>"))


def output_name(order: Column, name: Column) -> Column:
    """Number of at least two digits and slug."""
    number = order.cast("string")
    return F.concat(F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number), F.lit("_"), slugify(name))
