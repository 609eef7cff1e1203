"""Fill-in-middle transformation: texts cut at two token ranks and put in another order.

A text is cut into overlapping chunks of CHUNK code points (each sees one more, the next
chunk's first).  A token ends between two adjacent characters of which the left is no
white space and the right is; a chunk counts the pairs whose left character is its own.
Sums of the counts of the chunks before tell which chunk owns a cut's rank, and only the
owning chunks are scanned again, for the cut's place.  Texts of one chunk are counted in
place; the chunks of longer ones are dealt to tasks by (row, chunk), and only counts
and cut places go back to the text.  Everything is made of DataFrame functions.

Null texts count as empty; an empty text has no tokens and stays plain; a null doc_id
draws as an empty one.  Rows with equal doc_id and text get equal results, one each.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityloom.llm.store import row_keys

#: Code points of a chunk.
CHUNK = 1 << 16
_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"
_PAIR = f"{_WORD}(?={_SPACE})"
_BETWEEN = f"(?<={_WORD})(?={_SPACE})"
_KEY = ["row_a", "row_b"]


def _draw(i: int) -> Column:
    return F.conv(F.substring("_hex", 8 * i + 1, 8), 16, 10).cast("long")


def _ranks(df: DataFrame) -> DataFrame:
    """low and high, the tokens before either cut, from n and the row's hash."""
    one, two = (F.pmod(_draw(i), F.col("n") + 1) for i in (0, 1))
    return df.withColumn("low", F.least(one, two)).withColumn("high", F.greatest(one, two))


def _pairs(piece: str) -> Column:
    return F.regexp_count(F.col(piece), F.lit(_PAIR)).cast("long")


def _place(piece: str, rank: str) -> Column:
    """Code points of piece up to the end of its rank-th token (rank at least 1)."""
    return F.length(F.array_join(F.slice(F.split(F.col(piece), _BETWEEN), F.lit(1), F.col(rank).cast("int")), ""))


def _cut(rank: str, place: Column) -> Column:
    return F.when(F.col(rank) == 0, 0).when(F.col(rank) >= F.col("n"), F.length("text")).otherwise(place).cast("long")


def _short(df: DataFrame) -> DataFrame:
    """n and both cuts of texts of one chunk."""
    df = _ranks(df.withColumn("n", F.when(F.length("text") == 0, 0).otherwise(_pairs("text") + 1)))
    return df.withColumn("from", _cut("low", _place("text", "low"))).withColumn("to", _cut("high", _place("text", "high")))


def _long(df: DataFrame, chunk: int) -> DataFrame:
    """n and both cuts of texts of several chunks, whose chunks are counted in tasks of their own."""
    df = df.select("*", *row_keys("doc_id", "text"))
    piece = F.transform(F.sequence(F.lit(0), ((F.length("text") - 1) / chunk).cast("int")), lambda i: F.substring(F.col("text"), i * chunk + 1, F.lit(chunk + 1)))
    pieces = df.select(*_KEY, "_hex", F.posexplode(piece).alias("i", "piece")).dropDuplicates([*_KEY, "i"])
    before = Window.partitionBy(*_KEY).orderBy("i")
    counts = pieces.select(*_KEY, "_hex", "i", _pairs("piece").alias("own"))
    counts = counts.withColumn("seen", F.sum("own").over(before) - F.col("own")).withColumn("n", F.sum("own").over(Window.partitionBy(*_KEY)) + 1)
    # Each of the two ranks goes to the chunk that holds its pair.
    owner = F.array(*(F.struct(F.lit(k).alias("end"), (F.col(k) - F.col("seen")).alias("rank")) for k in ("low", "high")))
    routed = _ranks(counts).withColumn("cut", F.explode(F.filter(owner, lambda c: (c["rank"] > 0) & (c["rank"] <= F.col("own"))))).select(*_KEY, "i", "cut.*")
    found = routed.join(pieces.drop("_hex"), [*_KEY, "i"]).select(*_KEY, "end", (F.col("i") * chunk + _place("piece", "rank")).alias("place"))
    totals = counts.groupBy(*_KEY).agg(F.max("n").alias("n"))
    ends = found.groupBy(*_KEY).agg(*(F.max(F.when(F.col("end") == k, F.col("place"))).alias(f"_{k}") for k in ("low", "high")))
    out = _ranks(df.join(totals, _KEY).join(ends, _KEY, "left"))
    return out.withColumn("from", _cut("low", F.col("_low"))).withColumn("to", _cut("high", F.col("_high"))).drop(*_KEY, "_low", "_high")


def cut(documents: DataFrame, seed: int = 42, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text (null: empty), n tokens, and the code points before either cut, from and to."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_hex", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256))
    return _short(rows.where(F.length("text") <= chunk)).unionByName(_long(rows.where(F.length("text") > chunk), chunk))


def transformed(documents: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars and output.

    rate of 100 texts are put in another order, spm of 100 of those with the suffix
    first.  Texts that hold a control string stay plain.
    """
    text = F.col("text")
    holds = [text.contains(mark) for mark in ("<P>", "<S>", "<M>")]
    form = (
        F.when((text == "") | holds[0] | holds[1] | holds[2] | (F.pmod(_draw(2), F.lit(100)) >= rate), "plain")
        .when(F.pmod(_draw(3), F.lit(100)) < spm, "spm")
        .otherwise("psm")
    )
    df = cut(documents, seed, chunk).withColumn("form", form)
    prefix, middle, suffix = F.substring(text, F.lit(1), F.col("from").cast("int")), F.substring(text, (F.col("from") + 1).cast("int"), (F.col("to") - F.col("from")).cast("int")), F.substring(text, (F.col("to") + 1).cast("int"), F.length("text"))
    mark = {m: F.lit(f"<{m}>") for m in "PSM"}
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(mark["P"], prefix, mark["S"], suffix, mark["M"], middle)).otherwise(F.concat(mark["S"], suffix, mark["P"], prefix, mark["M"], middle))
    shown = F.col("form") != "plain"
    return df.select("doc_id", "n", "form", F.when(shown, F.col("from")).alias("prefix_chars"), F.when(shown, F.col("to") - F.col("from")).alias("middle_chars"), output.alias("output"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text, from an output and its form alone."""
    body = F.col(output)
    first = F.when(F.col(form) == "psm", "<S>").otherwise("<P>")
    at, last = (F.call_function("locate", mark, body) for mark in (first, F.lit("<M>")))
    one, two, middle = F.substring(body, F.lit(4), at - 4), F.substring(body, at + 3, last - at - 3), F.substring(body, last + 3, F.length(body))
    return F.when(F.col(form) == "plain", body).when(F.col(form) == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def infill_report(documents: DataFrame) -> DataFrame:
    """Cuts and digests of every document's output and of the text rebuilt from it."""
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    out = transformed(documents)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
d AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
         CAST('0x' || hex[1:8] AS BIGINT) AS h1, CAST('0x' || hex[9:16] AS BIGINT) AS h2,
         CAST('0x' || hex[17:24] AS BIGINT) AS h3, CAST('0x' || hex[25:32] AS BIGINT) AS h4 FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT doc_id, n, form, text, array_to_string(units[1:low], '') AS a, array_to_string(units[low + 1:high], '') AS b,
         array_to_string(units[high + 1:n], '') AS s FROM c)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || b
              ELSE '<S>' || s || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
