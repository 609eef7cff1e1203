r"""WARC: archives written and read as DataFrames, with boundary-chain verification.

Writing: each record is a row; Spark's text writer puts CR LF CR LF behind it, which
is the record terminator, so a part file is a WARC file on whatever file system Spark
writes to, and the commit protocol survives lost executors.  Payloads are not shuffled,
but for those of rows that a bit set takes for revisits.

Reading: files are cut into splits.  A task reports every place in its split where a
record could begin (``WARC/1.`` and header lines with a length that ends in the file)
and where the chain of successors from there leaves the split.  Magic inside payloads
is reported as well, so the true records are those that the chain from offset 0
reaches: pointer jumping over the places where chains enter splits doubles the reach a
round.  Payloads are read, in bounded pieces, only after that.

Headers may have any length.  Null payloads are empty; empty tables write no records;
rows are not merged.  A null page_id is written as ``<urn:page:null>`` and read back as
null; such a row is a revisit where a row with an id has its payload.  Rows that repeat
a page_id and payload are all responses where that id is the smallest, else revisits.
A file that doesn't start with a record, whose chain ends before the file does, or
whose record has no terminator raises ValueError when read.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.llm.store import Workspace, hot_keys, maybe_in, row_keys, spread_join

_END = b"\r\n\r\n"
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_NAME = re.compile(rb"[!#$%&'*+\-.^_`|~0-9A-Za-z]*")
_LENGTH = re.compile(rb"[0-9]{1,18}")
_PIECE = 1 << 20


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _digest_column(data: F.Column) -> F.Column:
    """Bare upper-case base32 of the SHA-1: five hex digits give four base32 ones."""
    digits, letters = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = [F.lpad(F.conv(F.substring(F.sha1(data), 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), digits, letters)


def with_digests(pages: DataFrame, work: Workspace, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html (null for revisits), payload_bytes, payload_digest, refers_to.

    Of equal payloads of at least least_bytes bytes, all but those with the smallest
    page_id refer to it.  Keys decide that; only rows that may be revisits are shuffled.
    """
    data = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    full = pages.select("page_id", "url", "html", F.octet_length(data).cast("long").alias("payload_bytes"), _digest_column(data).alias("payload_digest"))
    full = full.select("*", *row_keys("page_id", "payload_digest"))
    keys = work.written(full.select("page_id", "payload_bytes", "payload_digest", "row_a", "row_b"), "warc-keys")
    first = (
        keys.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 AND first_id IS NOT NULL").select("payload_digest", "first_id")
    )
    held = spread_join(keys, work.written(first, "warc-firsts"), ["payload_digest"], hot_keys(keys, ["payload_digest"]))
    again = work.written(held.where("page_id IS NULL OR page_id > first_id").select("row_a", "row_b", F.col("first_id").alias("refers_to")).distinct(), "warc-again")
    some, rest = maybe_in(full, "row_a", again.select("row_a"), work)
    joined = some.join(again, ["row_a", "row_b"], "left").withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))
    names = ["page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to"]
    joined = joined.select(*names)
    return joined if rest is None else joined.union(rest.withColumn("refers_to", F.lit(None).cast(dict(again.dtypes)["refers_to"])).select(*names))


def record_uri(page_id: str) -> F.Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("null")), F.lit(">"))


def record_text(pages: DataFrame) -> DataFrame:
    """One string a record, without its terminator."""
    revisit = F.col("refers_to").isNotNull()
    crlf = "\r\n"
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    body = F.when(revisit, "").otherwise(F.coalesce("html", F.lit("")))
    head = F.concat(
        F.lit(f"WARC/1.0{crlf}WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{crlf}WARC-Record-ID: "),
        record_uri("page_id"),
        F.lit(f"{crlf}WARC-Date: 1970-01-01T00:00:00Z{crlf}WARC-Target-URI: "),
        url,
        F.lit(f"{crlf}WARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"{crlf}WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest{crlf}WARC-Refers-To: "), record_uri("refers_to"))).otherwise(""),
        F.lit(f"{crlf}Content-Type: text/html{crlf}Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(f"{crlf}{crlf}"),
        body,
    )
    return pages.select(head.alias("value"))


def write_archives(pages: DataFrame, path: str, records_per_file: int = 100_000) -> None:
    """WARC files of all rows of with_digests() under path."""
    (
        record_text(pages)
        .write.option("lineSep", "\r\n\r\n")
        .option("maxRecordsPerFile", records_per_file)
        .mode("overwrite")
        .text(path)
    )


def _open(path: str):
    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    store, name = pafs.FileSystem.from_uri(path)
    return store.open_input_file(name)


class _Window:
    """Bytes of a file from lo on, read as far as they are asked for."""

    def __init__(self, file, size: int, lo: int, hi: int):
        self.file, self.size, self.lo = file, size, lo
        self.data = bytearray(file.read_at(min(hi, size) - lo, lo))

    def more(self) -> bool:
        at = self.lo + len(self.data)
        piece = self.file.read_at(min(1 << 16, self.size - at), at) if at < self.size else b""
        self.data += piece
        return bool(piece)

    def header(self, at: int) -> tuple[dict[str, str], int, int] | None:
        """Fields, start and length of the payload of a record that may begin at the file's
        offset at; None if none can.  A line that is no field ends the search."""
        at -= self.lo
        while len(self.data) < at + 10 and self.more():
            pass
        if not _MAGIC.match(self.data, at):
            return None
        at, fields, name = at + 10, {}, None
        while True:
            while (stop := self.data.find(b"\r\n", at)) < 0:
                named = _NAME.match(self.data, at).end()
                known = named < len(self.data) and self.data[at:] != b"\r" and self.data[at] not in b" \t"
                if known and self.data[named] != 58:  # a colon
                    return None
                if not self.more():
                    return None
            if stop == at:
                break
            line = bytes(self.data[at:stop])
            if line[:1] in (b" ", b"\t") and name:
                fields[name] += b" " + line.strip()
            else:
                named = _NAME.match(line).end()
                if not named or line[named : named + 1] != b":":
                    return None
                name = line[:named].lower().decode()
                fields[name] = line[named + 1 :].strip()
            at = stop + 2
        length = fields.get("content-length", b"")
        start = self.lo + at + 2
        if "warc-type" not in fields or not _LENGTH.fullmatch(length) or start + int(length) + 4 > self.size:
            return None
        return {k: v.decode("utf-8", "replace") for k, v in fields.items()}, start, int(length)


def candidates(file, size: int, lo: int, hi: int):
    """(offset, successor) of the places from lo to hi where a record may begin."""
    window = _Window(file, size, lo, hi + 9)
    for found in list(_MAGIC.finditer(bytes(window.data))):
        offset = lo + found.start()
        if offset < hi and (head := window.header(offset)):
            yield offset, head[1] + head[2] + 4


def _scan(batches):
    """path, offset, exit: where the chain from each candidate of a split leaves it."""
    for batch in batches:
        for path, lo, hi, size in zip(*(batch.column(i).to_pylist() for i in range(4))):
            with _open(path) as file:
                found = list(candidates(file, size, lo, hi))
            out: dict[int, int] = {}
            for offset, successor in reversed(found):  # successors are larger, so they are known already
                out[offset] = out.get(successor, successor)
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(out), pa.string()), pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.int64())], ["path", "offset", "exit"])


def splits(spark: SparkSession, path: str, split_bytes: int) -> DataFrame:
    """path, split, lo, hi, size of all files; contents are not read here."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size")).where("size > 0")
    n = F.ceil(F.col("size") / split_bytes).cast("long")
    parts = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("split"))
    return parts.select(
        "path", "split", (F.col("split") * split_bytes).alias("lo"), F.least("size", (F.col("split") + 1) * split_bytes).alias("hi"), "size"
    )


def _entries(places: DataFrame, work: Workspace) -> DataFrame:
    """path, offset, exit of the places that the chain from offset 0 reaches.

    Of all candidates only file starts and places that another split's chain leaves for
    can be reached; pointer jumping over these takes as many rounds as the logarithm of
    a file's number of splits.
    """
    targets = places.select("path", F.col("exit").alias("offset")).distinct()
    nodes = work.written(places.join(targets, ["path", "offset"], "left_semi").union(places.where("offset = 0")).distinct(), "warc-nodes")
    jump, old = nodes, None
    reached = work.written(nodes.where("offset = 0").select("path", "offset"), "warc-reached")
    n = reached.count()
    while True:
        on = reached.join(jump, ["path", "offset"]).select("path", F.col("exit").alias("offset"))
        grown = work.written(reached.union(on.join(nodes.select("path", "offset"), ["path", "offset"], "left_semi")).distinct(), "warc-reached")
        work.drop(reached)
        reached, last, n = grown, n, grown.count()
        if n == last:
            return reached.join(nodes, ["path", "offset"])
        far = jump.select("path", F.col("offset").alias("exit"), F.col("exit").alias("far"))
        jump = work.written(jump.join(far, ["path", "exit"], "left").select("path", "offset", F.coalesce("far", "exit").alias("exit")), "warc-jump")
        if old is not None:
            work.drop(old)
        old = jump


_FIELDS = "path string, offset long, successor long, record_type string, record_id string, refers_to string, digest string, payload_bytes long, payload_digest string"


def _walk(batches):
    """The records of splits from where the chain enters them."""
    names = [x.split()[0] for x in _FIELDS.split(", ")]
    kinds = [pa.string() if " string" in x else pa.int64() for x in _FIELDS.split(", ")]
    for batch in batches:
        for path, offset, hi, size in zip(*(batch.column(i).to_pylist() for i in range(4))):
            rows = []
            with _open(path) as file:
                while offset < hi:
                    fields, start, length = _Window(file, size, offset, offset + 2048).header(offset)
                    sha = hashlib.sha1()
                    for at in range(start, start + length, _PIECE):
                        sha.update(file.read_at(min(_PIECE, start + length - at), at))
                    if file.read_at(4, start + length) != _END:
                        raise ValueError(f"the record at {offset} of {path} doesn't end where it says")
                    successor = start + length + 4
                    rows.append([path, offset, successor, fields["warc-type"], *(fields.get(x) for x in ("warc-record-id", "warc-refers-to", "warc-payload-digest")), length, base64.b32encode(sha.digest()).decode()])
                    offset = successor
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names)


def read_archives(spark: SparkSession, path: str, work: Workspace, split_bytes: int = 16 << 20) -> DataFrame:
    """The records of all archives under path: path, offset, successor, type, ids, payload digest."""
    parts = work.written(splits(spark, path, split_bytes), "warc-splits")
    n = max(1, min(100_000, parts.count()))
    dealt = parts.repartition(n, "path", "split")
    places = work.written(dealt.select("path", "lo", "hi", "size").mapInArrow(_scan, "path string, offset long, exit long"), "warc-places")
    entries = work.written(_entries(places, work), "warc-entries")
    files = parts.where("lo = 0").select("path", "size")
    ends = entries.groupBy("path").agg(F.max("exit").alias("last"))
    bad = files.join(ends, "path", "left").where("last IS NULL OR last <> size").limit(1).collect()
    if bad:
        raise ValueError(f"the records of {bad[0]['path']} don't fill the file")
    inside = F.floor(F.col("offset") / split_bytes).cast("long")
    begin = entries.select("path", inside.alias("split"), "offset").join(parts, ["path", "split"])
    return begin.repartition(n, "path", "split").select("path", "offset", "hi", "size").mapInArrow(_walk, _FIELDS)


def page_records(spark: SparkSession, path: str, work: Workspace) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, all read from archives.

    A revisit's size is that of the response it refers to, whose digest must be its own.
    """
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'urn:page:(-?[0-9]+)', 1) AS BIGINT)")
    records = read_archives(spark, path, work).select(
        page("record_id").alias("page_id"), "record_type", page("refers_to").alias("refers_to"), F.regexp_replace("digest", "^sha1:", "").alias("digest"), "payload_bytes", "payload_digest"
    )
    records = work.written(records, "warc-pages")
    plain = records.where("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")
    )
    again = records.where("record_type = 'revisit'").select("page_id", "refers_to", F.col("digest").alias("payload_digest"), "record_type")
    target = plain.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").dropDuplicates(["refers_to", "payload_digest"])
    key = ["refers_to", "payload_digest"]
    seen = spread_join(again, target, key, hot_keys(again, key), "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return plain.union(seen)


def page_archives(pages: DataFrame) -> DataFrame:
    """Writes all pages as archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    write, read = Workspace(spark), Workspace(spark)
    path = read.path("warc")
    write_archives(with_digests(pages, write), path)
    write.close()
    return page_records(spark, path, read)


ORACLE = """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM sized)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM firsts
"""
