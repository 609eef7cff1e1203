"""Chat formatting: conversations rebuilt from event logs, then rendered.

Event log columns: conv_id, seq, msg, kind, role, text.  Events of a conversation
are taken in order of (seq, msg, kind, role, text), so ties have one result:

* ``delta``       appends text to message msg (which it creates with its role)
* ``edit``        replaces the text of msg, and its role unless null
* ``regenerate``  drops msg and all later messages; later events fill them again

Unknown and null kinds count as deltas.  Null text and role are empty.  Rows with a
null conv_id form one conversation.  Repeated delta rows append twice.  Messages come
out in order of msg, one row each, so neither a long conversation nor a hot one is
ever held in memory: only one message is.  Extra columns are ignored.

Template: ``<|role|>text<|end|>``.  Control strings inside texts get a backslash after
their first character (one more if they have some already), which is undone by
removing one.  In roles ``% |`` and line feeds are percent-encoded.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_CONTROL = re.compile(r"([<\[])(\\*)(\||/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(\||/?s>|/?INST\])")
_END = "<|end|>"
_BATCH = 2000
_TURN_SCHEMA = "conv_id {}, turn long, formatted string, loss_start long, loss_end long, ends boolean"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _role_out(role: str) -> str:
    return role.replace("%", "%25").replace("|", "%7C").replace("\n", "%0A")


def _role_in(role: str) -> str:
    return role.replace("%0A", "\n").replace("%7C", "|").replace("%25", "%")


def turn_events(turns: DataFrame) -> DataFrame:
    """The log of a table of finished turns (conv_id, turn, role, text): a delta each.

    Rows are numbered by (turn, role, text); equal rows stay separate messages.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order).cast("long")
    return turns.select("conv_id", n.alias("seq"), n.alias("msg"), F.lit("delta").alias("kind"), "role", "text")


def _live(events: DataFrame) -> DataFrame:
    """Events that no later regeneration of their own or an earlier message drops."""
    later = (
        Window.partitionBy("conv_id")
        .orderBy(F.desc("seq"), F.desc("msg"), F.desc("kind"), F.desc("role"), F.desc("text"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    cut = F.min(F.when(F.col("kind") == "regenerate", F.col("msg"))).over(later)
    return (
        events.select("conv_id", "seq", "msg", "kind", "role", "text")
        .withColumn("cut", cut)
        .where("(cut IS NULL OR msg IS NULL OR msg < cut) AND (kind IS NULL OR kind <> 'regenerate')")
        .drop("cut")
    )


def _messages(batches):
    """(conv_id, role, text, whether a conversation begins) by message, from sorted events."""
    none = object()
    conv = msg = none
    role, parts = "", []
    fresh = True
    for batch in batches:
        for c, m, kind, r, t in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if c != conv or m != msg:
                if msg is not none:
                    yield conv, role, "".join(parts), fresh
                    fresh = c != conv
                conv, msg, role, parts = c, m, r or "", []
            if kind == "edit":
                parts = []
                role = r if r is not None else role
            parts.append(t or "")
    if msg is not none:
        yield conv, role, "".join(parts), fresh


def rendered(events: DataFrame) -> DataFrame:
    """One row a message: conv_id, turn, formatted, loss_start, loss_end, ends.

    The pieces ``formatted`` of a conversation, joined in order of turn, are its
    text; loss_start and loss_end are the code points of an assistant's text in it.
    The rows of a conversation are in one partition, in order; ``ends`` marks the last.
    """
    kind = dict(events.dtypes)["conv_id"]
    ordered = _live(events).sortWithinPartitions("conv_id", "msg", "seq", "kind", "role", "text")

    def run(batches):
        rows, turn, at, held = [], 0, 0, None
        for conv, role, text, fresh in _messages(batches):
            if fresh:
                turn = at = 0
            if held:
                rows.append((*held, fresh))
            head, body = f"<|{_role_out(role)}|>", escape(text)
            piece = head + body + _END
            span = (at + len(head), at + len(head) + len(body)) if role == "assistant" else (None, None)
            held = (conv, turn, piece, *span)
            turn, at = turn + 1, at + len(piece)
            if len(rows) >= _BATCH:
                yield _batch(rows, out)
                rows = []
        if held:
            rows.append((*held, True))
        if rows:
            yield _batch(rows, out)

    out = [pa.int64() if kind == "bigint" else pa.string() if kind == "string" else pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    return ordered.select("conv_id", "msg", "kind", "role", "text").mapInArrow(run, _TURN_SCHEMA.format(kind))


def _batch(rows: list[tuple], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [str(i) for i in range(len(kinds))])


def parse(piece: str) -> tuple[str, str]:
    """Role and text of a formatted message."""
    if not piece.startswith("<|") or not piece.endswith(_END):
        raise ValueError("not a formatted message")
    role, found, body = piece[2 : -len(_END)].partition("|>")
    if not found or "<|" in body:
        raise ValueError("not a formatted message")
    return _role_in(role), unescape(body)


def read_back(turns: DataFrame) -> DataFrame:
    """Per conversation, digests of what ``rendered`` rows hold, parsed from them alone."""
    kind = dict(turns.dtypes)["conv_id"]
    out = [pa.int64() if kind == "bigint" else pa.string() if kind == "string" else pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        rows = []
        n = loss = at = 0
        whole, masked = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            for conv, piece, start, end, ends in zip(*(batch.column(i).to_pylist() for i in range(5))):
                role, text = parse(piece)
                whole.update(f"{role}\n{text}\n".encode())
                if start is not None:
                    part = unescape(piece[start - at : end - at])
                    masked.update(part.encode())
                    loss += len(part)
                n, at = n + 1, at + len(piece)
                if ends:
                    rows.append((conv, n, whole.hexdigest(), loss, masked.hexdigest(), at))
                    n = loss = at = 0
                    whole, masked = hashlib.sha256(), hashlib.sha256()
                    if len(rows) >= _BATCH:
                        yield _batch(rows, out)
                        rows = []
        if rows:
            yield _batch(rows, out)

    return turns.select("conv_id", "formatted", "loss_start", "loss_end", "ends").mapInArrow(
        run,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose texts are control strings."""
    spark = conversations.sparkSession
    control = spark.sql(
        "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"
    )
    turns = conversations.select("conv_id", "turn", "role", "text").union(control)
    return read_back(rendered(turn_events(turns)))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(length('<|' || replace(replace(replace(role, '%', '%25'), '|', '%7C'), chr(10), '%0A') || '|>'
         || regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') || '<|end|>')) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
