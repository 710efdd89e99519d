"""Chat formatting from event logs.

A log is a table of events (conv_id, seq, kind, message, role, text). It is partitioned by conversation and sorted by
sequence, and each conversation is folded into its final messages as its events stream by:

* `begin` opens a message with a role, and a text if there is one;
* `delta` appends to a message;
* `edit` replaces a message's text; what follows stays;
* `regenerate` removes the message and all later ones, as their context is gone.

Messages are rendered with a mark before each turn and one after. In roles and texts, < and [ are followed by the escape, and
the escape itself is doubled: a mark or control string that begins with one of them (<|turn|>, </s>, [INST]) is broken up
(<\\|turn|>, <\\/s>, [\\INST]), so no text can hold one, and the reader gets the same text back.

Defined cases: null text is empty; a null role is `unknown`; events of equal sequence are taken in order of message, kind, role and
text; events for messages that never began open them with the event's role; rows that repeat are turns each; a null conv_id
is a conversation of its own; an empty table gives no rows; further columns are not looked at; a very long text streams
through as its deltas, and only its conversation's messages are held, as they are one value of the result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN, SPLIT, CLOSE, ESCAPE = "<|turn|>", "<|text|>", "<|end|>", "\\"
_SPECIAL, _ESCAPED = re.compile(r"[<\[\\]"), re.compile(r"([<\[\\])\\")
#: Roles whose texts the loss counts.
LEARNED = ("assistant",)
CONTROL = -7


def escaped(text: str) -> str:
    """The text without any mark or control string: the escape stands behind each character that could begin one."""
    return _SPECIAL.sub(lambda m: m[0] + ESCAPE, text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans in it that the loss counts."""
    out, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"{OPEN}{escaped(role)}{SPLIT}", escaped(text)
        if role in LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation. Marks can't occur in what is escaped, so they are looked for as they are."""
    turns, at = [], 0
    while at < len(formatted):
        split = formatted.find(SPLIT, at)
        close = formatted.find(CLOSE, split)
        if not formatted.startswith(OPEN, at) or split < 0 or close < 0:
            raise ValueError(f"no turn begins at {at}")
        turns.append((unescaped(formatted[at + len(OPEN) : split]), unescaped(formatted[split + len(SPLIT) : close])))
        at = close + len(CLOSE)
    return turns


class Fold:
    """The messages of one conversation, from its events in order."""

    def __init__(self) -> None:
        self.messages: dict[int, tuple[str, list[str]]] = {}

    def take(self, kind: str, message: int, role: str | None, text: str | None) -> None:
        if kind == "regenerate":
            keys = list(self.messages)
            for k in keys[keys.index(message) :] if message in self.messages else []:
                del self.messages[k]
            return
        if message not in self.messages:
            self.messages[message] = (role or "unknown", [])
        if kind == "edit":
            self.messages[message][1].clear()
        self.messages[message][1].append(text or "")

    def final(self) -> list[tuple[str, str]]:
        return [(role, "".join(parts)) for role, parts in self.messages.values()]


_NAMES = ["conv_id", "formatted", "loss_spans"]
_SCHEMA = "conv_id long, formatted string, loss_spans array<struct<begin:long,end:long>>"
_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size, own, fold = 0, None, None

    def out() -> pa.RecordBatch:
        ids, texts, spans = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array([[{"begin": a, "end": b} for a, b in s] for s in spans], _SPANS)], _NAMES)

    def close() -> None:
        nonlocal size
        text, spans = render(fold.final())
        rows.append((own, text, spans))
        size += len(text)

    for batch in batches:
        for conv, kind, message, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "message", "role", "text"))):
            if fold is None or conv != own:
                if fold is not None:
                    close()
                    if size >= 4 << 20:
                        yield out()
                        rows, size = [], 0
                own, fold = conv, Fold()
            fold.take(kind, message, role, text)
    if fold is not None:
        close()
        yield out()


def formatted(events: DataFrame, partitioned: bool = False) -> DataFrame:
    """conv_id, formatted and loss_spans (code points, end exclusive) of each conversation of an event log.

    `partitioned`: each conversation's events already lie in one partition, as after `events_of`.

    A conversation streams through one task, which holds its messages only: the result itself is one value."""
    columns = ("conv_id", "seq", "kind", "message", "role", "text")
    events = events.select(*columns)
    return (events if partitioned else events.repartition("conv_id")).sortWithinPartitions("conv_id", "seq", "message", "kind", "role", "text").mapInArrow(_folded, _SCHEMA)


#: Deltas that a turn's text streams as, and characters of what is said at first and taken back.
DELTAS, DRAFT = 3, 24


def events_of(turns: DataFrame) -> DataFrame:
    """An event log that a live system may have kept of a table of turns, and that folds to them.

    A turn's text streams as several deltas. An assistant's turn is first answered otherwise and regenerated; another's is
    first a draft, which an edit replaces by the text's beginning. A turn of a null role has no drafts. Turns are numbered
    within their conversation, so rows that repeat a turn are messages of their own."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("message", F.row_number().over(order).cast("long"))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    width = F.floor(F.length("text") / DELTAS).cast("int") + 1
    part = [F.substring("text", width * k + 1, width) for k in range(DELTAS)]
    draft, rest = F.reverse(F.substring("text", F.lit(1), F.lit(DRAFT))), [event("delta", p) for p in part[1:]]
    begin = event("begin", F.lit(""))
    answered = F.array(event("begin", draft), event("delta", F.lit("?")), event("regenerate", F.lit("")), begin, event("delta", part[0]), *rest)
    edited = F.array(begin, event("delta", draft), event("edit", part[0]), *rest)
    plain = F.array(begin, event("delta", part[0]), *rest)
    steps = F.when(F.col("role").isin(*LEARNED), answered).when(F.col("role").isNotNull(), edited).otherwise(plain)
    return numbered.select("conv_id", "message", "role", F.posexplode(steps).alias("at", "e")).select("conv_id", (F.col("message") * 16 + F.col("at")).alias("seq"), "e.kind", "message", "role", "e.text")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for batch in batches:
        rows = []
        for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            turns = parse(text)
            every, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
            for role, said in turns:
                every.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            for s in spans:
                said = unescaped(text[s["begin"] : s["end"]])
                chars += len(said)
                loss.update(said.encode("utf-8", "surrogatepass"))
            rows.append((conv, len(turns), every.hexdigest(), chars, loss.hexdigest(), len(text)))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)


def measured(done: DataFrame) -> DataFrame:
    """What a reader gets back from the formatted conversations and their loss masks."""
    return done.mapInArrow(_measured, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4_event_sourced_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    control = spark.createDataFrame([(CONTROL, 0, "user", said), (CONTROL, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return measured(formatted(events_of(turns.unionByName(control)), partitioned=True))


QUERIES = {"op4_event_sourced_chat": op4_event_sourced_chat}
_LOSS = "string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant')"
_ESC = r"regexp_replace(x, '([<\[\\])', '\\\1', 'g')"
SQL = {
    "op4_event_sourced_chat": rf"""
        WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
               length(coalesce({_LOSS}, '')) AS loss_chars, sha256(coalesce({_LOSS}, '')) AS loss_sha256,
               sum(length({_ESC.replace("(x", "(t")}) + length({_ESC.replace("(x", "(role")}) + {len(OPEN + SPLIT + CLOSE)})::BIGINT AS formatted_chars
        FROM c GROUP BY conv_id"""
}
