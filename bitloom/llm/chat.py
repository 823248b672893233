"""Operator 6, chat formatting: conversations rebuilt from an event log, rendered with a template, and read back.

An event log has rows (conv_id, seq, kind, turn, role, text). Kinds: `start` opens a message at a turn (a second start
of a turn is a regeneration and throws the earlier draft away), `delta` appends streamed text, `edit` replaces the text
so far, `drop` removes the message. The log is partitioned by conversation and sorted by seq; a fold streams over it,
so a conversation costs memory for its own final messages only and no group is gathered by Spark.

The template marks a turn as <|role|>, newline, text, <|end|>, newline. In a text a control string's mark `<|` is
written `<\\|`, and a backslash after `<` or in a run that `<` opens is doubled by one more, which `unescape` takes back.
Edge cases: a null text is empty; a null role is the empty role; rows that repeat a turn are turns of their own, in the
order of role and text; a null turn comes first; rows without a conv_id are one conversation; an empty table gives the fixed conversation alone; extra columns go.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

END, PIECE = "<|end|>\n", 700
FIXED, FIXED_TEXT = -7, "</s>[INST] ok [/INST]"
_HIDE, _SHOW = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|((?:[^|\\]|\\[\s\S])*)\|>\n([\s\S]*?)<\|end\|>\n")


def escape(text: str) -> str:
    """No `<|` is left; the inverse is `unescape`."""
    return _HIDE.sub(lambda m: "<\\" + m[1] + "|", text)


def unescape(text: str) -> str:
    return _SHOW.sub(lambda m: "<" + m[1] + "|", text)


def _role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("|", "\\|")


def render(messages: Iterable[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of it under the loss mask (the texts of `learn`)."""
    parts, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"<|{_role(role)}|>\n", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(re.sub(r"\\([\s\S])", r"\1", m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


Drafts = dict[int | None, tuple[str, list[str]]]


def apply(drafts: Drafts, kind: str, turn: int | None, role: str | None, text: str | None) -> None:
    """One event; a draft that is thrown away or edited over is held no longer."""
    if kind == "start":
        drafts.pop(turn, None)
        drafts[turn] = (role or "", [text or ""])
    elif kind == "drop":
        drafts.pop(turn, None)
    elif turn in drafts and kind == "delta":
        drafts[turn][1].append(text or "")
    elif turn in drafts and kind == "edit":
        drafts[turn][1][:] = [text or ""]


def final(drafts: Drafts) -> list[tuple[str, str]]:
    return [(role, "".join(parts)) for _, (role, parts) in sorted(drafts.items(), key=lambda x: (x[0] is not None, x[0]))]


def fold(events: Iterable[tuple[str, int | None, str | None, str | None]]) -> list[tuple[str, str]]:
    """Final messages of one conversation from its events (kind, turn, role, text) in order."""
    drafts: Drafts = {}
    for event in events:
        apply(drafts, *event)
    return final(drafts)


SCHEMA = "conv_id bigint, formatted string, spans array<struct<start:bigint,end:bigint>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def reconstruct(log: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, spans) of every conversation in an event log."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(done: list) -> pa.RecordBatch:
            ids, texts, spans = zip(*done)
            rows = [[{"start": a, "end": b} for a, b in s] for s in spans]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(rows, SPANS)], names=["conv_id", "formatted", "spans"])

        own, drafts, done, size, open_ = None, {}, [], 0, False
        for b in batches:
            for conv, kind, turn, role, text in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "kind", "turn", "role", "text"))):
                if open_ and conv != own:
                    done.append((own, *render(final(drafts), learn)))
                    size, drafts = size + len(done[-1][1]), {}
                    if size > 4 << 20:
                        yield flush(done)
                        done, size = [], 0
                own, open_ = conv, True
                apply(drafts, kind, turn, role, text)
        if open_:
            done.append((own, *render(final(drafts), learn)))
        if done:
            yield flush(done)

    rows = log.select("conv_id", "seq", "kind", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "seq", "kind", "turn", "role", "text")
    return rows.mapInArrow(run, SCHEMA)


def event_log(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """The log of a streaming service for finished turns: an assistant's turn starts with a draft that a regeneration throws away and then streams in deltas; a user's turn is sent empty and edited.

    seq orders a conversation's events; it is made from the turn's rank, so repeated turns stay apart.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select("conv_id", F.row_number().over(w).cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    n = F.ceil(F.length("text") / F.lit(piece)).cast("int")
    deltas = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: event("delta", F.substring("text", i * piece + 1, F.lit(piece))))).otherwise(F.array().cast("array<struct<kind:string,text:string>>"))
    streamed = F.concat(F.array(event("start", F.lit("")), event("delta", F.substring("text", 1, 40)), event("start", F.lit(""))), deltas)
    edited = F.array(event("start", F.lit("")), event("edit", F.col("text")))
    out = rows.select("conv_id", "turn", "role", F.posexplode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)).alias("k", "e"))
    return out.select("conv_id", (F.col("turn") * (1 << 32) + F.col("k")).alias("seq"), F.col("e.kind").alias("kind"), "turn", "role", F.col("e.text").alias("text"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say, parsed again: turns, and the text under the loss mask."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, text, spans in zip(*(c.to_pylist() for c in b.columns)):
                turns, loss, n, count = hashlib.sha256(), hashlib.sha256(), 0, 0
                for role, body in parse(text):
                    turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                    count += 1
                for s in spans:
                    own = unescape(text[s["start"] : s["end"]])
                    loss.update(own.encode("utf-8", "surrogatepass"))
                    n += len(own)
                rows.append((conv, count, turns.hexdigest(), n, loss.hexdigest(), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    fixed = spark.range(2).select(F.lit(FIXED).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(FIXED_TEXT).alias("text"))
    return read_back(reconstruct(event_log(rows.unionByName(fixed))))
