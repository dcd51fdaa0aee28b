r"""Chat logs to training text: fold events into final messages, render, and read back.

The template of a turn is `### role: text</turn>` and a line feed. Inside roles and texts `\`,
`#` and `</` are written `\\`, `\#` and `<\/` (in roles also `:` as `\:`), so the marks of the
template never occur there, and dropping each backslash before its character gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import shuffle_partitions

OPEN, END = "### ", "</turn>\n"
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*?)</turn>\n", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
LEARNED = ("assistant",)

CONVERSATION = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint"
)


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of event-sourced conversations: conv_id, position, role, text.

    Events have conv_id, seq, message_id, kind, role, text. `message` opens a message with its
    role and text, `delta` appends streamed text, `edit` replaces all text so far, `regenerate`
    starts it anew (deltas follow). Later events count from the last opening, edit or
    regeneration on. A message stands where its first event stands; its role is the first one
    given. Null text and role are empty, a null kind is a delta. Rows that are equal in all of these
    columns are one event that was delivered again. Of openings, edits and regenerations of one `seq`
    that with the greatest text counts, and deltas of that `seq` follow it; deltas of equal `seq` append
    in the order of their texts, and ties in `position` are broken by role and text. Other columns are
    not read. Events without a `seq` come first.

    The only shuffle is by (conv_id, message_id): a hot conversation spreads over its messages.
    """
    message = ["conv_id", "message_id"]
    ordered = F.coalesce("seq", F.lit(-(1 << 62)))  # events without a seq come first
    starts = F.coalesce(F.col("kind").isin("message", "edit", "regenerate"), F.lit(False))
    live = events.select(
        *message, "seq", "role", F.coalesce("text", F.lit("")).alias("text"), starts.alias("starts"), "kind", F.col("role").alias("given")
    )
    over = Window.partitionBy(*message)
    live = live.withColumns({
        "reset": F.max(F.when(F.col("starts"), F.col("seq"))).over(over),
        "position": F.min("seq").over(over),
        "role": F.min_by("role", F.when(F.col("role").isNotNull(), F.struct(ordered, "role"))).over(over),
    })
    told = F.struct(ordered.alias("seq"), (~F.col("starts")).alias("later"), "text", "kind", "given")
    parts = F.array_sort(F.collect_set(told))
    n_starts = F.size(F.filter("parts", lambda p: ~p["later"]))
    text = F.transform(F.slice("parts", F.greatest(n_starts, F.lit(1)), F.size("parts")), lambda p: p["text"])
    return (
        live.filter("reset is null or seq >= reset")
        .groupBy(*message).agg(
            F.min("position").alias("position"), F.coalesce(F.min("role"), F.lit("")).alias("role"), parts.alias("parts"),
        )
        .select("conv_id", "position", "role", F.array_join(text, "").alias("text"))
    )


def escape(text: Column) -> Column:
    for raw, written in (("\\", "\\\\"), ("#", "\\#"), ("</", "<\\/")):
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(messages: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """One rendered turn per message: conv_id, position, segment, loss_from, loss_to.

    The formatted conversation is its segments in the order of position, joined by nothing. The
    characters from loss_from to loss_to of a segment are under the loss mask (nulls: none).
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), F.replace(escape(role), F.lit(":"), F.lit("\\:")), F.lit(": "))
    body, is_learned = escape(text), role.isin(*learned)
    return messages.select(
        "conv_id", "position", F.concat(head, body, F.lit(END)).alias("segment"),
        F.when(is_learned, F.length(head)).alias("loss_from"),
        F.when(is_learned, F.length(head) + F.length(body)).alias("loss_to"),
    )


class _Reader:
    """Digests of one conversation, from its output read piece by piece."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.rest = conv_id, ""
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def read(self, piece: str, loss_from: int | None, loss_to: int | None) -> None:
        self.chars += len(piece)
        if loss_from is not None:
            learned = unescape(piece[loss_from:loss_to])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())
        self.rest += piece
        used = 0
        for turn in TURN.finditer(self.rest):
            if turn.start() != used:
                raise ValueError(f"conversation {self.conv_id} holds text between turns")
            self.turns.update(f"{unescape(turn[1])}\n{unescape(turn[2])}\n".encode())
            self.n_turns, used = self.n_turns + 1, turn.end()
        self.rest = self.rest[used:]

    def row(self) -> tuple:
        if self.rest:
            raise ValueError(f"conversation {self.conv_id} ends within a turn")
        return (
            self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars,
            self.loss.hexdigest(), self.chars,
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in CONVERSATION.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    reader, rows = None, []
    for batch in batches:
        for conv_id, segment, loss_from, loss_to in zip(*(c.to_pylist() for c in batch.columns)):
            if reader is None or reader.conv_id != conv_id:
                if reader is not None:
                    rows.append(reader.row())
                reader = _Reader(conv_id)
            reader.read(segment, loss_from, loss_to)
        if len(rows) > 1000:
            yield out(rows)
            rows = []
    if reader is not None:
        yield out([*rows, reader.row()])


def read_back(segments: DataFrame) -> DataFrame:
    """One row per conversation, parsed from its rendered output.

    A digest of a whole conversation needs its turns in order, so its rows stream through one
    task; that holds one turn at a time, and Spark's sort spills.
    """
    return (
        segments.repartition(shuffle_partitions(segments.sparkSession), "conv_id")
        .sortWithinPartitions("conv_id", "position", "segment")
        .select("conv_id", "segment", "loss_from", "loss_to")
        .mapInArrow(_digests, CONVERSATION)
    )
