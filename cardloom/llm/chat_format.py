"""Chat formatting with typed content parts.

Each message holds ordered parts: text, image, audio or document.  A visitor flattens them into one string: text is
escaped, every attachment becomes a placeholder that names its kind and its ordinal in the message, and the visitor
records the attachment's reference and how many model tokens the placeholder will expand to.

Template of a turn, control strings in angle brackets::

    <turn ROLE>\\nTEXT</turn>\\n

``<`` inside a role or text is written ``\\l`` and a backslash ``\\\\``, so no text can contain a control string and the
escaping can be undone exactly.  The loss mask covers the text part between header and ``</turn>`` of assistant turns.

Rows are formatted where they are read.  To put conversations together, rows are dealt by ``conv_id`` and sorted by
turn within the partition; a streaming pass hashes or joins them, so one task never holds a conversation in memory,
however many turns it has.

Defined cases: null text is empty text, null role an empty role, null parts no parts; a null ``conv_id`` is a
conversation of its own; rows with equal turn numbers are ordered by role, then text (null turns first); extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<type string, text string, ref string, width int, height int, seconds double, pages int>"
#: Model tokens of a square image tile of TILE pixels a side, a second of audio and a page of a document.
TILE, TILE_TOKENS, IMAGE_TOKENS, SECOND_TOKENS, PAGE_TOKENS = 512, 170, 85, 25, 750
LOSS_ROLE = "assistant"

_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn ([^<>\n]*)>\n([^<]*(?:<(?!/turn>)[^<]*)*)</turn>\n")


def escape(text: str) -> str:
    """Text without any control string."""
    return text.replace("\\", "\\\\").replace("<", "\\l")


def escape_role(role: str) -> str:
    """Role for the header, where ``>`` and a line break would end it."""
    return escape(role).replace(">", "\\g").replace("\n", "\\n")


def unescape(text: str) -> str:
    """Inverse of :func:`escape` and :func:`escape_role`."""
    return _UNESCAPE.sub(lambda m: {"l": "<", "g": ">", "n": "\n"}.get(m[1], m[1]), text)


class PartVisitor:
    """Flattens the parts of one message."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.attachments: list[dict[str, Any]] = []
        self.expanded_tokens = 0

    def visit(self, part: dict[str, Any]) -> None:
        """Dispatches on the part's type; an unknown or null type is text."""
        getattr(self, f"visit_{part.get('type')}", self.visit_text)(part)

    def visit_text(self, part: dict[str, Any]) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict[str, Any]) -> None:
        across, down = (-(-max(part.get(side) or 0, 1) // TILE) for side in ("width", "height"))
        self._attach("image", part, IMAGE_TOKENS + TILE_TOKENS * across * down)

    def visit_audio(self, part: dict[str, Any]) -> None:
        self._attach("audio", part, max(1, round((part.get("seconds") or 0) * SECOND_TOKENS)))

    def visit_document(self, part: dict[str, Any]) -> None:
        self._attach("document", part, PAGE_TOKENS * max(1, part.get("pages") or 0))

    def _attach(self, kind: str, part: dict[str, Any], tokens: int) -> None:
        ordinal = len(self.attachments)
        self.pieces.append(f"<{kind} {ordinal}>")
        self.attachments.append({"ordinal": ordinal, "type": kind, "ref": part.get("ref"), "tokens": tokens})
        self.expanded_tokens += tokens


def format_turn(role: str | None, parts: Iterable[dict[str, Any]] | None) -> tuple[str, int, int, PartVisitor]:
    """The formatted turn, where its loss mask starts and ends (equal if it has none), and the visitor."""
    visitor = PartVisitor()
    for part in parts or ():
        visitor.visit(part or {})
    body = "".join(visitor.pieces)
    head = f"<turn {escape_role(role or '')}>\n"
    start = len(head)
    end = start + len(body) if (role or "") == LOSS_ROLE else start
    return f"{head}{body}</turn>\n", start, end, visitor


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, escaped body) of each turn of a formatted string."""
    at = 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        at = m.end()
        yield unescape(m[1]), m[2]
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")


def text_part() -> Column:
    """A one-part message from a ``text`` column."""
    nothing = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    fields = [F.lit("text").alias("type"), F.coalesce(F.col("text"), F.lit("")).alias("text")]
    return F.array(F.struct(*fields, *(F.lit(None).cast(t).alias(n) for n, t in nothing.items())))


TURNS = (
    "conv_id long, turn long, formatted string, loss_start long, loss_end long, expanded_tokens long, "
    "attachments array<struct<ordinal int, type string, ref string, tokens long>>, tie string, raw string"
)


def format_turns(messages: DataFrame) -> DataFrame:
    """One row per message (``conv_id``, ``turn``, ``role``, ``parts``): its formatted string, loss mask and attachments."""
    attachment = pa.struct([("ordinal", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, parts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            done = [format_turn(r, p) for r, p in zip(roles, parts, strict=True)]
            columns = [
                pa.array([d[0] for d in done], pa.string()),
                pa.array([d[1] for d in done], pa.int64()),
                pa.array([d[2] for d in done], pa.int64()),
                pa.array([d[3].expanded_tokens for d in done], pa.int64()),
                pa.array([d[3].attachments for d in done], pa.list_(attachment)),
                pa.array([r or "" for r in roles], pa.string()),
                pa.array(["".join(unescape(body) for _, body in parse(d[0])) for d in done], pa.string()),
            ]
            names = ["conv_id", "turn", "formatted", "loss_start", "loss_end", "expanded_tokens", "attachments", "tie", "raw"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    rows = messages.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "cast(role as string) role", "parts")
    return rows.mapInArrow(run, TURNS)


def in_order(turns: DataFrame) -> DataFrame:
    """Formatted turns dealt by conversation and sorted by turn within each partition."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "tie", "raw")


def join_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id`` and the whole formatted string, for conversations that fit one row."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "tie", "raw", "formatted")))
    joined = F.array_join(F.transform(ordered, lambda t: t["formatted"]), "")
    return turns.groupBy("conv_id").agg(joined.alias("formatted"), F.sum("expanded_tokens").alias("expanded_tokens"))


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "expanded_tokens long, n_attachments long"
)


class _Reader:
    """Reads one conversation back, turn by turn."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = self.tokens = self.attached = 0

    def read(self, formatted: str, start: int, end: int, tokens: int, attachments: int) -> None:
        for role, body in parse(formatted):
            self.turns.update(f"{role}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
        masked = unescape(formatted[start:end])
        self.loss.update(masked.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(masked)
        self.formatted_chars += len(formatted)
        self.tokens += tokens
        self.attached += attachments

    def row(self) -> dict[str, Any]:
        values = (
            self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(),
            self.formatted_chars, self.tokens, self.attached,
        )
        return dict(zip((c.split()[0] for c in DIGEST.split(", ")), values, strict=True))


def read_back(turns: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted output alone: turns and masked text as digests."""
    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in DIGEST.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: _Reader | None = None
        for batch in batches:
            rows = []
            for conv_id, formatted, start, end, tokens, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if reader is None or reader.conv_id != conv_id:
                    if reader is not None:
                        rows.append(reader.row())
                    reader = _Reader(conv_id)
                reader.read(formatted, start, end, tokens, n)
            yield pa.RecordBatch.from_pylist(rows, schema)
        if reader is not None:
            yield pa.RecordBatch.from_pylist([reader.row()], schema)

    columns = ("conv_id", "formatted", "loss_start", "loss_end", "expanded_tokens")
    slim = in_order(turns).select(*columns, F.size("attachments").cast("long").alias("n_attachments"))
    return slim.mapInArrow(run, DIGEST)
