"""Chat formatting with typed content parts.

The content of a turn is a plain text, or a list of typed parts written as JSON (only where the
caller says so). A visitor flattens the parts in order: text is escaped, an image, audio or document
part becomes a placeholder with its number, and its reference and expanded token count are recorded.

A turn reads ``<|role|>text<|end|>`` with the role in place of ``role``; a placeholder is
``<|image:0|>``. In texts ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``; in roles every backslash, bar, colon and ``<`` gets
a backslash. So neither can write a control string, and ``parse`` gives every text back.

Null roles and texts count as empty. Turns are ordered by turn number (null first), then role, then
text; repeated rows are repeated turns. Rows with a null conversation id form one conversation. An
empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CONTROL = re.compile(r"<\|((?:[^\\<|]|\\.|<(?!\|)|\|(?!>))*)\|>", re.S)
_MEDIA = re.compile(r"(image|audio|document):(\d+)")
LEARNED_ROLES = ("assistant",)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    """A role stands inside a control string, so its bars and angles are escaped as well."""
    return re.sub(r"[\\|:<]", lambda m: "\\" + m[0], role)


class PartVisitor:
    """Flattens the typed parts of one turn; ``attachments`` are (number, kind, ref, tokens)."""

    def __init__(self, image_tile: int = 512, tokens_per_tile: int = 170, image_base: int = 85, audio_tokens_per_second: float = 25.0, document_tokens_per_page: int = 400):
        self.tile, self.per_tile, self.base = image_tile, tokens_per_tile, image_base
        self.per_second, self.per_page = audio_tokens_per_second, document_tokens_per_page
        self.out: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        tiles = math.ceil((part.get("width") or self.tile) / self.tile) * math.ceil((part.get("height") or self.tile) / self.tile)
        self.attach("image", part, self.base + tiles * self.per_tile)

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil((part.get("seconds") or 0) * self.per_second))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, (part.get("pages") or 1) * self.per_page)

    def visit_unknown(self, part: dict) -> None:
        """A part of another type is kept as its own JSON text, so nothing is lost."""
        self.out.append(escape(json.dumps(part, ensure_ascii=False, sort_keys=True)))

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.out.append(f"<|{kind}:{len(self.attachments)}|>")
        self.attachments.append({"number": len(self.attachments), "kind": kind, "ref": part.get("ref"), "tokens": tokens})


def format_turn(role: str | None, content: str | None, typed: bool = False) -> tuple[str, list[int], list[dict]]:
    """Formatted turn, its loss span (start and end, or empty), its attachments."""
    visitor, head = PartVisitor(), f"<|{escape_role(role or '')}|>"
    parts = None
    if typed and content and content.lstrip().startswith("["):
        try:
            parts = json.loads(content)
        except ValueError:
            parts = None  # text that only looks like a list of parts
    if not (isinstance(parts, list) and all(isinstance(p, dict) for p in parts)):
        parts = [{"type": "text", "text": content}]
    for part in parts:
        visitor.visit(part)
    body = "".join(visitor.out)
    span = [len(head), len(head) + len(body)] if role in LEARNED_ROLES else []
    return head + body + "<|end|>", span, visitor.attachments


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn; start and end are the place of the escaped text.

    Placeholders stay in the text as they are written. Whatever is not read as a whole turn raises.
    """
    turns, role, start, done = [], None, 0, 0
    for m in _CONTROL.finditer(formatted):
        if role is None:
            if m.start() != done:
                raise ValueError("text between turns")
            role, start = unescape(m[1]), m.end()
        elif m[1] == "end":
            turns.append((role, unescape(formatted[start : m.start()]), start, m.start()))
            role, done = None, m.end()
        elif not _MEDIA.fullmatch(m[1]):
            raise ValueError("a turn without its end")
    if role is not None or done != len(formatted):
        raise ValueError("the text does not end with a whole turn")
    return turns


def format_turns(df: DataFrame, typed: bool = False, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, formatted, loss_start, loss_end, attachments of every turn; no shuffle."""
    source = df.select(
        F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    media = pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turn(r, t, typed) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            new = [
                pa.array([m[0] for m in made], pa.string()),
                pa.array([m[1][0] if m[1] else None for m in made], pa.int64()),
                pa.array([m[1][1] if m[1] else None for m in made], pa.int64()),
                pa.array([m[2] for m in made], media),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names)

    names = [*source.columns, "formatted", "loss_start", "loss_end", "attachments"]
    fields = "conv_id bigint, turn bigint, role string, text string, formatted string, loss_start bigint, loss_end bigint, attachments array<struct<number int, kind string, ref string, tokens bigint>>"
    return source.mapInArrow(run, fields)


def read_back(turns: DataFrame) -> DataFrame:
    """Per conversation what its formatted turns and loss spans say.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Turns are sorted by
    Spark and stream by, so a conversation of any length needs the memory of one batch; only digests
    are carried from row to row, which has to happen in order.
    """
    ordered = (
        turns.select("conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_end")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "formatted", "loss_start", "loss_end")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []
        for batch in batches:
            for conv, formatted, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state.conv != conv:
                    if state:
                        done.append(state.row())
                    state = _Digest(conv)
                state.add(formatted, lo, hi)
            yield _rows(done)
            done = []
        if state:
            yield _rows([state.row()])

    return ordered.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


class _Digest:
    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss, self.chars = conv, 0, 0, 0
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, lo: int | None, hi: int | None) -> None:
        self.chars += len(formatted)
        for role, text, _, _ in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        if lo is not None:
            text = unescape(formatted[lo:hi])
            self.loss += len(text)
            self.learned.update(text.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss, self.learned.hexdigest(), self.chars


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])
