"""Chat formatting: typed content parts flattened by a visitor into ordered placeholders, one template for all turns."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of parts, and the marks of the template. Every mark begins with ``<`` or ``[``.
KINDS = ("text", "image", "audio", "document")
USER, END_USER, END_OTHER, ROLE, END_ROLE, END_TURN = "[INST]", "[/INST]", "</s>", "[ROLE]", "[/ROLE]", "[/TURN]"
PART = "struct<kind: string, text: string, ref: string, size: array<double>>"
SCHEMA = (
    "conv_id long, position long, role string, formatted string, loss_start int, loss_end int, "
    "attachments array<struct<placeholder: string, kind: string, ref: string, tokens: long>>, n_tokens long")


def escape(text: str) -> str:
    r"""A backslash before every backslash, ``<`` and ``[``: no mark or placeholder is left inside."""
    return re.sub(r"([\\<\[])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\([\\<\[])", r"\1", text)


@dataclass
class Flattener:
    """Visitor over the parts of one turn: collects its text, attachments and token count, in order.

    An image of width x height pixels is expanded to one token per ``patch`` x ``patch`` tile, audio of some
    seconds to ``rate`` tokens a second, a document to ``page`` tokens a page, text to one token per word.
    An unknown kind is an error, a part without a size counts as one tile, second or page.
    """

    patch: int = 28
    rate: float = 25.0
    page: int = 512
    first: int = 0
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0

    def visit(self, part: dict) -> None:
        kind = part["kind"] or "text"
        if kind not in KINDS:
            raise ValueError(f"unknown kind of part: {kind}")
        getattr(self, f"visit_{kind}")(part)

    def visit_text(self, part: dict) -> None:
        text = part["text"] or ""
        self.tokens += len(text.split())
        self.out.append(escape(text))

    def visit_image(self, part: dict) -> None:
        width, height = [*(part["size"] or []), self.patch, self.patch][:2]
        self._attach(part, math.ceil(width / self.patch) * math.ceil(height / self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, math.ceil([*(part["size"] or []), 1][0] * self.rate))

    def visit_document(self, part: dict) -> None:
        self._attach(part, math.ceil([*(part["size"] or []), 1][0]) * self.page)

    def _attach(self, part: dict, tokens: int) -> None:
        mark = f"<{part['kind']}:{self.first + len(self.attachments)}>"
        self.attachments.append({"placeholder": mark, "kind": part["kind"], "ref": part["ref"], "tokens": tokens})
        self.tokens += tokens
        self.out.append(mark)


def text_parts(text: Column) -> Column:
    """A plain text as a list of one part; null is empty."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("array<double>").alias("size")))


def _marks(role: str) -> tuple[str, str]:
    if role == "user":
        return USER, END_USER
    if role == "assistant":
        return "", END_OTHER
    return f"{ROLE}{escape(role)}{END_ROLE}", END_TURN


def format_turns(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), **sizes: float) -> DataFrame:
    """One row per turn, in the order of the conversation: its piece of the formatted text and what belongs to it.

    messages: conv_id, turn, role and parts (list of kind, text, ref, size). The formatted conversation is the
    pieces in order of position, joined without anything between; ``loss_start`` and ``loss_end`` are code
    points inside the piece, null outside the loss. Placeholders are numbered through a conversation.

    Turns are ordered by turn (null first), then role and parts, so ties and repeated rows keep a fixed order. A null
    role is the empty role, null parts and texts are empty; null conv_ids form one conversation. An empty table
    gives an empty result; further columns are not read.

    A conversation is never one row or one list: its turns are streamed, sorted, through a task that keeps two
    numbers, so a conversation of any length fits.
    """
    order = ["conv_id", "turn", "role", "key"]
    turns = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.col("parts").cast(f"array<{PART}>").alias("parts"))
    turns = turns.withColumn("key", F.to_json("parts")).repartition("conv_id").sortWithinPartitions(*order).drop("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, position, attached = object(), 0, 0
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                rows = []
                for row in part.to_pylist():
                    if row["conv_id"] != now:
                        now, position, attached = row["conv_id"], 0, 0
                    flat = Flattener(first=attached, **sizes)
                    for piece in row["parts"] or []:
                        if piece is not None:
                            flat.visit(piece)
                    (opening, closing), body = _marks(row["role"]), "".join(flat.out)
                    held = row["role"] in loss_roles
                    rows.append({
                        "conv_id": now, "position": position, "role": row["role"], "formatted": opening + body + closing,
                        "loss_start": len(opening) if held else None, "loss_end": len(opening) + len(body) if held else None,
                        "attachments": flat.attachments, "n_tokens": flat.tokens})
                    position, attached = position + 1, attached + len(flat.attachments)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=OUT)

    return turns.mapInArrow(run, SCHEMA)


OUT = pa.schema([
    ("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32()),
    ("attachments", pa.list_(pa.struct([("placeholder", pa.string()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))), ("n_tokens", pa.int64())])

MARK = re.compile(r"\\.|<[^>]*>|\[[^\]]*\]", re.DOTALL)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted text; placeholders of attachments stay as they are."""
    out, role, start, opened = [], "assistant", 0, 0
    for found in MARK.finditer(formatted):
        mark = found[0]
        if mark == USER:
            role, start = "user", found.end()
        elif mark == ROLE:
            opened = found.end()
        elif mark == END_ROLE:
            role, start = unescape(formatted[opened : found.start()]), found.end()
        elif mark in (END_USER, END_OTHER, END_TURN):
            out.append((role, unescape(formatted[start : found.start()])))
            role, start = "assistant", found.end()
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted pieces: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, n_tokens, n_attachments. Pieces are streamed in order into running digests."""
    turns = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "position").select(
        "conv_id", "formatted", "loss_start", "loss_end", "n_tokens", F.size("attachments").alias("n_attachments"))
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_attachments"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = object(), None, []

        def closed() -> list:
            n, turns_sha, chars, loss_sha, total, tokens, attachments = state
            return [now, n, turns_sha.hexdigest(), chars, loss_sha.hexdigest(), total, tokens, attachments]

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith("256") else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)

        for batch in batches:
            for conv, text, start, end, tokens, attachments in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if conv != now:
                    if state:
                        out.append(closed())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, said in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                if start is not None:
                    lost = unescape(text[start:end])
                    state[2] += len(lost)
                    state[3].update(lost.encode())
                state[4] += len(text)
                state[5] += tokens
                state[6] += attachments
                if len(out) >= 1000:
                    yield batch_of(out)
                    out = []
        if state:
            out.append(closed())
        if out:
            yield batch_of(out)

    return turns.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_attachments long")
