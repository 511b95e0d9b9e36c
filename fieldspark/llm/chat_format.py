"""Formatting of conversations for training, and reading the result back.

Rows are brought together by conversation, sorted by turn and rendered as a
stream, so a conversation of any length passes through a task in pieces of
bounded size (a single turn is never cut). Texts are escaped reversibly: every
control string of the template begins with ``<``, and a text's own ``<`` and
``\\`` get a ``\\`` before them.

Null texts and roles are empty. Null turns come first, rows with equal turn are
sorted by role and text; rows without conv_id are one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chat_template import Template

TEMPLATE = (
    "<chat>\n{% for m in messages %}<turn>{{ m.role | escape }}</role>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}</chat>\n"
)
# Code points after which a piece is closed at the end of a turn.
PIECE = 1 << 20
TURN = re.compile(r"<turn>((?:[^<\\]|\\.)*)</role>((?:[^<\\]|\\.)*)</turn>\n", re.S)


def escape(value: str | None) -> str:
    return (value or "").replace("\\", "\\\\").replace("<", "\\<")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


PIECES = "conv_id bigint, piece int, formatted string, loss array<struct<start:int,stop:int>>"


def format_conversations(rows: DataFrame, template: str = TEMPLATE, limit: int = PIECE) -> DataFrame:
    """(conv_id, piece, formatted, loss) with loss spans in code points of the piece. Pieces of a conversation come in order, in one partition."""
    tidy = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    together = tidy.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    Template(template, {"escape": escape})  # errors show before the run

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield from zip(*[batch.column(i).to_pylist() for i in (0, 2, 3)], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template, {"escape": escape})
        for conv, turns in groupby(stream(batches), key=lambda r: r[0]):
            messages = ({"role": r, "text": t} for _, r, t in turns)
            for i, (text, spans) in enumerate(compiled.pieces({"messages": messages}, limit)):
                yield conv, i, text, [{"start": a, "stop": b} for a, b in spans]

    return together.mapInArrow(lambda batches: _batched(run(batches), PIECES_ARROW), PIECES)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
PIECES_ARROW = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("formatted", pa.string()), ("loss", SPANS)])
DIGEST_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)
DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of rows, closed at about ``size`` characters."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += 100 + sum(len(v) for v in row if isinstance(v, str))
        if chars >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def read_back(pieces: DataFrame) -> DataFrame:
    """Turns, loss text and lengths per conversation, parsed from formatted pieces in the order in which they were made."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, group in groupby(rows(batches), key=lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = chars = total = 0
            for _, _, text, spans in group:
                total += len(text)
                for role, said in TURN.findall(text):
                    turns.update(f"{unescape(role)}\n{unescape(said)}\n".encode())
                    n += 1
                for span in spans:
                    said = unescape(text[span["start"] : span["stop"]])
                    loss.update(said.encode())
                    chars += len(said)
            yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), total

    return pieces.mapInArrow(lambda batches: _batched(run(batches), DIGEST_ARROW), DIGESTS)
