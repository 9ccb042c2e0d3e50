"""Chat formatting by token-level assembly.

Each turn is `<|im_start|>role\\ntext<|im_end|>\\n`. Role line, text and line end are encoded as
separate segments and the two markers are spliced in as reserved ids, so no text can tokenise
into a marker. Control strings inside a text are escaped reversibly as well: every `<` followed
by any number of backslashes and a `|` gets one backslash more, so `<|` never occurs in formatted
content. The loss mask covers exactly the text segments of assistant turns; it is kept as token
spans, whose ends are prefix sums of segment lengths.

Tokenising runs where the rows lie. Only ids are shuffled by conversation and sorted by turn;
assembly streams over them, so a conversation of any length needs one turn of memory, and it
leaves as parts of at most PART_TOKENS tokens (a longer turn is a part of its own).

Edge cases: null text or role counts as empty; rows with a null conv_id form one conversation;
null turns come first; repeated rows and ties of turn are all kept, ordered by role and text; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow
from .packing import encoder

START, END = 50257, 50258
MARKERS = {START: b"<|im_start|>", END: b"<|im_end|>"}
PART_TOKENS = 1 << 16


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def _assembled_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = encoder().encode_ordinary
    line = encode("\n")
    for batch in batches:
        ids, first, after = [], [], []
        for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            role = role or ""
            segments = [[START], encode(escape(role) + "\n"), encode(escape(text or "")), [END], line]
            ends = np.cumsum([len(s) for s in segments])
            ids.append(np.array(sum(segments, []), "<u2").tobytes())
            first.append(int(ends[1]) if role == "assistant" else -1)
            after.append(int(ends[2]) if role == "assistant" else -1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array(first, pa.int32()), pa.array(after, pa.int32())], [*batch.schema.names, "ids", "loss_first", "loss_after"])


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of conversations from turns in order."""
    names = ["conv_id", "part", "token_start", "turns", "input_ids", "loss_spans"]
    spans = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))

    def row(conv, part, start, held):
        ends = np.cumsum([0] + [len(h[0]) // 2 for h in held])
        loss = [{"first": int(ends[i] + h[1]), "after": int(ends[i] + h[2])} for i, h in enumerate(held) if h[1] >= 0]
        return (conv, part, start, len(held), b"".join(h[0] for h in held), loss), int(start + ends[-1])

    conv, part, start, held, size, rows, begun = None, 0, 0, [], 0, [], False
    for batch in batches:
        for c, ids, first, after in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "ids", "loss_first", "loss_after")), strict=True):
            n = len(ids) // 2
            if held and (c != conv or size + n > PART_TOKENS):
                out, start = row(conv, part, start, held)
                rows.append(out)
                part, held, size = part + 1, [], 0
            if c != conv or not begun:
                conv, part, start, begun = c, 0, 0, True
            held.append((ids, first, after))
            size += n
        if sum(len(r[4]) for r in rows) > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), spans))], names)
            rows = []
    if held:
        rows.append(row(conv, part, start, held)[0])
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), spans))], names)


def format_chat(turns: DataFrame) -> DataFrame:
    """Rows conv_id, part, token_start, turns, input_ids (16-bit ids), loss_spans, sorted within partitions."""
    return (
        turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
        .transform(in_arrow, _assembled_turns, "conv_id long, turn long, role string, text string, ids binary, loss_first int, loss_after int")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "ids", "loss_first", "loss_after")
        .transform(in_arrow, _assembled, "conv_id long, part long, token_start long, turns long, input_ids binary, loss_spans array<struct<first:long,after:long>>")
    )


def decode(ids: np.ndarray) -> bytes:
    """The bytes that ids stand for, markers included."""
    e, out, at = encoder(), [], 0
    for mark in [*np.flatnonzero(ids >= START), len(ids)]:
        out.append(e.decode_bytes(ids[at:mark].tolist()))
        if mark < len(ids):
            out.append(MARKERS[int(ids[mark])])
        at = mark + 1
    return b"".join(out)


def parse_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted string."""
    for block in formatted.split(MARKERS[START].decode())[1:]:
        role, _, text = block[: -len(MARKERS[END].decode()) - 1].partition("\n")
        yield unescape(role), unescape(text)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation, read from its parts in order."""
    rows: list[tuple] = []
    conv, begun, n, turns, loss, loss_chars, chars = None, False, 0, None, None, 0, 0
    for batch in batches:
        for c, ids, spans in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "input_ids", "loss_spans")), strict=True):
            if c != conv or not begun:
                if begun:
                    rows.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                conv, begun, n, turns, loss, loss_chars, chars = c, True, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
            ids = np.frombuffer(ids, "<u2")
            formatted = decode(ids).decode()
            chars += len(formatted)
            for role, text in parse_turns(formatted):
                n += 1
                turns.update(f"{role}\n{text}\n".encode())
            for span in spans:
                said = unescape(decode(ids[span["first"] : span["after"]]).decode())
                loss.update(said.encode())
                loss_chars += len(said)
    if begun:
        rows.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame) -> DataFrame:
    """What format_chat wrote, read back: turns and loss text of each conversation as digests."""
    return (
        formatted.select("conv_id", "part", "input_ids", "loss_spans")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "part")
        .transform(in_arrow, _digested, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    )
