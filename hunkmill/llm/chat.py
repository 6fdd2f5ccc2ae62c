"""Chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. For a batch of turns all pieces (marks, roles,
texts) have a length and a place in one source buffer; running sums give their places in the output,
and one preallocated Arrow buffer is filled by scatter indices, a block of bytes at a time.

``<``, any backslashes, ``|`` inside a text gets one backslash more, so no control string is left in
it, and taking one away restores the text. Roles are treated alike after writing ``\\`` and line ends
as ``\\\\`` and ``\\n``.

Edge cases: null texts and roles are empty; null conversation ids are one conversation, null turns
come first; equal turn numbers are ordered by the hash of role and text; repeated rows are all kept; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hunkmill.llm.shared_files import partition_id

START, END = b"<|im_start|>", b"<|im_end|>\n"
#: Output bytes written by one scatter step, and turns and bytes of a conversation kept in one row.
BLOCK, PART_TURNS, PART_BYTES = 1 << 20, 4096, 1 << 24


def escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def unescaped(text: bytes) -> bytes:
    return re.sub(rb"<\\(\\*)\|", rb"<\1|", text) if b"<\\" in text else text


def escaped_roles(roles: pa.Array) -> pa.Array:
    return escaped(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def unescaped_role(role: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], unescaped(role))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow text column and the offsets in them."""
    texts = texts.cast(pa.string()) if not pa.types.is_string(texts.type) else texts
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """The bytes of all turns, where each turn ends, and where its text begins and ends."""
    marks = START + b"\n" + END
    role_bytes, role_at = _bytes_of(escaped_roles(roles))
    text_bytes, text_at = _bytes_of(escaped(texts))
    source = np.concatenate([np.frombuffer(marks, np.uint8), role_bytes, text_bytes])
    count, roles_from = len(texts), len(marks)
    texts_from = roles_from + len(role_bytes)
    origin = np.empty((count, 5), np.int64)
    length = np.empty((count, 5), np.int64)
    for column, (place, size) in enumerate([
        (0, len(START)), (roles_from + role_at[:-1], np.diff(role_at)), (len(START), 1),
        (texts_from + text_at[:-1], np.diff(text_at)), (len(START) + 1, len(END)),
    ]):
        origin[:, column], length[:, column] = place, size
    ends = np.cumsum(length.ravel())
    starts, origin = ends - length.ravel(), origin.ravel()
    total = int(ends[-1]) if count else 0
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    for low in range(0, total, BLOCK):
        high = min(low + BLOCK, total)
        part = slice(np.searchsorted(ends, low, "right"), np.searchsorted(starts, high, "left"))
        size = np.minimum(ends[part], high) - np.maximum(starts[part], low)
        out[low:high] = source[np.repeat(origin[part] - starts[part], size) + np.arange(low, high)]
    grid = ends.reshape(count, 5)
    return buffer, grid[:, 4], np.stack([grid[:, 2], grid[:, 3]], axis=1)


def format_conversations(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: str = "assistant") -> DataFrame:
    """Rows of whole turns in order: conversation, task, part, n_turns, formatted bytes, and ``loss``,
    byte ranges of the learned roles' texts.

    Turns are range-partitioned by conversation and turn, so an endless conversation is split over
    tasks. A conversation is one row unless it is very long or lies across two tasks; its rows are
    ordered by (task, part).
    """
    rows = turns.select(
        F.col(conversation).alias("conversation"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.xxhash64(role, text).alias("tie"),
    )
    wanted = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), turns.rdd.getNumPartitions())
    keys = ["conversation", "turn", "tie"]
    ordered = rows.repartitionByRange(wanted, *keys).sortWithinPartitions(*keys).select("conversation", "role", "text")
    kind = turns.schema[conversation].dataType

    def work(batches):
        task, part = partition_id(), 0
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            names = held["conversation"]
            change = np.flatnonzero(_changes(names.combine_chunks())) if len(held) else np.zeros(0, int)
            ready = int(change[-1]) if len(change) else 0
            tail = held.slice(ready)
            if len(tail) > PART_TURNS or tail.nbytes > PART_BYTES:
                ready = len(held)
            if ready:
                yield _formatted(held.slice(0, ready), task, part, learned)
                part += 1
                held = held.slice(ready)
        if held is not None and len(held):
            yield _formatted(held, task, part, learned)

    made = ordered.mapInArrow(work, f"conversation {kind.simpleString()}, task long, part long, n_turns long, formatted binary, loss array<struct<start:bigint,end:bigint>>")
    return made.withColumnRenamed("conversation", conversation)


def _changes(names: pa.Array) -> np.ndarray:
    """Whether each row begins another conversation than the row before (the first row does not)."""
    if isinstance(names, pa.ChunkedArray):
        names = names.combine_chunks()
    codes = pc.dictionary_encode(names, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[False], codes[1:] != codes[:-1]])


def _formatted(rows: pa.Table, task: int, part: int, learned: str) -> pa.RecordBatch:
    rows = rows.combine_chunks()
    names, roles, texts = (rows[c].chunk(0) if rows[c].num_chunks == 1 else pa.concat_arrays(rows[c].chunks) for c in ("conversation", "role", "text"))
    buffer, ends, spans = assemble(roles, texts)
    first = np.flatnonzero(_changes(names))
    first = np.concatenate([[0], first]).astype(np.int64)
    last = np.concatenate([first[1:], [len(names)]])
    bounds = np.concatenate([[0], ends[last - 1]])
    formatted = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), buffer])
    own = pc.equal(roles, learned).to_numpy(zero_copy_only=False)
    inside = np.repeat(bounds[:-1], last - first)
    loss = pa.StructArray.from_arrays([pa.array((spans[:, 0] - inside)[own]), pa.array((spans[:, 1] - inside)[own])], ["start", "end"])
    upto = np.concatenate([[0], np.cumsum(own)])
    return pa.RecordBatch.from_arrays([
        names.take(pa.array(first)), pa.array(np.full(len(first), task)), pa.array(np.full(len(first), part)), pa.array(last - first), formatted,
        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto[last]]).astype(np.int32)), loss),
    ], ["conversation", "task", "part", "n_turns", "formatted", "loss"])


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of every turn, as they were before formatting."""
    turns = []
    for piece in formatted.split(START)[1:]:
        role, text = piece.split(b"\n", 1)
        turns.append((unescaped_role(role), unescaped(text[: -len(END)])))
    return turns


def _letters(text: bytes) -> int:
    return int(((np.frombuffer(text, np.uint8) & 0xC0) != 0x80).sum())


def digests(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Read back from formatted rows, one row per conversation: n_turns, turns_sha256 over role, line
    end, text, line end of each turn, loss_chars and loss_sha256 over the text under the loss mask, and
    formatted_chars. The rows of a conversation are read one at a time, in order."""
    kind = formatted.schema[conversation].dataType.simpleString()
    rows = formatted.select(F.col(conversation).alias("key"), "task", "part", "formatted", "loss")
    ordered = rows.repartition("key").sortWithinPartitions("key", "task", "part").drop("task", "part")

    def work(batches):
        nothing = object()
        name, state = nothing, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if name is nothing or row["key"] != name:
                    if state:
                        out.append(state.row(name))
                    name, state = row["key"], _Digest()
                state.add(row["formatted"], row["loss"])
            if out:
                yield _rows(out)
        if state:
            yield _rows([state.row(name)])

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    types = [to_arrow_type(formatted.schema[conversation].dataType), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    read = ordered.mapInArrow(work, f"key {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return read.withColumnRenamed("key", conversation)


class _Digest:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, formatted: bytes, loss: list[dict]) -> None:
        for role, text in parse(formatted):
            self.turns.update(role + b"\n" + text + b"\n")
            self.n_turns += 1
        for span in loss:
            text = unescaped(formatted[span["start"]:span["end"]])
            self.loss.update(text)
            self.loss_chars += _letters(text)
        self.chars += _letters(formatted)

    def row(self, name) -> tuple:
        return name, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars
