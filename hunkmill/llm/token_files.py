"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds, one after the other:

* data frames: ids as little-endian integers of 2 or 4 bytes. A frame ends with a document, except
  inside documents of more than ``LONG_TOKENS`` ids, which take several frames;
* one skippable frame (magic 0x184D2A5D): the document index, itself compressed: per document its
  id (8 bytes), whether the id is there (1 byte) and its number of ids (8 bytes), then 16 bytes:
  the number of documents and the bytes of an id;
* one skippable frame (magic 0x184D2A5E): the seek table of the public seekable format: compressed
  size, size and checksum (low 4 bytes of XXH64 of the content) of every data frame, the number of
  frames, a descriptor byte (0x80: with checksums) and the magic 0x8F92EAB1.

A plain zstandard reader sees the data frames one after the other. A seeking reader takes the last
bytes, then only the frames that hold the documents it was asked for.

Edge cases: a null text counts as empty and holds just the end id; a null document id is kept as
null and sorts first; equal document ids are ordered by the text's hash; an empty table gives no
files; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from hunkmill.llm.shared_files import new_file, partition_id, reading, with_scheme, writing
from hunkmill.llm.word_ids import WordIds, once, utf8
from hunkmill.session import landed, new_shared_path

FRAME_TOKENS = 1 << 16
LONG_TOKENS = 1 << 22
INDEX_MAGIC, TABLE_MAGIC, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
INDEX_BLOCK = 4096
INDEX_ROW = np.dtype([("doc", "<i8"), ("known", "u1"), ("tokens", "<u8")])


class Writer:
    """Writes one file, holding one frame in memory, and 17 bytes of the index for each document."""

    def __init__(self, path: str, kind: np.dtype):
        self.path, self.kind, self.out = path, kind, writing(path)
        self.compressor = zstandard.ZstdCompressor(level=3)
        self.parts: list[bytes] = []
        self.held = self.tokens = 0
        self.table: list[tuple[int, int, int]] = []
        self.documents = 0
        #: The document index so far: whole blocks of rows, and the rows of the last one.
        self.blocks: list[bytes] = []
        self.rows: list[tuple[int, int, int]] = []

    def add(self, doc: int | None, ids: bytes) -> None:
        size = self.kind.itemsize
        count = len(ids) // size
        self.rows.append((0 if doc is None else doc, doc is not None, count))
        self.documents += 1
        self.tokens += count
        if len(self.rows) == INDEX_BLOCK:
            self._block()
        for at in range(0, len(ids), LONG_TOKENS * size):
            self.parts.append(ids[at:at + LONG_TOKENS * size])
            self.held += len(self.parts[-1]) // size
            if self.held >= FRAME_TOKENS:
                self._frame()

    def _block(self) -> None:
        self.blocks.append(np.array(self.rows, INDEX_ROW).tobytes())
        self.rows = []

    def _frame(self) -> None:
        content = b"".join(self.parts)
        frame = self.compressor.compress(content)
        self.out.write(frame)
        self.table.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.parts, self.held = [], 0

    def close(self) -> None:
        if self.parts:
            self._frame()
        self._block()
        index = self.compressor.compress(b"".join(self.blocks)) + struct.pack("<QQ", self.documents, self.kind.itemsize)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *row) for row in self.table)
        table += struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)
        self.out.close()


class Reader:
    """Reads documents of one file; decompresses only the frames they lie in."""

    def __init__(self, path: str):
        self.file = reading(path)
        end = self.file.size()
        frames, descriptor, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE or descriptor != 0x80:
            raise ValueError(f"{path}: no seek table")
        size = 12 * frames + 9
        table = np.frombuffer(self._at(end - size, size - 9), "<u4").reshape(frames, 3)
        self.checks = table[:, 2]
        self.starts = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        at = int(self.starts[-1])
        index = self._at(at + 8, struct.unpack("<II", self._at(at, 8))[1])
        count, width = struct.unpack("<QQ", index[-16:])
        self.kind = np.dtype(f"<u{width}")
        self.index = np.frombuffer(zstandard.decompress(index[:-16], max_output_size=max(1, count * INDEX_ROW.itemsize)), INDEX_ROW)
        self.tokens = np.concatenate([[0], np.cumsum(table[:, 1] // width, dtype=np.int64)])
        self.offsets = np.concatenate([[0], np.cumsum(self.index["tokens"], dtype=np.int64)])
        self.last: tuple[int, bytes] = (-1, b"")
        self.frames_read = 0

    def _at(self, start: int, size: int) -> bytes:
        return self.file.read_at(size, start)

    def frame(self, number: int) -> bytes:
        if self.last[0] != number:
            start, end = int(self.starts[number]), int(self.starts[number + 1])
            content = zstandard.decompress(self._at(start, end - start))
            if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != int(self.checks[number]):
                raise ValueError(f"frame {number}: checksum differs")
            self.last = (number, content)
            self.frames_read += 1
        return self.last[1]

    def pieces(self, row: int) -> Iterator[np.ndarray]:
        """The ids of the document at this place of the index, frame by frame."""
        start, end = int(self.offsets[row]), int(self.offsets[row + 1])
        number = int(np.searchsorted(self.tokens, start, side="right")) - 1
        while start < end:
            base = int(self.tokens[number])
            upto = min(end, int(self.tokens[number + 1]))
            yield np.frombuffer(self.frame(number), self.kind)[start - base:upto - base]
            start, number = upto, number + 1

    def document(self, row: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, self.kind), *self.pieces(row)])


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every text and writes the ids in ascending key order; returns the list of files.

    The texts are range-partitioned by key (ties by hash, so a key that repeats endlessly is split as
    well) and each partition streams into one file. Files: part, file, documents, tokens; in order
    of part the files hold the whole table in order.
    """
    spark = docs.sparkSession
    folder = with_scheme(folder or new_shared_path(spark, "token-files"))
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text)).alias("tie"))
    ordered = rows.repartitionByRange(wanted, "doc", "tie").sortWithinPartitions("doc", "tie").select("doc", "text")

    def write(batches):
        encoder, writer = once(WordIds, tokenizer), None
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            for doc, raw in zip(batch["doc"].to_pylist(), utf8(batch["text"])):
                writer = writer or Writer(new_file(folder, ".tokens.zst"), encoder.kind)
                writer.add(doc, encoder.encode(raw) + end)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"part": partition_id(), "file": writer.path, "documents": writer.documents, "tokens": writer.tokens}])

    return landed(ordered.mapInArrow(write, "part long, file string, documents long, tokens long"), "token-file-list")


def read_tokens(files: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32.

    The list of files has one short row per file, so its running total is taken in one task; the files
    themselves are read by as many tasks as there are files, a frame at a time.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                reader = Reader(row["file"])
                known, doc = reader.index["known"].astype(bool), reader.index["doc"]
                checks = np.zeros(len(doc), np.int64)
                for i in range(len(doc)):
                    check = 0
                    for ids in reader.pieces(i):
                        check = zlib.crc32(ids.astype("<u4").tobytes(), check)
                    checks[i] = check
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc, pa.int64(), mask=~known), pa.array(reader.offsets[:-1] + row["start"]),
                    pa.array(reader.index["tokens"].astype(np.int64)), pa.array(checks),
                ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(max(1, files.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
