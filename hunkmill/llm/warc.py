"""WARC archives, written and read as chunks.

Every row becomes a record in a gzip member of its own: of records with equal payloads of at least
``LEAST_BYTES`` the one with the largest key is a response, the others are revisits that refer to it.
Reading gives a chunk table: rows of record identifier, chunk number, at most ``CHUNK`` bytes, and the
number and SHA-1 of all payload bytes up to and including the chunk. The archive is decompressed in
small pieces, so a record of any size takes a chunk of memory.

Edge cases: a null payload is empty; null keys are written as "null" and read back as null, and a
null key is never the one referred to; rows that repeat the largest key with the same payload are
all responses; null addresses are left out; line ends in addresses are escaped; an empty table
gives no archives; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hunkmill.llm.shared_files import new_file, reading, with_scheme, writing
from hunkmill.llm.sized import sent_if_small
from hunkmill.session import landed, new_shared_path

LEAST_BYTES = 1000
CHUNK = 1 << 20
#: Compressed bytes of an archive that one task reads, at least.
SPAN = 32 << 20
PIECE = 1 << 16
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_record_types(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """key, url, payload (bytes), digest, payload_bytes and refers_to (null for responses).

    Equal payloads are counted with partial sums; only digests that repeat are joined back.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    large = rows.where(F.col("payload_bytes") >= LEAST_BYTES)
    repeated = large.groupBy("digest", "payload_bytes").agg(F.max("key").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    repeated = sent_if_small(landed(repeated, "repeated-payloads"), 120)
    joined = rows.join(repeated, ["digest", "payload_bytes"], "left")
    return joined.withColumn("refers_to", F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def _header(row: dict, block: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {'response' if row['refers_to'] is None else 'revisit'}"]
    lines.append(f"WARC-Record-ID: <urn:page:{'null' if row['key'] is None else row['key']}>")
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{row['digest']}", f"WARC-Payload-Length: {row['payload_bytes']}"]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + row["url"].replace("\r", "%0D").replace("\n", "%0A"))
    if row["refers_to"] is not None:
        lines += [f"WARC-Refers-To: <urn:page:{row['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}", "", ""]
    return "\r\n".join(lines).encode()


def write_archives(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes rows of ``with_record_types``, one archive per task; returns the list of spans (file,
    offset, length), each a run of whole records."""
    folder = with_scheme(folder or new_shared_path(records.sparkSession, "archives"))

    def write(batches):
        out, path, start, spans = None, new_file(folder, ".warc.gz"), 0, []
        for batch in batches:
            narrow = batch.drop_columns(["payload"]).to_pylist()
            for row, payload in zip(narrow, batch["payload"]):
                out = out or writing(path)
                body = memoryview(payload.as_buffer()) if row["refers_to"] is None else memoryview(b"")
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(member.compress(_header(row, len(HTTP) + len(body)) + HTTP))
                for at in range(0, len(body), CHUNK):
                    out.write(member.compress(body[at:at + CHUNK]))
                out.write(member.compress(b"\r\n\r\n") + member.flush())
                if out.tell() - start >= SPAN:
                    spans.append((path, start, out.tell() - start))
                    start = out.tell()
        if out:
            if out.tell() > start:
                spans.append((path, start, out.tell() - start))
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": f, "offset": o, "length": n} for f, o, n in spans])

    return landed(records.mapInArrow(write, "file string, offset long, length long"), "archive-spans")


class _Source:
    """Decompressed bytes of a run of gzip members, taken in order."""

    def __init__(self, path: str, offset: int, length: int):
        self.file, self.left = reading(path), length
        self.file.seek(offset)
        self.member, self.raw, self.held = zlib.decompressobj(31), b"", bytearray()

    def _more(self) -> bool:
        if self.member.eof:
            self.raw, self.member = self.member.unused_data or self.raw, zlib.decompressobj(31)
        if not self.raw:
            self.raw = self.file.read(min(PIECE, self.left))
            self.left -= len(self.raw)
            if not self.raw:
                return False
        data, rest = self.member.decompress(self.raw, CHUNK), self.member.unconsumed_tail
        self.raw = rest
        if self.member.eof:
            self.raw = self.member.unused_data
            self.member = zlib.decompressobj(31)
        self.held += data
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.held.find(mark)) < 0:
            if not self._more():
                return None
        out = bytes(self.held[:at])
        del self.held[:at + len(mark)]
        return out

    def take(self, size: int) -> bytes:
        while len(self.held) < size and self._more():
            pass
        out = bytes(self.held[:size])
        del self.held[:size]
        if len(out) < size:
            raise ValueError("archive ends inside a record")
        return out


def _number(value: str | None) -> int | None:
    text = value.rsplit(":", 1)[-1].rstrip(">") if value else "null"
    return None if text == "null" else int(text)


def chunks(path: str, offset: int, length: int) -> Iterator[dict]:
    """The chunk rows of the records in a span."""
    source = _Source(path, offset, length)
    while (head := source.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        left = int(fields["Content-Length"]) - len(HTTP)
        source.take(len(HTTP))
        row = {
            "record_id": fields["WARC-Record-ID"][1:-1], "key": _number(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"],
            "refers_to": _number(fields.get("WARC-Refers-To")), "target_uri": fields.get("WARC-Target-URI"),
        }
        if row["record_type"] == "revisit":
            yield {**row, "chunk": 0, "last": True, "data": b"", "bytes_so_far": int(fields["WARC-Payload-Length"]), "digest_so_far": fields["WARC-Payload-Digest"][5:]}
        else:
            digest, done, number = hashlib.sha1(), 0, 0
            while True:
                data = source.take(min(CHUNK, left - done))
                digest.update(data)
                done += len(data)
                yield {**row, "chunk": number, "last": done == left, "data": data, "bytes_so_far": done, "digest_so_far": digest.hexdigest()}
                number += 1
                if done == left:
                    break
            if f"sha1:{digest.hexdigest()}" != fields["WARC-Payload-Digest"]:
                raise ValueError(f"{path}: digest of {row['record_id']} differs")
        source.take(4)


CHUNK_ROW = pa.schema([
    ("record_id", pa.string()), ("key", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()),
    ("chunk", pa.int64()), ("last", pa.bool_()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()),
])


def read_archives(spans: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk table of written spans; a task reads a span, a chunk at a time."""

    def read(batches):
        for batch in batches:
            for span in batch.to_pylist():
                rows, held = [], 0
                for row in chunks(span["file"], span["offset"], span["length"]):
                    if not with_data:
                        row["data"] = None
                    rows.append(row)
                    held += len(row["data"] or b"") + 300
                    if held >= 4 * CHUNK:
                        yield pa.RecordBatch.from_pylist(rows, CHUNK_ROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, CHUNK_ROW)

    return spans.repartition(max(1, spans.count())).mapInArrow(read, "record_id string, key long, record_type string, refers_to long, target_uri string, chunk long, last boolean, data binary, bytes_so_far long, digest_so_far string")
