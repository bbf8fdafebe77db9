"""Zstandard WARC archives: one frame per record, a shared dictionary in the leading skippable frame.

Layout of a ``.warc.zst`` file: an optional skippable frame (magic 0x184D2A5D) whose content is the dictionary, plain
or as a zstandard frame of its own, then one zstandard frame per WARC/1.1 record.

Writing: every task writes the archives of its rows to the shared folder under a fresh name and returns a manifest row
for each; the manifest is a Parquet table, so archives of failed or speculative attempts are never listed. Reading:
the listed archives are spread over tasks, each read frame by frame with checks of headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import shared_dir, written

DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
ARCHIVE_BYTES = 64 << 20
#: An archive's dictionary is trained on its first records, up to these bounds.
SAMPLE_RECORDS, SAMPLE_BYTES, DICT_BYTES = 200, 1 << 20, 32 << 10
#: Records at most this long once decoded are accepted.
MAX_RECORD_BYTES = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6f0f4f0e-7c0c-5b7e-9d55-3a8a8f3f1c11")


class WarcError(ValueError):
    """An archive that breaks the format; names what and where."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(text: str) -> str:
    """``text`` fit for one header line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 0x20 or ord(c) == 0x7F else c for c in text)


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page_id))}>"


def make_record(page_id, url: str | None, payload: bytes, refers_to=None, is_revisit=False, date="2024-01-01T00:00:00Z") -> bytes:
    """A response record with the payload, or a revisit record with its HTTP headers alone."""
    sha = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}"]
    lines += [f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    lines += [f"WARC-Block-Digest: sha1:{digest(block)}", f"WARC-Payload-Digest: sha1:{sha}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if is_revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> Record:
    """Parses and checks one decoded record."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("no WARC version line or no end of headers")
    headers = _headers(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no {name} header")
    if not headers["content-length"].isdigit():
        raise WarcError("content-length is not a number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"content-length is {n}, the record holds {len(rest) - 4}")
    record = Record(headers, rest[:n])
    if (want := headers.get("warc-block-digest")) and want != f"sha1:{digest(record.block)}":
        raise WarcError("the block digest differs")
    kind = headers["warc-type"]
    if kind in ("response", "revisit") and headers.get("content-type", "").startswith("application/http"):
        head, found, body = record.block.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if not found or not lines[0].startswith(b"HTTP/"):
            raise WarcError("no HTTP status line or no end of HTTP headers")
        record.http, record.payload = _headers(lines[1:]), body
        if kind == "response":
            if record.http.get("content-length", str(len(body))) != str(len(body)):
                raise WarcError("the HTTP content-length differs from the payload")
            if (want := headers.get("warc-payload-digest")) and want != f"sha1:{digest(body)}":
                raise WarcError("the payload digest differs")
        elif body:
            raise WarcError("a revisit record holds a payload")
        elif "warc-refers-to" not in headers:
            raise WarcError("a revisit record refers to nothing")
    return record


def _headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, found, value = line.partition(b":")
        if not found or not name.strip():
            raise WarcError("a header line without a name")
        out[name.strip().decode("utf-8").lower()] = value.strip().decode("utf-8")
    return out


class Writer:
    """Writes records to a binary stream, the dictionary first."""

    def __init__(self, out, samples: list[bytes], level: int = 3, dict_bytes: int = DICT_BYTES) -> None:
        self.out, self.size = out, 0
        trained = None
        if len(samples) >= 16 and sum(map(len, samples)) >= 8 * dict_bytes:
            try:
                trained = zstandard.train_dictionary(dict_bytes, samples, k=256, d=8)
            except zstandard.ZstdError:  # samples too alike or too short for one: the archive has none
                trained = None
        if trained:
            packed = zstandard.ZstdCompressor(level=level).compress(trained.as_bytes())
            self._put(struct.pack("<II", DICT_MAGIC, len(packed)) + packed)
            trained.precompute_compress(level=level)
            self.zstd = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
        else:
            self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.size += len(raw)

    def add(self, record: bytes) -> None:
        self._put(self.zstd.compress(record))


def read_archive(stream) -> Iterator[Record]:
    """Records of an archive, one frame at a time, each parsed and checked.

    Raises :class:`WarcError` for a broken dictionary, frame, header or length, and for data after the last frame.
    """
    buffer = b""

    def fill(n: int) -> bytes:
        nonlocal buffer
        while len(buffer) < n and (more := stream.read(max(1 << 20, n - len(buffer)))):
            buffer += more
        return buffer

    dictionary, first, k = None, True, 0
    while fill(8):
        if len(buffer) < 8:
            raise WarcError(f"frame {k}: cut short")
        magic, size = struct.unpack("<II", buffer[:8])
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if len(fill(8 + size)) < 8 + size:
                raise WarcError(f"frame {k}: a skippable frame is cut short")
            content, buffer = buffer[8 : 8 + size], buffer[8 + size :]
            if first and magic == DICT_MAGIC:
                if content[:4] == struct.pack("<I", FRAME_MAGIC):
                    content = zstandard.ZstdDecompressor().decompress(content, max_output_size=64 << 20)
                dictionary = zstandard.ZstdCompressionDict(content)
        elif magic == FRAME_MAGIC:
            zstd = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
            one, parts, held = zstd.decompressobj(), [], 0
            try:
                while not one.eof:
                    if not buffer and not fill(1):
                        raise WarcError(f"frame {k}: cut short")
                    parts.append(one.decompress(buffer))
                    held += len(parts[-1])
                    if held > MAX_RECORD_BYTES:
                        raise WarcError(f"frame {k}: longer than {MAX_RECORD_BYTES} bytes")
                    buffer = one.unused_data if one.eof else b""
            except zstandard.ZstdError as e:
                raise WarcError(f"frame {k}: {e}") from e
            try:
                yield parse_record(b"".join(parts))
            except WarcError as e:
                raise WarcError(f"frame {k}: {e}") from e
            k += 1
        else:
            raise WarcError(f"frame {k}: magic number {magic:#x}")
        first = False


def _open(path: str, mode: str):
    """A binary stream of a path or URI in any store that pyarrow can reach."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if ":" in path.partition("/")[0] else (fs.LocalFileSystem(), path)
    if mode == "w":
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        return store.open_output_stream(inner)
    return store.open_input_stream(inner, buffer_size=1 << 20)


def mark_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Adds ``response_id``: of the rows with an equal payload of at least ``min_bytes``, the largest id.

    Only digests that occur twice or more are joined back, so rows with a payload of their own meet no partner; a hot
    payload is one row of the small side, and adaptive execution splits its rows on the other.
    """
    body = F.coalesce(F.encode(F.col(payload_col).cast("string"), "utf-8"), F.lit(b""))
    rows = pages.withColumn("__sha", F.when(F.length(body) >= min_bytes, F.sha1(body)))
    same = rows.where("__sha is not null").groupBy("__sha").agg(F.max(id_col).alias("__top"), F.count("*").alias("__n"))
    out = rows.join(same.where("__n > 1").drop("__n"), "__sha", "left")
    return out.withColumn("response_id", F.coalesce("__top", id_col)).drop("__sha", "__top")


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Writes a record per row to archives below ``folder``; returns the manifest (``path``, ``n_records``, ``n_bytes``).

    Rows with equal payloads of at least ``min_bytes``: those with the largest id are responses, the others revisit
    records without the payload. A null payload is an empty one. A row repeated with its id is a response again; ids
    that are null come after all others, and are all responses if a payload has no other id. A null url leaves its
    header out. An empty table makes no archive.
    """
    marked = mark_revisits(pages.select(id_col, url_col, payload_col), id_col, payload_col, min_bytes)
    rows = marked.select(
        F.col(id_col).cast("string").alias("i"),
        F.col(url_col).cast("string").alias("u"),
        F.encode(F.col(payload_col).cast("string"), "utf-8").alias("b"),
        F.col("response_id").cast("string").alias("r"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import chain

        def flat():
            for batch in batches:
                for k in range(batch.num_rows):
                    yield tuple(batch.column(c)[k].as_py() for c in range(4))

        source, done = flat(), False
        while not done:
            head, samples, held = [], [], 0
            for row in source:
                head.append(row)
                body = row[2] or b""
                if body and row[0] == row[3]:
                    samples.append(body[: SAMPLE_BYTES // 8])
                    held += len(samples[-1])
                if len(head) >= SAMPLE_RECORDS or held >= SAMPLE_BYTES:
                    break
            if not head:
                return
            path, n = f"{folder}/{uuid.uuid4().hex}.warc.zst", 0
            with _open(path, "w") as out:
                writer, done = Writer(out, samples), True
                for i, u, b, r in chain(head, source):
                    writer.add(make_record(i, u, b or b"", r, is_revisit=i != r))
                    n += 1
                    if writer.size >= archive_bytes:
                        done = False
                        break
                size = writer.size
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [size]})

    return rows.mapInArrow(run, "path string, n_records long, n_bytes long")


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row per record of the archives in ``manifest``: ``page_id`` (string), ``url``, ``record_type``, ``refers_to``
    (string), ``payload_bytes``, ``payload_digest``, ``payload`` (null in revisit records). Raises on a broken archive
    and where an archive holds another number of records than the manifest says."""
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = 0
                with _open(path, "r") as stream:
                    rows, held = [], 0
                    for rec in read_archive(stream):
                        seen += 1
                        rows.append(_row(rec))
                        held += len(rec.payload)
                        if held > (8 << 20) or len(rows) >= 5000:
                            yield _batch(rows)
                            rows, held = [], 0
                    yield _batch(rows)
                if seen != want:
                    raise WarcError(f"{path}: {seen} records, {want} were written")

    spread = manifest.select("path", "n_records").repartition(n, "path")
    return spread.mapInArrow(run, _ROW)


_ROW = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"
_ARROW = pa.schema(
    [(n, pa.int64() if t == "long" else pa.binary() if t == "binary" else pa.string()) for n, t in (x.strip().split(" ") for x in _ROW.split(","))]
)


def _row(rec: Record) -> tuple:
    kind, sha = rec.headers["warc-type"], rec.headers.get("warc-payload-digest", "")
    length = rec.http.get("content-length", "")
    if kind == "revisit" and (not length.isdigit() or not sha.startswith("sha1:")):
        raise WarcError("a revisit record without the payload's length or digest")
    n, body = (int(length), None) if kind == "revisit" else (len(rec.payload), rec.payload)
    name = sha.removeprefix("sha1:") if kind == "revisit" else digest(rec.payload)
    return rec.headers.get("x-page-id"), rec.headers.get("warc-target-uri"), kind, rec.headers.get("x-refers-to-page-id"), n, name, body


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def archive_round_trip(pages: DataFrame, **names: str) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and returns the records read back from them."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    return read_archives(written(write_archives(pages, folder, **names), "warc-manifest"))


def read_bytes(raw: bytes) -> list[Record]:
    """Records of an archive held in memory."""
    return list(read_archive(io.BytesIO(raw)))
