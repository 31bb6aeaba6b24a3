"""WARC archives under Zstandard, one frame a record, with a dictionary in front.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, as
it is or as a Zstandard frame of its own. Every frame after it holds one record. The reader
streams: it loads the dictionary, decodes frame by frame, and checks the version line, the
required headers, the record's length against Content-Length and what ends it, and the digests.

Writers name archives by task and attempt and return a manifest; only archives of the manifest are
read, so leftovers of lost tasks do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut

MAGIC = 0x184D2A5D
DICTIONARY_BYTES, TRAIN_BYTES, TRAIN_RECORDS = 32 << 10, 2 << 20, 400
ARCHIVE_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


class WarcError(ValueError):
    """An archive or record that does not follow the format."""


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:page:{page_id}>"


def write_record(page_id, url, payload: bytes, kind: str, refers_to, digest: str) -> bytes:
    """A response, or a revisit that carries the HTTP header of the payload but not the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id("" if page_id is None else page_id)), ("WARC-Date", DATE)]
    if url:
        # A line break would end the header.
        head.append(("WARC-Target-URI", " ".join(url.split())))
    head += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest32(block)}")]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block; raises WarcError."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("no WARC version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise WarcError(f"header without colon: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in REQUIRED:
        if name not in headers:
            raise WarcError(f"no {name}")
    if not headers["content-length"].isdigit():
        raise WarcError("Content-Length is not a number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"block of {n} bytes declared, {len(rest) - 4} there")
    block = rest[:n]
    said = headers.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != digest32(block):
        raise WarcError("block digest differs")
    return headers, block


def write_archive(out, records: list[bytes] | Iterator[bytes], dictionary: bytes) -> tuple[int, int]:
    """Dictionary frame and one frame a record; returns records and bytes."""
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    z = zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=True, write_checksum=True)
    front = zstandard.ZstdCompressor(level=9).compress(dictionary) if dictionary else b""
    out.write(struct.pack("<II", MAGIC, len(front)) + front)
    n, size = 0, 8 + len(front)
    for r in records:
        frame = z.compress(r)
        out.write(frame)
        n, size = n + 1, size + len(frame)
    return n, size


def read_archive(source, chunk: int = 1 << 16) -> Iterator[bytes]:
    """Records of an archive, decoded one frame after another in bounded memory but for the record itself."""
    front = source.read(8)
    if len(front) < 8 or struct.unpack("<I", front[:4])[0] != MAGIC:
        raise WarcError("no dictionary frame in front")
    size = struct.unpack("<I", front[4:])[0]
    raw = source.read(size)
    if len(raw) != size:
        raise WarcError("dictionary frame cut off")
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        raw = zstandard.ZstdDecompressor().decompress(raw)
    z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    held = source.read(chunk)
    while held:
        frame, parts = z.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(held))
            except zstandard.ZstdError as e:
                raise WarcError(f"bad frame: {e}") from None
            if frame.eof:
                held = frame.unused_data or source.read(chunk)
                break
            held = source.read(chunk)
            if not held:
                raise WarcError("frame cut off")
        yield b"".join(parts)


def train(samples: list[bytes]) -> bytes:
    """A dictionary from a bounded sample, or none if there is too little to learn from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if sum(map(len, samples)) > 8 * 1024 and len(samples) > 7 else b""
    except zstandard.ZstdError:
        return b""


def _open(folder: str):
    return pafs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def _write(batches, folder):
    """Archives of a task and their manifest rows."""
    context = TaskContext.get()
    fs, root = _open(folder)
    held: list[bytes] = []
    size = number = 0

    def flush():
        nonlocal held, size, number
        path = f"{root}/{context.partitionId():06d}-{number:04d}-{context.taskAttemptId()}.warc.zst"
        sample, total = [], 0
        for r in held[:TRAIN_RECORDS]:
            if total + len(r) <= TRAIN_BYTES:
                sample.append(r)
                total += len(r)
        with fs.open_output_stream(path) as out:
            n, written = write_archive(out, held, train(sample))
        held, size, number = [], 0, number + 1
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([written], pa.int64())], names=["path", "records", "bytes"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "kind", "refers_to", "digest"))):
            page_id, url, html, kind, refers_to, digest = row
            r = write_record(page_id, url, (html or "").encode(), kind, refers_to, digest)
            held.append(r)
            size += len(r)
            if size >= ARCHIVE_BYTES:
                yield flush()
    if held:
        yield flush()


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _number(uri: str | None):
    text = (uri or "")[len("<urn:page:"):-1]
    return int(text) if text else None


def _row(data: bytes, with_payload: bool):
    headers, block = parse_record(data)
    http, sep, payload = block.partition(b"\r\n\r\n")
    lengths = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not sep or not lengths:
        raise WarcError("no HTTP header in the block")
    n, kind = int(lengths[0]), headers["warc-type"]
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if n != len(payload):
            raise WarcError(f"payload of {n} bytes declared, {len(payload)} there")
        if digest != digest32(payload):
            raise WarcError("payload digest differs")
    elif kind == "revisit" and (payload or "warc-refers-to" not in headers or headers.get("warc-profile") != PROFILE):
        raise WarcError("a revisit needs a profile and what it refers to, and has no payload")
    return (_number(headers["warc-record-id"]), headers.get("warc-target-uri"), n, digest, kind, _number(headers.get("warc-refers-to")), payload if with_payload and kind == "response" else None)


def _read(batches, folder, with_payload):
    fs, _ = _open(folder)
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        for path, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
            rows, n, size = [], 0, 0
            with fs.open_input_stream(path) as source:
                for data in read_archive(source):
                    rows.append(_row(data, with_payload))
                    n, size = n + 1, size + (len(data) if with_payload else 0)
                    if len(rows) >= 1000 or size > 4 << 20:
                        yield out(rows)
                        rows, size = [], 0
            if n != expected:
                raise WarcError(f"{path} has {n} records, its manifest says {expected}")
            if rows:
                yield out(rows)


def _digests(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([digest32((t or "").encode()) for t in batch.column("html").to_pylist()])], names=[*batch.schema.names, "digest"])


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) under a folder all executors share; the manifest (path, records, bytes).

    Of records with equal payloads of at least ``least`` bytes, that with the largest page_id is the response and the
    others revisit it; rows that repeat that page_id are responses too. Null html is an empty payload. A null page_id is
    written without number and never is the response of a group that has a numbered page. Other columns are ignored.
    """
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kept = pages.mapInArrow(_digests, "page_id long, url string, html string, digest string")
    # Only groups of two rows or more travel back to the pages.
    groups = (pages.select("page_id", "html").mapInArrow(_digests, "page_id long, html string, digest string").groupBy("digest")
              .agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1 AND largest IS NOT NULL").select("digest", "largest"))
    rows = kept.join(groups, "digest", "left")
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest")) & (F.octet_length(F.coalesce("html", F.lit(""))) >= least)
    rows = rows.select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("largest")).alias("refers_to"), "digest")
    return cut(rows.mapInArrow(partial(_write, folder=folder), "path string, records long, bytes long"))


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records (``RECORDS``) of the archives of a manifest, an archive a task; WarcError fails the job."""
    return manifest.repartition(max(1, manifest.count())).mapInArrow(partial(_read, folder=folder, with_payload=with_payload), RECORDS)


def round_trip(pages: DataFrame, shared: str, least: int = 0) -> DataFrame:
    """Write ``pages`` into a new folder below ``shared`` and read them back: one row a page, without the payload."""
    folder = f"{shared}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(pages, folder, least)
    return read_archives(manifest, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
