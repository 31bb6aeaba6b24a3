"""Document fingerprints from prefix polynomial hashes.

For code points c_j the prefix array S[i] = sum(c_j * B**j, j < i) mod p, for two primes p,
gives the hash of any span in two look-ups, so span equality takes constant time and
the longest common extension of two positions a binary search.

A fingerprint is the hash of the whole text followed by the ``SKETCH`` least hashes of
its distinct spans of ``SPAN`` code points (of the text itself if shorter). Two fingerprints'
likeness is the share of the least hashes of both together that both have, an estimate of the
Jaccard similarity of their spans; equal texts have equal fingerprints and likeness 1.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import mix, partitions, parts_of

PRIMES = (2147483629, 2147483587)
BASES = (911382323, 972663749)
SPAN, SKETCH = 16, 64
#: Texts a range of doc_ids holds, and ids sampled for each: what the driver knows of a range is these, its bounds and its least id.
BUCKET_BYTES, BUCKET_KEYS, SAMPLE_DOCS = 64 << 20, 8, 20_000
FIRST_ID = -(2**63)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**j and B**-j mod the k-th prime, for j < n at least."""
    if k not in _tables or len(_tables[k][0]) < n:
        size, p, out = 1 << max(12, (n - 1).bit_length()), PRIMES[k], []
        for base in (BASES[k], pow(BASES[k], -1, PRIMES[k])):
            x = np.ones(size, np.int64)
            have = 1
            while have < size:
                x[have:2 * have] = x[:have] * pow(base, have, p) % p
                have *= 2
            out.append(x)
        _tables[k] = tuple(out)
    return _tables[k]


class Prefix:
    """Prefix hashes of one text."""

    def __init__(self, text: str):
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
        self.n, self.sums = len(c), []
        for k, p in enumerate(PRIMES):
            s = np.zeros(self.n + 1, np.int64)
            np.cumsum(c * _powers(k, self.n + 1)[0][:self.n] % p, out=s[1:])
            self.sums.append(s)

    def spans(self, start, size: int) -> np.ndarray:
        """62-bit hashes of the spans of one size at each start."""
        start = np.asarray(start)
        a, b = ((s[start + size] - s[start]) % p * _powers(k, self.n + 1)[1][start] % p for k, (p, s) in enumerate(zip(PRIMES, self.sums)))
        return ((a << 31) | b).astype(np.uint64)

    def hash(self, start: int, size: int) -> int:
        return int(self.spans([start], size)[0])

    def equal(self, i: int, other: Prefix, j: int, size: int) -> bool:
        return self.hash(i, size) == other.hash(j, size)

    def extension(self, i: int, other: Prefix, j: int) -> int:
        """Length of the longest common extension from i here and j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            half = (low + high + 1) // 2
            low, high = (half, high) if self.equal(i, other, j, half) else (low, half - 1)
        return low

    def fingerprint(self) -> str:
        whole = int(mix(np.array([self.hash(0, self.n) * 4 + (self.n > 0)], np.uint64))[0])
        if not self.n:
            return f"{whole:016x}"
        size = min(SPAN, self.n)
        h = (mix(self.spans(np.arange(self.n - size + 1), size)) >> np.uint64(32)).astype(np.uint32)
        low = np.unique(np.partition(h, 4 * SKETCH)[:4 * SKETCH] if len(h) > 8 * SKETCH else h)
        if len(low) < SKETCH and len(h) > 8 * SKETCH:
            low = np.unique(h)
        return f"{whole:016x}" + low[:SKETCH].astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f[16:]), ">u4") for f in (a, b))
    if not len(x) or not len(y):
        return 0.0
    low = np.union1d(x, y)[:SKETCH]
    return float(np.isin(low, np.intersect1d(x, y, assume_unique=True), assume_unique=True).sum() / len(low))


# ---- The next document in order of doc_id ---------------------------------

def splitters_of(ids: np.ndarray, sizes: np.ndarray, buckets: int) -> np.ndarray:
    """At most buckets - 1 ids that part sampled documents into ranges of even size."""
    order = np.argsort(ids, kind="stable")
    total = np.cumsum(sizes[order].astype(float) + 1)
    if not len(total) or buckets < 2:
        return np.zeros(0, np.int64)
    return np.unique(ids[order][np.searchsorted(total, total[-1] * np.arange(1, buckets) / buckets).clip(max=len(total) - 1)])


def _bucketed(batches, shared):
    """Rows with their bucket; the first document of a bucket also goes to the bucket before it."""
    splitters, head_ids, head_to = shared.value
    z = zstandard.ZstdCompressor(level=1)
    for batch in parts_of(batches):
        ids = batch.column("doc_id").fill_null(FIRST_ID).to_numpy(zero_copy_only=False)
        to = np.searchsorted(splitters, ids, "right")
        rows, bucket, extra = np.arange(len(ids)), to, np.zeros(len(ids), np.int32)
        at = np.searchsorted(head_ids, ids).clip(max=len(head_ids) - 1)
        if len(heads := np.flatnonzero(head_ids[at] == ids)):
            rows = np.concatenate([rows, heads])
            bucket = np.concatenate([bucket, head_to[at[heads]]])
            extra = np.concatenate([extra, np.ones(len(heads), np.int32)])
        texts = [z.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(extra, pa.int32()), pa.array(ids[rows], pa.int64()),
                                          batch.column("doc_id").is_null().take(pa.array(rows)), pa.array([texts[i] for i in rows], pa.binary())],
                                         names=["bucket", "extra", "doc_id", "no_id", "text"])


REPORT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_prefix long"


def _fingerprints(batches):
    """Rows sorted by (bucket, extra, doc_id, text): each is held against the row after it."""
    z = zstandard.ZstdDecompressor()
    held, out = None, []

    def against(one, text, prefix, f):
        doc_id, own_text, own, own_f = one
        half = own.n // 2
        edited = own_text[:own.n - half] + text[:half]
        p = Prefix(edited)
        e = p.fingerprint()
        return (doc_id, own.n, hashlib.sha256(edited.encode()).hexdigest(), own_f, e, likeness(own_f, e), likeness(own_f, f), own.extension(0, p, 0))

    def flush():
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
        names = [x.split()[0] for x in REPORT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    for batch in batches:
        for bucket, extra, doc_id, no_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "extra", "doc_id", "no_id", "text"))):
            if held is None and extra:
                continue  # only the first of the rows from the next bucket counts
            text = z.decompress(text).decode()
            prefix = Prefix(text)
            f = prefix.fingerprint()
            if held is not None:
                out.append(against(held, text, prefix, f))
            held = None if extra else (None if no_id else doc_id, text, prefix, f)
            if len(out) >= 512:
                yield flush()
                out = []
    if out:
        yield flush()


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): columns of ``REPORT``.

    The edited text keeps the first code points but the last floor(n_chars / 2), and puts in their place as many
    from the start of the next document (or all it has): the next by ascending doc_id, after the last the first. Null ids
    come first; rows of one doc_id follow each other in a fixed order of their bytes. Null texts count as empty. near_edited and near_next are the
    likeness of the text's fingerprint to the edited text's and to the next document's; edited_prefix is the longest
    common prefix of text and edited text. A single document is its own next one; an empty table gives an empty result.

    Documents are range-partitioned by doc_id, once, by ids sampled in proportion to the ranges; the driver
    knows no more of a range than those and its least doc_id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    size, n = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], REPORT)
    buckets = max(partitions(spark), int(size) // BUCKET_BYTES + 1)
    share = min(1.0, max(SAMPLE_DOCS, BUCKET_KEYS * buckets) / n)
    some = docs.sample(share, seed=41).select(F.coalesce("doc_id", F.lit(FIRST_ID)).alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).toArrow()
    splitters = splitters_of(some.column(0).to_numpy(), some.column(1).to_numpy(), buckets)
    held = spark.sparkContext.broadcast(splitters)

    def least(batches):
        found: dict[int, int] = {}
        for batch in batches:
            ids = np.sort(batch.column("doc_id").fill_null(FIRST_ID).to_numpy(zero_copy_only=False))
            to = np.searchsorted(held.value, ids, "right")
            for b, i in zip(*np.unique(to, return_index=True)):
                found[int(b)] = min(found.get(int(b), 2**63 - 1), int(ids[i]))
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int32()), pa.array(found.values(), pa.int64())], names=["bucket", "head"])

    heads = docs.select("doc_id").mapInArrow(least, "bucket int, head long").groupBy("bucket").agg(F.min("head").alias("head")).toArrow().sort_by("bucket")
    # Ranges in order have heads in order; each head also goes to the range before its own.
    shared = spark.sparkContext.broadcast((splitters, heads.column("head").to_numpy(), np.roll(heads.column("bucket").to_numpy(), 1)))
    rows = docs.mapInArrow(partial(_bucketed, shared=shared), "bucket int, extra int, doc_id long, no_id boolean, text binary")
    return rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "extra", "doc_id", "text").mapInArrow(_fingerprints, REPORT)
