"""What the corpus operators share: lineage cuts, byte-level batches, components.

Texts travel through Arrow as UTF-8 and are handled as flat byte arrays in
slices of a few MB, so memory does not depend on how many rows a batch holds;
one document is the only thing that has to fit in a task whole.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import shared_dir

#: Bytes of text handled at once by the numpy kernels.
SLICE_BYTES = 1 << 19

#: ASCII white space: tab to carriage return, and the blank.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
WORD = r"[^\x20\x09-\x0D]+"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15 | 5)
_PINV = np.uint64(pow(int(_P), -1, 2**64))


# ---- Spark ---------------------------------------------------------------

def free(df: DataFrame, name: str) -> str:
    """The name, or with as many underscores behind it as it takes not to be that of a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder; a lost executor then costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Links that one task contracts at once.
CONTRACTED = 250_000


def _contracted(batches):
    """Union-find over one task's links: (u, v) from each node to the least of its set."""
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root.setdefault(a, a)
            root.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    rows = [(x, find(x)) for x in root]
    for i in range(0, len(rows), 10_000):
        part = rows[i:i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in part], kind) for k in (0, 1)], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, root being the least node reachable.

    ``edges`` has columns a, b of one orderable type. They are dealt to tasks of about ``CONTRACTED``
    links, each of which joins what it can by union-find; what several tasks hold is joined by alternating large-star
    and small-star rounds until a round changes nothing. A round is made of map-side combined minima and
    equi-joins, so no node's neighbours are ever gathered in one place.
    """
    e = cut(edges.where("a <> b").select("a", "b"))
    tasks = e.count() // CONTRACTED + 1
    kind = e.schema["a"].dataType.simpleString()
    e = cut(e.repartition(tasks).mapInArrow(_contracted, f"u {kind}, v {kind}"))
    if tasks == 1:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    e = e.where("u <> v")

    def mark(x: DataFrame):
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")
        ).select("x.*").where("u <> v").distinct()
        e = cut(small)
        now = mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def named(least, key) -> F.Column:
    """Name of a class of rows that sorts as its least id, null last: nine bytes of that, then some of the class's own key.

    The least name of a component then tells its least id, without another look at its members.
    """
    digits = F.lpad(F.hex(least.bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.when(least.isNull(), F.concat(F.unhex(F.lit("01" + "0" * 16)), key)).otherwise(F.concat(F.unhex(F.concat(F.lit("00"), digits)), F.substring(key, 1, 8)))


def first_id(node) -> F.Column:
    """The least id that a class is named by."""
    n = F.conv(F.hex(F.substring(node, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(2**63)))
    return F.when(F.hex(F.substring(node, 1, 1)) == "00", n)


# ---- Arrow and numpy -----------------------------------------------------

def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of an Arrow string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    elif pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def parts_of(batches, rows: int = 512):
    """Batches of fewer rows: what is made of a batch in Python is held only for these."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def settled(run):
    """A task's generator after which the worker, which Spark keeps for later tasks, gives freed memory back."""
    @functools.wraps(run)
    def wrapped(*args, **more):
        try:
            yield from run(*args, **more)
        finally:
            settle()
    return wrapped


def settle() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges of at most ``limit`` bytes, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("_POW", _P), ("_INV", _PINV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            globals()[name] = np.cumprod(x, dtype=np.uint64)
    return _POW, _INV


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, equal for equal spans wherever they are."""
    n = len(buf)
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * power[:n], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h ^ (ends - starts).astype(np.uint64))


def words(buf: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """Per word: start, end, document row and a 64-bit hash of its bytes. Words never span rows."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    if lower:
        buf = LOWER[buf]
    gap = SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    starts = np.flatnonzero(~gap & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, gap[1:]
    ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows, span_hashes(buf, starts, ends)


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each document; a shorter text is one shingle."""
    m = np.uint64(0xD6E8FEB86659FD93)
    full = np.zeros(0, np.uint64)
    if len(hashes) >= k:
        full = hashes[:len(hashes) - k + 1].copy()
        for j in range(1, k):
            full = mix(full * m + hashes[j:len(hashes) - k + 1 + j])
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            out.append(np.unique(full[at:at + c - k + 1]))
        elif c:
            x = hashes[at:at + 1].copy()
            for j in range(1, c):
                x = mix(x * m + hashes[at + j:at + j + 1])
            out.append(mix(x + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def shingle_sets(texts, k: int):
    """Shingle hash sets of an Arrow string column, row by row."""
    buf, offsets = flat(texts)
    for i, j in slices(offsets):
        own = offsets[i:j + 1] - offsets[i]
        _, _, rows, h = words(buf[offsets[i]:offsets[j]], own)
        yield from shingles(h, np.bincount(rows, minlength=j - i), k)
