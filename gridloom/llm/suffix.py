"""Suffix-array deduplication of byte strings that documents share.

Sorting a suffix for every byte would shuffle many times the corpus, so the suffix array
is sparse: of every window of ``length`` bytes the least seed (by a hash of its ``SEED``
bytes, leftmost on ties) is an anchor. Equal windows choose the same anchor, hence no
shared string is missed. An anchor's suffix stands for the run of windows that chose it:
its context.

1. Each task sorts its anchors and combines equal contexts: all but those of its least
   document are removed at once. The rest go to buckets that sampled splitters
   range-partition by the leading bytes of the suffix and then its context, so that not even
   one seed with very many contexts makes a large bucket.
2. A bucket sorts locally by multikey quicksort (8 leading bytes, the next 8 and the context,
   doc_id). Runs of one context are compared with the run's least document.
3. Where runs of one seed hold different contexts, the contexts themselves are fetched
   and compared window by window, again against the least document of each window. A context
   that this document holds in several places is fetched once and goes in all of them. A seed
   that reaches across a boundary (it is that of a splitter) is compared with its other buckets:
   its windows are combined by the tasks that fetch them and meet by their hash, wherever they were.
4. The removed ranges meet the texts, bucketed by document, and are cut out.

Hot strings reach a bucket once a task, whatever the number of documents that hold them.
Positions, ranges and contexts travel as compressed column blocks, not as rows.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, flat, mix, partitions, parts_of, settled, slices

SEED = 16
#: Text of a bucket, and how many groups the contexts and windows of one bucket are compared in.
BUCKET_BYTES, SPREAD = 12 << 20, 4
#: Bytes of anchors that a task sorts and combines at once.
HELD_BYTES = 8 << 20
#: For splitters: documents sampled at least, keys of each, and keys a bucket beyond that. The driver holds no more.
SAMPLE_DOCS, SAMPLE_KEYS, BUCKET_KEYS = 2000, 32, 4
#: Rows up to which quicksort leaves the rest to a plain sort, and windows that a task combines at once.
SMALL, HELD_WINDOWS = 4096, 2_000_000
_U = np.uint64
_C = np.random.default_rng(11).integers(1, 2**63, 12, dtype=np.uint64) | _U(1)
NULL_ID = np.iinfo(np.int64).max


def pack(columns: dict[str, np.ndarray]) -> bytes:
    """Columns as byte planes under zstd: small integers cost no more than their low bytes."""
    head = ";".join(f"{k},{v.dtype.str},{len(v)}" for k, v in columns.items()).encode()
    planes = b"".join(np.ascontiguousarray(v).view(np.uint8).reshape(len(v), v.dtype.itemsize).T.tobytes() for v in columns.values())
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + planes)


def unpack(block: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n = int.from_bytes(raw[:4], "little")
    out, at = {}, 4 + n
    for item in raw[4:4 + n].decode().split(";"):
        name, kind, rows = item.split(",")
        kind, rows = np.dtype(kind), int(rows)
        planes = np.frombuffer(raw, np.uint8, rows * kind.itemsize, at).reshape(kind.itemsize, rows)
        out[name] = np.ascontiguousarray(planes.T).reshape(-1).view(kind) if rows else np.zeros(0, kind)
        at += rows * kind.itemsize
    return out


def stack(blocks: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([b[k] for b in blocks]) for k in blocks[0]} if blocks else {}


def _at(padded: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes at each of n positions, little endian."""
    return np.ndarray((n,), "<u8", padded, strides=(1,))


def window_hash(x: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of the ``length`` >= 8 bytes at each start; x is ``_at`` of the bytes."""
    h = np.zeros(len(starts), np.uint64)
    for i, o in enumerate([*range(0, length - 8, 8), length - 8]):
        h ^= x[starts + o] * _C[i % 12]
        h = (h ^ (h >> _U(29))) * _C[(i + 5) % 12]
    return mix(h)


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int):
    """(x, a, b, m): windows a..b, by start, have their anchor at m."""
    n, w = len(buf), length - SEED + 1
    padded = np.zeros(n + 64, np.uint8)
    padded[:n] = buf
    x = _at(padded, n + 48)
    none = np.zeros(0, np.int64)
    if n < length:
        return x, none, none, none
    h = x[:n] * _C[0] + (x[8:n + 8] ^ (x[8:n + 8] >> _U(23))) * _C[1]
    h ^= h >> _U(31)
    h *= _C[2]
    low = (h & _U(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    have = 1
    while have * 2 <= w:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < w:
        low = np.minimum(low[:len(low) - (w - have)], low[w - have:])
    change = np.zeros(n + 1, np.int32)
    size = np.diff(offsets)
    long = size >= length
    np.add.at(change, offsets[:-1][long], 1)
    np.add.at(change, offsets[1:][long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(change[:n]) > 0)
    m = (low[starts] & _U(0xFFFFFFFF)).astype(np.int64)
    if not len(m):
        return x, none, none, none
    first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(m) - 1]])
    return x, starts[first], starts[last], m[first]


def multikey_quicksort(keys: list[np.ndarray]) -> np.ndarray:
    """Order of rows by several keys, the first the most significant; equal rows stay in order.

    Rows are parted into those below, at and above a pivot of the current key; only those at it go on to the next key.
    """
    order = np.arange(len(keys[0]))
    stack = [(0, len(order), 0)]
    while stack:
        low, high, depth = stack.pop()
        part = order[low:high]
        if len(part) <= SMALL:
            order[low:high] = part[np.lexsort([k[part] for k in keys[depth:][::-1]])]
            continue
        k = keys[depth][part]
        some = k[::max(1, len(k) // 64)]
        pivot = np.partition(some, len(some) // 2)[len(some) // 2]
        below, above = k < pivot, k > pivot
        a, b = low + int(below.sum()), high - int(above.sum())
        order[low:high] = np.concatenate([part[below], part[~(below | above)], part[above]])
        stack += [(i, j, d) for i, j, d in ((low, a, depth), (a, b, depth + 1), (b, high, depth)) if j - i > 1 and d < len(keys)]
    return order


def _least(keys: list[np.ndarray], doc: np.ndarray):
    """Sort by keys, the first the most significant, then doc: (order, group of each, group starts)."""
    order = multikey_quicksort([*keys, doc])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def _ids(column) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def _records(batch, length: int):
    """Anchor columns of each slice of a batch with _id, _tag and text."""
    buf, offsets = flat(batch.column("text"))
    ids, tags = _ids(batch.column("_id")), batch.column("_tag").to_numpy(zero_copy_only=False)
    for i, j in slices(offsets):
        own = offsets[i:j + 1] - offsets[i]
        x, a, b, m = anchors(buf[offsets[i]:offsets[j]], own, length)
        row = np.searchsorted(own, a, "right") - 1
        context = mix(window_hash(x, a, length) + mix(window_hash(x, b, length) ^ ((b - a) * 64 + (m - a)).astype(np.uint64)))
        yield {
            "k0": x[m].byteswap(), "k1": (mix(x[m + 8]) >> _U(48)).astype(np.uint16), "c0": (context >> _U(32)).astype(np.uint32), "c1": context.astype(np.uint16),
            "doc": ids[i + row], "tag": tags[i + row], "a": (a - own[row]).astype(np.uint32), "ma": (m - a).astype(np.uint8), "n": (b - a).astype(np.uint8),
        }


def _key(r) -> list[np.ndarray]:
    """Leading bytes; digests of the next bytes and of the context."""
    return [r["k0"], (r["k1"].astype(np.uint64) << _U(48)) | (r["c0"].astype(np.uint64) << _U(16)) | r["c1"]]


def split_at(keys: list[np.ndarray], splitters: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Where the ranges between splitters begin and end in sorted keys; a splitter begins the range after it."""
    first = np.searchsorted(keys[0], splitters[0], "left")
    last = np.searchsorted(keys[0], splitters[0], "right")
    for i in np.flatnonzero(first < last):
        first[i] += np.searchsorted(keys[1][first[i]:last[i]], splitters[1][i], "left")
    return np.concatenate([[0], first, [len(keys[0])]])


def _splitters(k0: np.ndarray, k1: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """At most buckets - 1 quantiles of the distinct keys of a sample, in order."""
    order = multikey_quicksort([k0, k1])
    k0, k1 = k0[order], k1[order]
    new = np.ones(len(k0), bool)
    new[1:] = (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])
    at = np.flatnonzero(new)
    at = at[np.unique(np.linspace(0, len(at), buckets + 1).astype(int)[1:-1])] if len(at) else at
    return k0[at], k1[at]


def _spans(r, chosen, length: int) -> dict[str, np.ndarray]:
    return {"doc": r["doc"][chosen], "tag": r["tag"][chosen], "a": r["a"][chosen], "n": (r["n"][chosen].astype(np.uint16) + np.uint16(length))}


def _by_doc(kind: int, columns: dict[str, np.ndarray], buckets: int):
    """Blocks (kind, bucket of the document, bytes)."""
    if not len(columns["doc"]):
        return
    to = doc_bucket(columns["doc"], buckets)
    order = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(edges)):
        part = order[edges[k]:edges[k + 1]]
        yield kind, int(k), pack({c: v[part] for c, v in columns.items()})


def doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64)) % _U(buckets)).astype(np.int64)


def _blocks(rows):
    rows = list(rows)
    kind, to, block = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(to, pa.int32()), pa.array(block, pa.binary())], names=["kind", "bucket", "block"])


BLOCKS = "kind int, bucket int, block binary"


@settled
def _map(batches, length, shared, held_bytes=HELD_BYTES):
    held, size, splitters = [], 0, shared.value

    def out():
        r = stack(held)
        held.clear()
        order, group, start = _least(_key(r), r["doc"])
        r = {k: v[order] for k, v in r.items()}
        later = r["doc"] > r["doc"][start][group]
        # Spans go along in buckets of their own kind, any bucket will do.
        yield 0, int(r["k0"][0] % _U(len(splitters[0]) + 1)), pack(_spans(r, later, length))
        r = {k: v[~later] for k, v in r.items()}
        edges = split_at(_key(r), splitters)
        for k in np.flatnonzero(np.diff(edges)):
            yield 1, int(k), pack({c: v[edges[k]:edges[k + 1]] for c, v in r.items()})

    for batch in parts_of(batches):
        for r in _records(batch, length):
            held.append(r)
            size += 20 * len(r["a"])
            if size >= held_bytes:
                yield _blocks(out())
                size = 0
    if sum(len(r["a"]) for r in held):
        yield _blocks(out())


def _bucket(key, table, length, buckets, shared):
    """One bucket of suffixes: spans (kind 0) and contexts to compare within it (kind 1) or with other buckets (kind 2), by document."""
    number = key[0].as_py()
    kinds = table.column("kind").to_pylist()
    blocks = [unpack(b) for b in table.column("block").to_pylist()]
    rows = [_by_doc(0, stack([b for k, b in zip(kinds, blocks) if k == 0]), buckets)] if 0 in kinds else []
    r = stack([b for k, b in zip(kinds, blocks) if k == 1])
    if r:
        order, group, start = _least(_key(r), r["doc"])
        r = {k: v[order] for k, v in r.items()}
        later = r["doc"] > r["doc"][start][group]
        rows.append(_by_doc(0, _spans(r, later, length), buckets))
        head = {k: v[start] for k, v in r.items()}
        new = np.concatenate([[True], (head["k0"][1:] != head["k0"][:-1]) | (head["k1"][1:] != head["k1"][:-1])])
        seed = np.cumsum(new) - 1
        contexts = np.bincount(seed)
        least, most = (f.reduceat(head["doc"], np.flatnonzero(new)) for f in (np.minimum, np.maximum))
        across = np.zeros(len(seed), bool)
        for i in (number - 1, number):
            if 0 <= i < len(shared.value[0]):
                across |= (head["k0"] == shared.value[0][i]) & (head["k1"] == (shared.value[1][i] >> _U(48)).astype(np.uint16))
        inside = ((contexts > 1) & (least < most))[seed] & ~across
        # Seeds are dealt anew: which of them have contexts to compare does not follow their order.
        to = (mix(head["k0"] ^ head["k1"]) % _U(buckets * SPREAD)).astype(np.int32)
        # A context goes wherever its least document holds it; one of the seed's least document stays, and one place will do.
        one = np.zeros(len(group), bool)
        one[start] = True
        for kind, ask in ((1, inside), (2, across)):
            ask = ask[group] & ~later & (one | (across | (head["doc"] > least[seed]))[group])
            rows.append(_by_doc(kind, {c: r[c][ask] for c in ("doc", "tag", "a", "n")} | {"to": to[group[ask]]}, buckets))
    return pa.Table.from_batches([_blocks(x for part in rows for x in part)])


def _texts(table):
    """(id, tag) of each row, and its bytes."""
    z = zstandard.ZstdDecompressor()
    return list(zip(_ids(table.column("_id")).tolist(), table.column("_tag").to_pylist())), (z.decompress(x) for x in table.column("text").to_pylist())


def _ranges(table):
    """The blocks of a document bucket, by (id, tag): slices of columns sorted so, among them the block's kind."""
    r = stack([(b := unpack(x)) | {"kind": np.full(len(b["doc"]), k, np.int8)} for k, x in zip(table.column("kind").to_pylist(), table.column("block").to_pylist())])
    if not r:
        return {}, r
    order = np.lexsort([r["a"], r["tag"], r["doc"]])
    r = {k: v[order] for k, v in r.items()}
    new = np.flatnonzero(np.concatenate([[True], (r["doc"][1:] != r["doc"][:-1]) | (r["tag"][1:] != r["tag"][:-1])]))
    return {(int(r["doc"][i]), int(r["tag"][i])): (i, j) for i, j in zip(new, [*new[1:], len(order)])}, r


def _windows(texts: list[bytes], r, length: int):
    """Every window of contexts: its hash, the context it is of, and its start therein."""
    count = r["n"].astype(np.int64) + 1
    text = np.frombuffer(b"".join(texts), np.uint8)
    base = np.concatenate([[0], np.cumsum(count + length - 1)])[:-1]
    owner = np.repeat(np.arange(len(count), dtype=np.int32), count)
    step = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
    padded = np.zeros(len(text) + 64, np.uint8)
    padded[:len(text)] = text
    return window_hash(_at(padded, len(text) + 48), base[owner] + step, length), owner, step


def _placed(r, owner, of, at):
    """Contexts are in several places, the i-th at at[i] if it is of[i]: for each place of each item, by its sorted owner, (item, doc, tag, place)."""
    low = np.searchsorted(owner, of, "left")
    count = np.searchsorted(owner, of, "right") - low
    place = np.repeat(np.arange(len(of)), count)
    item = np.arange(len(place)) + np.repeat(low - np.cumsum(count) + count, count)
    return item, r["doc"][of[place]], r["tag"][of[place]], at[place]


def _merged(r, of, at, owner, step, hit, length: int):
    """Spans of windows that go, neighbours of one context made one range, wherever the context is."""
    hit = np.sort(hit)
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])
    first, last = hit[new], hit[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(hit) - 1]])] if len(hit) else hit
    i, doc, tag, a = _placed(r, owner[first], of, at)
    first, last = step[first][i], step[last][i]
    return {"doc": doc, "tag": tag, "a": (a + first).astype(np.uint32), "n": (last - first + length).astype(np.uint16)}


def _dealt(texts: list[bytes], r, of, at, length: int, buckets: int):
    """Windows of contexts whose seed is in several buckets: those that an earlier document of this task holds go (kind 0), the others meet by hash (kind 3)."""
    h, owner, step = _windows(texts, r, length)
    doc = r["doc"][owner]
    order, group, start = _least([h], doc)
    later = doc[order] > doc[order][start][group]
    yield from _by_doc(0, _merged(r, of, at, owner, step, order[later], length), buckets)
    left = np.sort(order[~later])
    i, doc, tag, a = _placed(r, owner[left], of, at)
    left = left[i]
    h, a = h[left], (a + step[left]).astype(np.uint32)
    to = (h % _U(buckets * SPREAD)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[by], np.arange(buckets * SPREAD + 1))
    for k in np.flatnonzero(np.diff(edges)):
        x = by[edges[k]:edges[k + 1]]
        yield 3, int(k), pack({"h": h[x], "doc": doc[x], "tag": tag[x], "a": a[x]})


def _fetch(docs, asks, length, buckets, held):
    """Contexts asked for: as they are, by seed (kind 1), or in windows."""
    where, r = _ranges(asks)
    if not where or not docs.num_rows:
        return pa.Table.from_batches([_blocks([])])
    # Distinct contexts of each document; the ask that each was first met by; for every ask, the context.
    rows, seen, size = [], set(), 0
    parts, meta, places = ({1: [], 2: []} for _ in range(3))

    def found(kind):
        of, at = np.array(places[kind], np.int64).reshape(-1, 2).T
        return parts[kind], np.array(meta[kind], np.int64), of, at

    def across():
        nonlocal size
        text, first, of, at = found(2)
        if text:
            rows.extend(_dealt(text, {c: r[c][first] for c in ("doc", "tag", "n")}, of, r["a"][at], length, buckets))
        parts[2], meta[2], places[2], size = [], [], [], 0

    for key, text in zip(*_texts(docs)):
        if key not in where or key in seen:
            continue
        seen.add(key)
        i, j = where[key]
        known, asked = {}, set()
        for at, a, n, kind in zip(range(i, j), r["a"][i:j].tolist(), r["n"][i:j].tolist(), r["kind"][i:j].tolist()):
            if a in asked:
                continue
            asked.add(a)
            context = text[a:a + n + length]
            of = known.setdefault((kind, context), len(parts[kind]))
            if of == len(parts[kind]):
                parts[kind].append(context)
                meta[kind].append(at)
            places[kind].append((of, at))
            size += n + 1 if kind == 2 else 0
        if size >= held:
            across()
    across()
    text, first, of, at = found(1)
    order = np.argsort(r["to"][first], kind="stable")
    of, first = np.argsort(order)[of], first[order]
    by = np.argsort(of, kind="stable")
    of, at = of[by], at[by]
    new = np.flatnonzero(np.diff(r["to"][first], prepend=-1))
    for i, j in zip(new, [*new[1:], len(first)]):
        p, q = np.searchsorted(of, (i, j))
        rows.append((1, int(r["to"][first[i]]), pack({c: r[c][first[i:j]] for c in ("doc", "tag", "n")} | {
            "of": (of[p:q] - i).astype(np.uint32), "at": r["a"][at[p:q]], "text": np.frombuffer(b"".join(text[k] for k in order[i:j]), np.uint8)})))
    return pa.Table.from_batches([_blocks(rows)])


def _compare(key, table, length, buckets):
    """Every window of the contexts of some seeds, and of those that met by hash, against the least document that holds it."""
    by: dict[int, list] = {}
    for kind, block in zip(table.column("kind").to_pylist(), table.column("block").to_pylist()):
        by.setdefault(kind, []).append(unpack(block))
    rows = []
    if 0 in by:
        rows.append(_by_doc(0, stack(by[0]), buckets))
    if 1 in by:
        text, size = [b.pop("text").tobytes() for b in by[1]], np.cumsum([0, *(len(b["n"]) for b in by[1])])
        r = stack([b | {"of": b["of"] + n} for b, n in zip(by[1], size)])
        of, at = r.pop("of"), r.pop("at")
        h, owner, step = _windows(text, r, length)
        del text
        doc = r["doc"][owner]
        order, group, start = _least([h], doc)
        doc = doc[order]
        later = order[doc > doc[start][group]]
        del h, group, order, doc
        rows.append(_by_doc(0, _merged(r, of, at, owner, step, later, length), buckets))
    if 3 in by:
        r = stack(by[3])
        order, group, start = _least([r["h"]], r["doc"])
        r = {k: v[order] for k, v in r.items()}
        later = r["doc"] > r["doc"][start][group]
        rows.append(_by_doc(0, {k: r[k][later] for k in ("doc", "tag", "a")} | {"n": np.full(later.sum(), length, np.uint16)}, buckets))
    return pa.Table.from_batches([_blocks(x for part in rows for x in part)])


def _cover(where, r, key, n):
    """Removed bytes of one text as a mask, and the number of maximal runs."""
    if key not in where:
        return None, 0
    i, j = where[key]
    change = np.zeros(n + 1, np.int32)
    a = r["a"][i:j].astype(np.int64)
    np.add.at(change, a, 1)
    np.add.at(change, a + r["n"][i:j], -1)
    gone = np.cumsum(change[:n]) > 0
    return gone, int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


def _report(docs, spans):
    where, r = _ranges(spans)
    out = {"doc_id": docs.column("_id").cast(pa.int64()), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
    for key, text in zip(*_texts(docs)):
        gone, runs = _cover(where, r, key, len(text))
        kept = text if gone is None else np.frombuffer(text, np.uint8)[~gone].tobytes()
        for name, x in zip(list(out)[1:], (len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest())):
            out[name].append(x)
    return pa.table({k: v if k == "doc_id" else pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()})


def _without(docs, spans, names):
    where, r = _ranges(spans)
    texts, chars = [], []
    for key, text in zip(*_texts(docs)):
        gone, _ = _cover(where, r, key, len(text))
        texts.append((text if gone is None else np.frombuffer(text, np.uint8)[~gone].tobytes()).decode(errors="ignore"))
        chars.append(len(texts[-1]))
    null = docs.column("_null").to_pylist()
    new = {"text": pa.array([None if x else t for t, x in zip(texts, null)], pa.string()), "n_chars": pa.array([None if x else n for n, x in zip(chars, null)], pa.int64())}
    return pa.table({c: new[c] if c in new else docs.column(c) for c in names})


@settled
def _packed(batches, buckets):
    z = zstandard.ZstdCompressor(level=1)
    for batch in parts_of(batches):
        to = doc_bucket(_ids(batch.column("_id")), buckets).astype(np.int32)
        cols = {n: batch.column(n) for n in batch.schema.names}
        text = cols["text"]
        cols |= {"_null": text.is_null(), "text": pa.array([z.compress((t or "").encode()) for t in text.to_pylist()], pa.binary()), "_to": pa.array(to, pa.int32())}
        yield pa.RecordBatch.from_pydict(cols)


def _leading(batches, length):
    """Up to ``SAMPLE_KEYS`` keys of each sampled document's suffixes, in blocks."""
    for batch in batches:
        keys = []
        for r in _records(batch, length):
            k0, k1 = _key(r)
            some = np.argsort(mix(k0 ^ k1))[:SAMPLE_KEYS * (len(np.unique(r["doc"])) or 1)]
            keys.append({"k0": k0[some], "k1": k1[some]})
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([pack(stack(keys))], pa.binary())], names=["block"])


def _ranged(docs: DataFrame, length: int):
    """(texts by document bucket, removed ranges by document bucket) of docs with text, _id, _tag."""
    spark = docs.sparkSession
    n, size = docs.select("_id", F.octet_length("text").alias("n")).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = max(partitions(spark), int(size) // BUCKET_BYTES + 1)
    slim = docs.select("_id", "_tag", "text")
    wanted = max(SAMPLE_DOCS, buckets * BUCKET_KEYS // SAMPLE_KEYS)
    sample = slim.sample(min(1.0, 1.2 * wanted / max(n, 1)), seed=5)
    keys = stack([unpack(r.block) for r in sample.mapInArrow(partial(_leading, length=length), "block binary").collect()])
    shared = spark.sparkContext.broadcast(_splitters(keys["k0"], keys["k1"], buckets) if keys else (np.zeros(0, np.uint64),) * 2)
    by = lambda df: df.groupBy("bucket")

    suffixes = slim.mapInArrow(partial(_map, length=length, shared=shared), BLOCKS)
    step = partial(_bucket, length=length, buckets=buckets, shared=shared)
    found = cut(by(suffixes).applyInArrow(lambda key, t: step(key, t), BLOCKS))
    kinds = docs.schema
    packed_schema = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in kinds) + ", _null boolean, _to int"
    pack_texts = partial(_packed, buckets=buckets)
    asked = found.where("kind > 0")
    slim_packed = slim.mapInArrow(pack_texts, f"_id long, _tag {kinds['_tag'].dataType.simpleString()}, text binary, _null boolean, _to int")
    fetch, compare = partial(_fetch, length=length, buckets=buckets, held=HELD_WINDOWS), partial(_compare, length=length, buckets=buckets)
    contexts = slim_packed.groupBy("_to").cogroup(by(asked)).applyInArrow(lambda a, b: fetch(a, b), BLOCKS)
    edges = by(contexts).applyInArrow(lambda key, t: compare(key, t), BLOCKS)
    spans = found.where("kind = 0").union(edges)
    return docs.mapInArrow(pack_texts, packed_schema).groupBy("_to"), spans.groupBy("bucket")


def _prepared(docs: DataFrame) -> DataFrame:
    docs = docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    twice = docs.groupBy("_id").count().where("count > 1").limit(1).count()
    return docs.withColumn("_tag", F.xxhash64("text") if twice else F.lit(0))


def repeated_bytes(docs: DataFrame, length: int = 50) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of ``length`` UTF-8 bytes that covers it also starts in a document with a
    smaller doc_id; strings never cross documents and are judged on the input. Null and empty texts
    have 0 bytes. A null doc_id counts as greater than any other; rows of one doc_id never remove each
    other's bytes and each gives a row. An empty table gives an empty result; other columns are ignored.
    """
    texts, spans = _ranged(_prepared(docs.select("doc_id", "text")).select("_id", "_tag", "text"), length)
    return texts.cogroup(spans).applyInArrow(_report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` with repeated strings (see ``repeated_bytes``) cut out of text; n_chars, if there, follows.

    A code point that loses some of its bytes goes whole. Null texts stay null.
    """
    # Other columns travel under names of their own, so that none can clash.
    names = [c if c in ("doc_id", "text", "n_chars") else f"c{i}" for i, c in enumerate(docs.columns)]
    inner = docs.toDF(*names)
    schema = ", ".join(f"{f.name} {'string' if f.name == 'text' else 'long' if f.name == 'n_chars' else f.dataType.simpleString()}" for f in inner.schema)
    texts, spans = _ranged(_prepared(inner), length)
    return texts.cogroup(spans).applyInArrow(lambda a, b: _without(a, b, names), schema).toDF(*docs.columns)
