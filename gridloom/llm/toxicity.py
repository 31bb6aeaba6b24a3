"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, one of the toxic and one of the ordinary training documents, count in
how many documents an expression occurs, so that a text that repeats itself teaches once. They
share their backoff weights and their last backoff, the number of distinct words that a word
follows, pooled over both classes and saturating at ``SATURATE``. A rare expression thus has
nearly the same probability under both and says little; one that a class uses often departs from it.

A text is scored by its log-likelihood ratios over its distinct expressions, normalised by
length in four ways: their mean, their sum by the square root of their number, the share of
strong ones likewise, and the mean of the ``TOP`` strongest (plain means drown a few
insults in a long text). A logistic fit on training documents that the counts leave out joins them.
A bigram moves the ratio of its word by at most ``SHIFT``: groups of near copies make
bigrams that only one class has, and these must not count as toxic.

The counts cover every labelled training document, however many there are, but those of the logistic fit, a bounded sample: at most ``PER_CLASS``
documents of either class. The tables are keyed by the words and bigrams themselves (64-bit hashes), so they grow
with the vocabulary and no two expressions share an entry. They are counted in parts of the bigrams, then of the words, that grow in number
with the training documents. What the discounts leave nothing of has the ratio of an unseen word, or of its word,
so only the other entries are kept. Up to ``FILE_BYTES`` of them go in a file that executors fetch and their workers map, of which
the driver holds one part at a time. Beyond that no task sees the whole table: texts are cut into slices, each slice asks for its distinct
expressions, and the answers come back to it (``_dealt_out``). Scoring takes every text whole.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, flat, free, mix, settled, slices, words
from gridloom.llm.suffix import pack, stack, unpack

PER_CLASS = 6000
#: Training documents a part of the bigrams, such parts to one of the words, rows of (doc_id, class) that a broadcast may hold.
PART_DOCS, FAN, BROADCAST_ROWS = 5_000, 4, 1_000_000
DISCOUNT_PAIR, DISCOUNT_WORD, SATURATE, SHIFT, STRONG, TOP = 5, 2, 2, 0.5, 3.0, 3
#: Bytes of ratios that executors may fetch as a file; beyond, bytes of ratios a part, of text a slice, and slices that ask one copy of a part, for each part.
FILE_BYTES, TABLE_BYTES, PIECE_BYTES, ASKING = 512 << 20, 16 << 20, 8 << 20, 4
FEATURES = 4
FLOOR = 1e-15
_U = np.uint64
_START = _U(0x51ED270B)
_HIGH = _U(24)
# Words here are runs of letters and digits: ASCII punctuation separates too.
_PLAIN = np.arange(256, dtype=np.uint8)
for _c in range(128):
    if not chr(_c).isalnum():
        _PLAIN[_c] = 32


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def _tokens(column):
    """Per slice of rows: first row, number of rows, then of each distinct (context, word) of a row: row, word hash, context hash."""
    buf, offsets = flat(column)
    for i, j in slices(offsets):
        own = offsets[i:j + 1] - offsets[i]
        _, _, rows, h = words(_PLAIN[buf[offsets[i]:offsets[j]]], own)
        before = np.empty_like(h)
        if len(h):
            before[1:] = h[:-1]
            before[np.concatenate([[True], rows[1:] != rows[:-1]])] = _START
        one = _distinct(rows, mix(before * _U(3) + h))
        yield i, j - i, rows[one], h[one], before[one]


def _distinct(rows, key) -> np.ndarray:
    """Positions where a key occurs first in its row, in order."""
    return np.sort(np.unique(key + rows.astype(np.uint64) * _U(0x9E3779B97F4A7C15), return_index=True)[1])


def _part(h, parts):
    """Part of a word: ranges of the hash in order."""
    return (((h >> (_U(64) - _HIGH)) * _U(parts)) >> _HIGH).astype(np.int64)


def _key(before, h):
    """Bigram key: the leading bits of its word, so that parts of the words are ranges of it, and 40 of its own."""
    low = _U(64) - _HIGH
    return (h >> low << low) | (mix(before * _U(0x9E3779B97F4A7C15) + h) >> _HIGH)


@settled
def _pairs(batches, parts):
    """Distinct (context, word, class) of a task's texts with counts, dealt to parts by bigram."""
    held = []

    def out():
        r = stack(held)
        if not len(r.get("w", ())):
            return
        order = np.lexsort([r["y"], r["w"], r["v"]])
        r = {k: x[order] for k, x in r.items()}
        new = np.concatenate([[True], (r["v"][1:] != r["v"][:-1]) | (r["w"][1:] != r["w"][:-1]) | (r["y"][1:] != r["y"][:-1])])
        at = np.flatnonzero(new)
        n = np.diff(np.concatenate([at, [len(new)]])).astype(np.uint32)
        first = np.add.reduceat(r["first"].astype(np.uint32), at)
        r = {k: r[k][new] for k in "vwy"} | {"n": n, "first": first.astype(np.uint32)}
        part = (mix(r["v"] * _U(0xD6E8FEB86659FD93) + r["w"]) % _U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        found, edges = np.unique(part[order], return_index=True)
        for c, i, j in zip(found.tolist(), edges, [*edges[1:], len(order)]):
            yield c, pack({k: x[order[i:j]] for k, x in r.items()})

    def batch_of(rows):
        part, block = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.binary())], names=["part", "block"])

    for batch in batches:
        y = batch.column("toxic").to_numpy(zero_copy_only=False)
        for i, _, rows, h, before in _tokens(batch.column("text")):
            first = np.zeros(len(h), np.uint8)
            first[_distinct(rows, mix(h))] = 1
            held.append({"v": before, "w": h, "y": y[i + rows].astype(np.uint8), "first": first})
        if sum(len(x["w"]) for x in held) > 2_000_000:
            if rows := list(out()):
                yield batch_of(rows)
            held = []
    if held and (rows := list(out())):
        yield batch_of(rows)


def _starts(*keys) -> np.ndarray:
    """Where sorted rows of another key begin."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _sums(r, by: str):
    """Sums of the other columns by one, in its order."""
    order = np.argsort(r[by], kind="stable")
    k = r[by][order]
    at = _starts(k)
    return {by: k[at]} | {c: np.add.reduceat(x[order], at) if len(at) else x for c, x in r.items() if c != by}


def _dealt(kind: str, r, parts: int, by: str):
    """(part, kind, block) of each part of the words that rows fall in."""
    part = _part(r[by], parts)
    order = np.argsort(part, kind="stable")
    found, edges = np.unique(part[order], return_index=True)
    for p, i, j in zip(found.tolist(), edges, [*edges[1:], len(order)]):
        yield p, kind, pack({k: x[order[i:j]] for k, x in r.items()})


def _table(rows):
    rows = list(rows)
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([r[1] for r in rows], pa.string()), "block": pa.array([r[2] for r in rows], pa.binary())})


def _blocks(table) -> dict:
    """The rows of each kind, stacked."""
    held: dict = {}
    for kind, block in zip(table.column("kind").to_pylist(), table.column("block").to_pylist()):
        held.setdefault(kind, []).append(unpack(block))
    return {k: stack(x) for k, x in held.items()}


def _tables(table, parts):
    """Counts of one part of the bigrams, dealt to parts of the words.

    word: distinct contexts, and documents of either class, by word. context: bigrams of either class and what the discount takes from them, by context.
    pair: the bigrams that the discount leaves something of, in the part of their context.
    """
    r = stack([unpack(b) for b in table.column("block").to_pylist()])
    order = np.lexsort([r["w"], r["v"]])
    r = {k: x[order] for k, x in r.items()}
    at = _starts(r["v"], r["w"])
    v, w = r["v"][at], r["w"][at]
    of = lambda name, y: np.add.reduceat(np.where(r["y"] == y, r[name], 0).astype(np.uint32), at)
    n0, n1 = of("n", 0), of("n", 1)
    word = {"k": w, "contexts": np.ones(len(w), np.uint32), "n0": of("first", 0), "n1": of("first", 1)}
    context = {"k": v, "c0": n0, "c1": n1, "left": np.minimum(n0, DISCOUNT_PAIR) + np.minimum(n1, DISCOUNT_PAIR)}
    kept = np.maximum(n0, n1) > DISCOUNT_PAIR
    pair = {"v": v[kept], "w": w[kept], "n0": n0[kept], "n1": n1[kept]}
    return _table([*_dealt("word", _sums(word, "k"), parts, "k"), *_dealt("context", _sums(context, "k"), parts, "k"), *_dealt("pair", pair, parts, "v")])


def _joined(key, table, parts):
    """One part of the words: those that a discount leaves something of, sums over all, and the bigrams with what is known of their contexts, now in the part of their word."""
    r = _blocks(table)
    out = []
    if "word" in r:
        x = _sums(r["word"], "k")
        n = [x[f"n{y}"].astype(np.int64) for y in (0, 1)]
        shared = np.minimum(x["contexts"], SATURATE) + 0.5
        # Documents, what the discount takes from them, shared weight.
        out.append((key[0].as_py(), "total", pack({"t": np.array([n[0].sum(), n[1].sum(), np.minimum(n[0], DISCOUNT_WORD).sum(), np.minimum(n[1], DISCOUNT_WORD).sum(), shared.sum()], float)})))
        kept = np.maximum(*n) > DISCOUNT_WORD
        out.append((key[0].as_py(), "word", pack({"k": x["k"][kept], "n0": x["n0"][kept], "n1": x["n1"][kept], "shared": shared[kept]})))
    if "pair" in r:
        # Every context of a bigram is counted in its part.
        c, x = _sums(r["context"], "k"), r["pair"]
        at = np.searchsorted(c["k"], x["v"])
        c = {k: y[at].astype(float) for k, y in c.items() if k != "k"}
        own = {f"p{y}": np.maximum(x[f"n{y}"].astype(float) - DISCOUNT_PAIR, 0) / np.maximum(c[f"c{y}"], 1) for y in (0, 1)}
        out += _dealt("pair", {"v": x["v"], "w": x["w"], "back": c["left"] / (c["c0"] + c["c1"])} | own, parts, "w")
    return _table(out)


def _ratios(key, table, total):
    """Log-likelihood ratios of one part's words, and how far its bigrams move them, each in the order of their keys."""
    r = _blocks(table)
    x = r["word"]
    order = np.argsort(x["k"])
    x = {k: y[order] for k, y in x.items()}
    low = [(np.maximum(x[f"n{y}"].astype(float) - DISCOUNT_WORD, 0) + total[2 + y] * x["shared"] / total[4]) / max(1.0, total[y]) for y in (0, 1)]
    plain = np.log(low[1] + FLOOR) - np.log(low[0] + FLOOR)
    keys, moved = np.zeros(0, np.uint64), np.zeros(0)
    if "pair" in r:
        p = r["pair"]
        # A bigram of more than DISCOUNT_PAIR documents has a word of as many.
        at = np.searchsorted(x["k"], p["w"])
        both = [np.log(p[f"p{y}"] + p["back"] * low[y][at] + FLOOR) for y in (0, 1)]
        moved = np.clip(both[1] - both[0] - plain[at], -SHIFT, SHIFT)
        keys = _key(p["v"], p["w"])
        order = np.argsort(keys)
        keys, moved = keys[order], moved[order]
    block = pack({"words": x["k"], "ratio": plain.astype(np.float32), "pairs": keys, "moved": moved.astype(np.float32)})
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "words": pa.array([len(x["k"])], pa.int64()), "pairs": pa.array([len(keys)], pa.int64()), "block": pa.array([block], pa.binary())})


def _stored(found: DataFrame, sizes) -> tuple[str, int, int]:
    """The parts in one file of the executors: name, numbers of words and bigrams. A last key ends either, as a bound for look-ups."""
    n, m = sum(x[1] for x in sizes) + 1, sum(x[2] for x in sizes) + 1
    starts, i, j = {}, 0, 0
    for part, a, b in sizes:
        starts[part] = i, j
        i, j = i + a, j + b
    name = f"toxicity-{uuid.uuid4().hex}"
    # The file server reads it as long as the application runs.
    path = os.path.join(tempfile.mkdtemp(prefix="gridloom-toxicity-"), name)
    raw = np.memmap(path, np.uint8, "w+", shape=12 * (n + m))
    views = _views(raw, n, m)
    views[0][-1] = views[1][-1] = _U(2**64 - 1)
    for r in found.toLocalIterator():
        i, j = starts[r.part]
        x = unpack(r.block)
        views[0][i:i + r.words], views[2][i:i + r.words] = x["words"], x["ratio"]
        views[1][j:j + r.pairs], views[3][j:j + r.pairs] = x["pairs"], x["moved"]
    raw.flush()
    found.sparkSession.sparkContext.addFile(path)
    return name, n, m


def _views(raw, n: int, m: int):
    """Keys of words and of bigrams, values of both."""
    return raw[:8 * n].view(np.uint64), raw[8 * n:8 * (n + m)].view(np.uint64), raw[8 * (n + m):8 * (n + m) + 4 * n].view(np.float32), raw[8 * (n + m) + 4 * n:].view(np.float32)


def _looked_up(keys, values, asked, missing) -> np.ndarray:
    order = np.argsort(asked)  # neighbours in the file one after another
    asked = asked[order]
    at = np.searchsorted(keys, asked)
    out = np.empty(len(asked), np.float64)
    out[order] = np.where(keys[at] == asked, values[at], missing)
    return out


class Model:
    """The ratios (a file, or a table too large for one), the ratio of an unseen word, and the logistic weights."""

    def __init__(self, stored: tuple[str, int, int] | None, unseen: float, tables: DataFrame | None = None, parts: int = 0):
        self.stored, self.unseen, self.views, self.tables, self.parts = stored, unseen, None, tables, parts
        self.weights, self.scale = np.zeros(FEATURES + 1), np.ones(FEATURES)

    def __getstate__(self):
        return self.__dict__ | {"views": None, "tables": None}

    def ratio(self, before, h) -> np.ndarray:
        """log p(word | context, toxic) - log p(word | context, ordinary), each with interpolated backoff."""
        if self.views is None:
            name, n, m = self.stored
            self.views = _views(np.asarray(np.memmap(SparkFiles.get(name), np.uint8, "r")), n, m)
        words, pairs, ratio, moved = self.views
        return _looked_up(words, ratio, h, self.unseen) + _looked_up(pairs, moved, _key(before, h), 0.0)

    def features(self, column) -> np.ndarray:
        out = []
        for _, many, rows, h, before in _tokens(column):
            r = self.ratio(before, h)
            n = np.maximum(np.bincount(rows, minlength=many), 1)
            total = np.bincount(rows, r, many)
            order = np.lexsort([-r, rows])
            first = order[np.arange(len(r)) - np.searchsorted(rows, rows) < TOP]
            top = np.bincount(rows[first], r[first], many) / TOP
            out.append(np.column_stack([total / n, total / np.sqrt(n), np.bincount(rows, r > STRONG, many) / np.sqrt(n), top]))
        return np.concatenate(out) if out else np.zeros((0, FEATURES))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30) -> None:
        """Ridge logistic regression by Newton steps."""
        self.scale = np.maximum(x.std(axis=0), 1e-9)
        x = np.column_stack([np.ones(len(x)), x / self.scale])
        w = np.zeros(FEATURES + 1)
        ridge = np.ones(FEATURES + 1)
        ridge[0] = 1e-6
        weight = weight * len(x) / weight.sum()
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (weight * (p - y)) + ridge * w
            h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
            w = w - np.linalg.solve(h, g)
        self.weights = w

    def scores(self, column) -> np.ndarray:
        x = self.features(column)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + (x / self.scale) @ self.weights[1:], -30, 30)))


def _spread(kind: str, keys, parts: int, values=None):
    """(part, kind, block) of keys dealt evenly: bigrams of one word go to different parts."""
    part = _part(mix(keys), parts)
    order = np.argsort(part, kind="stable")
    found, edges = np.unique(part[order], return_index=True)
    for p, i, j in zip(found.tolist(), edges, [*edges[1:], len(order)]):
        o = order[i:j]
        yield p, kind, pack({"k": keys[o]} | ({} if values is None else {"x": values[o]}))


@settled
def _redealt(batches, parts):
    for batch in batches:
        for block in batch.column("block").to_pylist():
            r = unpack(block)
            rows = [*_spread("word", r["words"], parts, r["ratio"]), *_spread("pair", r["pairs"], parts, r["moved"])]
            yield from _table(rows).to_batches()


def _cut_up(batches):
    """Rows as slices of about ``PIECE_BYTES`` of text, or of one row, each with a name of its own."""
    for batch in batches:
        for i, j in slices(flat(batch.column("text"))[1], PIECE_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch.slice(i, j - i))
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["slice", "rows"])


@settled
def _asked(batches, parts):
    """The distinct words and bigrams of each slice."""
    for batch in batches:
        for name, rows in zip(batch.column("slice").to_pylist(), batch.column("rows").to_pylist()):
            h, pairs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for _, _, _, w, before in _tokens(pa.ipc.open_stream(rows).read_all().column("text")):
                h.append(np.unique(w))
                pairs.append(np.unique(_key(before, w)))
            asks = _table([*_spread("word", np.unique(np.concatenate(h)), parts), *_spread("pair", np.unique(np.concatenate(pairs)), parts)])
            yield from asks.append_column("slice", pa.array([name] * asks.num_rows, pa.string())).to_batches()


def _answered(asks, table):
    """What one part of the table says of each slice's keys; nothing of those that it does not hold."""
    held = {}
    for kind, r in _blocks(table).items():
        order = np.argsort(r["k"])
        held[kind] = r["k"][order], r["x"][order]
    out = []
    for name, kind, block in zip(*(asks.column(c).to_pylist() for c in ("slice", "kind", "block"))):
        if kind in held:
            asked, (keys, values) = unpack(block)["k"], held[kind]
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            hit = keys[at] == asked
            if hit.any():
                out.append((name, kind, pack({"k": asked[hit], "x": values[at[hit]]})))
    return pa.table({c: pa.array([x[i] for x in out], t) for i, (c, t) in enumerate((("slice", pa.string()), ("kind", pa.string()), ("block", pa.binary())))})


def _known(model: Model, answers) -> None:
    """The answers to one slice as the model's look-up arrays."""
    r, views = _blocks(answers), {}
    for kind in ("word", "pair"):
        x = r.get(kind) or {"k": np.zeros(0, np.uint64), "x": np.zeros(0, np.float32)}
        order = np.argsort(x["k"])
        views[kind] = np.append(x["k"][order], _U(2**64 - 1)), np.append(x["x"][order], np.float32(0))
    model.views = views["word"][0], views["pair"][0], views["word"][1], views["pair"][1]


def _dealt_out(docs: DataFrame, model: Model, make, schema: str) -> DataFrame:
    """``make(model, batch)`` of all rows where the table of ratios is too large for a file.

    A slice asks once for an expression, however often it holds it, and a part's copies grow in number with the slices, so neither frequent
    words nor many texts make a group large. What a slice gets back is bounded by its own text.
    """
    spark, parts = docs.sparkSession, model.parts
    pieces = cut(docs.mapInArrow(_cut_up, "slice string, rows binary"))
    copies = pieces.count() // (ASKING * parts) + 1
    asks = pieces.mapInArrow(partial(_asked, parts=parts), "part int, kind string, block binary, slice string").withColumn("copy", F.pmod(F.xxhash64("slice"), F.lit(copies)).cast("int"))
    tables = model.tables.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    answers = asks.groupBy("part", "copy").cogroup(tables.groupBy("part", "copy")).applyInArrow(_answered, "slice string, kind string, block binary")
    shared = spark.sparkContext.broadcast(model)

    def joined(rows, answers):
        own = shared.value
        _known(own, answers)
        return pa.Table.from_batches([make(own, b) for block in rows.column("rows").to_pylist() for b in pa.ipc.open_stream(block)])

    return pieces.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(joined, schema)


def _applied(docs: DataFrame, model: Model | float, make, schema: str) -> DataFrame:
    """``make(model, batch)`` of all rows of ``docs``, which have a column text."""
    if isinstance(model, Model) and model.tables is not None:
        return _dealt_out(docs, model, make, schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @settled
    def run(batches):
        for batch in batches:
            yield make(shared.value, batch)

    return docs.mapInArrow(run, schema)


COUNTS, DEALT = "part int, block binary", "part int, kind string, block binary"


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | float:
    """Fit on labelled documents that are not held out; a constant score where a class is missing.

    Of several labels of a document the greatest counts; null labels and null ids are left out.
    At most ``per_class`` documents of a class (of those with crc32 mod 5 = 4) calibrate; every other one is counted.
    """
    spark = docs.sparkSession
    known = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
             .where(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id", F.lit(17))))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 2)
    pick = known.withColumn("part", F.crc32(F.col("doc_id").cast("string")) % 5)
    calibrate = pick.where("part = 4 AND toxic = 0").orderBy("h", "doc_id").limit(per_class).unionByName(pick.where("part = 4 AND toxic = 1").orderBy("h", "doc_id").limit(per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    count = known.join(F.broadcast(calibrate.select("doc_id")), "doc_id", "left_anti").select("doc_id", "toxic")
    n = sizes[0] + sizes[1]
    parts = n // PART_DOCS + 1
    of_words = -(-parts // FAN)
    counted = cut(texts.join(F.broadcast(count) if n <= BROADCAST_ROWS else count, "doc_id").select("text", "toxic").mapInArrow(partial(_pairs, parts=parts), COUNTS)
                  .groupBy("part").applyInArrow(lambda t: _tables(t, of_words), DEALT)
                  .groupBy("part").applyInArrow(lambda key, t: _joined(key, t, of_words), DEALT))
    total = np.zeros(5)
    for r in counted.where("kind = 'total'").select("block").collect():  # five numbers a part of the words
        total += unpack(r.block)["t"]
    total[4] += 0.5  # the word never seen
    found = cut(counted.where("kind <> 'total'").groupBy("part").applyInArrow(lambda key, t: _ratios(key, t, total), "part int, words long, pairs long, block binary"))
    never = [np.log(total[2 + y] / max(1.0, total[y]) * 0.5 / total[4] + FLOOR) for y in (0, 1)]
    unseen = float(never[1] - never[0])
    held = sorted((r.part, r.words, r.pairs) for r in found.select("part", "words", "pairs").collect())
    size = 12 * sum(x[1] + x[2] for x in held)
    if size <= FILE_BYTES:
        model = Model(_stored(found, held), unseen)
    else:
        tables = size // TABLE_BYTES + 1
        model = Model(None, unseen, cut(found.mapInArrow(partial(_redealt, parts=tables), DEALT)), tables)
    # At most 2 * per_class rows, of two numbers here and of FEATURES + 1 on the driver.
    fitted = texts.join(F.broadcast(calibrate.select("doc_id", "toxic")), "doc_id").select("text", "toxic")
    rows = _applied(fitted, model, _measured, "x array<double>, y int").collect()
    y = np.array([r.y for r in rows], float)
    if not len(y) or y.min() == y.max():
        return (sizes[1] + 0.5) / (sum(sizes.values()) + 2)
    x = np.array([r.x for r in rows])
    # The bounded sample may not hold the classes as all labels do; weigh them back.
    model.fit(x, y, np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum()))
    return model


def _measured(model: Model, batch):
    x = model.features(batch.column("text"))
    return pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("toxic")], names=["x", "y"])


def with_score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, column: str = "toxicity") -> DataFrame:
    """``docs`` with a score of every whole text in a new ``column``; only the text is an input of it."""
    def scored(model, batch):
        s = np.full(batch.num_rows, model) if isinstance(model, float) else model.scores(batch.column("text"))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, column])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{column}` double"
    return _applied(docs, train(docs, labels, per_class), scored, schema)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score in 0..1, predicted.

    ``labels`` (doc_id, toxic) teaches only from rows that are not held out (crc32 of doc_id as text, mod 5, not 0).
    Null, empty and blank texts have no evidence and score by the prior; a null doc_id is not held out. Without
    labels of both classes all score alike. Repeated rows score alike; an empty table gives an empty result.
    """
    scored = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels, per_class, "score")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` without the documents that score at or above the threshold."""
    name = free(docs, "_toxicity")
    return with_score(docs, labels, per_class, name).where(F.col(name) < threshold).drop(name)
