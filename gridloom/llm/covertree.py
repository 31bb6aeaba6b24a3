"""Embedding near-duplicates by dual traversal of cover trees.

Vectors of one label are compared on the unit sphere, where cosine >= c means distance
<= sqrt(2 - 2c). Equal vectors form one class. A label's classes fall into cells around
at most ``PIVOTS`` pivots (as many as its size asks for), cells into blocks of about ``BLOCK``; pairs of cells further apart than
their covering radii and the threshold allow are never formed. A task gets one pair of blocks,
builds a cover tree of each (nested levels of halving radii) and walks both at once,
pruning node pairs by the same bound; leaves are compared exactly. It returns one count
a class and a spanning forest of the links it found, never the links of a group.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import components, cut, first_id, named

BLOCK, PIVOTS, LEAF, SLACK = 2048, 256, 64, 1e-9


def _vectors(batches):
    """vec_id, key of the class, label, dim, vector bytes; vector null where it can link with nothing."""
    for batch in batches:
        keys, dims, raw = [], [], []
        rows = zip(batch.column("embedding").to_pylist(), batch.column("label").to_pylist(), batch.column("vec_id").to_pylist())
        for vector, label, vec_id in rows:
            data = None
            if vector is not None and label is not None and len(vector) and None not in vector:
                x = np.array(vector, np.float64) + 0.0
                if np.isfinite(x).all() and x.any():
                    data = x.tobytes()
            raw.append(data)
            dims.append(len(vector) if data else None)
            keys.append(hashlib.blake2b(f"{label}|".encode() + data if data else f"{vec_id}".encode(), digest_size=16 if data else 15).digest())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), batch.column("label"), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())],
                                         names=["vec_id", "key", "label", "dim", "vector"])


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of tiny or huge components are lost
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _celled(batches, pivots):
    """Cell and distance of its pivot, among the first ``m`` pivots of the row's dimension."""
    for batch in batches:
        cell, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
        dims, m = (np.array(batch.column(c).to_pylist()) for c in ("dim", "m"))
        raw = batch.column("vector").to_pylist()
        for d in np.unique(dims):
            if int(d) not in pivots:
                continue  # one cell
            p = pivots[int(d)]
            for i in np.array_split(np.flatnonzero(dims == d), max(1, (dims == d).sum() // 1024)):
                if len(i):
                    dot = unit([raw[k] for k in i]) @ p.T
                    dot[np.arange(len(p))[None, :] >= np.maximum(m[i], 1)[:, None]] = -2
                    cell[i] = dot.argmax(axis=1)
                    far[i] = np.sqrt(np.maximum(0, 2 - 2 * dot.max(axis=1)))
        columns = {n: batch.column(n) for n in ("key", "label", "dim", "vector", "n")} | {"cell": pa.array(cell), "far": pa.array(far)}
        yield pa.RecordBatch.from_pydict(columns)


class Node:
    """Points within ``radius`` of the centre, and children of half the level's radius unless a leaf."""

    __slots__ = ("at", "centre", "radius", "children")

    def __init__(self, x: np.ndarray, at: np.ndarray, centre: int, level: float, least: float):
        self.at, self.centre, self.children = at, x[centre], []
        away = np.sqrt(np.maximum(0, 2 - 2 * (x[at] @ self.centre)))
        self.radius = float(away.max())
        if len(at) <= LEAF or level / 2 < least:
            return
        # A net of half the radius: every point goes to the first centre that covers it.
        rest, parts = at, []
        while len(rest):
            if len(parts) > max(8, len(at) // 8):
                return  # too spread out to split: a leaf
            c = rest[0]
            near = np.maximum(0, 2 - 2 * (x[rest] @ x[c])) <= (level / 2) ** 2
            near[0] = True
            parts.append((rest[near], c))
            rest = rest[~near]
        if len(parts) == 1:
            self.__init__(x, at, parts[0][1], level / 2, least)
        else:
            self.children = [Node(x, part, c, level / 2, least) for part, c in parts]


def dual(x: np.ndarray, y: np.ndarray | None, cosine: float):
    """(i, j) arrays of pairs at or above the threshold, piece by piece; y None: pairs i < j within x."""
    most = np.sqrt(2 - 2 * cosine) + SLACK
    a = Node(x, np.arange(len(x)), 0, 2.0, most / 2)
    b = a if y is None else Node(y, np.arange(len(y)), 0, 2.0, most / 2)
    other = x if y is None else y
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if a is not b and np.sqrt(max(0.0, 2 - 2 * float(a.centre @ b.centre))) - a.radius - b.radius > most:
            continue
        if not a.children and not b.children:
            for part in np.array_split(a.at, max(1, len(a.at) // 512)):
                i, j = np.nonzero(x[part] @ other[b.at].T >= cosine)
                i, j = part[i], b.at[j]
                if y is None and a is b:
                    i, j = i[i < j], j[i < j]
                elif y is None:
                    i, j = np.minimum(i, j), np.maximum(i, j)
                if len(i):
                    yield i, j
        elif a is b:
            kids = a.children
            stack += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids))]
        elif b.children and (not a.children or b.radius > a.radius):
            stack += [(a, k) for k in b.children]
        else:
            stack += [(k, b) for k in a.children]


def _compared(key, table, cosine):
    table = table.sort_by("key")
    side = np.array(table.column("side").to_pylist())
    keys, n = table.column("key").to_pylist(), table.column("n").to_numpy()
    x = unit(table.column("vector").to_pylist())
    same = key[-1].as_py() == key[-2].as_py() and key[-3].as_py() == key[-4].as_py()
    first, second = (np.arange(len(keys)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    links, root, forest = np.zeros(len(keys), np.int64), list(range(len(keys))), []

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if len(first) and len(second):
        for i, j in dual(x[first], None if same else x[second], cosine):
            i, j = first[i], second[j]
            links += np.bincount(i, n[j], len(keys)).astype(np.int64) + np.bincount(j, n[i], len(keys)).astype(np.int64)
            for u, v in zip(i.tolist(), j.tolist()):
                u, v = find(u), find(v)
                if u != v:
                    root[v] = u
                    forest.append((u, v))
    some = np.flatnonzero(links)
    return pa.table({"a": pa.array([keys[i] for i in some] + [keys[u] for u, _ in forest], pa.binary()),
                     "b": pa.array([None] * len(some) + [keys[v] for _, v in forest], pa.binary()),
                     "links": pa.array([*links[some].tolist(), *[0] * len(forest)], pa.int64())})


def near_vectors(embeddings: DataFrame, cosine: float = 0.98) -> DataFrame:
    """One row per row of ``embeddings`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of equal, non-null label and equal length link at cosine >= ``cosine``, in double precision. Null, empty
    and zero vectors and those with null or non-finite components link with nothing, nor do vectors without a label.
    n_links counts the other rows linked directly, repeated rows each; component_id is the least vec_id
    reachable over links. A null vec_id counts as greater than any other. An empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    rows = cut(e.mapInArrow(_vectors, "vec_id long, key binary, label string, dim int, vector binary"))
    live = rows.where("vector IS NOT NULL").groupBy("key", "label", "dim").agg(F.first("vector").alias("vector"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    # Classes are named by their least vec_id, so the least name of a component tells its component_id.
    live = cut(live.select(F.col("key").alias("class"), named(F.col("least"), F.col("key")).alias("key"), "label", "dim", "vector", "n"))

    shares = live.groupBy("label", "dim").agg(F.least(F.lit(PIVOTS), F.ceil(F.count("*") / BLOCK)).cast("int").alias("m"))
    # Dimensions with a label of more than one block, at most a row for BLOCK vectors, and their pivots.
    wanted = shares.groupBy("dim").agg(F.max("m").alias("k")).where("k > 1")
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("key"), "key"))
    chosen = live.select("dim", "key", "vector").withColumn("rank", rank).where(F.col("rank") <= PIVOTS).join(wanted, "dim").where("rank <= k")
    held: dict[int, list] = {}
    for r in chosen.select("dim", "rank", "vector").collect():
        held.setdefault(r.dim, []).append((r["rank"], r.vector))
    pivots = {d: unit([v for _, v in sorted(p)]) for d, p in held.items()}
    celled = cut(live.join(shares, ["label", "dim"]).mapInArrow(partial(_celled, pivots=pivots), "key binary, label string, dim int, vector binary, n long, cell int, far double"))
    cells = celled.groupBy("label", "dim", "cell").agg(F.max("far").alias("radius"), F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))

    # Pairs of cells, at most PIVOTS a label, that the covering radii do not rule out.
    apart = spark.createDataFrame([(d, i, j, float(np.sqrt(max(0.0, 2 - 2 * p[i] @ p[j])))) for d, p in pivots.items() for i in range(len(p)) for j in range(i, len(p))],
                                  "dim int, c0 int, c1 int, apart double")
    x = cells.select("label", "dim", F.col("cell").alias("c0"), F.col("radius").alias("r0"), F.col("parts").alias("p0"))
    y = cells.select("label", "dim", F.col("cell").alias("c1"), F.col("radius").alias("r1"), F.col("parts").alias("p1"))
    # Written out, so that a join with them can split a large cell.
    pairs = cut(x.join(y, ["label", "dim"]).where("c0 <= c1").join(apart, ["dim", "c0", "c1"], "left")
             .where((F.col("c0") == F.col("c1")) | (F.col("apart") - F.col("r0") - F.col("r1") <= float(np.sqrt(2 - 2 * cosine)) + SLACK)).select("label", "dim", "c0", "c1", "p0", "p1"))
    part = lambda p: F.pmod(F.xxhash64("key", F.lit(3)), F.col(p)).cast("int")
    from_a = (celled.withColumnRenamed("cell", "c0").join(pairs, ["label", "dim", "c0"]).withColumn("s0", part("p0"))
              .withColumn("s1", F.explode(F.expr("sequence(IF(c0 = c1, s0, 0), p1 - 1)"))).withColumn("side", F.lit(0)))
    from_b = (celled.withColumnRenamed("cell", "c1").join(pairs, ["label", "dim", "c1"]).withColumn("s1", part("p1"))
              .withColumn("s0", F.explode(F.expr("sequence(0, IF(c0 = c1, greatest(s1 - 1, 0), p0 - 1))"))).withColumn("side", F.lit(1)))
    from_b = from_b.where("s0 >= 0 AND NOT (c0 = c1 AND s0 >= s1)")
    names = ["label", "dim", "c0", "c1", "s0", "s1", "side", "key", "vector", "n"]
    members = from_a.select(*names).union(from_b.select(*names))
    compare = partial(_compared, cosine=cosine)
    found = cut(members.groupBy("label", "dim", "c0", "c1", "s0", "s1").applyInArrow(lambda key, t: compare(key, t), "a binary, b binary, links long"))

    links = found.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    comp = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "key")
    of = live.select("class", "key", "n").join(comp, "key", "left").join(links, "key", "left").select(
        F.col("class").alias("key"), first_id(F.coalesce("root", "key")).alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    out = rows.select("vec_id", "key", F.col("vector").isNotNull().alias("live")).join(of, "key", "left")
    out = out.withColumn("component_id", F.when(F.col("live"), F.col("component_id")).otherwise(F.col("vec_id")))
    return out.select("vec_id", F.when(F.col("live"), F.col("links")).otherwise(0).cast("long").alias("n_links"), "component_id",
                      F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
