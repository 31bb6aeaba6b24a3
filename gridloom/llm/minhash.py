"""MinHash near-duplicates by a signature-coordinate inverted join.

Every distinct shingle set (texts with equal sets form one class) is posted under
its (coordinate, value) pairs. Two sets of Jaccard similarity s agree on a coordinate
with probability s, so linked sets share at least ``MATCH_INDEX`` of the ``INDEX``
posted coordinates but for a chance below 1e-5 at the very threshold. With lists ordered from
rare to common, they then share a list among the first ``INDEX - MATCH_INDEX + 1`` of
each (prefix merging); the other, longer lists are skipped, as the whole signature
gives the count of collisions anyway. Pairs with at least ``MATCH_FULL`` of ``WIDTH``
equal coordinates are confirmed on the full shingle sets.

A posting list is not expanded into its pairs. First each member is held against one
hub of the list, then, if their components differ, against ``HUBS`` more. Linked members
fall into one component; lists that still hold different components are compared in
blocks of about ``BLOCK`` members, inside a task: signatures first, then the full sets of
those members that match one of another component, as bitmaps and not as rows a pair.
Only a forest of links leaves the task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import components, cut, first_id, free, named, parts_of, settled, shingle_sets

WIDTH, INDEX, MATCH_INDEX, MATCH_FULL, BLOCK, BLOCK_SHINGLES, HUBS = 128, 32, 13, 80, 256, 2_000_000, 4
_R = np.random.default_rng(7)
_A = _R.integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _R.integers(0, 2**63, WIDTH, dtype=np.uint64)
#: Similarity that MATCH_INDEX and MATCH_FULL are made for; below it they would lose links.
LEAST_PERCENT = 80
FEATURES = "doc_id long, th long, n_shingles long, cid binary, tokens array<long>, sig binary"


def signature(s: np.ndarray) -> np.ndarray:
    """WIDTH minima of 32-bit hashes of a set."""
    low = np.full(WIDTH, 2**32 - 1, np.uint64)
    for i in range(0, len(s), 2048):
        x = s[None, i:i + 2048] * _A[:, None]
        x += _B[:, None]
        np.minimum(low, x.min(axis=1) >> np.uint64(32), out=low)
    return low


def _features(k: int):
    lanes = np.arange(INDEX, dtype=np.int64)

    @settled
    def run(batches):
        for batch in batches:
            ids, n, cid, tokens, sig = batch.column("doc_id"), [], [], [], []
            for key, s in zip(ids.to_pylist(), shingle_sets(batch.column("text"), k)):
                n.append(len(s))
                if len(s):
                    low = signature(s)
                    cid.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    tokens.append(low[:INDEX].astype(np.int64) * 64 + lanes)
                    sig.append(low.astype(np.uint8).tobytes())
                else:  # a class of its own, so that empty texts do not meet under one key
                    cid.append(hashlib.blake2b(b"%d" % key if key is not None else b"", digest_size=15).digest())
                    tokens.append(None)
                    sig.append(None)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), batch.column("th"), pa.array(n, pa.int64()), pa.array(cid, pa.binary()),
                 pa.array(tokens, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                names=["doc_id", "th", "n_shingles", "cid", "tokens", "sig"])
    return run


@settled
def _packed(batches):
    z = zstandard.ZstdCompressor(level=1)
    for batch in parts_of(batches):
        texts = [z.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(texts, pa.binary())], names=["doc_id", "th", "packed"])


def _matching(batches):
    """Pairs (a, b) whose signatures agree on MATCH_FULL coordinates."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, WIDTH) for c in ("sa", "sb"))
        yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= MATCH_FULL))


def _confirmed(k: int, percent: int):
    @settled
    def run(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [list(shingle_sets(pa.array([z.decompress(t).decode() for t in part.column(c).to_pylist()], pa.large_string()), k)) for c in ("ta", "tb")]
                for j, (x, y) in enumerate(zip(*sets)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i + j] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    return run


def _runs(batches, keys, rest):
    """Runs of rows of equal keys in sorted batches: (key, one list for each of the other columns)."""
    key, held = None, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in (*keys, *rest))):
            if row[:len(keys)] != key:
                if held:
                    yield key, held
                key, held = row[:len(keys)], [[] for _ in rest]
            for to, x in zip(held, row[len(keys):]):
                to.append(x)
    if held:
        yield key, held


@settled
def _blocks(batches):
    """Rows sorted by (token, bi, bj, cid): members that match one of another label, each with a bitmap of those after it.

    A pair counts at the first list that both members are on, and not again at the others.
    """
    for (token, bi, bj), (side, cid, label, sig, lists) in _runs(batches, ("token", "bi", "bj"), ("own", "cid", "label", "sig", "lists")):
        n = len(cid)
        sig = np.frombuffer(b"".join(sig), np.uint8).reshape(n, WIDTH)
        on = np.full((n, 64), -1, np.int64)  # the lists before this one, by coordinate
        for i, x in enumerate(lists):
            x = np.array([t for t in x if t < token], np.int64)
            on[i, x % 64] = x
        on = on[:, (on >= 0).any(axis=0)]
        side, at = np.array(side), np.arange(n)
        _, same = np.unique(np.array(label, object), return_inverse=True)
        match = np.zeros((n, n), bool)
        for i in at if bi == bj else at[side == bi]:
            other = at[i + 1:] if bi == bj else at[side == bj]
            other = other[same[other] != same[i]]
            other = other[(sig[other] == sig[i]).sum(axis=1) >= MATCH_FULL]
            other = other[~((on[other] == on[i]) & (on[i] >= 0)).any(axis=1)]
            match[np.minimum(i, other), np.maximum(i, other)] = True
        some = np.flatnonzero(match.any(axis=0) | match.any(axis=1))
        if len(some):
            bits = np.packbits(match[np.ix_(some, some)], axis=1)
            columns = ([token] * len(some), [bi] * len(some), [bj] * len(some), range(len(some)), [cid[i] for i in some], [label[i] for i in some], [x.tobytes() for x in bits])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OPEN)], schema=_OPEN)


_OPEN = pa.schema([("token", pa.int64()), ("bi", pa.int32()), ("bj", pa.int32()), ("pos", pa.int32()), ("cid", pa.binary()), ("label", pa.binary()), ("open", pa.binary())])
OPEN = "token long, bi int, bj int, pos int, cid binary, label binary, open binary"


def _verified(k: int, percent: int):
    """Rows of ``OPEN`` with texts, sorted by (token, bi, bj, pos): links between different labels, as a forest."""
    @settled
    def run(batches):
        z = zstandard.ZstdDecompressor()
        for _, (cid, label, bits, texts) in _runs(batches, ("token", "bi", "bj"), ("cid", "label", "open", "packed")):
            sets = list(shingle_sets(pa.array([z.decompress(t).decode() for t in texts], pa.large_string()), k))
            size = np.array([len(x) for x in sets])
            edges = np.concatenate([[0], np.cumsum(size)])
            _, number = np.unique(np.concatenate(sets), return_inverse=True)
            open_ = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(cid), -1), axis=1, count=len(cid)).astype(bool)
            _, same = np.unique(np.array(label, object), return_inverse=True)
            mine, found = np.zeros(len(number), bool), []
            for i in np.flatnonzero(open_.any(axis=1)):
                mine[number[edges[i]:edges[i + 1]]] = True
                for j in np.flatnonzero(open_[i]):
                    if same[i] == same[j]:
                        continue
                    both = int(mine[number[edges[j]:edges[j + 1]]].sum())
                    if 100 * both >= percent * (size[i] + size[j] - both):
                        found.append((cid[i], cid[j]))
                        same[same == same[j]] = same[i]
                mine[number[edges[i]:edges[i + 1]]] = False
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.binary()) for c in (0, 1)], names=["a", "b"])
    return run


def _prefixes(classes: DataFrame) -> DataFrame:
    """(token, cid) of each class's rarest lists, as far as a match must show there."""
    posts = classes.select("cid", F.explode("tokens").alias("token"))
    shared = posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    live = posts.join(shared, "token").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("lists"))
    first = INDEX - MATCH_INDEX + 1
    return (live.withColumn("n", F.lit(first - INDEX) + F.size("lists")).where("n > 0")
            .select("cid", F.explode(F.slice("lists", F.lit(1), F.col("n"))).alias("x")).select("cid", "x.token"))


def _dealt(labelled: DataFrame, sizes: DataFrame, more: DataFrame) -> DataFrame:
    """Members (token, cid, label) of lists of more than one label, with ``more`` of their class, in pairs of blocks: own, bi, bj added.

    A label of ``BLOCK`` members or more has blocks of its own, which are not paired with one another; the others
    share blocks, dealt by a hash. So a list of one large component and a few strangers costs their product, not its square.
    """
    share = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("s") / BLOCK_SHINGLES)).cast("int")
    group = labelled.join(sizes, "cid").groupBy("token", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).withColumn("large", (F.col("n") >= BLOCK) | (F.col("s") >= BLOCK_SHINGLES))
    small = lambda c: F.coalesce(F.sum(F.when(~F.col("large"), F.col(c))), F.lit(0)).alias(c)
    lists = group.groupBy("token").agg(F.count("*").alias("labels"), small("n"), small("s"), F.coalesce(F.sum(F.when(F.col("large"), share)), F.lit(0)).alias("of_large"))
    # Written out, so that a join with them can split a long list.
    lists = cut(lists.where("labels > 1").select("token", share.alias("shared"), (share + F.col("of_large")).cast("int").alias("total")))
    before = Window.partitionBy("token").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    large = cut(group.where("large").select("token", "label", share.alias("parts"), F.coalesce(F.sum(share).over(before), F.lit(0)).cast("int").alias("offset")))
    x = labelled.join(lists, "token").join(large, ["token", "label"], "left").join(more, "cid")
    x = x.withColumn("low", F.when(F.col("parts").isNull(), 0).otherwise(F.col("shared") + F.col("offset"))).withColumn("high", F.when(F.col("parts").isNull(), 0).otherwise(F.col("low") + F.col("parts")))
    x = x.withColumn("own", F.col("low") + F.pmod(F.xxhash64("cid"), F.coalesce("parts", "shared")).cast("int"))
    x = x.withColumn("other", F.explode(F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda i: (i < F.col("low")) | (i >= F.col("high")))))
    return x.select("token", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "cid", "label", *[c for c in more.columns if c != "cid"])


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of
    distinct ``shingle``-word shingles (A-Z lower-cased, words between ASCII white space).
    A text of fewer words is one shingle; a null, empty or blank text has none and is linked
    with nothing. component_id is the least doc_id reachable over links. Repeated rows belong
    to one class and each gives a row; null ids stay null and count as greater than any other. An empty table
    gives an empty result; further columns of ``docs`` are ignored.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"the thresholds for candidates find links from {LEAST_PERCENT} percent on, not {percent}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    feats = cut(docs.mapInArrow(_features(shingle), FEATURES))
    # Classes are named by their least doc_id, so the least name of a component tells its component_id.
    classes = feats.where("n_shingles > 0").groupBy("cid").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "th", "n_shingles", "tokens", "sig")).alias("x"))
    classes = cut(classes.select(F.col("cid").alias("class"), named(F.col("least"), F.col("cid")).alias("cid"), "x.*"))
    prefix = cut(_prefixes(classes))
    sig = classes.select("cid", "sig")

    # Whole texts of the classes that have any candidate list, compressed.
    wanted = prefix.select("cid").distinct().join(classes.select("cid", "doc_id", "th"), "cid")
    packed = docs.mapInArrow(_packed, "doc_id long, th long, packed binary")
    near_null = (wanted.doc_id.eqNullSafe(packed.doc_id)) & (wanted.th == packed.th)
    texts = cut(wanted.join(packed, near_null).select("cid", "packed").groupBy("cid").agg(F.first("packed").alias("packed")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        full = (pairs.join(texts.select(F.col("cid").alias("a"), F.col("packed").alias("ta")), "a")
                .join(texts.select(F.col("cid").alias("b"), F.col("packed").alias("tb")), "b"))
        return full.select("a", "b", "ta", "tb").mapInArrow(_confirmed(shingle, percent), "a binary, b binary")

    def matching(pairs: DataFrame) -> DataFrame:
        signed = (pairs.join(sig.select(F.col("cid").alias("a"), F.col("sig").alias("sa")), "a")
                  .join(sig.select(F.col("cid").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb"))
        return cut(confirmed(signed.mapInArrow(_matching, "a binary, b binary")))

    def with_labels(comp: DataFrame) -> DataFrame:
        return cut(prefix.join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("token", "cid", F.coalesce("root", "cid").alias("label")))

    def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
        return components(comp.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))

    hubs = cut(prefix.groupBy("token").agg(F.min("cid").alias("b"), F.count("*").alias("n")).where("n > 1"))
    comp = components(matching(prefix.join(hubs, "token").where("cid <> b").select(F.col("cid").alias("a"), "b").distinct()))

    # Members whose component is not that of their hub meet HUBS more of the list, picked by hash.
    labelled = with_labels(comp)
    picks = [F.min(F.struct(F.xxhash64("cid", F.lit(i)).alias("h"), F.col("cid").alias("b"), F.col("label").alias("lb"))) for i in range(HUBS)]
    hubs = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.array(*picks).alias("x")).where("lo <> hi")
    pairs = labelled.join(cut(hubs.select("token", "x")), "token").select("cid", "label", F.explode("x").alias("x")).where("label <> x.lb")
    pairs = pairs.select(F.greatest("cid", "x.b").alias("a"), F.least("cid", "x.b").alias("b")).distinct()
    comp = joined(comp, matching(pairs))

    # Lists that still hold more than one component, in blocks.
    lists = prefix.groupBy("cid").agg(F.sort_array(F.collect_list("token")).alias("lists"))
    members = _dealt(with_labels(comp), classes.select("cid", "n_shingles"), sig.join(lists, "cid"))
    members = members.repartition("token", "bi", "bj").sortWithinPartitions("token", "bi", "bj", "cid")
    # Only members with an open match travel again, with their texts.
    open_ = members.mapInArrow(_blocks, OPEN).join(texts, "cid").repartition("token", "bi", "bj").sortWithinPartitions("token", "bi", "bj", "pos")
    second = cut(open_.select("token", "bi", "bj", "cid", "label", "open", "packed").mapInArrow(_verified(shingle, percent), "a binary, b binary"))
    comp = joined(comp, second)

    roots = classes.join(comp.withColumnRenamed("node", "cid"), "cid", "left").select(F.col("class").alias("cid"), first_id(F.coalesce("root", "cid")).alias("component_id"))
    # Texts without words are classes of their own and not among them.
    found = feats.select("doc_id", "n_shingles", "cid").join(roots, "cid", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_per_group(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents of each near-duplicate group but the one of least doc_id.

    Rows that repeat a kept doc_id and its text stay once.
    """
    name = free(docs, "_kept_id")
    kept = near_duplicates(docs, shingle, percent).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi").dropDuplicates(["doc_id", "text"])
