"""Near-duplicates, repeated strings and vectors against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import common, covertree, minhash, suffix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def texts(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(300)]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 120))) for _ in range(12)]
    out = []
    for i in range(n):
        w = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append((i, r.choice([" ", "  ", "\n"]).join(w)))
    passage = " ".join(r.choice(vocabulary) for _ in range(30))
    out += [(n, passage), (n + 1, "x" + passage + "y"), (n + 2, base[0][:40] + passage)]
    return out + [(n + 3, None), (n + 4, ""), (n + 5, " \n\t"), (n + 6, "A b"), (n + 7, "a B"), (n + 8, "ab " * 400), (n + 9, "ab " * 401), (n + 10, "z" * 5000)]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_match_brute_force(spark, k):
    rows = texts()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, cid string, sig int")
    sets = {i: shingles(t, k) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, k).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert sorted(r.doc_id for r in minhash.one_per_group(df, k).collect()) == sorted(i for i in want if want[i] == i)


@pytest.mark.parametrize("block", [256, 4])
def test_large_group_without_a_common_hub(spark, monkeypatch, block):
    """Every copy differs from every other; only chains of links join them. Small blocks give large labels blocks of their own."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        if i % 8 == 0:
            words[r.randrange(60)] = f"n{i}"
        w = list(words)
        w[i % 60] = f"own{i}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t, 4) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == want


def test_near_duplicates_of_nothing_and_of_null_ids(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)]
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (None, 0, None, True)], key=str)


def test_classes_are_named_in_order_of_their_least_ids(spark):
    ids = [-(2**63), -7, -1, 0, 1, 255, 256, 2**40, 2**63 - 1, None]
    rows = spark.createDataFrame([(i, bytes([k]) * 16) for k, i in enumerate(ids)], "i long, c binary").select("i", common.named(F.col("i"), F.col("c")).alias("n"))
    got = rows.withColumn("back", common.first_id(F.col("n"))).collect()
    assert all(r.i == r.back for r in got)
    assert [r.i for r in sorted(got, key=lambda r: bytes(r.n))] == ids


def test_members_of_mixed_lists_meet_all_of_other_labels_once_a_pair(spark, monkeypatch):
    """A dominant label's blocks never meet each other, so rows grow with the product of both sides."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    label = {i: "big" if i < 100 else "mid" if i < 120 else f"l{i}" for i in range(130)}
    lab = spark.createDataFrame([(t, bytes([i]), y.encode()) for t in (5, 6) for i, y in label.items() if t == 5 or y == "big"], "token long, cid binary, label binary")
    size = spark.createDataFrame([(bytes([i]), 3) for i in label], "cid binary, n_shingles long")
    rows = minhash._dealt(lab, size, size.select("cid")).collect()
    assert {r.token for r in rows} == {5}
    met = Counter()
    for bi, bj in {(r.bi, r.bj) for r in rows}:
        here = [(r.cid[0], r.own) for r in rows if (r.bi, r.bj) == (bi, bj)]
        met.update((i, j) for i, a in here for j, b in here if i < j and (bi == bj or a != b))
    assert all(met[i, j] == (1 if label[i] != label[j] else met[i, j]) for i in label for j in label if i < j)
    assert all(label[i] == label[j] and label[i].startswith("l") or label[i] != label[j] for i, j in met)
    assert len(rows) < 130 * 8


def cut_by_hand(rows, n):
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            first.setdefault(b[p:p + n], 2**63 if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p:p + n]] < (2**63 if i is None else i):
                gone[p:p + n] = b"\1" * n
        runs = sum(1 for p in range(len(b)) if gone[p] and (not p or not gone[p - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_multikey_quicksort_sorts_stably(monkeypatch):
    monkeypatch.setattr(suffix, "SMALL", 8)
    r = np.random.default_rng(2)
    for n, top in ((0, 5), (1, 5), (5000, 3), (5000, 2**63), (300, 1)):
        keys = [r.integers(0, top, n, dtype=np.uint64) for _ in range(3)]
        assert (suffix.multikey_quicksort(keys) == np.lexsort(keys[::-1])).all()


def test_splitters_part_even_one_seed_into_even_buckets():
    """All suffixes begin alike, and only their contexts differ: no bucket holds much more than its share."""
    r = np.random.default_rng(3)
    k0, k1 = np.full(64_000, 7, np.uint64), r.integers(0, 2**63, 64_000, dtype=np.uint64)
    some = r.choice(64_000, 64 * suffix.BUCKET_KEYS, replace=False)
    s = suffix._splitters(k0[some], k1[some], 64)
    assert len(s[0]) == 63
    order = suffix.multikey_quicksort([k0, k1])
    edges = suffix.split_at([k0[order], k1[order]], s)
    assert edges[0] == 0 and edges[-1] == 64_000 and (np.diff(edges) >= 0).all() and np.diff(edges).max() < 5000
    for k in range(63):
        assert (k1[order][edges[k]:edges[k + 1]] < s[1][k]).all() and (k1[order][edges[k + 1]:edges[k + 2]] >= s[1][k]).all()


def test_a_seed_of_many_contexts_is_compared_across_buckets(spark, monkeypatch):
    """A passage in ever other surroundings; splitters from all keys, so that many fall among its contexts."""
    monkeypatch.setattr(suffix, "BUCKET_BYTES", 256)
    monkeypatch.setattr(suffix, "HELD_WINDOWS", 300)
    r = random.Random(4)
    passage = "".join(r.choice("abcdefgh ") for _ in range(64))
    junk = lambda n: "".join(r.choice("ijklmnopqrstuv ") for _ in range(n))
    rows = [(i, junk(r.randint(0, 20)) + passage[r.randint(0, 8):64 - r.randint(0, 8)] + junk(r.randint(0, 20))) for i in range(60)]
    got = sorted(map(tuple, suffix.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()), key=str)
    assert got == cut_by_hand(rows, 50)


@pytest.mark.parametrize("n, bucket", [(20, 16 << 20), (50, 16 << 20), (50, 512)])
def test_repeated_bytes_match_brute_force(spark, monkeypatch, n, bucket):
    monkeypatch.setattr(suffix, "BUCKET_BYTES", bucket)
    rows = texts(5)
    df = spark.createDataFrame([(t, i, "s") for i, t in rows], "text string, doc_id long, bucket string")
    assert sorted(map(tuple, suffix.repeated_bytes(df, n).collect()), key=str) == cut_by_hand(rows, n)


def test_repeated_rows_and_null_ids_keep_their_own_bytes(spark):
    long = "one two three four five six seven eight nine ten eleven"
    rows = [(1, long), (1, long), (1, long + " more"), (None, long), (2, "x" + long), (None, "y" + long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffix.repeated_bytes(df, 50).collect()), key=str) == cut_by_hand(rows, 50)
    assert suffix.repeated_bytes(df.limit(0), 50).count() == 0


@pytest.mark.parametrize("bucket", [16 << 20, 128])
def test_what_a_document_repeats_goes_in_every_place(spark, monkeypatch, bucket):
    """The later document holds a piece of the earlier one several times, ever in the same surroundings, in one row or in two of one id."""
    monkeypatch.setattr(suffix, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(suffix, "HELD_WINDOWS", 300)
    r = random.Random(11)
    junk = lambda n: "".join(r.choice("ijklmnopqrstuv ") for _ in range(n))
    rows = []
    for i in range(12):
        piece, before, after = junk(90), junk(60), junk(60)
        again = before + piece + after
        rows += [(3 * i, junk(70) + piece + junk(70)), (3 * i + 1, junk(30) + (again + junk(30)) * 3 + again), (3 * i + 2, again + junk(20)), (3 * i + 2, junk(20) + again)]
    got = sorted(map(tuple, suffix.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()), key=str)
    assert got == cut_by_hand(rows, 50)


def test_many_different_rows_of_one_id_are_told_apart(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [(0, passage)] + [(5, f"{i} {passage}" if i % 2 else f"{i} and nothing else that any other row would hold, {i * i * i} times over") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffix.repeated_bytes(df, 50).collect()), key=str) == cut_by_hand(rows, 50)


def test_without_repeats_keeps_columns_and_valid_text(spark):
    shared = "é" * 40
    rows = [(0, "aß" + shared + "b", "s", 99), (1, "cé" + shared + "d", None, 99), (2, None, "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r for r in suffix.without_repeats(df, 50).collect()}
    assert got[0].text == "aß" + shared + "b" and got[0].n_chars == 43
    assert got[1].text in ("cd", "céd") and got[1].n_chars == len(got[1].text) and got[1].source is None
    assert got[2].text is None and got[2].n_chars is None


def test_a_hot_passage_is_cut_everywhere_but_in_the_first(spark):
    r = random.Random(9)
    line = "this very common line is in every document of this corpus, word by word"
    rows = [(i, " ".join(str(r.random()) for _ in range(5)) + line + " ".join(str(r.random()) for _ in range(5))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {x.doc_id: x.n_removed for x in suffix.repeated_bytes(df).collect()}
    assert got[0] == 0 and all(got[i] >= len(line) for i in range(1, 300))


def vectors(seed=0):
    r = np.random.default_rng(seed)
    base = r.normal(size=(30, 16))
    out = []
    for i in range(400):
        v = base[r.integers(30)] + r.normal(size=16) * r.choice([0, 0.02, 0.1, 0.2, 1])
        out.append((i, [float(np.float32(x)) for x in v * r.choice([1, 1e-3, 50])], int(r.integers(3)) if i % 2 else 0))
    out += [(400, None, 0), (401, [], 0), (402, [0.0] * 16, 0), (403, [None] + [1.0] * 15, 0), (404, [float("nan")] * 16, 0), (405, out[0][1], None), (406, out[0][1], out[0][2]), (407, out[0][1][:8], 0)]
    return out


def linked(rows, cosine):
    links = defaultdict(set)
    good = [(i, np.array(v, float), y) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    for i, a, x in good:
        for j, b, y in good:
            if i != j and x == y and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                links[i].add(j)
    return links


@pytest.mark.parametrize("block", [2048, 32])
def test_near_vectors_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    rows = vectors()
    links = linked(rows, 0.98)
    want = components([i for i, _, _ in rows], [(a, b) for a in links for b in links[a]])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.near_vectors(df).collect()}
    assert got == {i: (len(links[i]), want[i], want[i] == i) for i, _, _ in rows}


def test_near_vectors_of_repeated_rows_and_of_nothing(spark):
    schema = "label int, vec_id long, embedding array<float>, key string"
    rows = [(1, 5, [1.0, 2.0], "k"), (1, 5, [1.0, 2.0], "k"), (1, 9, [2.0, 4.0], "k"), (2, 9, [1.0, 2.0], "k"), (1, None, [1.0, 2.0], "k")]
    got = sorted(map(tuple, covertree.near_vectors(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(5, 3, 5, True), (5, 3, 5, True), (9, 3, 5, False), (9, 0, 9, True), (None, 3, 5, False)], key=str)
    assert covertree.near_vectors(spark.createDataFrame([], schema)).count() == 0


def test_cover_trees_prune_and_lose_nothing():
    r = np.random.default_rng(4)
    x = np.repeat(r.normal(size=(40, 8)), 20, axis=0) + r.normal(size=(800, 8)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {(int(a), int(b)) for i, j in covertree.dual(x, None, 0.98) for a, b in zip(i, j)}
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.98, 1)))}
    both = {(int(a), int(b)) for i, j in covertree.dual(x[:300], x[300:], 0.98) for a, b in zip(i, j)}
    assert both == {(int(a), int(b)) for a, b in zip(*np.nonzero(x[:300] @ x[300:].T >= 0.98))}


@pytest.mark.parametrize("most", [250_000, 20])
def test_components_of_chains_stars_and_loops(spark, monkeypatch, most):
    monkeypatch.setattr(common, "CONTRACTED", most)
    r = random.Random(6)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(50)] + [(300, 300)]
    r.shuffle(links)
    want = components({x for ab in links if ab[0] != ab[1] for x in ab}, links[:0] + [ab for ab in links if ab[0] != ab[1]])
    got = {x.node: x.root for x in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


@pytest.mark.parametrize("run", [minhash.near_duplicates, minhash.one_per_group])
def test_percents_that_candidates_are_not_made_for_are_refused(spark, run):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    with pytest.raises(ValueError, match="60"):
        run(df, percent=60)
    assert run(df, percent=80).count() == 1
