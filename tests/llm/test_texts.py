"""Mixing, pieces, fingerprints, toxicity, chats and licences."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import chat, fingerprint, license, mixing, pieces, toxicity
from gridloom.llm.common import words


def docs_of(n=900, seed=2):
    r = random.Random(seed)
    sources = ["a", "b", "c", "é", None]
    return [(i, r.choice(sources[:1] * 6 + sources), " ".join(["w"] * r.choice([1, 3, 10, 200]))) for i in range(n)] + [(n, "a", None), (n + 1, "z", ""), (n + 2, None, " \n")]


def fair(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, stopped, total = {}, set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in stopped)
        free = [s for s in order if s not in stopped]
        target = {s: most * sizes[s] if s in stopped else rest * w[s] / sum(w[f] for f in free) for s in order}
        above = [s for s in free if target[s] > most * sizes[s] + 1e-9]
        if not above:
            return target
        stopped |= set(above)


@pytest.mark.parametrize("bucket", [4096, 8])
def test_mixture_meets_its_targets(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", bucket)
    monkeypatch.setattr(mixing, "FAN", 3)
    rows = docs_of()
    df = spark.createDataFrame([(s, i, t, 1) for i, s, t in rows], "source string, doc_id long, text string, copies int")
    source = {i: s for i, s, _ in rows}
    got = {r.doc_id: r for r in mixing.mixture(df).collect()}
    sizes = {}
    for i, s, t in rows:
        assert got[i].size == len((t or "").split())
        sizes[s] = sizes.get(s, 0) + got[i].size
    want = fair(sizes)
    taken = dict.fromkeys(sizes, 0)
    for i, r in got.items():
        assert r.source_size == sizes[source[i]] and r.target == pytest.approx(want[source[i]])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source[i]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 200 for s in sizes)
    again = {r.doc_id: r.taken for r in mixing.mixture(df.repartition(9)).collect()}
    assert again == {i: r.taken for i, r in got.items()}
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.taken // r.size for r in got.values() if r.size)


def test_mixture_of_repeated_rows_and_of_nothing(spark):
    schema = "doc_id long, source string, text string"
    df = spark.createDataFrame([(1, "a", "x y")] * 3 + [(None, None, None), (2, "b", "z")], schema)
    got = mixing.mixture(df).collect()
    assert len(got) == 5 and len({r.taken for r in got if r.doc_id == 1}) == 1
    assert mixing.mixture(df.limit(0)).count() == 0
    assert [r.taken for r in mixing.mixture(df.where("doc_id IS NULL")).collect()] == [0]


SAMPLES = ["", "Hello, world", "  two  blanks ", "ein größeres Übel\n\tund mehr", "▁mark ▁▁ inside", "日本語と🙂", "a" * 3000, "word " * 2000, "\x00\x7f", None]


def best_score(p, text):
    """Plain dynamic programme over all substrings."""
    text = (" " + text).replace(" ", pieces.MARK)
    best = [0.0] + [-1e300] * len(text)
    for j in range(1, len(text) + 1):
        best[j] = best[j - 1] + p.unknown
        for i in range(max(0, j - 40), j):
            if p.trie.exists(text[i:j]):
                best[j] = max(best[j], best[i] + p.trie.get(text[i:j])[2])
    return best[-1]


def test_unigram_paths_are_optimal():
    p = pieces.Pieces(pieces.load_model(), pieces.UNIGRAM)
    for t in SAMPLES[1:4] + ["unbelievable tokenization of thhehent"]:
        ids = p.encode(t)
        assert p.decode(ids) == t
        got = sum(p.scores[i] for i in ids if i not in p.byte_of)
        characters = len(bytes(p.byte_of[i] for i in ids if i in p.byte_of).decode())
        assert got + characters * p.unknown == pytest.approx(best_score(p, t))


def test_bpe_ids_are_those_of_the_tokenizer_itself(monkeypatch):
    """Against the library's own encoder, and merging as it is defined; the memory overflows meanwhile."""
    import sentencepiece

    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    monkeypatch.setattr(pieces, "JOINS", 500)
    model = pieces.load_model()
    assert pieces.model_type(model) == pieces.BPE
    p, sp, r = pieces.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model), random.Random(8)
    texts = [t or "" for t in SAMPLES if pieces.MARK not in (t or "")] + ["".join(r.choice("abcdeéß  \nth漢e字🙂in.-'\u200b") for _ in range(r.randint(0, 60))) for _ in range(400)]
    ids, at = p.encode_all(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [sp.encode(t) for t in texts]
    assert p.comes_back(pa.array(texts), ids, at).all()
    assert not p.comes_back(pa.array(["x"]), p.encode_all(pa.array(["y"]))[0], np.array([0, 1])).any()
    for t in ["▁unbelievable", "▁▁▁the", "thhehent"]:
        assert [p.strings[i] for i in p.chunk(t)] == p.merge(t)


def test_models_that_change_texts_are_refused():
    model = pieces.load_model()
    with pytest.raises(ValueError, match="only unigram and BPE"):
        pieces.model_type(bytes([2 << 3 | 2, 2, 3 << 3, 3]) + b"\x1a\x04\x18\x01\x20\x00")  # a word model
    with pytest.raises(ValueError, match="normalises"):
        pieces.model_type(model + b"\x1a\x04\x18\x01\x20\x01")  # surplus blanks go


def test_pieces_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "doc_id long, text string")
    assert all(r.round_trip for r in pieces.piece_report(df).collect())
    back = pieces.decoded(pieces.encoded(df.withColumnRenamed("doc_id", "piece_ids")), "piece_ids_")
    assert all(r.decoded == r.text for r in back.collect())
    assert pieces.piece_report(df.limit(0)).count() == 0


def test_pieces_of_nulls_repeats_clashing_columns_and_long_texts(spark):
    rows = [(None, "a b", "x"), (1, "a b", None), (1, "a b", None), (2, None, "y"), (3, "", "z"), (4, "word " * 300_000 + "▁" * 7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece_ids string")
    got = {(r.doc_id, r.n_pieces, r.ids_sha256) for r in pieces.piece_report(df).collect()}
    ids = pieces.Pieces(pieces.load_model()).encode("a b")
    digest = lambda x: hashlib.sha256(np.array(x, "<i4").tobytes()).hexdigest()
    assert {(None, len(ids), digest(ids)), (1, len(ids), digest(ids)), (2, 0, digest([])), (3, 0, digest([]))} <= got and len(got) == 5
    assert pieces.piece_report(df).count() == len(rows)
    e = pieces.encoded(df)
    assert e.columns == ["doc_id", "text", "piece_ids", "piece_ids_"]
    assert {r.doc_id: r.piece_ids_ for r in e.collect() if r.doc_id in (2, 3)} == {2: None, 3: []}
    assert pieces.encoded(df.limit(0)).count() == 0


def test_prefix_hashes_answer_spans():
    a, b = fingerprint.Prefix("abcabcabd"), fingerprint.Prefix("xabcabce")
    assert a.equal(0, a, 3, 3) and not a.equal(0, a, 6, 3)
    assert a.extension(0, b, 1) == 6 and a.extension(8, b, 0) == 0 and a.extension(0, a, 3) == 5


def test_ranges_of_ids_are_even_in_bytes():
    r = np.random.default_rng(1)
    ids = np.cumsum(r.integers(1, 10**6, 40_000)) - 2**40
    sizes = np.where(r.random(40_000) < 0.01, 5_000, 500)
    some = r.choice(40_000, 200 * fingerprint.BUCKET_KEYS, replace=False)
    s = fingerprint.splitters_of(ids[some], sizes[some], 200)
    assert len(s) > 180 and (np.diff(s) > 0).all()
    held = np.bincount(np.searchsorted(s, ids, "right"), sizes)
    assert held.max() < 6 * held.mean()
    assert not len(fingerprint.splitters_of(np.zeros(0, np.int64), np.zeros(0), 9)) and fingerprint.splitters_of(np.full(9, 3), np.ones(9), 4).tolist() == [3]


@pytest.mark.parametrize("bucket", [64 << 20, 1000])
def test_fingerprints_match_their_definition(spark, monkeypatch, bucket):
    monkeypatch.setattr(fingerprint, "BUCKET_BYTES", bucket)
    r = random.Random(5)
    rows = [(i * 7, "".join(r.choice("abc é🙂") for _ in range(r.choice([0, 1, 5, 100, 3000])))) for i in range(60)] + [(1, None), (1000, "x" * 200)]
    df = spark.createDataFrame([(t, i) for i, t in rows], "text string, doc_id long").repartition(5)
    got = {x.doc_id: x for x in fingerprint.fingerprints(df).collect()}
    order = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        f, e, n = (fingerprint.Prefix(s).fingerprint() for s in (t, edited, after))
        assert (x.fingerprint, x.edited_fingerprint) == (f, e)
        assert (x.near_edited, x.near_next) == (fingerprint.likeness(f, e), fingerprint.likeness(f, n))
        assert (x.near_edited == 1.0) == (t == edited) or len(t) < 100
        assert x.edited_prefix == next((k for k in range(min(len(t), len(edited))) if t[k] != edited[k]), min(len(t), len(edited)))


def test_fingerprints_of_one_of_none_and_of_repeated_ids(spark):
    schema = "doc_id long, text string"
    one = fingerprint.fingerprints(spark.createDataFrame([(4, "abcdef")], schema)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one[0].near_next == 1.0
    assert fingerprint.fingerprints(spark.createDataFrame([], schema)).count() == 0
    assert fingerprint.fingerprints(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, None)], schema)).count() == 4


def test_toxicity_learns_only_from_training_rows(spark):
    r = random.Random(8)
    plain = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        bad = r.random() < 0.3
        w = [r.choice(plain) for _ in range(r.choice([20, 150]))]
        for _ in range(4 * bad):
            w[r.randrange(len(w))] = r.choice(["vile", "foul"])
        rows.append((i, " ".join(w)))
        held = zlib.crc32(str(i).encode()) % 5 == 0
        labels.append((i, int(bad != held)))  # held-out labels lie
    rows += [(900, None), (901, ""), (None, "vile foul vile foul vile vile foul")]
    df, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (902, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(df, y).collect()}
    right = sum((labels[i][1] == 0 if got[i].held_out else labels[i][1] == 1) == (got[i].predicted == 1) for i in range(900))
    assert right >= 880 and all(0 <= x.score <= 1 for x in got.values())
    assert got[900].predicted == got[901].predicted == 0 and got[900].score == got[901].score
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(902))
    clean = toxicity.without_toxic(df.withColumnRenamed("doc_id", "_toxicity").selectExpr("_toxicity AS doc_id", "text", "_toxicity"), y)
    assert clean.columns == ["doc_id", "text", "_toxicity"] and clean.count() == sum(x.predicted == 0 for x in got.values())


def test_toxicity_counts_in_parts_as_in_one(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["vile", "foul"] if i % 3 == 0 and r.random() < 0.2 else ["a", "b", "c", "d", "e", "f"]) for _ in range(40))) for i in range(300)]
    df, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    want = {x.doc_id: x.score for x in toxicity.toxicity(df, y).collect()}
    monkeypatch.setattr(toxicity, "PART_DOCS", 20)
    monkeypatch.setattr(toxicity, "FAN", 3)
    assert {x.doc_id: x.score for x in toxicity.toxicity(df, y).collect()} == pytest.approx(want)
    # More rows than a broadcast may hold: the same by a shuffle.
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 10)
    assert {x.doc_id: x.score for x in toxicity.toxicity(df, y).collect()} == pytest.approx(want)


def hashes_of(names):
    own = [n.encode() for n in names]
    return words(np.frombuffer(b" ".join(own), np.uint8), np.array([0, sum(map(len, own)) + len(own) - 1]))[3]


def test_toxicity_of_a_table_too_large_for_a_file(spark, monkeypatch):
    r = random.Random(23)
    rows = [(i, " ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(r.randrange(40))) + (" vile" if i % 3 == 0 else "")) for i in range(150)]
    rows += [(200, None), (201, ""), (202, rows[4][1]), (202, rows[4][1]), (203, "xx " * 5000), (None, rows[3][1])]
    df, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows[:150]], "doc_id long, toxic int")
    want = sorted((str(x.doc_id), x.held_out, round(x.score, 9)) for x in toxicity.toxicity(df, y).collect())
    for name, value in (("FILE_BYTES", 0), ("TABLE_BYTES", 60), ("PIECE_BYTES", 500), ("ASKING", 1)):
        monkeypatch.setattr(toxicity, name, value)
    model = toxicity.train(df, y)
    assert model.tables is not None and model.parts > 3
    assert sorted((str(x.doc_id), x.held_out, round(x.score, 9)) for x in toxicity.toxicity(df, y).collect()) == want
    assert toxicity.toxicity(df.limit(0), y).count() == 0
    wide = df.selectExpr("doc_id", "text", "array(doc_id) AS slice", "1.5 AS part")
    clean = toxicity.without_toxic(wide, y)
    assert clean.dtypes == wide.dtypes and clean.count() == sum(s < 0.5 for _, _, s in want)


def test_toxicity_keeps_words_of_one_slot_apart(spark):
    names = [f"x{i}" for i in range(6000)]
    slots, pair = {}, None
    for name, h in zip(names, hashes_of(names).tolist()):
        if (other := slots.setdefault(h % (1 << 20), name)) != name:
            pair = other, name
            break
    bad, other = pair
    r = random.Random(6)
    plain = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.sample(plain, 20) + [bad if i % 3 == 0 else r.choice(plain)] * 2)) for i in range(300)]
    asked = [(-1, f"w1 w2 {bad} w3 {bad} w4"), (-2, f"w1 w2 {other} w3 {other} w4"), (-3, "w1 w2 never w3 never w4")]
    df, y = spark.createDataFrame(rows + asked, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(df, y).collect()}
    assert got[-1].predicted == 1 and got[-2].score == pytest.approx(got[-3].score) and got[-2].score < got[-1].score


def test_toxicity_ratios_are_those_of_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PART_DOCS", 40)
    monkeypatch.setattr(toxicity, "FAN", 2)
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(vocabulary[min(int(r.expovariate(0.15)), 59)] for _ in range(25))) for i in range(260)]
    y = {i: int(i % 4 == 0) for i, _ in rows}
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(y.items()), "doc_id long, toxic int"))
    pairs, single, before = [Counter(), Counter()], [Counter(), Counter()], {}
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3):
            w = t.split()
            pairs[y[i]].update(set(zip(["^"] + w, w)))
            single[y[i]].update(set(w))
            for a, b in zip(["^"] + w, w):
                before.setdefault(b, set()).add(a)
    shared = {w: min(len(x), 2) + 0.5 for w, x in before.items()}
    every = sum(shared.values()) + 0.5
    context = [Counter(), Counter()]
    left = Counter()
    for k in (0, 1):
        for (a, _), n in pairs[k].items():
            context[k][a] += n
            left[a] += min(n, 5)

    def ratio(a, b):
        p, q = [], []
        for k in (0, 1):
            low = (max(single[k][b] - 2, 0) + sum(min(n, 2) for n in single[k].values()) * shared.get(b, 0.5) / every) / sum(single[k].values())
            seen = context[0][a] + context[1][a]
            q.append(math.log(low))
            p.append(math.log(max(pairs[k][a, b] - 5, 0) / max(context[k][a], 1) + (left[a] / seen if seen else 1) * low))
        plain = q[1] - q[0]
        return plain + max(-0.5, min(0.5, p[1] - p[0] - plain))

    asked = [(a, b) for a in vocabulary[:20] for b in vocabulary] + [("never", "w1"), ("w1", "never")]
    h = dict(zip(vocabulary + ["never"], hashes_of(vocabulary + ["never"])))
    got = model.ratio(np.array([h[a] for a, _ in asked]), np.array([h[b] for _, b in asked]))
    want = [ratio(a, b) for a, b in asked]
    assert got == pytest.approx(want, abs=1e-5) and sum(max(c[x] for c in pairs) > 5 for x in asked) > 20


def test_toxicity_counts_all_but_the_fitted_documents(spark):
    r = random.Random(4)
    plain = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(1200):
        bad = int(i % 3 == 0)
        w = [r.choice(plain) for _ in range(30)] + ["vile"] * bad
        if bad and zlib.crc32(str(i).encode()) % 5 == 4:
            w.append("foul")  # only where the fit's sample comes from
        r.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, bad))
    rows += [(-1, "w1 w2 foul w3 w4"), (-2, "w1 w2 w5 w3 w4")]
    df, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x.doc_id: x.predicted for x in toxicity.toxicity(df, y, per_class=12).collect()}
    assert (got[-1], got[-2]) == (1, 0)


def test_toxicity_without_labels_or_documents(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [x.predicted for x in toxicity.toxicity(df, none).collect()] in ([0], [1])
    assert toxicity.toxicity(df.limit(0), none).count() == 0


def test_preferences(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "ho"), (2, 2, "assistant", None), (2, 1, None, "x"), (3, 0, "user", "only"), (None, 0, "user", "lost"), (64, 0, "assistant", "q")]
    got = {r.pair_id: r for r in chat.preference_report(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")).collect()}
    assert set(got) == {1, 2}  # 64 has no neighbour
    r = got[1]
    assert (r.n_common, r.prompt, r.chosen, r.rejected) == (1, "<|user|>\nhi<|end|>\n", "<|assistant|>\nyes<|end|>\n", "<|assistant|>\n<|end|>\n")
    a, b = map(int, r.chosen_spans.split("-"))
    assert r.chosen[a:b] == "yes<|end|>"
    turn = "array<struct<role:string,text:string>>"
    pairs = spark.createDataFrame([(1, [("user", "a")], [("user", "a"), ("assistant", "b")]), (2, None, [("user", "a")]), (3, [("user", "a")], [("user", "a")]), (4, [(None, None)], [(None, None)])], f"pair_id int, chosen {turn}, rejected {turn}")
    got = {r.pair_id: (r.n_common, r.chosen, r.rejected) for r in chat.preferences(pairs).collect()}
    assert got == {1: (1, "", "<|assistant|>\nb<|end|>\n"), 2: (0, "", "<|user|>\na<|end|>\n"), 3: (1, "", ""), 4: (1, "", "")}
    assert chat.preference_report(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_preferences_match_a_loop(spark):
    """Gaps in the numbers, negative numbers, ties, repeated rows, nulls, a very long text, an extra column of a clashing name."""
    r = random.Random(12)
    ids = [i for i in range(-70, 300) if r.random() < 0.4] + [2**40, 2**40 + 5]
    rows = [(i, t, r.choice(["user", "assistant", "assistant", None]), r.choice([None, "", "a", "b\nc", f"é{i}"]), "n") for i in ids for t in [r.choice([None, 1, 2, 2, 3]) for _ in range(r.randint(1, 6))]]
    rows += rows[:20] + [(5, 9, "assistant", "long " * 50_000, "n"), (None, 1, "assistant", "x", "n")]
    key = lambda x: (x is not None, x if x is not None else "")
    held = {}
    for i, t, role, text, _ in rows:
        if i is not None:
            held.setdefault(i, []).append((key(t), key(role), key(text), role, text))
    held = {i: [x[3:] for x in sorted(v)] for i, v in held.items()}
    answers = {i: [k for k, x in enumerate(v) if x[0] == "assistant"] for i, v in held.items()}
    groups = {}
    for i in sorted(i for i in held if answers[i]):
        groups.setdefault(i >> 6, []).append(i)
    want = {}
    show = lambda xs: "".join(f"<|{a or ''}|>\n{t or ''}<|end|>\n" for a, t in xs)
    for g in groups.values():
        for i, j in zip(g, g[1:] + g[:1]):
            if i != j:
                a, k = held[i][:answers[i][-1] + 1], answers[i][i % len(answers[i])]
                b = a[:k] + [("assistant", held[j][answers[j][-1]][1])]
                n = next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))
                want[i] = (n, show(a[:n]), show(a[n:]), ["".join([t or "", "<|end|>"]) for y, t in a[n:] if y == "assistant"], show(b[n:]))
    got = chat.preferences(chat.answer_pairs(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, near string"))).collect()
    assert {x.pair_id: (x.n_common, x.prompt, x.chosen, [x.chosen[s.start:s.end] for s in x.chosen_spans], x.rejected) for x in got} == want
    assert len(got) == len(want) and len({x[0] for x in want.values()}) > 3


def test_licences(spark):
    mit = dict(license.TEXTS)["MIT"]
    rows = [(1, mit), (2, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("LICENSE", "LICENCE")), (3, mit + " no"), (4, None), (5, "prose\nReleased under the  MIT licence\nLicensed under CC BY-NC 4.0."), (5, "prose\nReleased under the  MIT licence\nLicensed under CC BY-NC 4.0.")]
    got = [tuple(r) for r in license.scan(spark.createDataFrame([(i, t, "d") for i, t in rows], "doc_id long, text string, digest string")).orderBy("doc_id").select("doc_id", "license_id", "notices").collect()]
    assert got == [(1, "MIT", ""), (2, "MIT", ""), (3, None, ""), (4, None, ""), (5, None, "CC-BY-NC-4.0,MIT"), (5, None, "CC-BY-NC-4.0,MIT")]
    assert license.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licences_of_full_texts_with_and_without_titles(spark):
    mit = dict(license.TEXTS[:4])["MIT"].split("\n\n", 1)[1]
    rows = [("MIT", mit), ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2024 Someone\n\n" + mit), (None, "Some other title\n\n" + mit)]
    known = {}
    for name, text in license.TEXTS:
        known.setdefault(name, []).append(text)
    for name in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0"):
        whole = max(known[name], key=len)
        rows += [(name, "Copyright (c) 2020 Someone\n" + whole.replace("\n", "\n  ")), (None, whole[:len(whole) // 2])]
    got = {r.doc_id: r.license_id for r in license.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == [x for x, _ in rows]


def test_licences_of_nulls_repeats_long_texts_and_clashing_columns(spark):
    mit = dict(license.TEXTS)["MIT"]
    rows = [(None, mit, "x"), (1, mit, None), (1, mit, None), (2, None, "y"), (3, " \n\t", None), (4, "word " * 300_000 + "\nSPDX-License-Identifier: MIT\n", None), (5, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license_id string")
    got = sorted(((r.doc_id, r.license_id, r.notices) for r in license.scan(df).collect()), key=str)
    assert got == sorted([(None, "MIT", ""), (1, "MIT", ""), (1, "MIT", ""), (2, None, ""), (3, None, ""), (4, None, "MIT"), (5, None, "")], key=str)
    assert license.scan(df.limit(0)).columns == ["doc_id", "digest", "license_id", "notices"]


@pytest.mark.parametrize("sources", [1000, 2])
def test_mixture_of_many_sources_in_shares(spark, monkeypatch, sources):
    """Sources in shares of about two: targets hold all the same."""
    monkeypatch.setattr(mixing, "SOURCES", sources)
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 50)
    r = random.Random(3)
    rows = [(i, f"s{r.randrange(40):02d}" if i % 9 else None, "w " * r.randint(0, 30)) for i in range(2000)]
    taken = {}
    for x in mixing.mixture(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect():
        s = dict((i, y) for i, y, _ in rows)[x.doc_id]
        t = taken.setdefault(s, [0, x.target, x.source_size])
        t[0] += x.taken
    assert len(taken) == 41 and all(abs(a - b) <= 90 for a, b, _ in taken.values())
