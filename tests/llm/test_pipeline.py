"""The corpus pipeline, stage by stage against brute force, and as a whole."""

import random
from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from gridloom.llm import mixing, pieces, toxicity
from tests.llm.test_dedup import WORD, components, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=3):
    """Documents with insults in some, exact and near copies, and a passage that many share."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(3, 8))) for _ in range(1500)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    rows, labels = [], []
    for i in range(900):
        w = [r.choice(vocabulary) for _ in range(r.randint(20, 90))]
        bad = r.random() < 0.25
        if bad:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(["vile", "scum", "filth"])
        text = " ".join(w)
        if not bad and i % 9 == 0:
            text += " " + passage
        rows.append((i, text, "xx", f"s{i % 4}", len(text)))
        labels.append((i, 1, int(bad)))
    for i in range(900, 960):
        w = rows[r.randrange(200, 260)][1].split()
        if i % 2:
            w[r.randrange(len(w))] = "other"
        rows.append((i, " ".join(w), None, None, 0))
    rows += [(960, None, None, "s0", None), (961, "", "xx", "s1", 0), (962, " \n ", None, None, 3), (963, "ab é🙂 " * 4000, "xx", "s2", 24000)]
    return rows, labels


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's rows, written and read again as the run does, after those of documents."""
    folder = tmp_path_factory.mktemp("corpus").as_uri()
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs.collect())
    return folder, out


def test_toxic_documents_go_and_others_stay_as_they_are(spark, stages):
    folder, (docs, kept, *_) = stages
    rows, labels = corpus()
    bad = {i for i, _, toxic in labels if toxic}
    said = {r.doc_id: r.predicted for r in toxicity.toxicity(spark.createDataFrame(rows, SCHEMA), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert sorted(kept, key=str) == sorted((r for r in docs if not said[r.doc_id]), key=str)
    left = {r.doc_id for r in kept}
    assert len(left & bad) <= 0.05 * len(bad) and len({i for i, *_ in rows} - left - bad) <= 20


def test_one_document_of_each_group_stays(stages):
    before, after = stages[1][1:3]
    sets = {r.doc_id: shingles(r.text, 5) for r in before}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = components(sets, links)
    assert len(links) > 20 and sorted(after, key=str) == sorted((r for r in before if root[r.doc_id] == r.doc_id), key=str)


def test_strings_of_earlier_documents_are_cut(stages):
    before, after = stages[1][2:4]
    first = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        b = (r.text or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p:p + 50], r.doc_id)
    want = {}
    for r in before:
        b = (r.text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < r.doc_id:
                gone[p:p + 50] = b"\1" * 50
        text = bytes(x for x, g in zip(b, gone) if not g).decode(errors="ignore")
        want[r.doc_id] = (None, None) if r.text is None else (text, len(text))
    assert {r.doc_id: (r.text, r.n_chars) for r in after} == want and sum(len(r.text or "") for r in after) < sum(len(r.text or "") for r in before) - 1000
    assert {(r.doc_id, r.lang, r.source) for r in after} == {(r.doc_id, r.lang, r.source) for r in before}


def test_sources_come_near_their_targets(stages):
    before, after = stages[1][3:5]
    size = lambda r: len(WORD.findall(r.text or ""))
    copies = Counter((r.doc_id, r.text, r.source, r.lang, r.n_chars) for r in after)
    assert set(copies) <= {(r.doc_id, r.text, r.source, r.lang, r.n_chars) for r in before if size(r)} and max(copies.values()) <= mixing.MOST
    sizes, taken = Counter(), Counter()
    for rows, to in ((before, sizes), (after, taken)):
        for r in rows:
            to[r.source] += size(r)
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    limit = {s: mixing.MOST * n for s, n in sizes.items()}
    low, high = 0.0, 10.0 * sum(sizes.values())
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if sum(min(limit[s], c * weight[s]) for s in sizes) < sum(sizes.values()) else (low, c)
    largest = Counter()
    for r in before:
        largest[r.source] = max(largest[r.source], size(r))
    assert all(abs(taken[s] - min(limit[s], low * weight[s])) <= largest[s] + 1 for s in sizes)


def test_texts_are_encoded_as_the_tokenizer_does(stages):
    before, after = stages[1][4:6]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert Counter((r.doc_id, tuple(r.piece_ids)) for r in after) == Counter((r.doc_id, tuple(sp.encode(r.text))) for r in before)


def test_the_run_is_the_stages_one_after_another(spark, stages):
    folder, rows = stages
    got = corpus_pipeline.run(spark, folder)
    assert Counter(map(str, got.collect())) == Counter(map(str, rows[-1])) and corpus_pipeline.ORACLE_SQL is None


def test_stages_of_nothing_and_of_odd_rows(spark, tmp_path):
    """Empty tables, and repeated rows, nulls everywhere and extra columns of clashing names, pass every stage."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    schema = SCHEMA + ", _id long, bucket string, _copies int, toxicity double, cid string"
    rows = [(None, None, None, None, None, 1, "b", 2, 0.5, "c")] * 2 + [(1, "a b c", None, None, None, None, None, None, None, None)] * 2 + [(2, "x " * 30_000, "l", "s", 9, 0, "", 0, 0.0, "")]
    for some in ([], rows):
        docs = spark.createDataFrame(some, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, f"file://{tmp_path}")
            assert docs.columns == [x.split()[0] for x in schema.split(", ")]
        assert {r.doc_id for r in docs.collect()} <= {x[0] for x in some}
