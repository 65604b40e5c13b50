"""Operators that compare rows with each other, against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from textmine.llm import bpe, decontaminate, quality, suffix_dedup, token_rollup, vector_dedup
from textmine.llm.common import text_bytes
from textmine.llm.components import connected_components
from textmine.llm.jaccard_join import similarity_classes
from textmine.llm.queries import BYTE_BPE

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdef") for _ in range(RNG.randint(2, 8))) for _ in range(900)]


def prose(n: int) -> str:
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def reach(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(5, 7), (7, 5), (7, 6), (3, 3), (100, 50)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = dict(map(tuple, connected_components(frame).collect()))
    ids = {x for pair in links if pair[0] != pair[1] for x in pair}
    assert got == reach([p for p in links if p[0] != p[1]], ids)
    assert connected_components(frame.limit(0)).count() == 0


def suffix_brute(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter()
    for t in texts:
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] += 1
    out = collections.Counter()
    for (doc, _), t in zip(rows, texts, strict=True):
        inside = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                inside[i + 1 : i + 201] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~inside[1:-1]])
        spans = int((inside[1:] & ~inside[:-1]).sum())
        digest = hashlib.sha256(kept).hexdigest()
        out[doc, len(t), int(inside.sum()), spans, digest] += 1
    return out


def test_repeated_strings_go(spark):
    shared = [prose(60) for _ in range(3)]
    rows = [
        (i, f"{prose(RNG.randint(0, 60))} {RNG.choice(shared)[RNG.randint(0, 60):]} {prose(9)}")
        for i in range(60)
    ]
    copy = prose(120)
    rows += [(100 + i, copy) for i in range(20)] + [(None, copy), (200, "a" * 900), (201, None)]
    rows += [(202, ""), (203, "z" * 200), (204, "q" * 200), (204, "q" * 200), (205, "é" * 150)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string")
    expected = suffix_brute(rows)
    for shard in (4096, 6):  # the second one cuts groups and merges them
        got = collections.Counter(
            (
                r["doc_id"],
                r["n_bytes"],
                sum(x["end"] - x["start"] for x in r["runs"]),
                len(r["runs"]),
                r["kept_sha256"],
            )
            for r in suffix_dedup.remove_repeats(frame, shard=shard).collect()
        )
        assert got == expected
    assert suffix_dedup.remove_repeats(frame.limit(0)).count() == 0


def shingles(text, k):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", lowered)
    if len(words) < k:
        return frozenset({tuple(words)} if words else ())
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def test_jaccard_classes_against_all_pairs(spark):
    base = prose(150).split()
    rows = []
    for i in range(90):  # a group of near copies, some similar enough and some not
        own = list(base)
        for _ in range(RNG.randint(0, 5)):
            own[RNG.randrange(len(own))] = RNG.choice(WORDS)
        rows.append((i, " ".join(own)))
    rows += [(200 + i, prose(RNG.randint(1, 80))) for i in range(40)]
    rows += [(300, "a b"), (301, "A  b"), (302, "b a"), (303, ""), (304, None), (305, " \n")]
    rows += [(306, rows[0][1]), (306, rows[0][1]), (307, "solo")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    sets = {i: shingles(t, 4) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b)
        for j, a in enumerate(ids)
        for b in ids[:j]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    root = reach(links, ids)
    got = similarity_classes(frame, k=4, share=(85, 100)).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"]) == (len(sets[i]), root[i])
    assert similarity_classes(frame.limit(0)).count() == 0


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(120, 16))
    near = np.concatenate([points[i] + rng.normal(size=(12, 16)) * 0.12 for i in range(6)])
    vectors = [v.tolist() for v in np.concatenate([points, near])]
    vectors += [vectors[0], vectors[0]]
    rows = list(enumerate(vectors))
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] * 16, [None] * 16, [1.0]]
    frame = spark.createDataFrame(
        [(i, v, 0) for i, v in rows] + [(1000 + i, v, 0) for i, v in enumerate(bad)],
        "vec_id long, embedding array<double>, n int",
    )
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    similar = unit @ unit.T >= 0.95
    np.fill_diagonal(similar, False)
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(frame).collect()}
    found = sum(got[i]["n_links"] for i, _ in rows)
    assert found >= 0.9 * similar.sum()
    assert all(got[i]["n_links"] <= similar[i].sum() for i, _ in rows)
    assert got[0]["n_links"] >= 2 and not got[len(vectors) - 1]["kept"]
    for i in range(len(bad)):
        r = got[1000 + i]
        assert (r["n_links"], r["component_id"], r["kept"]) == (0, 1000 + i, True)
    assert vector_dedup.near_vectors(frame.limit(0)).count() == 0


def test_benchmark_items_in_documents(spark):
    items = [(i, f"{prose(25).capitalize()}. {prose(12)}.") for i in range(30)]
    items += [(30, None), (31, ""), (32, items[0][1])]
    clean = [(100 + i, prose(150)) for i in range(40)]
    leaks = [(i, f"{prose(100)} {items[i][1].upper()} {prose(200)}") for i in range(10)]
    leaks.append((10, f"{prose(3000)} {items[10][1]}"))
    rows = clean + leaks + [(50, None), (51, ""), (0, leaks[0][1])]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_items(frame, benchmark)
    assert out.columns == [*frame.columns, "benchmark_items"] and out.count() == len(rows)
    found = {(r["doc_id"], x["item_id"]) for r in out.collect() for x in r["benchmark_items"]}
    assert found == {(i, i) for i in range(11)} | {(0, 32)}
    assert decontaminate.find_items(frame, benchmark.limit(0)).count() == len(rows)
    assert decontaminate.find_items(frame.limit(0), benchmark).count() == 0


def test_estimated_labellers():
    """Posteriors recover a hidden class from labellers of different accuracy."""
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.2
    votes = np.stack(
        [np.where(rng.random(len(truth)) < right, truth, ~truth) for right in (0.95, 0.9, 0.8)], 1
    ).astype(int)
    votes[rng.random(votes.shape) < 0.2] = 2
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior = quality.estimate(patterns, counts.astype(float), 1.0)[back.ravel()]
    assert ((posterior > 0.5) == truth).mean() > 0.93


def test_junk_and_toxic_documents_go(spark):
    rows = [(i, f"{prose(RNG.randint(30, 90)).capitalize()}.\n{prose(30)}.") for i in range(200)]
    rows += [(200 + i, " ".join(w + "%%%" for w in prose(60).split())) for i in range(20)]
    rows += [(220 + i, (prose(8) + "\n") * 20) for i in range(20)]
    rows += [(240 + i, prose(20) + " stupid worthless idiot trash " + prose(20)) for i in range(20)]
    rows += [(300, None), (301, ""), (302, " \n ")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, junk string")
    out = quality.classify(frame)
    assert out.columns == ["doc_id", "text", "junk", "toxicity", "kept"]
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert len(kept) == len(rows)
    assert sum(kept[i] for i in range(200)) >= 196
    assert sum(kept[i] for i in range(200, 260)) <= 4
    assert not any(kept[i] for i in (300, 301, 302))
    assert quality.classify(frame.limit(0)).count() == 0


def test_few_toxic_documents_of_a_large_corpus_go(spark):
    """The sample holds one document in ten, and hardly a toxic one if drawn evenly."""
    bad = ["zorgle", "flumpet", "gribbit", "snarvik"]
    rows = [(i, f"{prose(RNG.randint(30, 60)).capitalize()}. {prose(12)}.") for i in range(3000)]
    rows += [(3000 + i, f"{prose(25)} {RNG.choice(bad)} {RNG.choice(bad)} {prose(25)}") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    told = [(i, int(i >= 3000)) for i in range(0, 3060, 2)]
    labels = spark.createDataFrame(told, "doc_id long, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality.classify(frame, labels=labels, train_rows=300).collect()}
    assert sum(kept[i] for i in range(3001, 3060, 2)) <= 2  # none of them is labelled
    assert sum(kept[i] for i in range(3000)) >= 2940


def test_small_strata_are_drawn_whole():
    share = quality.shares(np.array([9000, 20, 5, 600]), 1000)
    assert share[1] == share[2] == 1 and abs(share @ [9000, 20, 5, 600] - 1000) < 1e-6


def test_parts_of_a_benchmark_do_not_change_scores(spark, monkeypatch):
    items = [(i, f"{prose(RNG.randint(6, 30))}. {prose(4)}.") for i in range(60)]
    docs = [(i, f"{prose(50)} {items[i][1]} {prose(50)}") for i in range(60)]
    docs += [(100 + i, items[i][1]) for i in range(60)]
    benchmark = spark.createDataFrame([*items, (98, ""), (99, None)], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")

    def found():
        rows = decontaminate.find_items(frame, benchmark).collect()
        return {
            (r["doc_id"], f["item_id"]): (round(f["score"], 9), f["at"])
            for r in rows
            for f in r["benchmark_items"]
        }

    one = found()
    monkeypatch.setattr(decontaminate, "PART_ITEMS", 16)
    assert len(one) >= 120 and found() == one


def test_batches_count_once(spark, tmp_path):
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "rollup"))
    kind = "source string, lang string, tokens long, chars long, extra int"
    first = spark.createDataFrame(
        [("s", "en", 5, 20, 0), ("s", None, 2, 9, 0), ("s", "en", 5, 20, 0)], kind
    )
    assert rollup.totals().count() == 0
    assert rollup.apply("one", token_rollup.signed(first, 1, "v1"))
    assert not rollup.apply("one", token_rollup.signed(first, 1, "v1"))
    gone = first.where("lang is null")
    rollup.apply("two", token_rollup.signed(gone, -1, "v1"))
    rollup.apply("none", token_rollup.signed(first.limit(0), 1, "v1"))
    expected = [("s", "en", "v1", 2, 10, 40)]
    assert [tuple(r) for r in rollup.totals().collect()] == expected
    rollup.compact()
    assert [tuple(r) for r in rollup.totals().collect()] == expected
    revised = token_rollup.signed(first.limit(1), -1, "v1").union(
        token_rollup.signed(first.limit(1), 1, "v2")
    )
    rollup.apply("three", revised)
    rollup.apply("two", token_rollup.signed(gone, -1, "v1"))
    rollup.compact()
    got = {tuple(r) for r in rollup.totals().collect()}
    assert got == {("s", "en", "v1", 1, 5, 20), ("s", "en", "v2", 1, 5, 20)}


def test_pipeline_stages(spark, folder):
    item = f"{prose(20).capitalize()}. {prose(10)}."
    rows = [(i, f"{prose(60).capitalize()}. {prose(40)}.", "en", "s", 1) for i in range(150)]
    rows += [(150 + i, "!!! ### " * 40 + prose(5), "en", "s", 1) for i in range(12)]
    copy = rows[0][1]
    rows += [(170, copy, "en", "s", 1), (171, copy + " more", "en", "s", 1)]
    rows += [(180, prose(50) + " " + item + " " + prose(50), "en", "s", 1)]
    rows += [(181, prose(50) + " ab@cd.ef " + prose(50), "en", "s", 1), (190, None, None, None, None)]
    sf = folder(
        documents=(rows, "doc_id long, text string, lang string, source string, n_chars long"),
        labels=([(0, 1, 0), (150, 0, 0)], "doc_id long, quality int, toxic int"),
        benchmark=([(1, item)], "item_id long, text string"),
    )
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert not {*range(150, 162), 170, 171, 180, 190} & set(got)
    assert len(set(got) & set(range(150))) >= 147
    assert "[EMAIL]" in got[181]["text"] and got[181]["n_chars"] == len(got[181]["text"])
    assert all(r["decodes"] and r["n_tokens"] == len(r["token_ids"]) for r in got.values())


def test_pipeline_stages_bound_the_bytes_of_batches(spark):
    """Every stage, also run on its own, and for texts of any length."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "A text.", "en", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(name, "64m")
            stage(spark, docs, "/root/testdata/sf0.001")
            assert int(spark.conf.get(name)) <= 4 << 20
    finally:
        spark.conf.set(name, before)


def test_decoding_builds_no_merges(monkeypatch):
    content = type("Content", (), {"value": open(BYTE_BPE, "rb").read()})
    own = bpe.Encoder(bpe.Vocabulary.parse(content.value))
    ids, offsets = own.encode(["Hello wörld <|endoftext|> x", None, "a b"])
    monkeypatch.setattr(bpe, "Vocabulary", None)
    monkeypatch.setattr(bpe, "_decoders", {})
    assert bpe.decoder(content).decode(ids, offsets) == ["Hello wörld <|endoftext|> x", "", "a b"]


def test_the_driver_gives_the_training_sample_back(spark, monkeypatch):
    """The sample and what was made of it must not stay in the driver's Python."""
    given = []
    monkeypatch.setattr(quality, "give_back", lambda: given.append(1))
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toPandas", None)
    rows = [(i, f"some words of a text {i}" if i % 3 else "you stupid idiot moron") for i in range(60)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(30)], "doc_id long, toxic boolean")
    model = quality.fit(documents, labels=labels)
    assert len(given) == 2
    found = {r["doc_id"]: r["kept"] for r in quality.score(documents, model).collect()}
    assert found == {i: i % 3 != 0 for i in range(60)}


def test_the_labellers_read_every_text_once(spark, monkeypatch):
    """Drawing the training sample hands no further texts to Python but its own."""
    plain = type(spark.range(1)).mapInArrow
    read = []

    def counted(frame, *args, **kwargs):
        if "text" in frame.columns:
            read.append(frame.count())
        return plain(frame, *args, **kwargs)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", counted)
    rows = [(i, f"{prose(30)}." if i % 50 else "you stupid idiot moron") for i in range(600)]
    rows += [rows[0], rows[1], (None, None), (None, "")]
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), train_rows=100)
    assert model.weights.any()
    assert read[0] == len(rows) and 50 < sum(read[1:]) <= 100


def test_votes_need_no_shapes_and_count_different_words_exactly():
    data, offsets = text_bytes(pa.array(["a b a\nA b", "", None, "b b", "%%% x\n%%% x\nyou idiot"]))
    piece = quality.Features(data, offsets)
    votes = piece.votes(np.zeros(0, np.uint64))
    assert "shapes" not in vars(piece)
    assert piece.measures[:, 2].tolist() == [3 / 5, 1, 1, 1 / 2, 4 / 6]
    assert piece.measures[:, 3].tolist() == [1, 1, 1, 1, 2 / 3]
    assert votes["marks"][:, 3].tolist() == [2, 1, 1, 2, 2] and votes["toxic"][4, 0] == 1
