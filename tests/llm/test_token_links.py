"""Alignment of two tokenizers against a plain brute-force version."""

from __future__ import annotations

import hashlib
import os
import random
from collections import Counter, defaultdict

import pytest

from textmine.llm import token_links
from textmine.llm.queries import vocabulary_file

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
A, B = vocabulary_file("byte_bpe_50k.json"), vocabulary_file("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    """Whole texts by the libraries, overlaps by comparing all ranges of a group."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=B)
    bytes_a = token_links.byte_level_tokens(open(A, "rb").read())
    bytes_b = token_links.piece_tokens(b)
    kept, docs = [], Counter()
    for doc, text in rows:
        want = (" " + (text or "")).encode()
        both = []
        for ids, table in (
            (a.encode(" " + (text or ""), add_special_tokens=False).ids, bytes_a),
            (b.encode(text or ""), bytes_b),
        ):
            at, tokens = 0, []
            for i in ids:
                tokens.append((i, at, at + len(table[i])))
                at += len(table[i])
            both.append(tokens if b"".join(table[i] for i in ids) == want else None)
        if not text or None in both:
            kept.append((doc, [], [], [], [], ""))
            continue
        ends = sorted({t[2] for t in both[0]} & {t[2] for t in both[1]})
        groups, links, first = [], [], 0
        for end in ends:
            x, y = ([t for t in side if first <= t[1] < end] for side in both)
            groups.append((x, y))
            links += [(p[0], q[0]) for p in x for q in y if p[1] < q[2] and q[1] < p[2]]
            first = end
        docs.update(set(links))
        shown = ";".join(
            ",".join(str(t[0]) for t in x) + "|" + ",".join(str(t[0]) for t in y)
            for x, y in groups
        )
        digest = hashlib.sha256(shown.encode()).hexdigest()
        kept.append((doc, both[0], both[1], groups, links, digest))
    best = defaultdict(int)
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    return [
        (
            doc,
            len(x),
            len(y),
            len(groups),
            len(links),
            sum(docs[link] == best[link[0]] for link in links),
            sum(docs[link] for link in links),
            digest,
        )
        for doc, x, y, groups, links, digest in kept
    ], docs


def check(spark, rows, schema=SCHEMA, width=2):
    want, docs = brute([r[:width] for r in rows])
    found = token_links.align(spark.createDataFrame(rows, schema).repartition(3), A, B)
    got = sorted(map(repr, found.documents.collect()))
    assert found.documents.columns == COLUMNS
    names = [f"{c}={{!r}}" for c in COLUMNS]
    assert got == sorted(f"Row({', '.join(names)})".format(*r) for r in want)
    pairs = {(r.a, r.b): r.docs for r in found.pairs.collect()}
    assert pairs == dict(docs)


TEXTS = [
    "plain words and, punctuation.",
    "aaa aaa aaaa",
    " leading", "trailing ", "a  b", "a   b\n\n c", "\t\tx \n y", " ", "  ", "\n",
    "it's they'll 12345 3.14",
    "café naïve 你好 \U0001f600\U0001f600 ﬁ",
    "under▁score a▁ b",
    "<s> </s> <unk> <|endoftext|> <0x41>",
    "\x00 nul \x1c x y 　z",
    "é Å ﻿bom",
    "https://example.com/a?b=c&d=e#f 0xdeadbeef ___ ---- ....",
    "q" * 5000,
    "word " * 3000,
    "",
    None,
]


def test_texts_of_all_kinds_repeated_rows_and_null_ids(spark):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[0]), (3, TEXTS[0]), (None, TEXTS[1]), (None, None)]
    check(spark, rows)


def test_random_texts(spark):
    draw = random.Random(5)
    letters = "ab e.'é\n  一T1-"
    rows = [(i, "".join(draw.choices(letters, k=draw.randrange(60)))) for i in range(400)]
    check(spark, rows)


def test_many_chunks_and_a_small_table_of_fragments(spark, monkeypatch):
    monkeypatch.setattr(token_links, "KEPT_FRAGMENTS", 5)
    aligner = token_links.Aligner(open(A, "rb").read(), open(B, "rb").read())
    import pyarrow as pa

    texts = ["one two three four", "five six seven", "one two", "eight nine ten one"]
    want = [aligner.chunk(pa.array([1]), pa.array([t])) for t in texts]
    again = [aligner.chunk(pa.array([1]), pa.array([t])) for t in texts]
    for x, y in zip(want, again, strict=True):
        assert x["documents"] == y["documents"] and x["pairs"].tolist() == y["pairs"].tolist()


def test_empty_table_and_clashing_columns(spark):
    check(spark, [])
    schema = "doc_id long, text string, chunk int, doc string, pairs int, n_a int, docs int"
    check(spark, [(1, "some text", 1, "x", 2, 3, 4), (2, None, 1, "x", 2, 3, 4)], schema)


def test_identity_map_prefers_other_pieces_to_bytes():
    got = token_links.identity_map([b"a", b"b", b"zz"], [b"a", b"b", b"a", b"b"], {0, 3})
    assert got.tolist() == [2, 1, -1]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query_equals_brute_force(spark):
    import __spark_entry__ as contract

    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    want, _ = brute([tuple(r) for r in documents.collect()])
    got = contract.queries()["op13_token_links"](spark, FOLDER)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
