"""Rows that share an id, have none, or differ in dimension."""

from __future__ import annotations

import corpus_pipeline
from textmine.llm import vector_dedup
from textmine.llm.queries import QUERIES

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
A = "one two three four five six seven eight nine ten"
B = "red orange yellow green blue indigo violet black white grey"


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCUMENT)
    got = corpus_pipeline.ngram_jaccard_join(spark, docs.repartition(3), "")
    assert got.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in got.collect()), key=str)


def test_different_texts_of_one_id_both_stay(spark):
    assert kept(spark, [(7, A), (7, B), (3, A)]) == [(3, A), (7, B)]


def test_copies_without_an_id_are_compared(spark):
    assert kept(spark, [(None, A), (None, A), (None, B)]) == [(None, A), (None, B)]
    assert kept(spark, [(None, A), (9, A), (9, A)]) == [(9, A)]


def test_no_text_and_no_rows(spark):
    rows = [(1, None), (2, None), (3, ""), (3, "")]
    assert kept(spark, rows) == sorted(rows, key=str)
    assert kept(spark, []) == []


def test_no_different_text_is_lost(spark):
    texts = [A.replace("five", f"w{i}") + f" tail{i} end{i}" for i in range(6)] + [A, B, A]
    rows = [(i % 2 or None, t) for i, t in enumerate(texts)]
    assert {t for _, t in kept(spark, rows)} == set(texts)


def test_vectors_link_within_their_dimension(spark):
    vectors = [[1.0, 2.0], [1.0, 2.0], [2.0, 4.0], *[[1.0, i / 9, -i / 9] for i in range(6)]]
    vectors += [[1.0], [-3.0], [5.0], [], [0.0, 0.0], None]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in vector_dedup.near_vectors(df).collect()}

    def close(v, w):
        dot = sum(x * y for x, y in zip(v, w, strict=True))
        return dot >= 0.95 * (sum(x * x for x in v) * sum(x * x for x in w)) ** 0.5

    for i, v in enumerate(vectors):
        links = [
            j
            for j, w in enumerate(vectors)
            if i != j and v and w and any(v) and any(w) and len(v) == len(w) and close(v, w)
        ]
        assert got[i].n_links == len(links)
    assert [got[i].component_id for i in (0, 1, 2)] == [0, 0, 0]


def test_token_counts_equal_the_libraries(spark, folder):
    """Copies count once, what is not English by the other vocabulary, a null language too."""
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    from textmine.llm.queries import BYTE_BPE, MULTI_BPE

    rows = [
        (1, "Some plain text.", "en", "a", 1),
        (2, "Some plain text.", "de", "b", 1),
        (3, "Etwas anderes, größer", "de", "a", 1),
        (4, "Sans langue", None, "a", 1),
        (5, None, "en", None, 1),
        (6, "", "de", "b", 1),
    ]
    sf = folder(documents=(rows, DOCUMENT))
    ranks = (line.split() for line in open(MULTI_BPE, "rb"))
    import public_tokenizers

    multi = tiktoken.Encoding(
        "m",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks={base64.b64decode(a): int(b) for a, b in ranks},
        special_tokens={},
    )
    one = Tokenizer.from_file(BYTE_BPE)
    want: dict = {}
    seen = set()
    for _, text, lang, source, _ in rows:
        text = text or ""
        if text in seen:
            continue
        seen.add(text)
        english = lang == "en"
        n = len(one.encode(text).ids if english else multi.encode_ordinary(text))
        key = (source, lang, "byte_bpe_50k" if english else "byte_bpe_multi_50k")
        docs, tokens, chars = want.get(key, (0, 0, 0))
        want[key] = (docs + 1, tokens + n, chars + len(text))
    got = QUERIES["op8_token_counts"](spark, sf).collect()
    assert {(r.source, r.lang, r.version): (r.docs, r.tokens, r.chars) for r in got} == want


def test_one_row_of_each_text_is_counted(spark, folder):
    """Repeated rows, ids that texts share and rows without an id."""
    rows = [
        (1, "alpha beta", "en", "a", 1),
        (1, "alpha beta", "en", "a", 1),
        (1, "alpha beta", "de", "a", 1),
        (None, "alpha beta", "en", "b", 1),
        (None, "gamma", "fr", "b", 1),
        (None, "gamma", "fr", "b", 1),
        (1, "delta", "en", "a", 1),
    ]
    got = QUERIES["op8_token_counts"](spark, folder(documents=(rows, DOCUMENT))).collect()
    found = {(r.source, r.lang, r.version): (r.docs, r.chars) for r in got}
    assert found == {
        ("a", "de", "byte_bpe_multi_50k"): (1, 10),
        ("b", "fr", "byte_bpe_multi_50k"): (1, 5),
        ("a", "en", "byte_bpe_50k"): (1, 5),
    }
