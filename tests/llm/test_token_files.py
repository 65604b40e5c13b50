"""Token files against the tokenizers library and exact round trips."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textmine.llm import token_files
from textmine.llm.common import bound_batches
from textmine.llm.fragments import load_tokenizer
from textmine.llm.queries import vocabulary_file

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def reference(rows):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary_file("word_bpe_49k.json"))
    out, at = [], 0
    for doc, text in rows:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


def round_trip(spark, rows, tmp_path, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    path = f"{tmp_path}/files"
    token_files.write_token_files(df, vocabulary_file("word_bpe_49k.json"), path)
    got = token_files.read_token_files(spark, path)
    return sorted((tuple(r) for r in got.collect()), key=lambda r: r[1])


@given(
    st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 60), max_size=1500),
    st.integers(1, 100),
)
@settings(max_examples=60, deadline=None)
def test_blocks_hold_any_ids(ids, percent):
    ids = np.array(ids, np.uint32)
    data, starts = token_files.pack_blocks(ids, percent)
    got = token_files.unpack_blocks(data, starts, 0, len(starts) - 1)
    assert got[: len(ids)].tolist() == ids.tolist()


def test_narrow_blocks_with_a_few_patches_are_small():
    ids = np.arange(10_000, dtype=np.uint32) % 200 + 1000
    ids[::1000] = 40_000
    data, _ = token_files.pack_blocks(ids)
    assert len(data) < 10_000 * 1.05


def test_one_document_is_read_from_its_blocks():
    sizes = np.array([3, 0, 5000, 7, 600])
    ids = np.arange(sizes.sum(), dtype=np.uint32) * 7 % 49_000
    segment = token_files.Segment(token_files.encode_segment([5, None, 9, 9, -2], sizes, ids))
    assert segment.doc_ids.to_pylist() == [5, None, 9, 9, -2]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(5):
        assert segment.ids(i, i + 1).tolist() == ids[bounds[i] : bounds[i + 1]].tolist()
    assert segment.ids().tolist() == ids.tolist()


def test_a_damaged_segment_is_an_error():
    payload = bytearray(token_files.encode_segment([1], np.array([3]), np.arange(3)))
    payload[-1] ^= 1
    with pytest.raises(ValueError):
        token_files.Segment(bytes(payload))


def test_texts_of_all_kinds(spark, tmp_path):
    rows = [
        (7, "Plain words, twice. plain WORDS"),
        (1, None),
        (2, ""),
        (3, " \n\t two  spaces and others \n"),
        (4, "<|endoftext|> in<|startoftext|>side 's I'm they'LL 12345"),
        (5, "é É H̱ İ ẞ ΣΣ \U0001f600你好"),
        (6, "q" * 30_000 + " " + "long text " * 40_000),
        (9, "\x00\x1c\x85 control"),
        (10, "İstanbul Été, ÆØÅ! ĲĲ. ŉ? ẞ ǅ ſ Ⱥ; K Å word... word.,x don't. 'S ß"),
    ]
    assert round_trip(spark, rows, tmp_path) == reference(sorted(rows))


def test_null_ids_come_first_and_repeated_rows_stay(spark, tmp_path):
    rows = [(4, "b b"), (None, "x"), (4, "b b"), (-3, "a"), (4, "b b")]
    got = round_trip(spark, rows, tmp_path)
    assert got == reference([(None, "x"), (-3, "a"), (4, "b b"), (4, "b b"), (4, "b b")])


def test_equal_ids_of_different_texts_have_one_order(spark):
    rows = [(1, t) for t in "abcdef"] + [(None, "n"), (None, "m")]
    got = [
        token_files.unpack(
            token_files.pack(
                spark.createDataFrame(order, SCHEMA).repartition(n),
                vocabulary_file("word_bpe_49k.json"),
            )
        )
        .orderBy("start")
        .collect()
        for order, n in ((rows, 1), (rows[::-1], 3))
    ]
    assert got[0] == got[1]


@pytest.mark.parametrize("hot", [5, None])
def test_an_id_of_a_third_of_the_rows_is_dealt_over_several_parts(spark, hot):
    rows = [(i, f"text {i}") for i in range(200)] + [(hot, f"hot {i}") for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        segments = token_files.pack(df, vocabulary_file("word_bpe_49k.json"))
        assert segments.agg({"docs": "max"}).head()[0] < 70
        got = token_files.unpack(segments).orderBy("start").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    docs = [r.doc_id for r in got]
    assert docs == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    want = {tuple(r[4]) for r in reference(rows)}
    assert {tuple(r.token_ids) for r in got} == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_empty_table_and_clashing_columns(spark, tmp_path):
    assert round_trip(spark, [], tmp_path / "a") == []
    schema = "doc_id long, ids string, text string, payload int, start int, doc int, range int"
    rows = [(3, "x", "some text", 1, 2, 3, 4), (1, "y", "more", None, None, None, None)]
    got = round_trip(spark, rows, tmp_path / "b", schema)
    assert got == reference([(1, "more"), (3, "some text")])


def test_many_segments_and_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 40)
    rows = [(i, f"document {i} " * (i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    segments = token_files.pack(df, vocabulary_file("word_bpe_49k.json"))
    got = token_files.unpack(segments, with_ids=False).orderBy("start").collect()
    assert [tuple(r) for r in got] == [r[:4] for r in reference(rows)]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query_equals_the_library(spark):
    import __spark_entry__ as contract

    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id")
    want = reference([tuple(r) for r in documents.select("doc_id", "text").collect()])
    got = contract.queries()["op12_token_files"](spark, FOLDER)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [r[:4] for r in want]


def test_a_workers_tables_are_bounded_by_bytes(monkeypatch):
    """Fragments may be as long as texts, so their number alone is no bound."""
    monkeypatch.setattr(token_files, "KEPT_BYTES", 10_000)
    with open(vocabulary_file("word_bpe_49k.json"), "rb") as file:
        own = token_files._Ids(load_tokenizer(file.read()))
    texts = [f"{i}-" * 1_000 for i in range(20)]
    want = own.encode(pa.array(texts), 1)
    for text, ids in zip(texts, want, strict=True):
        assert own.encode(pa.array([text]), 1) == [ids]
        assert sum(map(len, [*own.words, *own.others])) <= 10_000


def test_batches_are_bounded_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")
        bound_batches(spark)
        texts = spark.range(0, 3_000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

        assert texts.mapInArrow(sizes, "n long").agg(F.max("n")).head()[0] < 5 << 20
        spark.conf.set(name, "1m")
        bound_batches(spark)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)


def test_the_parquet_reader_holds_few_rows(spark):
    """Texts of a reader's batch stand in one array, which must not grow with 4,096 texts."""
    names = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(name) for name in names]
    try:
        spark.conf.set(names[0], 4096)
        bound_batches(spark)
        assert int(spark.conf.get(names[0])) <= 256
        spark.conf.set(names[0], 16)
        bound_batches(spark)
        assert spark.conf.get(names[0]) == "16"
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)


def library_texts(own):
    """The texts that the library is given from now on, by one text and by many words in one."""
    single, many = [], []

    def spy(name, seen):
        plain = getattr(own, name)

        def run(texts, **options):
            seen.extend(texts)
            return plain(texts, **options)

        setattr(own, name, run)

    spy("encode_batch", single)
    spy("encode_words", many)
    return single, many


def test_symbols_behind_words_are_encoded_once():
    with open(vocabulary_file("word_bpe_49k.json"), "rb") as file:
        own = token_files._Ids(load_tokenizer(file.read()))
    single, _ = library_texts(own)
    symbols = [chr(i) for i in range(33, 127) if not chr(i).isalnum()]
    texts = [f"Étre{a} the{a}{b} {a}x{b}" for a in symbols for b in symbols]
    got = own.encode(pa.array(["alpha*** beta***", "gamma***"]), 1)
    assert single == ["***"]
    got += own.encode(pa.array(texts), 1)
    want = reference(enumerate(["alpha*** beta***", "gamma***", *texts]))
    assert [np.frombuffer(ids, own.kind).tolist() for ids in got] == [r[4] for r in want]


def test_frequent_units_outlive_full_tables(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_FRAGMENTS", 40)
    with open(vocabulary_file("word_bpe_49k.json"), "rb") as file:
        own = token_files._Ids(load_tokenizer(file.read()))
    single, many = library_texts(own)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [f"often 77 {' '.join(f'q{a}{b}' for b in letters)}" for a in letters]
    got = [own.encode(pa.array([text]), 1)[0] for text in texts]
    assert [np.frombuffer(ids, own.kind).tolist() for ids in got] == [
        r[4] for r in reference(enumerate(texts))
    ]
    assert single.count("77") == 1 and " ".join(many).split().count("often") == 1
    assert len(own.words) + len(own.old_words) <= 2 * 40
