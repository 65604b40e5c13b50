from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import tuples
from textmine.operators import cooccurrence as co
from textmine.operators import pair_blocks
from textmine.sources import tables
from textmine.sources.scratch import materialize


def brute(rows):
    """{(key, term, other): n} of rows (key, words, at, upto)."""
    n = Counter()
    for key, words, at, upto in rows:
        words = [w for w in words or [] if w is not None]
        for w in sorted(set(words))[at:upto]:
            for u in words:
                if u != w:
                    n[key, w, u] += 1
    return dict(n)


def lines(seed=3, pieces=False):
    rng = random.Random(seed)
    vocabulary = [f"{c}{i}" for c in "aéz" for i in range(15)]
    rows = [
        (rng.choice(["x", "y", None]), rng.choices(vocabulary, [1 / (i + 1) for i in range(45)], k=rng.randint(0, 20)))
        for _ in range(120)
    ]
    rows = [*rows, *rows[:40] * 3, ("x", None), ("y", [None, "a0", "z1"]), ("x", [])]
    if pieces:
        return [(k, w, at, at + 7) for k, w in rows for at in range(0, 21, 7)]
    return [(k, w, 0, pair_blocks.ALL) for k, w in rows]


def batches(rows, size):
    kinds = [pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32()]
    for i in range(0, len(rows), size):
        columns = zip(*rows[i : i + size], strict=True)
        arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "words", "at", "upto"])


@pytest.mark.parametrize("pieces", [False, True])
@pytest.mark.parametrize("small", [False, True])
def test_blocks_hold_the_counts(monkeypatch, pieces, small):
    """However chunks, slices and parts are cut, the blocks sum up to brute force."""
    if small:
        for name, value in (("PAIRS_PER_CHUNK", 3_000), ("PAIRS_PER_SLICE", 200), ("ENTRIES_HELD", 300),
                            ("ENTRIES_PER_ROW", 3), ("ROWS_PER_BATCH", 50)):
            monkeypatch.setattr(pair_blocks, name, value)
    rows, cuts = lines(pieces=pieces), [("a0", "a3"), ("a0", "b"), ("ab", "x"), ("z1", "a0"), ("zz", "a")]
    block = pa.schema([("key", pa.string()), ("part", pa.int32()), ("block", pa.binary())])
    out = pa.schema([("key", pa.string()), ("term", pa.string()), ("entries", pa.null())])
    dealt = list(pair_blocks.dealt(["key"], cuts, block)(batches(rows, 25)))
    got, many = {}, pa.Table.from_batches(dealt)
    for part in range(len(cuts) + 1):
        own = many.filter(pa.compute.equal(many["part"], part)).select(["key", "block"])
        for batch in pair_blocks.summed(["key"], out)(iter(own.to_batches())):
            for row in batch.to_pylist():
                for e in row["entries"]:
                    pair = row["term"], e["other"]
                    assert sum(c <= pair for c in cuts) == part
                    assert (row["key"], *pair) not in got
                    got[(row["key"], *pair)] = e["n"]
    assert got == brute(rows) and got


def test_copies_of_a_line_are_paired_once():
    chunk = pair_blocks.Chunk(pa.Table.from_batches(batches([("x", ["b", "a", "b"], 0, pair_blocks.ALL)] * 50, 9)), ["key"])
    assert len(chunk.terms) == 2
    _, term, other, n = (c.tolist() for c in next(chunk.entries()))
    assert (term, other, n) == ([0, 1], [1, 0], [100, 50])


def test_blocks_are_few_bytes():
    """A pair costs far less than its words."""
    rng = random.Random(1)
    rows = [("x", rng.sample([f"word{i}" for i in range(300)], 40), 0, pair_blocks.ALL) for _ in range(200)]
    block = pa.schema([("part", pa.int32()), ("block", pa.binary())])
    dealt = list(pair_blocks.dealt([], [], block)(batches(rows, 50)))
    assert sum(len(b) for d in dealt for b in d["block"].to_pylist()) < 3 * len(brute(rows))


@pytest.mark.parametrize("sort", [False, True])
def test_lines_are_read_once_and_sums_move_once(spark, sort):
    words = spark.createDataFrame([(["a", "b"],), (["b", "c"],)], "words array<string>")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    counted = co.directional_counts(words.mapInArrow(count, words.schema), sort=sort)
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(tuples(counted)) == [("a", "b", 1), ("b", "a", 1), ("b", "c", 1), ("c", "b", 1)]
    assert seen.value == 2


def test_long_lines_are_many_rows(spark, monkeypatch):
    monkeypatch.setattr(co, "PAIRS_PER_LINE", 30)
    rows = [(None,), ([],), (list("abcdefghij"),), (list("abc"),), (["a", None] * 6,)]
    df = spark.createDataFrame(rows, "words array<string>")
    cut = co._cut_lines(df, 100)
    assert cut.where("get(words, 9) = 'j'").count() == 4
    expected = brute([(None, w, 0, pair_blocks.ALL) for (w,) in rows])
    assert sorted(tuples(co.directional_counts(df))) == sorted((t, o, n) for (_, t, o), n in expected.items())


@pytest.mark.parametrize("kind", ["date", "bigint"])
def test_keys_of_any_type(spark, kind):
    rows = [("1", ["a", "b"]), ("2", ["a", "b", "b"]), (None, ["a", "c"]), ("1", ["b", "a"])]
    df = spark.createDataFrame(rows, "k string, words array<string>")
    key = F.expr("date_add(date'2020-01-01', cast(k as int))") if kind == "date" else F.col("k").cast(kind)
    got = tuples(co.directional_counts(df.withColumn("k", key), keys=["k"], sort=True))
    keys = [r[0] for r in tuples(df.select(key))]
    expected = brute([(k, w, 0, pair_blocks.ALL) for k, (_, w) in zip(keys, rows, strict=True)])
    assert got == sorted(((*k, n) for k, n in expected.items()), key=lambda r: (r[0] is not None, *map(str, r[:3])))


def test_stripes_read_their_counts_once(spark):
    counts = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "term string, other string, n bigint")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    assert co.as_stripes(counts.mapInArrow(count, counts.schema)).count() == 2
    assert seen.value == 2


def test_shuffles_of_a_written_table_are_gone(spark):
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    table = materialize(spark.range(1000).repartition(3).groupBy(F.col("id") % 7).count(), "counts")
    assert tracker.shuffleStatuses().size() <= before
    assert table.count() == 7


def test_items_are_dealt_by_order_before_they_are_listed(spark, tmp_path):
    spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 5)], "l_orderkey bigint, l_linenumber int, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(5, "red nut"), (6, "old rod")], "p_partkey bigint, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("select 1L o_orderkey, timestamp_ntz'1995-01-02 00:00:00' o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    lines = tables.dated_lines(spark, str(tmp_path))
    assert tuples(lines) == [(1, "19950102,red nut old rod")]
    plan = lines._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("partial_collect_list") :].split("\n")[1]
    assert "Exchange" in below or "AQEShuffleRead" in below or "ShuffleQueryStage" in below
