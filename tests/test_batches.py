"""Results kept by batch, dense numbers, ordered files, and counts from one reading."""

from __future__ import annotations

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import tuples
from textmine.operators import cooccurrence as co
from textmine.operators import counts
from textmine.operators.numbering import dense_numbers
from textmine.plans.jobs import tfidf_by_period
from textmine.sources import lines as text_lines
from textmine.sources.scratch import materialize

PERIODS = "period string, words array<string>"
DELTA = "term string, other string, n bigint"


# -- stripes ------------------------------------------------------------------


def applied(spark, batches, max_entries):
    stored = None
    for batch in batches:
        deltas = spark.createDataFrame(batch, DELTA)
        stored = materialize(co.apply_deltas(stored, deltas, max_entries=max_entries), "stripes")
    return stored


@pytest.mark.parametrize("max_entries", [3, 1000])
def test_signed_batches_equal_the_whole(spark, max_entries):
    draw = random.Random(1)
    loads = [
        [(draw.choice("abc"), f"w{draw.randrange(40)}", draw.randrange(1, 5)) for _ in range(120)]
        for _ in range(3)
    ]
    batches = [loads[0], loads[1] + loads[2], [(t, o, -n) for t, o, n in loads[1]]]
    stored = applied(spark, batches, max_entries)
    want = Counter()
    for t, o, n in loads[0] + loads[2]:
        want[t, o] += n
    got = tuples(co.stripes_to_rows(stored))
    assert sorted(got) == sorted((*k, n) for k, n in want.items())
    # A part holds twice its share at most, but for the unevenness of a hash.
    largest = stored.agg(F.max(F.size("stripe"))).head()[0]
    assert largest <= 5 * max_entries
    assert stored.groupBy("term", "part").count().where("count > 1").isEmpty()
    assert stored.groupBy("term").agg(F.countDistinct("parts").alias("n")).where("n > 1").isEmpty()


def test_entries_and_stripes_that_cancel_leave(spark):
    rows = [("a", "b", 2), ("a", "c", 1), ("b", "a", 1)]
    stored = applied(spark, [rows, [("a", "c", -1), ("b", "a", -1)], [("z", "y", 0)]], 10)
    assert tuples(stored) == [("a", 1, 0, {"b": 2})]


def test_parts_that_a_batch_does_not_touch_stay(spark):
    rows = [("a", f"w{i}", 1) for i in range(60)]
    stored = applied(spark, [rows], 5)
    later = co.apply_deltas(stored, spark.createDataFrame([("a", "w1", 4)], DELTA), max_entries=5)
    before, after = ({r.part: r.stripe for r in s.collect()} for s in (stored, later))
    changed = [p for p in before if before[p] != after[p]]
    assert set(before) == set(after) and len(changed) == 1
    assert after[changed[0]]["w1"] == 5


def test_stripes_of_keyed_counts(spark):
    df = spark.createDataFrame([("x", ["a", "b"]), ("y", ["a", "b"]), ("y", ["a", "c"])], PERIODS)
    keyed = co.directional_counts(df, keys=["period"])
    assert keyed.columns == ["period", "term", "other", "n"]
    stripes = co.as_stripes(keyed, keys=["period"], max_entries=1)
    assert stripes.columns == ["period", "term", "part", "stripe"]
    merged = sorted(tuples(co.merge_stripes(stripes)))
    assert merged == sorted(tuples(co.directional_counts(df)))


# -- periods ------------------------------------------------------------------

ROWS = [("p", ["a", "b", "a"]), ("q", ["a", ""]), ("r", []), ("s", None), (None, ["a"]), ("p", ["c"])]


def test_number_of_periods_comes_from_the_same_reading(spark, tmp_path):
    path = f"{tmp_path}/records"
    spark.createDataFrame(ROWS, PERIODS).write.parquet(path)
    df = spark.read.parquet(path)
    found, n = counts.term_and_period_counts(df)
    assert tuples(n) == [(4,)]
    assert sorted(tuples(found), key=str) == sorted(tuples(counts.term_period_counts(df)), key=str)
    weighted = tfidf_by_period(df)
    assert sorted(tuples(weighted), key=str) == sorted(tuples(tfidf_by_period(df, n_periods=4)), key=str)
    rows = weighted.collect()  # so that the adaptive plan is the final one
    plan = weighted._jdf.queryExecution().executedPlan().toString()
    final = plan.split("\n+- == Initial Plan ==")[0]
    # Only stages that ran read columns into rows; initial plans of subqueries do not.
    assert len(rows) == 5 and final.count("ColumnarToRow") == 1
    assert final.count("ReusedExchange") >= 2


def test_bitmaps_of_batches_merge(spark):
    draw = random.Random(2)
    rows = [(f"y{draw.randrange(150)}", draw.choices("abcdefgh", k=3)) for _ in range(400)]
    whole = spark.createDataFrame(rows, PERIODS)
    numbers, bitmaps = None, []
    for part in (rows[:150], rows[150:160], rows[160:]):
        counted = counts.term_period_counts(spark.createDataFrame(part, PERIODS))
        numbers = materialize(counts.number_periods(counted.select("period"), numbers), "numbers")
        bitmaps.append(counts.period_bitmaps(counted, numbers))
    used = sorted(r.number for r in numbers.collect())
    assert used == list(range(len({p for p, _ in rows})))
    got = counts.bitmap_frequency(counts.merge_period_bitmaps(*bitmaps))
    assert sorted(tuples(got)) == sorted(tuples(counts.period_frequency(whole)))
    words = counts.merge_period_bitmaps(*bitmaps).agg(F.max("word")).head()[0]
    assert words == (len(used) - 1) // 64


def test_bitmaps_of_nothing(spark):
    empty = counts.term_period_counts(spark.createDataFrame([], PERIODS))
    numbers = counts.number_periods(empty.select("period"))
    assert tuples(counts.bitmap_frequency(counts.period_bitmaps(empty, numbers))) == []


# -- numbers and order --------------------------------------------------------


def test_numbers_have_no_gaps_and_follow_the_order(spark):
    df = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(900)).alias("x"), "id").repartition(7)
    numbered = dense_numbers(df, [F.desc("x"), "id"], "n")
    assert dict(numbered.dtypes)["n"] == "int"
    rows = sorted(numbered.collect(), key=lambda r: (-r.x, r.id))
    assert [r.n for r in rows] == list(range(5000))
    assert dense_numbers(df.limit(0), ["x"], "n").count() == 0


@pytest.mark.parametrize("files", [None, 1, 5])
def test_files_in_name_order_are_the_sorted_rows(spark, tmp_path, files):
    rows = [(f"t{i * 7919 % 1000:03}", i % 3, f"line {i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "term string, period int, output string")
    path = f"{tmp_path}/out"
    text_lines.write_ordered_lines(df, path, ["term", F.desc("period")], files=files)
    names = sorted(n for n in os.listdir(path) if n.startswith("part-"))
    assert len(names) == (files or len(names))
    read = [line for n in names for line in open(f"{path}/{n}").read().splitlines()]
    want = [r[2] for r in sorted(rows, key=lambda r: (r[0], -r[1]))]
    assert read == want
    placed = text_lines.read_ordered_lines(spark, path).orderBy("place")
    assert tuples(placed) == list(enumerate(want))


def test_ordered_files_of_nothing(spark, tmp_path):
    path = f"{tmp_path}/none"
    empty = spark.createDataFrame([], "output string")
    text_lines.write_ordered_lines(empty, path, ["output"])
    assert text_lines.read_ordered_lines(spark, path).count() == 0
