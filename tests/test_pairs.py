from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tests.conftest import tuples
from textmine.functions.text import period_pair_line
from textmine.operators import cooccurrence as co
from textmine.operators import promising
from textmine.operators import tokens
from textmine.operators.topk import top_k_per_group
from textmine.plans.jobs import directional_cooccurrence, top_pairs_by_period

TOP3 = [
    ("2003", "council", "welcomes", 2),
    ("2003", "ambulance", "council", 1),
    ("2003", "ambulance", "decision", 1),
    ("2004", "cowboys", "eels", 2),
    ("2004", "bush", "castro", 1),
    ("2004", "bush", "cuban", 1),
    ("2020", "coronavirus", "economy", 2),
    ("2020", "aid", "china", 1),
    ("2020", "aid", "coronavirus", 1),
]


def counted(rows):
    """Pair counts by brute force over positions."""
    n = Counter()
    for period, words in rows:
        for a, b in combinations(words, 2):
            n[(period, *sorted((a, b)))] += 1
    return sorted((*key, c) for key, c in n.items())


def top(pairs, k):
    out = []
    for period in sorted({p for p, *_ in pairs}):
        mine = [r for r in pairs if r[0] == period]
        out += sorted(mine, key=lambda r: (-r[3], r[1], r[2]))[:k]
    return out


@pytest.fixture(params=[False, True], ids=["few", "many"])
def many_terms(request, monkeypatch):
    """Without and with the pruning that small vocabularies do not need."""
    if request.param:
        monkeypatch.setattr(promising, "FEW_DISTINCT", 0)


@pytest.fixture(scope="module")
def random_rows():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    return [
        (rng.choice("xxxy"), rng.choices(vocabulary, weights, k=rng.randint(0, 30)))
        for _ in range(120)
    ]


@pytest.fixture(scope="module")
def random_lines(spark, random_rows):
    return spark.createDataFrame(random_rows, "period string, words array<string>")


def test_fixture_counts(cleaned):
    per_line = co.unordered_pairs(cleaned).groupBy("period").agg(F.sum("n"))
    assert dict(tuples(per_line)) == {"2003": 41, "2004": 27, "2020": 85}
    per_period = co.pair_counts(cleaned).groupBy("period").count()
    assert dict(tuples(per_period)) == {"2003": 40, "2004": 26, "2020": 84}


@pytest.mark.parametrize("prune", [False, True])
def test_fixture_top(cleaned, prune, many_terms):
    assert tuples(top_pairs_by_period(cleaned, 3, prune=prune)) == TOP3


def test_fixture_text(cleaned):
    top3 = top_pairs_by_period(cleaned, 1)
    lines = top3.select(period_pair_line(*(F.col(c) for c in top3.columns)))
    assert tuples(lines)[0] == ("2003    council,welcomes:2",)


def test_headlines_top(parsed):
    assert tuples(top_pairs_by_period(parsed, 3)) == [
        ("2019", "adelaide", "centre", 1),
        ("2019", "adelaide", "shopping", 1),
        ("2019", "adelaide", "stabbed", 1),
        ("2020", "coronavirus", "economy", 2),
        ("2020", "aid", "china", 1),
        ("2020", "aid", "coronavirus", 1),
        ("2021", "bounce", "economy", 1),
        ("2021", "bounce", "starts", 1),
        ("2021", "bounce", "unemployment", 1),
    ]


def test_equal_counts_rank_by_terms(spark):
    df = spark.createDataFrame([("p", ["d", "c", "b", "a"])], "period string, words array<string>")
    assert [r[1:3] for r in tuples(top_pairs_by_period(df, 2))] == [("a", "b"), ("a", "c")]


def test_all_counts_against_brute_force(random_lines, random_rows):
    assert sorted(tuples(co.pair_counts(random_lines))) == counted(random_rows)


def test_spread_changes_nothing(random_lines, monkeypatch):
    plain = sorted(tuples(co.pair_counts(random_lines)))
    monkeypatch.setattr(co, "TERMS_PER_PIECE", 3)
    assert sorted(tuples(co.pair_counts(random_lines, spread=5))) == plain


@pytest.mark.parametrize("k", [1, 5, 100_000])
@pytest.mark.parametrize("buckets", [None, 7, 64])
def test_pruning_is_exact(random_lines, random_rows, k, buckets, monkeypatch):
    monkeypatch.setattr(promising, "SEED_TERMS", 4)
    monkeypatch.setattr(promising, "FEW_DISTINCT", 0)
    if buckets:  # with a pass over bucket sums, coarse or fine
        monkeypatch.setattr(promising, "FEW_PAIRS", 0)
        monkeypatch.setattr(promising, "BUCKETS", buckets)
    want = top(counted(random_rows), k)
    assert tuples(top_pairs_by_period(random_lines, k, prune=True)) == want


def test_buckets_give_a_floor_where_strong_terms_give_none(spark, monkeypatch):
    """Six pairs of different terms: the two strongest terms form one pair, not three."""
    monkeypatch.setattr(promising, "SEED_TERMS", 2)
    rows = [("p", [f"a{i}", f"b{i}"]) for i in range(6) for _ in range(10 - i)]
    df = spark.createDataFrame(rows, "period string, words array<string>")
    bags = co.with_bags(df, ["period"])
    _, floors = promising.promising_bags(bags, ["period"], 3)
    assert floors.count() == 0
    sums = promising.pair_buckets(co.bag_pairs(bags, ["period"]), ["period"])
    assert tuples(promising.bucket_floors(sums, ["period"], 3)) == [("p", 8)]
    monkeypatch.setattr(promising, "FEW_PAIRS", 0)
    monkeypatch.setattr(promising, "FEW_DISTINCT", 0)
    left = promising.promising_pairs(bags, ["period"], 3)
    assert sorted(r[3] for r in tuples(left)) == [8, 9, 10]


def test_pairs_of_light_buckets_are_not_counted(random_lines, monkeypatch):
    monkeypatch.setattr(promising, "FEW_PAIRS", 0)
    monkeypatch.setattr(promising, "FEW_DISTINCT", 0)
    bags = co.with_bags(random_lines, ["period"])
    left = promising.promising_pairs(bags, ["period"], 2).count()
    assert left < co.bag_pairs(bags, ["period"]).count() / 10


@pytest.mark.parametrize("copies", [1, 100_000])
def test_copies_of_a_line_are_expanded_once(spark, copies):
    words = ["a", "b", "b", "c"]
    df = spark.range(copies).select(F.lit("p").alias("period"), F.array(*map(F.lit, words)).alias("words"))
    bags = co.with_bags(df, ["period"])
    assert tuples(co.line_pieces(bags, ["period"]).select("lines")) == [(copies,)]
    assert co.bag_pairs(bags, ["period"]).count() == 4
    want = [(*key, n * copies) for *key, n in counted([("p", words)])]
    assert sorted(tuples(co.pair_counts(df))) == want
    both = sorted(tuples(co.directional_counts(df)))
    assert both == [(w, u, n * copies) for w, u, n in directed([words])]
    assert tuples(top_pairs_by_period(df, 2)) == [("p", "a", "b", 2 * copies), ("p", "b", "c", 2 * copies)]


def test_equal_ends_of_long_lines_are_one_piece(spark, monkeypatch):
    monkeypatch.setattr(co, "TERMS_PER_PIECE", 2)
    lines = [("p", list("abcdef")), ("p", list("zycdef"))] * 3
    df = spark.createDataFrame(lines, "period string, words array<string>")
    pieces = co.line_pieces(co.with_bags(df, ["period"]), ["period"])
    found = {"".join(e.term for e in r.piece): r.lines for r in pieces.collect()}
    assert found == {"abcdef": 3, "cdef": 3, "ef": 3, "cdefyz": 3, "efyz": 3, "yz": 3}
    assert sorted(tuples(co.pair_counts(df))) == counted(lines)


def test_pruning_keeps_rows_without_a_period(spark, monkeypatch):
    rows = [(None, ["a", "b", "b"]), (None, ["a", "b"]), ("p", ["c", "d"]), ("p", None)]
    df = spark.createDataFrame(rows, "period string, words array<string>")
    want = [(None, "a", "b", 3), ("p", "c", "d", 1)]
    assert tuples(top_pairs_by_period(df, 1, prune=False)) == want
    assert tuples(top_pairs_by_period(df, 1)) == want
    monkeypatch.setattr(promising, "FEW_PAIRS", 0)
    monkeypatch.setattr(promising, "FEW_DISTINCT", 0)
    assert tuples(top_pairs_by_period(df, 1)) == want


def test_pruning_drops_terms(random_lines):
    from textmine.operators.promising import promising_bags

    bags = co.with_bags(random_lines, ["period"])
    size = F.sum(F.size("bag"))
    reduced, _ = promising_bags(bags, ["period"], 1)
    assert reduced.agg(size).head()[0] < bags.agg(size).head()[0] / 2


@pytest.mark.parametrize("form", ["list", "frame", "long list", "long frame"])
def test_stopword_forms(spark, form, monkeypatch):
    rows = [("p", ["b", "the", "a", "b", "The"]), ("p", ["the", "c"])]
    df = spark.createDataFrame(rows, "period string, words array<string>")
    stop = ["the", "of"]
    if form.startswith("long"):
        monkeypatch.setattr(tokens, "MAX_INLINE_STOPWORDS", 1)
    if form.endswith("frame"):
        stop = spark.createDataFrame([(w,) for w in stop], "word string")
    assert tuples(top_pairs_by_period(df, 9, stopwords=stop)) == [
        ("p", "a", "b", 2),
        ("p", "b", "b", 1),
    ]


def test_top_k_above_the_group_limit(spark, random_lines):
    pairs = co.pair_counts(random_lines)
    order = [F.desc("n"), F.col("term1"), F.col("term2")]
    plain = sorted(tuples(top_k_per_group(pairs, ["period"], order, 7)))
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "3")
    try:
        salted = top_k_per_group(pairs, ["period"], order, 7, salts=5)
        assert sorted(tuples(salted)) == plain
        assert salted.columns == pairs.columns
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_top_k_plan_limits_before_the_shuffle(cleaned):
    plan = top_pairs_by_period(cleaned, 3, prune=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_k_must_be_positive(cleaned):
    with pytest.raises(ValueError, match="at least 1"):
        top_pairs_by_period(cleaned, 0)


def directed(lines):
    n = Counter()
    for words in lines:
        for w in set(words):
            for u in words:
                if u != w:
                    n[w, u] += 1
    return sorted((*key, c) for key, c in n.items())


def test_directional_sentence(spark):
    lines = spark.createDataFrame([("the number of the tts in words",)], "value string")
    rows = tuples(directional_cooccurrence(lines))
    assert len(rows) == 30 and rows == sorted(rows)
    assert all(n == (2 if other == "the" else 1) for _, other, n in rows)


def test_directional_sums_across_lines(spark):
    lines = spark.createDataFrame([("A b, a",), (" b a! ",), ("one",), ("",)], "value string")
    assert tuples(directional_cooccurrence(lines)) == [("a", "b", 2), ("b", "a", 3)]


def test_directional_against_brute_force(random_lines, random_rows):
    assert sorted(tuples(co.directional_counts(random_lines))) == directed(
        [w for _, w in random_rows]
    )


@pytest.mark.parametrize("sort", [False, True])
def test_directional_parts_and_frequent_terms(spark, random_lines, random_rows, monkeypatch, sort):
    """Small parts, so that frequent terms are cut by the beginnings of the other words."""
    monkeypatch.setattr(co, "PAIRS_PER_PART", 20)
    assert co._frequent(random_lines, "words")
    got = tuples(co.directional_counts(random_lines, sort=sort))
    assert (got if sort else sorted(got)) == directed([w for _, w in random_rows])


def test_directional_words_may_hold_anything(spark):
    rows = [(["a b", "a\nb", "", "a b", None],), ([],), (None,), ([f"w{i}" for i in range(200)],)]
    got = tuples(co.directional_counts(spark.createDataFrame(rows, "words array<string>")))
    assert sorted(got) == directed([["a b", "a\nb", "", "a b"], rows[3][0]])


def test_directional_pairs_are_not_shuffled(random_lines):
    plan = co.directional_counts(random_lines, sort=True)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "Sort [" in above and "Exchange" not in above


@pytest.mark.parametrize("max_entries", [10_000, 3])
def test_stripes_hold_the_rows(random_lines, max_entries):
    rows = co.directional_counts(random_lines)
    stripes = co.as_stripes(rows, max_entries=max_entries)
    assert sorted(tuples(co.stripes_to_rows(stripes))) == sorted(tuples(rows))
    parts = stripes.agg(F.max("part")).head()[0]
    assert parts == 0 if max_entries > 40 else parts > 0


def test_merge_stripes(spark):
    stripes = spark.createDataFrame(
        [("a", {"b": 1, "c": 2}), ("a", {"b": 4}), ("b", {"a": 1}), ("z", {})],
        "term string, stripe map<string, bigint>",
    )
    assert sorted(tuples(co.merge_stripes(stripes))) == [("a", "b", 5), ("a", "c", 2), ("b", "a", 1)]
