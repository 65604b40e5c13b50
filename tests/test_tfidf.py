from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest

from tests.conftest import HEADLINES, tuples
from textmine.plans.jobs import tfidf_by_period, tfidf_lines
from textmine.sources.lines import parse_dated_lines


def test_fixture(headlines):
    words = parse_dated_lines(headlines, id_col="id", tokenizer="tfidf")
    rows = tuples(tfidf_by_period(words, n_periods=3, beta=0.4))
    assert len(rows) == 37
    weights = {(t, p): w for t, p, _, _, w in rows}
    assert weights.pop(("coronavirus", "2020")) == pytest.approx(0.528274, abs=1e-6)
    assert all(w == pytest.approx(math.log10(3)) for w in weights.values())


def test_every_weight_is_tf_log_n_over_df(parsed):
    tf, df = Counter(), defaultdict(set)
    for line in HEADLINES:
        for word in line.split(",")[1].split(" "):
            tf[word, line[:4]] += 1
            df[word].add(line[:4])
    rows = tuples(tfidf_by_period(parsed))
    assert len(rows) == len(tf)
    for term, period, n, d, weight in rows:
        assert (n, d) == (tf[term, period], len(df[term]))
        assert weight == pytest.approx(n * math.log10(3 / d))


def test_order_is_term_then_latest_period(parsed):
    rows = [(t, p) for t, p, *_ in tuples(tfidf_by_period(parsed))]
    assert rows == sorted(rows, key=lambda r: (r[0], -int(r[1])))


def test_given_number_of_periods(parsed):
    (row,) = tuples(tfidf_by_period(parsed, n_periods=19).where("term = 'woman'"))
    assert row[4] == pytest.approx(math.log10(19))


def test_lines(parsed):
    weighted = tfidf_by_period(parsed, n_periods=10).where("term = 'woman'")
    assert tuples(tfidf_lines(weighted)) == [('"woman"\t"2019,1.0"',)]


def test_occurrences_are_counted_once(parsed):
    """Both sides of the join with the period counts read the same shuffle."""
    weighted = tfidf_by_period(parsed, n_periods=3)
    weighted.collect()
    plan = weighted._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and "Window" not in final
