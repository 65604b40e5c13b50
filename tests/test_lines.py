from __future__ import annotations

import pytest

from tests.conftest import HEADLINES, tuples
from textmine.sources.lines import (
    parse_dated_lines,
    read_lines,
    read_stopwords,
    unparsed_lines,
    write_lines,
)
from textmine.sources.scratch import materialize, scratch_folder
from textmine.sources.tables import deal_out


def test_parse(parsed):
    rows = {r.id: (r.period, sorted(r.words)) for r in parsed.collect()}
    assert rows[0] == ("2019", ["adelaide", "centre", "shopping", "stabbed", "woman"])
    assert rows[5][1] == ["apartment", "blocks", "builds", "china", "flu", "guard", "pig", "swine"]
    assert len(rows) == 9


def test_text_between_first_and_second_comma(spark):
    lines = spark.createDataFrame(
        [("20200101,a  b ",), ("20200101",), ("20200102,x y,z",), (None,)], "value string"
    )
    assert tuples(parse_dated_lines(lines).select("period", "words")) == [
        ("2020", ["a", "b"]),
        ("2020", ["x", "y"]),
    ]
    assert tuples(unparsed_lines(lines)) == [("20200101",), (None,)]


def test_made_up_ids_are_unique_and_increasing(spark):
    lines = spark.createDataFrame([(h,) for h in HEADLINES], "value string").repartition(3)
    ids = [r.id for r in parse_dated_lines(lines).collect()]
    assert len(set(ids)) == 9 and ids == sorted(ids)


def test_crlf_file(spark, tmp_path):
    (tmp_path / "in.txt").write_bytes("\r\n".join(HEADLINES).encode() + b"\r\n")
    lines = read_lines(spark, str(tmp_path / "in.txt"))
    assert [r.value for r in lines.collect()] == HEADLINES


def test_write_lines(spark, tmp_path):
    df = spark.createDataFrame([(h,) for h in HEADLINES], "value string").repartition(3)
    out = str(tmp_path / "out")
    write_lines(df, out)
    assert sorted(r.value for r in read_lines(spark, out).collect()) == sorted(HEADLINES)
    with pytest.raises(Exception, match="(?i)already exists"):
        write_lines(df, out)
    write_lines(df, str(tmp_path / "one"), single_file=True)
    assert len(list((tmp_path / "one").glob("part-*"))) == 1


def test_stopwords_are_distinct(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("the\nof\nthe\n")
    stop = read_stopwords(spark, str(tmp_path / "stop.txt"))
    assert stop.columns == ["term"]
    assert sorted(r.term for r in stop.collect()) == ["of", "the"]


def test_materialize_keeps_rows_and_schema(spark, parsed):
    table = materialize(parsed, "test")
    assert table.schema.simpleString() == parsed.schema.simpleString()
    assert sorted(tuples(table)) == sorted(tuples(parsed))
    assert scratch_folder(spark)


def test_deal_out_leaves_wide_scans_alone(spark):
    wide = spark.range(0, 100, 1, 16)
    assert deal_out(wide, "id") is wide
    assert deal_out(spark.range(0, 100, 1, 1), "id").rdd.getNumPartitions() == 4
