from __future__ import annotations

import pytest

from tests.conftest import HEADLINES
from textmine.cli import main


@pytest.fixture()
def run(spark, tmp_path):
    (tmp_path / "in.txt").write_text("\n".join(HEADLINES) + "\n")
    (tmp_path / "stop.txt").write_text("economy\n")

    def call(command, *args):
        out = tmp_path / f"out-{command}-{len(args)}"
        main([command, str(tmp_path / "in.txt"), str(out), *args], spark)
        parts = sorted(out.glob("part-*"))
        return [line for p in parts for line in p.read_text().splitlines()]

    call.stopwords = str(tmp_path / "stop.txt")
    return call


def test_tfidf(run):
    lines = run("tfidf", "--periods", "3", "--beta", "0.4")
    assert len(lines) == 37 and lines == sorted(lines)
    assert lines[0].startswith('"adelaide"\t"2019,0.477121')


def test_top_pairs(run):
    lines = run("top-pairs", run.stopwords, "1")
    assert lines == [
        "2019    adelaide,centre:1",
        "2020    aid,china:1",
        "2021    bounce,starts:1",
    ]
    assert run("top-pairs", run.stopwords, "1", "--prune") == lines


def test_similar(run):
    lines = run("similar", "0.125", "--single-file")
    assert lines == [
        "(1,2)    0.125",
        "(1,6)    0.125",
        "(2,6)    0.14285714285714285",
        "(2,7)    0.125",
    ]


def test_totals(run):
    assert sorted(run("totals")) == ['"chars"\t448', '"lines"\t9', '"words"\t49']


def test_initials(run):
    lines = run("initials")
    assert "c 8" in lines and len(lines) == 16


def test_cooccurrence(run):
    lines = run("cooccurrence")
    assert "economy coronavirus 2" in lines
    stripes = run("cooccurrence", "--stripes")
    assert any(line.startswith('woman\t{"20191124":1,"adelaide":1') for line in stripes)
