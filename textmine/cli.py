"""``spark-submit`` entry: one sub-command per job, text lines in and out.

``spark-submit --py-files textmine.zip textmine/cli.py top-pairs INPUT OUTPUT STOPWORDS K``
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmine.functions.text import id_pair_line, json_kv_line, kv_line, period_pair_line
from textmine.operators.cooccurrence import as_stripes
from textmine.plans import jobs
from textmine.sources.lines import (
    parse_dated_lines,
    read_lines,
    read_stopwords,
    write_lines,
)


def _tfidf(lines: DataFrame, args: argparse.Namespace) -> DataFrame:
    words = parse_dated_lines(lines, tokenizer="tfidf")
    return jobs.tfidf_lines(
        jobs.tfidf_by_period(words, n_periods=args.periods, beta=args.beta)
    )


def _top_pairs(lines: DataFrame, args: argparse.Namespace) -> DataFrame:
    stopwords = read_stopwords(lines.sparkSession, args.stopwords)
    top = jobs.top_pairs_by_period(
        parse_dated_lines(lines, period_from="field"), args.k, stopwords=stopwords, prune=args.prune
    )
    return top.select(period_pair_line(*(F.col(c) for c in top.columns)).alias("output"))


def _similar(lines: DataFrame, args: argparse.Namespace) -> DataFrame:
    pairs = jobs.jaccard_self_join(
        parse_dated_lines(lines), args.tau, cross_period=not args.any_period
    )
    return pairs.select(id_pair_line(*(F.col(c) for c in pairs.columns)).alias("output"))


def _totals(lines: DataFrame, args: argparse.Namespace) -> DataFrame:
    return jobs.corpus_totals(lines).select(
        json_kv_line(F.col("metric"), F.col("total")).alias("output")
    )


def _initials(lines: DataFrame, args: argparse.Namespace) -> DataFrame:
    letters = jobs.initial_letter_counts(lines)
    return letters.select(kv_line(F.col("letter"), F.col("n")).alias("output"))


def _cooccurrence(lines: DataFrame, args: argparse.Namespace) -> DataFrame:
    if args.stripes:
        stripes = as_stripes(jobs.directional_cooccurrence(lines, sort=False))
        return stripes.orderBy("term", "part").select(
            F.concat_ws("\t", "term", F.to_json("stripe")).alias("output")
        )
    counted = jobs.directional_cooccurrence(lines)
    key = F.concat_ws(" ", "term", "other")
    return counted.select(kv_line(key, F.col("n")).alias("output"))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textmine", description="Text mining on Spark.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, text: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=text)
        sub.add_argument("input", help="text file or folder")
        sub.add_argument("output", help="folder to write")
        sub.add_argument("--single-file", action="store_true", help="one output file, one task")
        sub.set_defaults(run=run)
        return sub

    sub = command("tfidf", _tfidf, "term weights per period")
    sub.add_argument("--periods", type=int, help="number of periods, default: counted")
    sub.add_argument("--beta", type=float, help="least weight")
    sub = command("top-pairs", _top_pairs, "most frequent term pairs per period")
    sub.add_argument("stopwords", help="file with one word per line")
    sub.add_argument("k", type=int, help="pairs per period")
    sub.add_argument("--prune", action="store_true", help="for large vocabularies")
    sub = command("similar", _similar, "similar pairs of lines")
    sub.add_argument("tau", type=float, help="least Jaccard similarity")
    sub.add_argument("--any-period", action="store_true", help="also within a period")
    command("totals", _totals, "characters, words and lines")
    command("initials", _initials, "words per initial letter")
    sub = command("cooccurrence", _cooccurrence, "directional term co-occurrence")
    sub.add_argument("--stripes", action="store_true", help="one map per term")
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("textmine").getOrCreate()
    result = args.run(read_lines(spark, args.input), args)
    write_lines(result, args.output, single_file=args.single_file)


if __name__ == "__main__":
    main()
