"""Text lines in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmine.functions.text import FIELD_SEPARATOR, tokenize
from textmine.operators.numbering import number_by_part


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row ``<value: string>`` per line, line ends removed."""
    return spark.read.text(path)


def read_stopwords(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One-column frame ``<term: string>`` from a file with one word per line."""
    return read_lines(spark, path).select(F.col("value").alias("term")).distinct()


def dated_text(line: Column) -> Column:
    """The text of ``YYYYMMDD,text``: the field between first and second comma."""
    return F.get(F.split(line, FIELD_SEPARATOR), F.lit(1))


def parse_dated_lines(
    lines: DataFrame,
    *,
    value: str = "value",
    id_col: str | None = None,
    tokenizer: str = "space",
    period_from: str = "line",
) -> DataFrame:
    """``<id: bigint, period: string, words: array<string>>`` from dated lines.

    The period is the first four characters of the line, or of what stands before
    the first comma with ``period_from="field"`` (they differ if that is shorter).
    Lines without a comma carry no
    text and are left out; :func:`unparsed_lines` returns them. Without
    ``id_col`` a row number that is unique and increasing, but not consecutive,
    is made up.
    """
    if period_from not in ("line", "field"):
        raise ValueError(f"period_from must be 'line' or 'field', not {period_from!r}")
    row_id = F.monotonically_increasing_id() if id_col is None else F.col(id_col)
    numbered = lines.select(row_id.cast("bigint").alias("id"), F.col(value).alias("line"))
    return numbered.where(F.contains(F.col("line"), F.lit(FIELD_SEPARATOR))).select(
        "id",
        F.substring(
            F.col("line")
            if period_from == "line"
            else F.get(F.split("line", FIELD_SEPARATOR), F.lit(0)),
            1,
            4,
        ).alias("period"),
        tokenize(dated_text(F.col("line")), tokenizer).alias("words"),
    )


def unparsed_lines(lines: DataFrame, *, value: str = "value") -> DataFrame:
    """The lines :func:`parse_dated_lines` leaves out."""
    return lines.where(F.col(value).isNull() | ~F.contains(F.col(value), F.lit(FIELD_SEPARATOR)))


def write_lines(
    df: DataFrame, path: str, *, single_file: bool = False, mode: str = "errorifexists"
) -> None:
    """Write a frame with one string column as text.

    One file per partition. ``single_file`` sends the whole result through one
    task, so it is off unless asked for; use it for results known to be small.
    """
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).text(path)


def write_ordered_lines(
    df: DataFrame,
    path: str,
    order: Sequence[str | Column],
    *,
    value: str = "output",
    files: int | None = None,
    mode: str = "errorifexists",
) -> None:
    """Write column ``value`` as text files whose names sort as the rows do.

    The rows are dealt by ranges of ``order`` and sorted inside them, so the files in
    name order, one after the other, are the sorted result, and no task holds more than
    its range. ``files`` is the number of ranges, by default that of the session.
    """
    ranges = df.repartitionByRange(*([files] if files else []), *order)
    ranges.sortWithinPartitions(*order).select(F.col(value)).write.mode(mode).text(path)


def read_ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``<place: bigint, value>``: lines with their place in all files in name order."""
    lines = read_lines(spark, path).select(
        "value",
        F.concat_ws(
            ":",
            "_metadata.file_name",
            F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"),
        ).alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
    )
    return number_by_part(lines, "place")


