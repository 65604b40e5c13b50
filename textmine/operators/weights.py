"""Term weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tfidf(counts: DataFrame, n_periods: int | DataFrame) -> DataFrame:
    """Add ``df`` and ``weight = tf * log10(N / df)`` to ``<term, period, tf>`` rows.

    The rows are unique per (term, period), so df is their number per term. It is
    counted with partial sums and joined back: a term of very many periods is one
    large join partition, which the adaptive skew join can split, where a window
    would keep it in one task. ``n_periods`` is a number or a one-row, one-column
    frame.
    """
    total = n_periods.scalar() if isinstance(n_periods, DataFrame) else F.lit(n_periods)
    # Using tf keeps it in this branch, so both branches are the same up to their
    # shuffle and Spark computes it once.
    frequency = counts.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    return counts.join(frequency, "term").withColumn(
        "weight", F.col("tf") * F.log10(total / F.col("df"))
    )
