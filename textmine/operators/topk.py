"""The first k rows of every group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def top_k_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    k: int,
    *,
    salts: int = 64,
) -> DataFrame:
    """Rows ranked 1 to ``k`` in their group by ``order``, which must be total.

    Up to the session's group-limit threshold Spark ranks within each input
    partition first, so no group travels whole. Above it the same is done with
    ``salts`` parts per group: a row among the first k of its group is among the
    first k of its part.
    """
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    columns = df.columns
    limit = int(df.sparkSession.conf.get(GROUP_LIMIT, "1000"))
    if k > limit:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*columns), F.lit(salts)))
        part = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = salted.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= k)
    whole = Window.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(whole)).where(F.col("_rank") <= k)
    return ranked.select(*columns)
