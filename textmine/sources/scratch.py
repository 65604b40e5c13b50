"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Whether the shuffle files of an execution are deleted when it has ended.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: dict[str, list[str]] = {}


def scratch_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else the context's own.

    Only a local session may fall back to a folder of this machine: on a
    cluster the executors would not share it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="textmine-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table of its own and return the table.

    This cuts the lineage in a way that outlives executors. Readers prune
    columns, and the optimizer sees the true size, so a later join broadcasts
    the table only if it really is below the session's threshold. What was shuffled
    for it is deleted with the end of the writing, as the table holds its result.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/textmine-{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def discard(table: DataFrame) -> None:
    """Delete one table that :func:`materialize` returned, as nothing reads it any more."""
    path = getattr(table, "_written_at", None)
    if path:
        _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession, keep: int = 0) -> int:
    """Delete the intermediate tables of this application; how many that were.

    Frames that were built on them can no longer be computed, so call it when
    their results are written. ``keep`` spares the first ones made.
    """
    made = _made.get(spark.sparkContext.applicationId, [])
    gone, made[keep:] = made[keep:], []
    for path in gone:
        _delete(spark, path)
    return len(gone)


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, the intermediate tables made inside it."""
    before = len(_made.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, keep=before)
