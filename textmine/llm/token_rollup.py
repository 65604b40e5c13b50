"""Token totals that are maintained by signed batches.

A batch holds signed counts: documents that came (+1), that went (-1), and counts
that were revised (the old one with -1, the new one with +1). It is summed up
per source, language and tokenizer version and written to a folder of its own;
it is committed when its folder is complete. Applying a committed batch again
does nothing, and a batch that broke off is written anew, so every batch counts
exactly once however often it is sent. Totals are the sum over the batches;
``compact`` replaces committed batches by one.

Defined cases: null sources, languages and versions are groups of their own; a
null or empty text has no tokens; texts are counted whole; repeated rows count
each; empty batches are committed and change nothing; groups whose counts are
all zero do not show in the totals; other columns of a batch are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "version"]
COUNTS = ["docs", "tokens", "chars"]
SCHEMA = "source string, lang string, version string, docs long, tokens long, chars long"


def signed(
    df: DataFrame, sign: int, version: str, *, docs: str | None = None, tokens: str = "tokens"
) -> DataFrame:
    """Rows of a batch from ``<source, lang, tokens, chars>``, one per document.

    With ``docs``, a row stands for as many equal documents as this column says.
    """
    n = F.lit(sign) if docs is None else F.col(docs) * sign
    return df.select(
        F.col("source"),
        F.col("lang"),
        F.lit(version).alias("version"),
        n.cast("long").alias("docs"),
        (F.col(tokens) * n).cast("long").alias("tokens"),
        (F.col("chars") * n).cast("long").alias("chars"),
    )


class TokenRollup:
    """Totals in a folder that all executors can reach; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(
            spark.sparkContext._jsc.hadoopConfiguration()
        )

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._path(f"{self._folder(batch)}/_SUCCESS"))

    def batches(self) -> list[str]:
        """Committed batches that count: those that a compacted one replaced do not."""
        root = self._path(self.folder)
        if not self._fs.exists(root):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(root)]
        names = sorted(f.removeprefix("batch-") for f in found if f.startswith("batch-"))
        names = [n for n in names if self.committed(n)]
        merged = [n for n in names if n.startswith("compacted.")]
        if not merged:
            return names
        last = max(merged, key=lambda n: int(n.split(".")[1]))
        done = self.spark.read.parquet(f"{self.folder}/done-{last}")
        gone = {r["batch"] for r in done.collect()}
        return [last, *(n for n in names if n not in gone and n not in merged)]

    def _folder(self, batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
            raise ValueError(f"not a name for a batch: {batch!r}")
        return f"{self.folder}/batch-{batch}"

    def apply(self, batch: str, deltas: DataFrame) -> bool:
        """Commit a batch of signed counts; False if it was committed before."""
        if self.committed(batch):
            return False
        self._sum(deltas).write.mode("overwrite").parquet(self._folder(batch))
        return True

    @staticmethod
    def _sum(deltas: DataFrame) -> DataFrame:
        sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS]
        return deltas.groupBy(*KEYS).agg(*sums)

    def totals(self) -> DataFrame:
        """``<source, lang, version, docs, tokens, chars>`` over all committed batches."""
        paths = [self._folder(b) for b in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*paths)
        return self._sum(rows).where("docs != 0 or tokens != 0 or chars != 0")

    def compact(self) -> str:
        """Write the totals as one batch that stands for all committed ones."""
        names = self.batches()
        number = 1 + max(
            [int(n.split(".")[1]) for n in names if n.startswith("compacted.")], default=0
        )
        name = f"compacted.{number}"
        before = [n for n in names if not n.startswith("compacted.")]
        old = [n for n in names if n.startswith("compacted.")]
        gone = [(n,) for n in before]
        for n in old:
            done = self.spark.read.parquet(f"{self.folder}/done-{n}")
            gone += [(r["batch"],) for r in done.collect()]
        # The list of what is replaced is there before the batch that replaces it.
        self.spark.createDataFrame(gone, "batch string").write.mode("overwrite").parquet(
            f"{self.folder}/done-{name}"
        )
        self.totals().write.mode("overwrite").parquet(self._folder(name))
        return name
