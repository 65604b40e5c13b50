"""The corpus pipeline: five stages over the documents, each on what the one before kept.

Every stage but the last returns the columns of ``documents``. ``ORACLE_SQL`` is
None, as SQL cannot express a trained classifier or byte-pair encoding; the tests
hold the stages against brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmine.llm import bpe, decontaminate, jaccard_join, pii, quality
from textmine.llm.common import bound_batches, ship_package
from textmine.llm.queries import BYTE_BPE
from textmine.sources.scratch import materialize
from textmine.sources.tables import table

ORACLE_SQL = None

#: The key by which near-duplicate rows are told apart.
ROW_KEY = "_row_key"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are neither junk nor toxic."""
    ship_package(spark)
    bound_batches(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return quality.classify(docs, labels=labels).where("kept").select(docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates.

    Five-word shingles, similarity 0.8. Groups are formed over rows, not ids: every row
    gets a key of its own, which is written, so rows that share an id or have none are
    compared like any others, and each different text stays. Rows with an id stay before
    rows without.
    """
    ship_package(spark)
    bound_batches(spark)
    keyed = materialize(docs.withColumn(ROW_KEY, F.monotonically_increasing_id()), "keyed-rows")
    classes = jaccard_join.similarity_classes(keyed, id_col=ROW_KEY, k=5, share=(80, 100))
    placed = keyed.select(ROW_KEY, "doc_id").join(classes.select(ROW_KEY, "component_id"), ROW_KEY)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW_KEY)).alias("first")
    kept = placed.groupBy("component_id").agg(first).select(F.col("first")[ROW_KEY].alias(ROW_KEY))
    return keyed.join(kept, ROW_KEY, "left_semi").select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship_package(spark)
    bound_batches(spark)
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("benchmark_items") == 0).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced and their lengths brought up to date."""
    bound_batches(spark)
    clean = pii.sanitise(docs)
    return clean.withColumn(
        "n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    )


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids, and whether these decode to the text again."""
    ship_package(spark)
    bound_batches(spark)
    both = bpe.decode(bpe.encode(docs, BYTE_BPE), BYTE_BPE)
    return both.select(
        *docs.columns,
        F.size("token_ids").cast("long").alias("n_tokens"),
        "token_ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("decodes"),
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", personal_data),
    ("BPE encoding and decoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
