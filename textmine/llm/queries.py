"""The registered queries: each applies an operator to its whole table.

The digests that the queries return are derived here; the operators return
texts, spans and ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmine.llm import (
    bpe,
    decontaminate,
    hard_negatives,
    html_text,
    jaccard_join,
    licenses,
    pii,
    quality,
    suffix_dedup,
    token_files,
    token_links,
    token_rollup,
    vector_dedup,
)
from textmine.llm.common import ship_package
from textmine.llm.oracles import ORACLES
from textmine.sources.scratch import materialize, scratch_folder
from textmine.sources.tables import table


def vocabulary_file(name: str) -> str:
    """Where a public tokenizer's file lies on the driver; executors get its content."""
    import public_tokenizers

    return public_tokenizers.path(name)


BYTE_BPE = vocabulary_file("byte_bpe_50k.json")
MULTI_BPE = vocabulary_file("byte_bpe_multi_50k.tiktoken")
WORD_BPE = vocabulary_file("word_bpe_49k.json")
PIECE_BPE = vocabulary_file("piece_bpe_32k.model")


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated strings of 200 bytes removed from every document."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return suffix_dedup.remove_repeats(documents).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("runs").cast("long").alias("n_spans"),
        "kept_sha256",
    )


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    found = licenses.scan(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.pos").alias("first_word"),
        F.array_max("phrases.pos").alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct("phrases.label")), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Documents linked at a Jaccard similarity of 0.85 over four-word shingles."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return jaccard_join.similarity_classes(documents, k=4, share=(85, 100))


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """``<doc_id, item_id, score, question, answer, first_word>``: items found in documents."""
    found = decontaminate.find_items(
        table(spark, folder, "documents").select("doc_id", "text"),
        table(spark, folder, "benchmark"),
    )
    return found.select("doc_id", F.explode("benchmark_items").alias("found")).select(
        "doc_id",
        "found.item_id",
        "found.score",
        "found.question",
        "found.answer",
        F.col("found.at").alias("first_word"),
    )


def op6_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors linked at a cosine of 0.95."""
    return vector_dedup.near_vectors(
        table(spark, folder, "embeddings").select("vec_id", "embedding")
    )


def op7_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """``<doc_id, n_tokens, ids_sha256, decoded_sha256>`` of every document."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    encoded = bpe.encode(documents, BYTE_BPE).drop("text")
    return bpe.decode(encoded, BYTE_BPE).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token totals after three batches, one of which is sent twice.

    All documents are counted with one vocabulary; then exact copies go (of each text one
    row stays, that with the smallest id, language and source); then what is not English is
    counted anew with a vocabulary for many languages. Copies are summed up per text, source
    and language, so each distinct text is read and encoded once.
    """
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")
    documents = table(spark, folder, "documents").select(
        "doc_id", "source", "lang", "text", digest
    )
    groups = materialize(
        documents.groupBy("digest", "source", "lang").agg(
            F.count(F.lit(1)).alias("docs"),
            F.min("doc_id").alias("doc_id"),
            F.max(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("chars"),
        ),
        "text-groups",
    )
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "lang", "source")
    kept = groups.groupBy("digest").agg(F.min(order).alias("kept"))
    # A null language is not English either.
    foreign = ~F.col("kept.lang").eqNullSafe("en")
    texts = documents.alias("d").join(
        kept.select("digest", "kept", foreign.alias("foreign")).alias("k"),
        (F.col("d.digest") == F.col("k.digest"))
        & F.col("d.doc_id").eqNullSafe(F.col("k.kept.doc_id")),
    )
    old, new = "byte_bpe_50k", "byte_bpe_multi_50k"
    counted = (
        bpe.count_tokens(
            texts.select("d.digest", "text", "kept", "foreign"),
            {old: BYTE_BPE, new: MULTI_BPE},
            asked="foreign",
        )
        .groupBy("digest")
        .agg(*[F.max(c).alias(c) for c in ("kept", "foreign", old, new)])
    )
    stays = [F.col(c).eqNullSafe(F.col("kept")[c]) for c in ("doc_id", "lang", "source")]
    rows = materialize(
        groups.join(counted, "digest").select(
            "source", "lang", "docs", "chars", "foreign", old, new,
            (stays[0] & stays[1] & stays[2]).cast("long").alias("stays"),
        ),
        "token-counts",
    ).withColumn("gone", F.col("docs") - F.col("stays"))
    rollup = token_rollup.TokenRollup(
        spark, f"{scratch_folder(spark)}/token-rollup-{uuid.uuid4().hex}"
    )
    signed = token_rollup.signed
    rollup.apply("load", signed(rows, 1, old, docs="docs", tokens=old))
    copies = signed(rows, -1, old, docs="gone", tokens=old)
    rollup.apply("copies", copies)
    rollup.apply("copies", copies)
    revised = rows.where((F.col("stays") == 1) & F.col("foreign"))
    rollup.apply(
        "revised",
        signed(revised, -1, old, tokens=old).union(signed(revised, 1, new, tokens=new)),
    )
    return rollup.totals()


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """``<doc_id, junk, toxicity, kept>`` of every document."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    return quality.classify(documents, labels=labels).select("doc_id", "junk", "toxicity", "kept")


def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document: counts and spans."""
    found = pii.find_personal_data(table(spark, folder, "documents").select("doc_id", "text"))

    def joined(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    def count(kind: str) -> Column:
        return (
            F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
        )

    return found.select(
        "doc_id",
        *[count(kind) for kind in pii.PATTERNS],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "term")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh label is moved by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").select(
        "vec_id", "embedding", moved.alias("label")
    )
    return hard_negatives.mine(vectors)


def op12_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents read back from the files that their token ids were written to."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    files = materialize(token_files.pack(documents, WORD_BPE), "token-files")
    return token_files.unpack(files, with_ids=False)


def op13_token_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links between the tokens of two tokenizers in every document."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return token_links.align(documents, BYTE_BPE, PIECE_BPE).documents


__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def _shipped(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return query(spark, folder)

    return run


_ALL: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_html_text": op3_html_text,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_decontaminate": op5_decontaminate,
    "op6_vector_dedup": op6_vector_dedup,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_token_counts": op8_token_counts,
    "op9_quality": op9_quality,
    "op10_personal_data": op10_personal_data,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_files": op12_token_files,
    "op13_token_links": op13_token_links,
}

QUERIES: dict[str, Query] = {name: _shipped(query) for name, query in _ALL.items()}
