"""Adapters from Parquet tables to the frames the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmine.functions.text import tokenize


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def deal_out(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan that has fewer splits than the session has cores.

    A table of a few megabytes is one split, and the tokenizing that follows
    would be one task. A table worth a cluster has more splits than cores and
    is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def document_terms(spark: SparkSession, folder: str) -> DataFrame:
    """``<id, period, words>``: a document, its source, its lower-cased letter runs."""
    documents = table(spark, folder, "documents").select("doc_id", "source", "text")
    return deal_out(documents, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("period"),
        tokenize(F.lower("text"), "letters").alias("words"),
    )


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``<id, period, value>``: one row per line of every document."""
    documents = table(spark, folder, "documents").select("doc_id", "source", "text")
    return deal_out(documents, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("period"),
        F.explode_outer(F.split("text", "\n")).alias("value"),
    )


def conversation_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``<id, period, value>``: one row per line of every turn; the period is the role."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return deal_out(turns, "conv_id", "turn").select(
        F.col("conv_id").alias("id"),
        F.col("role").alias("period"),
        F.explode_outer(F.split("text", "\n")).alias("value"),
    )


def dated_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``<id, value>``: ``YYYYMMDD,part names`` of every order, in line-item order."""
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    # Dealt by order before they are grouped: lists of the few items of an order that a task
    # meets by chance would be larger than the items, and sorted once more.
    named = (
        deal_out(items, "l_orderkey")
        .join(parts, items.l_partkey == parts.p_partkey)
        .repartition("l_orderkey")
        .groupBy("l_orderkey")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name"))
            ).alias("items")
        )
    )
    return orders.join(named, orders.o_orderkey == named.l_orderkey).select(
        F.col("o_orderkey").alias("id"),
        F.concat(
            F.date_format("o_orderdate", "yyyyMMdd"),
            F.lit(","),
            F.array_join(F.col("items.p_name"), " "),
        ).alias("value"),
    )
