"""Licence scan by a positional index of rare licence words, in DataFrame functions only.

The words of a few licence notices form a small vocabulary. A document keeps
only the places of these words. For every notice whose mandatory key phrase has
all its words in the document, the notice's words with the highest inverse
document frequency (over all documents) are looked up; a document word at place
p that stands at place q of the notice proposes the alignment p - q. An
alignment is accepted if a rare word proposes it and every word of the key
phrase stands in its place. Plain phrases are found beside that, at any place.

Defined cases: a null or empty text has no words and no labels; texts are read
whole; repeated rows keep a row each; rows need not have distinct ids for the
phrases, but rows that share an id also share their notices; an empty table
gives an empty result; other columns are left out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmine.sources.scratch import materialize

# What separates words.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The one letter outside ASCII whose lower case is a single ASCII letter, and a stand-in.
KELVIN, NOT_KELVIN = "K", "ķ"

# Phrases and their labels.
PHRASES = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]

# Label, notice, key phrase that must stand in its place in the notice.
NOTICES = [
    (
        "apache-2.0",
        "licensed under the apache license version 2 0",
        "apache license",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification",
        "source and binary forms",
    ),
    (
        "cc-by",
        "this work is licensed under a creative commons attribution 4 0 international license",
        "creative commons attribution",
    ),
    (
        "gpl",
        "redistribute it and or modify it under the terms of the gnu general public license",
        "general public license",
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy",
        "hereby granted free of charge",
    ),
    ("mit", "released under the mit license", "the mit license"),
    (
        "mpl-2.0",
        "subject to the terms of the mozilla public license v 2 0",
        "mozilla public license",
    ),
    ("public-domain", "released into the public domain", "public domain"),
    ("spdx", "spdx license identifier", "spdx license identifier"),
]
#: How many of a notice's rarest words in a document may propose alignments.
RARE_WORDS = 3


def vocabulary(phrases=PHRASES, notices=NOTICES) -> list[str]:
    """All words of the phrases and notices."""
    texts = [p for p, _ in phrases] + [n for _, n, _ in notices]
    return sorted({w for t in texts for w in t.split()})


def licence_words(
    df: DataFrame, *, id_col: str, text: str, phrases=PHRASES, notices=NOTICES
) -> DataFrame:
    """``<id, n_words, hits: array<struct<pos, word>>>``: places of vocabulary words."""
    known = vocabulary(phrases, notices)
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(NOT_KELVIN)))
    words = df.select(
        F.col(id_col).alias("id"),
        F.filter(F.split(lowered, SEPARATOR), lambda w: w != "").alias("words"),
    )
    placed = F.transform(
        "words", lambda w, i: F.struct(i.cast("long").alias("pos"), w.alias("word"))
    )
    return words.select(
        "id",
        F.size("words").cast("long").alias("n_words"),
        F.when(
            F.arrays_overlap("words", F.array(*map(F.lit, known))),
            F.filter(placed, lambda h: h["word"].isin(known)),
        )
        .otherwise(F.filter(placed, lambda h: F.lit(False)))
        .alias("hits"),
    )


def document_frequency(hits: DataFrame) -> DataFrame:
    """``<word, df>``: at most one row per vocabulary word."""
    return (
        hits.select(F.explode(F.array_distinct("hits.word")).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def phrase_places(hits: Column, phrase: str) -> Column:
    """The starts of ``phrase``: its words are hits with consecutive places."""
    words = phrase.split()

    def here(h: Column, i: Column) -> Column:
        found = h["word"] == words[0]
        for j, word in enumerate(words[1:], start=1):
            other = F.get(hits, i + j)
            found = found & F.coalesce(
                (other["word"] == word) & (other["pos"] == h["pos"] + j), F.lit(False)
            )
        return F.when(found, h["pos"])

    return F.array_compact(F.transform(hits, here))


def _proposals(number: int, notice: str, key: str, rarity: dict[str, int]) -> Column:
    """Array of ``<notice, at, is_key, is_rare>`` for one notice, empty if the key is absent."""
    words, key_words = notice.split(), key.split()
    key_at = next(
        i for i in range(len(words)) if words[i : i + len(key_words)] == key_words
    )
    ranked = sorted(set(words), key=lambda w: (rarity.get(w, 0), w))
    present = F.array_distinct(F.col("hits.word"))
    rare = F.slice(
        F.filter(F.array(*map(F.lit, ranked)), lambda w: F.array_contains(present, w)),
        1,
        RARE_WORDS,
    )
    def votes(i: int, word: str) -> Column:
        in_key = int(key_at <= i < key_at + len(key_words))
        is_rare = F.array_contains(rare, word).cast("int")
        return F.transform(
            F.filter("hits", lambda h: h["word"] == word),
            lambda h: F.struct(
                F.lit(number).alias("notice"),
                (h["pos"] - i).alias("at"),
                F.lit(in_key).alias("is_key"),
                is_rare.alias("is_rare"),
            ),
        )

    absent = F.array_except(F.array(*map(F.lit, key_words)), present)
    return F.when(F.size(absent) == 0, F.concat(*map(votes, range(len(words)), words)))


def notice_alignments(hits: DataFrame, notices=NOTICES) -> DataFrame:
    """``<id, label, at, coverage>`` of the accepted alignments, ``at`` in words."""
    # One row per vocabulary word at most, so the bound of this collect is the vocabulary.
    rarity = {r["word"]: r["df"] for r in document_frequency(hits).collect()}
    known = hits.where(F.size("hits") > 0)
    keys = [
        F.size(F.array_except(F.array(*map(F.lit, key.split())), F.col("hits.word"))) == 0
        for _, _, key in notices
    ]
    some_key = keys[0]
    for k in keys[1:]:
        some_key = some_key | k
    proposals = F.flatten(
        F.array_compact(
            F.array(*[_proposals(i, n, k, rarity) for i, (_, n, k) in enumerate(notices)])
        )
    )
    table = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                F.lit(len(notice.split())).alias("size"),
                F.lit(len(key.split())).alias("key_size"),
            )
            for label, notice, key in notices
        ]
    )
    return (
        known.where(some_key)
        .select("id", F.explode(proposals).alias("p"))
        .groupBy("id", F.col("p.notice").alias("notice"), F.col("p.at").alias("at"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("p.is_key").alias("n_key"),
            F.sum("p.is_rare").alias("n_rare"),
        )
        .withColumn("t", F.get(table, "notice"))
        .where((F.col("n_rare") > 0) & (F.col("n_key") == F.col("t.key_size")))
        .select(
            "id",
            F.col("t.label").alias("label"),
            "at",
            (F.col("n") / F.col("t.size")).alias("coverage"),
        )
    )


def scan(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    phrases=PHRASES,
    notices=NOTICES,
) -> DataFrame:
    """``<id, n_words, phrases: array<struct<pos, label>>, labels, score>`` of every row.

    ``labels`` are those of phrases and notices together. ``score`` is 1 with a
    phrase, else the largest share of a notice's words that stand in place.
    The places of licence words are written once and read three times.
    """
    hits = materialize(
        licence_words(df, id_col=id_col, text=text, phrases=phrases, notices=notices),
        "licence-words",
    )

    def labelled(phrase: str, label: str) -> Column:
        return F.transform(
            phrase_places(F.col("hits"), phrase),
            lambda p: F.struct(p.alias("pos"), F.lit(label).alias("label")),
        )

    places = F.concat(*[labelled(phrase, label) for phrase, label in phrases])
    based = hits.select(F.col("id").alias(id_col), "n_words", places.alias("phrases"))
    noticed = (
        notice_alignments(hits, notices)
        .groupBy(F.col("id").alias("of"))
        .agg(F.collect_set("label").alias("notice_labels"), F.max("coverage").alias("coverage"))
    )
    labels = F.sort_array(
        F.array_union(
            F.array_distinct("phrases.label"),
            F.coalesce("notice_labels", F.array().cast("array<string>")),
        )
    )
    return based.join(noticed, F.col(id_col).eqNullSafe(F.col("of")), "left").select(
        id_col,
        "n_words",
        "phrases",
        labels.alias("labels"),
        F.when(F.size("phrases") > 0, 1.0)
        .otherwise(F.coalesce("coverage", F.lit(0.0)))
        .alias("score"),
    )
