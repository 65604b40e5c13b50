"""Personal data: patterns, and terms that give a protected entity away.

DataFrame functions only. E-mail addresses, IP addresses, card and phone
numbers are the protected entities. A term (a word of a document with an entity,
wherever it stands outside entities) reveals it when knowing the term makes the
entity far likelier. With counts over all different documents of the corpus,
p(e) = df(e) / N and p(e|t) = df(t, e) / df(t), the disclosure of e by t is

    log(p(e|t) / p(e)) / log(1 / p(e)),

the pointwise mutual information as a share of the entity's information: 1 if
the term occurs with the entity only, 0 if it is independent of it. Terms at or
above a threshold that share documents with the entity in several different
contexts of it are spans of kind ``term``, at all their places in all documents
with the entity. Sanitising replaces entities by their kind and generalises or
removes the terms.

Defined cases: a null or empty text has no spans and stays as it is; texts are
read whole; equal texts count once and have the same spans, whatever their ids,
so copies of a document are no evidence; nor are documents that show an entity in
the same contexts; an empty table gives an empty result. Positions are code
points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmine.sources.scratch import materialize

# Kinds in their order, with patterns that match what the plain ones
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)        parts at most 255
#   card  [0-9]([\x20-]?[0-9])+                       16 to 19 digits
#   phone \+[0-9][\x20().0-9-]+[0-9]                  8 to 15 digits
# match, leftmost and without overlap. They are possessive and start at the edge of
# a run, so that long runs take linear time and no deep recursion; \G lets a match
# start where the one before it ended.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"

#: Code points on either side of an entity that tell its contexts apart.
CONTEXT = 48
#: Least share of an entity's information that a revealing term gives.
DISCLOSURE = 0.9
#: Different contexts of the entity in the documents that have the term.
SUPPORT = 2
#: Letters, marks and digits make up a term; no shortest length.
LETTER = r"\p{L}\p{M}\p{N}"
TERM = rf"[{LETTER}]++"
_CHUNK = 128
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(values: Column) -> Column:
    """Sums of the values before each one: chunk totals first, then inside the chunks."""

    def scan(part: Column) -> Column:
        return F.aggregate(
            part,
            F.array(F.lit(0)),
            lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)),
        )

    def sums(own: Column) -> Column:
        chunks = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(own) - 1, F.lit(0)), F.lit(_CHUNK)),
            lambda at: F.slice(own, at + 1, _CHUNK),
        )
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x))
        return F.flatten(
            F.zip_with(
                chunks,
                scan(totals),
                lambda c, base: F.transform(
                    scan(F.slice(F.coalesce(c, F.array().cast("array<int>")), 1, _CHUNK - 1)),
                    lambda x: x + base,
                ),
            )
        )

    return let(values, sums)


def matches(text: Column, pattern: str, kind: str) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` as an array of spans."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(
        F.split(text, pattern, -1),
        found,
        lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("value")),
    )

    def spans(own: Column) -> Column:
        before = running_sums(
            F.transform(own, lambda p: p["gap"] + F.coalesce(F.length(p["value"]), F.lit(0)))
        )
        placed = F.zip_with(
            own,
            before,
            lambda p, at: F.struct(
                F.lit(kind).alias("kind"),
                (at + p["gap"]).alias("start"),
                (at + p["gap"] + F.length(p["value"])).alias("end"),
                p["value"].alias("value"),
            ),
        )
        return F.filter(placed, lambda s: s["value"].isNotNull())

    return let(pairs, spans)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(value: Column) -> Column:
    """Whether the digits' checksum, every second from the right doubled, is a multiple of 10."""
    digits = F.split(F.reverse(_digits(value)), "")
    total = F.aggregate(
        F.transform(
            F.filter(digits, lambda d: d != ""),
            lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
                F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)
            ),
        ),
        F.lit(0),
        lambda s, x: s + x,
    )
    return total % 10 == 0


def entities(text: Column) -> Column:
    """The valid spans of every kind of pattern, by kind, then start."""
    empty = F.array().cast(SPAN)
    digits = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: F.rlike(s["value"], F.lit(OCTETS)),
        "card": lambda s: passes_luhn(s["value"]),
        "phone": lambda s: F.length(_digits(s["value"])).between(8, 15),
    }
    needs = {"email": "@", "ip": ".", "card": "", "phone": "+"}
    kinds = []
    for kind, pattern in PATTERNS.items():
        there = F.contains(text, F.lit(needs[kind])) & F.rlike(text, F.lit(pattern))
        kinds.append(
            F.when(
                F.coalesce(there, F.lit(False)),
                F.filter(matches(text, pattern, kind), digits[kind]),
            ).otherwise(empty)
        )
    return F.concat(*kinds)


def _mention(text: Column, span: Column) -> Column:
    """The entity of a span and a hash of the window around it."""
    first = F.greatest(span["start"] - CONTEXT, F.lit(0))
    left = F.substr(text, first + 1, span["start"] - first)
    right = F.substr(text, span["end"] + 1, F.lit(CONTEXT))
    return F.struct(
        F.concat_ws(":", span["kind"], F.lower(span["value"])).alias("entity"),
        F.xxhash64(left, right).alias("window"),
    )


def _digest(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def revealing_terms(
    found: DataFrame, *, disclosure: float = DISCLOSURE, support: int = SUPPORT
) -> DataFrame:
    """``<digest, terms>``: the terms of each document that give one of its entities away.

    ``found`` holds mentions and distinct words of every different document.
    """
    mentions = (
        found.select("digest", F.explode("mentions").alias("m"))
        .groupBy("digest", "m.entity")
        .agg(F.xxhash64(F.sort_array(F.collect_set("m.window"))).alias("evidence"))
    )
    total = found.count()
    log_n = F.log(F.lit(float(max(total, 2))))
    # An entity without enough contexts has no term with enough.
    entity_df = (
        mentions.groupBy("entity")
        .agg(F.count(F.lit(1)).alias("of_entity"), F.count_distinct("evidence").alias("contexts"))
        .where(F.col("contexts") >= support)
    )
    holders = materialize(
        mentions.join(entity_df.drop("contexts"), "entity"), "entity-documents"
    )
    term_df = (
        found.select(F.explode("words").alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("of_term"))
        .where(F.col("of_term") >= support)
    )
    words = found.join(holders.select("digest").distinct(), "digest", "left_semi").select(
        "digest", F.explode("words").alias("term")
    )
    # df(t, e) is at most df(e), so a term in more documents than this cannot reach the threshold.
    information = log_n - F.log("of_entity")
    most = F.log("of_entity") + (1 - disclosure) * information + 1e-6
    together = materialize(
        words.join(term_df, "term").join(holders, "digest").where(F.log("of_term") <= most),
        "term-pairs",
    )
    scored = (
        together.groupBy("entity", "term")
        .agg(
            F.count(F.lit(1)).alias("both"),
            F.count_distinct("evidence").alias("n"),
            F.max("of_term").alias("of_term"),
            F.max("of_entity").alias("of_entity"),
        )
        .where(F.col("n") >= support)
        .withColumn(
            "disclosure",
            (F.log("both") - F.log("of_term") + information)
            / F.greatest(information, F.lit(1e-9)),
        )
        .where(F.col("disclosure") >= disclosure)
        .select("entity", "term")
    )
    return (
        together.select("digest", "entity", "term")
        .join(scored, ["entity", "term"], "left_semi")
        .groupBy("digest")
        .agg(F.collect_set("term").alias("terms"))
    )


def _spans(df: DataFrame, *, text: str, disclosure: float, support: int) -> DataFrame:
    """``<__digest, spans>`` of every different text that has a span."""
    plain = "array<struct<kind:string,start:int,end:int>>"
    # What is no entity, with a blank in an entity's place.
    gaps = F.transform("base", lambda s: s.withField("kind", F.lit("gap")))
    words = F.split(redacted(F.col("content"), gaps), rf"[^{LETTER}]+")
    found = materialize(
        df.select(_digest(text).alias("digest"), F.coalesce(text, F.lit("")).alias("content"))
        .dropDuplicates(["digest"])
        .select("digest", "content", entities(F.col("content")).alias("base"))
        .select(
            "digest",
            F.transform("base", lambda s: s.dropFields("value")).alias("base"),
            F.transform("base", lambda s: _mention(F.col("content"), s)).alias("mentions"),
            F.filter(F.array_distinct(F.transform(words, F.lower)), lambda w: w != "").alias("words"),
            F.when(F.size("base") > 0, F.col("content")).alias("content"),
        ),
        "personal-data",
    )
    terms = revealing_terms(found, disclosure=disclosure, support=support).select(
        F.col("digest").alias("__digest"), "terms"
    )
    own = found.where(F.size("base") > 0).select("digest", "base", "content")

    def places(text: Column, terms: Column, base: Column) -> Column:
        kept = F.filter(
            matches(text, TERM, "term"),
            lambda t: F.array_contains(terms, F.lower(t["value"]))
            & ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])),
        )
        return F.transform(kept, lambda s: s.dropFields("value")).cast(plain)

    return own.join(terms, F.col("digest") == F.col("__digest"), "left").select(
        F.col("digest").alias("__digest"),
        F.concat(
            "base",
            F.when(
                F.col("terms").isNotNull(), places(F.col("content"), F.col("terms"), F.col("base"))
            ).otherwise(F.array().cast(plain)),
        ).alias("spans"),
    )


def find_personal_data(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    disclosure: float = DISCLOSURE,
    support: int = SUPPORT,
) -> DataFrame:
    """``<id, spans: array<struct<kind, start, end>>>`` of every row, by kind, then start."""
    spans = _spans(df, text=text, disclosure=disclosure, support=support)
    rows = df.select(F.col(id_col), _digest(text).alias("__of"))
    return rows.join(spans, F.col("__of") == F.col("__digest"), "left").select(
        id_col,
        F.coalesce("spans", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets, a term by nothing.

    Overlapping spans are replaced together, by the kind that begins first.
    """
    ordered = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), s["kind"].alias("k")),
        )
    )
    merged = F.aggregate(
        ordered,
        F.array().cast("array<struct<a:int,b:int,k:string>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (s["a"] < -F.coalesce(F.element_at(done, -1)["b"], F.lit(0))),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["a"].alias("a"),
                        F.least(F.element_at(done, -1)["b"], s["b"]).alias("b"),
                        F.element_at(done, -1)["k"].alias("k"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )

    def rebuilt(own: Column) -> Column:
        pieces = F.transform(
            own,
            lambda s, i: F.concat(
                F.substr(
                    text,
                    F.when(i == 0, 1).otherwise(1 - F.get(own, i - 1)["b"]),
                    s["a"] + F.when(i == 0, 0).otherwise(F.get(own, i - 1)["b"]),
                ),
                F.when(s["k"] == "term", "").when(s["k"] == "gap", " ").otherwise(
                    F.concat(F.lit("["), F.upper(s["k"]), F.lit("]"))
                ),
            ),
        )
        return F.concat(
            F.array_join(pieces, ""), F.substr(text, 1 - F.element_at(own, -1)["b"])
        )

    return F.when(F.size(spans) > 0, let(merged, rebuilt)).otherwise(text)


def sanitise(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    disclosure: float = DISCLOSURE,
    support: int = SUPPORT,
) -> DataFrame:
    """``df`` with its texts redacted; rows without a span keep theirs.

    Rows meet their spans by a digest of the text, so ids may be null or repeated.
    """
    spans = _spans(df, text=text, disclosure=disclosure, support=support)
    spans = spans.select("__digest", F.col("spans").alias("__spans"))
    return df.join(spans, _digest(text) == F.col("__digest"), "left").select(
        *[
            F.when(F.col("__spans").isNotNull(), redacted(F.col(text), F.col("__spans")))
            .otherwise(F.col(text))
            .alias(text)
            if c == text
            else F.col(f"`{c}`")
            for c in df.columns
        ]
    )
