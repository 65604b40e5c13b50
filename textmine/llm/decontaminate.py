"""Benchmark items inside training documents: BM25 retrieval and overlap checks.

The test items are the indexed side; every passage of every document is a query.
A passage is a window of words twice as long as the longest item, one item
length after the other, so an item that stands in a document stands whole in a
passage. Scores are BM25 with the item as the document, as a share of what the
item would score against itself; all items at or above ``SCORE`` are retrieved.
Items lie in blocks with the highest share that each term can add in the block
(block-max WAND): the sum over a passage's terms bounds the block's items, and
only blocks whose bound reaches the threshold are scored. A retrieved item
counts if the word n-grams of its question (all sentences but the last) and of
its answer (the last one) are both found in the passage to a given share.

The index is handed to all executors in parts of about ``PART_ITEMS`` items, so
its size does not grow with the benchmark; more parts mean more passes. Number of
items, document frequencies, mean and greatest length are counted once over the
whole benchmark, so results do not depend on the parts.

Defined cases: a null or empty text has no passage; a null or wordless item is
skipped; texts are read whole; repeated rows and items are found each; empty
tables give an empty result; other columns are kept, one with the result's name
is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmine.llm.common import mix, pieces, text_bytes, word_hashes

#: Share of an item's own score that a passage has to reach.
SCORE = 0.6
#: Share of the question's and of the answer's n-grams that the passage has to hold.
OVERLAP = 0.5
NGRAM = 5
K1, B = 1.2, 0.75
PART_ITEMS = 2000
BLOCK_ITEMS = 8
#: Bytes that separate words: everything in ASCII that is no letter or digit.
GAP = np.ones(256, bool)
GAP[128:] = False
for _first, _last in ((48, 58), (65, 91), (97, 123)):
    GAP[_first:_last] = False
FOUND = "array<struct<item_id:bigint,score:double,question:double,answer:double,at:bigint>>"


def _words(texts: list[str]) -> list[np.ndarray]:
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    words, _, _, owner = word_hashes(data, offsets, GAP)
    return np.split(words, np.searchsorted(owner, np.arange(1, len(texts))))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of the runs of ``n`` words."""
    count = len(words) - n + 1
    if count <= 0 or n <= 0:
        return np.zeros(0, np.uint64)
    run = np.zeros(count, np.uint64)
    for j in range(n):
        run = mix(run + words[j : j + count] * np.uint64(2 * j + 3))
    return np.unique(run)


def _halves(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence is the answer, else the last third of the words."""
    stripped = text.rstrip()
    cut = max(stripped.rfind(mark, 0, -1) for mark in (". ", "? ", "! ", ".\n", "?\n", "!\n"))
    if cut > 0:
        return stripped[: cut + 1], stripped[cut + 1 :]
    words = stripped.split()
    at = max(1, len(words) * 2 // 3)
    return " ".join(words[:at]), " ".join(words[at:])


class Totals(NamedTuple):
    """Number, mean length and greatest length of all items that have words."""

    items: int
    mean: float
    longest: int


class Index:
    """BM25 shares of the items of one part, by term and by block.

    ``frequencies`` has the number of items of the whole benchmark for each term of the part.
    """

    def __init__(self, items: list[tuple[int, str]], totals: Totals, frequencies: dict[int, int]):
        words = _words([t for _, t in items])
        keep = [i for i, w in enumerate(words) if len(w)]
        items, words = [items[i] for i in keep], [words[i] for i in keep]
        # Items with like vocabulary share blocks, so that block bounds are tight.
        order = sorted(range(len(items)), key=lambda i: (int(np.median(words[i])), items[i][0]))
        self.items = [items[i] for i in order]
        words = [words[i] for i in order]
        n = len(words)
        self.longest = totals.longest
        self.terms, flat = np.unique(np.concatenate(words or [np.zeros(0, np.uint64)]), return_inverse=True)
        owner = np.repeat(np.arange(n), list(map(len, words)))
        pair, tf = np.unique(flat * max(n, 1) + owner, return_counts=True)
        term, item = pair // max(n, 1), pair % max(n, 1)
        df = np.bincount(term, minlength=len(self.terms))
        length = np.bincount(owner, minlength=n)
        of_all = np.array([frequencies[t] for t in self.terms.view(np.int64).tolist()], float)
        idf = np.log1p((totals.items - of_all + 0.5) / (of_all + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / totals.mean))
        impact /= np.bincount(item, impact, minlength=n)[item]
        self.posting_of = np.concatenate([[0], np.cumsum(df)])
        self.item, self.impact = item, impact
        blocks = (n + BLOCK_ITEMS - 1) // BLOCK_ITEMS
        self.most = np.zeros((len(self.terms), max(blocks, 1)), np.float32)
        np.maximum.at(self.most, (term, item // BLOCK_ITEMS), impact.astype(np.float32))
        halves = [_halves(t) for _, t in self.items]
        self.grams = []
        for part in zip(_words([q for q, _ in halves]), _words([a for _, a in halves]), strict=True):
            sizes = [min(NGRAM, len(w)) for w in part]
            self.grams.append([(k, ngrams(w, k)) for w, k in zip(part, sizes, strict=True)])

    def search(self, words: np.ndarray, bounds: np.ndarray, score: float, overlap: float):
        """Rows (text number, item_id, score, question, answer, word) of verified items."""
        out: dict[tuple[int, int], tuple] = {}
        step = self.longest
        sizes = np.diff(bounds)
        chunks = np.maximum(-(-sizes // step), 0)
        first = np.concatenate([[0], np.cumsum(chunks)])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        chunk = first[owner] + (np.arange(len(words)) - bounds[owner]) // step
        slot = np.minimum(np.searchsorted(self.terms, words), max(len(self.terms) - 1, 0))
        known = np.flatnonzero(self.terms[slot] == words) if len(self.terms) else np.zeros(0, int)
        if not len(known):
            return out
        pair = np.unique(chunk[known] * len(self.terms) + slot[known])
        place, term = pair // len(self.terms), pair % len(self.terms)
        lead = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        bound = np.zeros((first[-1] + 1, self.most.shape[1]), np.float32)
        for a in range(0, len(lead), 4096):  # bounded rows at a time
            ends = lead[a + 4096] if a + 4096 < len(lead) else len(place)
            rows = self.most[term[lead[a] : ends]]
            bound[place[lead[a : a + 4096]]] = np.add.reduceat(rows, lead[a : a + 4096] - lead[a])
        of = np.repeat(np.arange(len(sizes)), chunks)
        follows = np.append(of[1:] == of[:-1], False) if len(of) else np.zeros(0, bool)
        total = bound[:-1] + np.where(follows[:, None], bound[1:], 0)
        window, block = np.nonzero(total >= score - 1e-4)
        starts = np.searchsorted(place, np.arange(first[-1] + 2))
        for w in np.unique(window).tolist():
            text = int(of[w])
            last = w + 1 if follows[w] else w
            terms = np.unique(term[starts[w] : starts[last + 1]])
            spans = [slice(self.posting_of[t], self.posting_of[t + 1]) for t in terms.tolist()]
            item = np.concatenate([self.item[s] for s in spans])
            share = np.bincount(item, np.concatenate([self.impact[s] for s in spans]))
            begin = int(bounds[text] + (w - first[text]) * step)
            own = words[begin : min(begin + 2 * step, int(bounds[text + 1]))]
            made: dict[int, np.ndarray] = {}
            for b in block[window == w].tolist():
                for i in range(b * BLOCK_ITEMS, min((b + 1) * BLOCK_ITEMS, len(share))):
                    if share[i] < score:
                        continue
                    found = []
                    for k, grams in self.grams[i]:
                        if k not in made:
                            made[k] = ngrams(own, k)
                        held = np.isin(grams, made[k]).mean() if len(grams) else 1.0
                        found.append(float(held))
                    key = (text, self.items[i][0])
                    if min(found) >= overlap and (key not in out or share[i] > out[key][2]):
                        out[key] = (*key, float(share[i]), *found, begin - int(bounds[text]))
        return out


def find_items(
    df: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    result: str = "benchmark_items",
    score: float = SCORE,
    overlap: float = OVERLAP,
) -> DataFrame:
    """``df`` with the benchmark items found in each text, best passage each, as an array."""
    spark = df.sparkSession
    items = benchmark.where(F.col(item_text).isNotNull()).select(
        F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text")
    )
    parts = max(1, -(-items.count() // PART_ITEMS))
    items = items.withColumn("part", F.expr(f"pmod(xxhash64(item, text), {parts})"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            words, _, _, owner = word_hashes(data, offsets, GAP)
            sizes = np.bincount(owner, minlength=batch.num_rows)
            pair = np.unique(np.stack([owner.astype(np.uint64), words], 1), axis=0)
            of = pair[:, 0].astype(np.int64)
            lead = np.concatenate([[True], of[1:] != of[:-1]])[: len(of)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(batch.column(1).to_numpy()[of]),
                    pa.array(np.ascontiguousarray(pair[:, 1]).view(np.int64)),
                    pa.array(np.where(lead, sizes[of], 0).astype(np.int64)),
                ],
                ["part", "term", "length"],
            )

    counted = items.select("text", "part").mapInArrow(terms, "part long, term long, length long")
    # The first term of an item brings its length, the others none.
    whole = counted.where("length > 0").agg(
        F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), F.max("length").alias("longest")
    ).first()
    totals = Totals(whole["n"], max(whole["mean"] or 1.0, 1.0), whole["longest"] or 1)
    frequencies = counted.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    out = df.drop(result).withColumn(result, F.array().cast(FOUND))
    for part in range(parts):
        # About PART_ITEMS rows, and the terms that stand in them.
        own = items.where(F.col("part") == part).collect()
        known = counted.where(F.col("part") == part).select("term").distinct()
        there = frequencies.join(known, "term", "left_semi").toArrow()
        known_df = dict(zip(there["term"].to_pylist(), there["n"].to_pylist(), strict=True))
        index = Index([(r["item"], r["text"]) for r in own], totals, known_df)
        out = _search_part(out, spark.sparkContext.broadcast(index), text, result, score, overlap)
    return out


def _search_part(df, index, text, result, score, overlap) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            place = batch.schema.get_field_index(text)
            data, offsets = text_bytes(batch.column(place))
            found: list[list[dict]] = batch.column(result).to_pylist()
            for a, b in pieces(offsets):
                local = offsets[a : b + 1] - offsets[a]
                words, _, _, owner = word_hashes(data[offsets[a] : offsets[b]], local, GAP)
                bounds = np.searchsorted(owner, np.arange(b - a + 1))
                for row in own.search(words, bounds, score, overlap).values():
                    names = ("item_id", "score", "question", "answer", "at")
                    found[a + row[0]].append(dict(zip(names, row[1:], strict=True)))
            kind = batch.schema.field(result).type
            columns = [
                pa.array(found, kind) if name == result else column
                for name, column in zip(batch.schema.names, batch.columns, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, df.schema)
