"""Quality classifier from weak labels.

Heuristic labellers vote on every document, for or against a class, or abstain.
How often each one is right is not known; expectation maximisation estimates it
from how the votes of all documents agree, and gives each pattern of votes a
posterior probability. The posteriors then are the targets of a logistic
regression on hashed words, word beginnings and word shapes, where a label, if
there is one, takes the posterior's place. A document's score is the larger of
the regression's and the posterior of its own votes. Three classes are judged this way: texts full of marks, texts that
repeat themselves (both junk), and toxic ones; a document is kept if it is none.
If labelled documents are given, words and word beginnings that stand almost
only in documents labelled toxic make up further labellers.

Only counts of vote patterns (at most 3 to the power of the labellers) and a
training sample of at most ``TRAIN_ROWS`` documents reach the driver; labelling,
counting and scoring cover all documents. The sample is dealt over the patterns
of votes and labels: rare ones are taken whole, frequent ones share the rest,
each drawn by a hash of id and text. So the number of toxic documents in it does
not fall as the corpus grows. The votes of all documents are kept in a table
while the sample is drawn, so no text is read by the labellers twice.

Defined cases: a null, empty or blank text has a low-quality score of 1 and is
not kept; texts are read whole; equal texts score alike; an empty table gives an
empty result; other columns are kept, those with the results' names replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmine.llm.common import (
    LOWER,
    bound_batches,
    give_back,
    giving_back,
    list_arrays,
    mix,
    pieces,
    rolling,
    span_hash,
    text_bytes,
    word_hashes,
    word_spans,
)
from textmine.llm.decontaminate import GAP
from textmine.sources.scratch import discard, materialize

#: Most documents that the scorers are trained on, and most labels that are looked at.
TRAIN_ROWS = 12_000
LABEL_ROWS = 10_000
#: A telling word: share of its labelled documents that are toxic, and their number.
TELLING_SHARE, TELLING_ROWS, TELLING_WORDS = 0.95, 8, 500
#: Bytes of a word's beginning.
STEM = 6
#: Hashed words, as a power of two.
HASH_BITS = 17
EPOCHS, RATE, DECAY = 6, 0.5, 1e-6
CLASSES = {"marks": 4, "repeats": 3, "toxic": 5}  # and the number of labellers of each
JUNK, TOXIC = 0.5, 0.5

# Insults, in two lists that the labellers of toxicity look for.
INSULTS = (
    "idiot moron stupid clown dumb fool imbecile dimwit loser jerk".split(),
    "worthless pathetic disgusting trash scum garbage vermin filth hate kill".split(),
)

_SHAPES, _BINS, _MEASURES = 48, 8, 5
_EXTRA = _SHAPES + _BINS * _MEASURES
#: Upper edges of the bins of each measure.
_EDGES = np.array(
    [
        [0.002, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2],  # symbols among bytes
        [0.03, 0.06, 0.1, 0.2, 0.3, 0.5, 0.7],  # capitals among ASCII letters
        [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8],  # different words among words
        [0.2, 0.4, 0.5, 0.6, 0.7, 0.85, 0.95],  # different lines among lines
        [0.01, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8],  # words that end in a symbol
    ]
)
_byte = np.arange(256)
_UPPER = (_byte >= 65) & (_byte <= 90)
_ALPHA = _UPPER | ((_byte >= 97) & (_byte <= 122))
_PLAIN = np.isin(_byte, list(b".,;:?'\"()-")) | (_byte <= 32)
_SYMBOL = GAP & ~_PLAIN
_NEWLINE = _byte == 10


def _share(part: np.ndarray, whole: np.ndarray, default: float = 0.0) -> np.ndarray:
    return np.where(whole > 0, part / np.maximum(whole, 1), default)


def _sorted_distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new]


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each of ``n`` texts has; the text's number takes low bits' place."""
    bits = np.uint64(max((n - 1).bit_length(), 1))
    rest = np.uint64(64) - bits
    keys = _sorted_distinct((owner.astype(np.uint64) << rest) | (hashes >> bits))
    return np.bincount((keys >> rest).astype(np.int64), minlength=n)


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are in a sorted list."""
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


@cache
def _insult_hashes() -> list[np.ndarray]:
    out = []
    for words in INSULTS:
        data, offsets = text_bytes(pa.array(words))
        out.append(np.sort(word_hashes(data, offsets, GAP)[0]))
    return out


class Features:
    """Words, word shapes and measures of the texts of one piece, each made when it is asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = self.n = len(offsets) - 1
        self.spans = word_spans(data, offsets)
        self.words = np.bincount(self.spans[2], minlength=n)
        lowered = LOWER[data]
        begin, stop, self.owner = word_spans(lowered, offsets, GAP)
        sums = rolling(lowered)
        self.hashes = span_hash(sums, begin, stop)
        long = stop - begin > STEM
        self.stems = span_hash(sums, begin[long], begin[long] + STEM) + np.uint64(1)
        self.stem_owner = self.owner[long]

    @cached_property
    def symbol_end(self) -> np.ndarray:
        """Which words end in a symbol."""
        end = self.spans[1]
        return _SYMBOL[self.data[end - 1]] if len(end) else np.zeros(0, bool)

    @cached_property
    def shapes(self) -> np.ndarray:
        """The share of each shape among a text's words."""
        data, n = self.data, self.n
        start, end, owner = self.spans
        upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
        caps = upper[end] - upper[start]
        last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
        kind = np.where(self.symbol_end, 2, np.where(GAP[last], 1, 0))
        first_upper = _UPPER[data[start]] if len(start) else np.zeros(0, bool)
        all_caps = (caps > 1) & (caps * 2 > end - start)
        shape = first_upper + 2 * all_caps + 4 * kind + 12 * np.minimum((end - start) // 4, 3)
        counts = np.bincount(owner * _SHAPES + shape, minlength=n * _SHAPES)
        return counts.reshape(n, _SHAPES) / np.maximum(self.words, 1)[:, None]

    @cached_property
    def sums(self) -> np.ndarray:
        return rolling(self.data)

    @cached_property
    def line_spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return word_spans(self.data, self.offsets, _NEWLINE)

    @cached_property
    def lines(self) -> np.ndarray:
        return np.bincount(self.line_spans[2], minlength=self.n)

    def _total(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        return np.diff(np.searchsorted(np.flatnonzero(flags[self.data]), self.offsets))

    @cached_property
    def measures(self) -> np.ndarray:
        n, words = self.n, self.words
        start, end, owner = self.spans
        different = _distinct(owner, span_hash(self.sums, start, end), n)
        first, last, line_owner = self.line_spans
        line_kinds = _distinct(line_owner, span_hash(self.sums, first, last), n)
        return np.stack(
            [
                _share(self._total(_SYMBOL), np.diff(self.offsets)),
                _share(self._total(_UPPER), self._total(_ALPHA)),
                _share(different, words, 1.0),
                _share(line_kinds, self.lines, 1.0),
                _share(np.bincount(owner, self.symbol_end, minlength=n), words),
            ],
            axis=1,
        )

    @cached_property
    def bigrams(self) -> np.ndarray:
        """Different pairs of words among a text's pairs."""
        start, end, owner = self.spans
        inside = owner[1:] == owner[:-1]
        pairs = owner[1:][inside]
        bigram = span_hash(self.sums, start[:-1][inside], end[1:][inside])
        return _share(
            _distinct(pairs, bigram, self.n), np.bincount(pairs, minlength=self.n), 1.0
        )

    @cached_property
    def insults(self) -> list[np.ndarray]:
        found = [_among(self.hashes, known) for known in _insult_hashes()]
        return [np.bincount(self.owner[f], minlength=self.n) for f in found]

    def telling(self, known: np.ndarray) -> np.ndarray:
        """How many words or word beginnings of each text are in a list of hashes."""
        known = np.sort(known)
        words, stems = _among(self.hashes, known), _among(self.stems, known)
        return np.bincount(self.owner[words], minlength=self.n) + np.bincount(
            self.stem_owner[stems], minlength=self.n
        )

    def votes(self, known: np.ndarray) -> dict[str, np.ndarray]:
        """Votes of the labellers of each class: 1 for, 0 against, 2 abstains."""

        def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
            return np.where(bad, 1, np.where(good, 0, 2))

        symbols, caps, variety, lines, ends = self.measures.T
        several, many = self.lines >= 3, self.words >= 20
        a, b = self.insults
        told = self.telling(known)
        votes = {
            "marks": [
                vote(symbols > 0.03, symbols < 0.01),
                vote((caps > 0.4) & (self.words > 3), caps < 0.2),
                vote(ends > 0.2, ends < 0.05),
                vote(self.words == 0, self.words < 0),
            ],
            "repeats": [
                vote(many & (variety < 0.45), many & (variety > 0.55)),
                vote(several & (lines < 0.6), several & (lines > 0.9)),
                vote(many & (self.bigrams < 0.6), many & (self.bigrams > 0.75)),
            ],
            "toxic": [
                vote(a > 0, a + b + told == 0),
                vote(b > 0, a + b + told == 0),
                vote(a + b >= 2, a + b + told == 0),
                vote(told > 0, told == 0),
                vote(told > 1, told == 0),
            ],
        }
        return {name: np.stack(v, 1) for name, v in votes.items()}

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, feature, value): each text's distinct hashed words, shapes and bins."""
        size = 1 << HASH_BITS
        hashes = np.concatenate([self.hashes, mix(self.stems)])
        slot = (hashes >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        pair = _sorted_distinct(np.concatenate([self.owner, self.stem_owner]) * size + slot)
        owner, slot = pair // size, pair % size
        weight = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=self.n), 1))
        text, shape = np.nonzero(self.shapes)
        bins = np.stack(
            [np.searchsorted(e, m, side="right") for e, m in zip(_EDGES, self.measures.T, strict=True)], 1
        )
        place = size + _SHAPES + np.arange(_MEASURES) * _BINS + bins
        return (
            np.concatenate([owner, text, np.repeat(np.arange(self.n), _MEASURES)]),
            np.concatenate([slot, size + shape, place.ravel()]),
            np.concatenate([4 * weight[owner], self.shapes[text, shape], np.ones(place.size)]),
        )


def estimate(patterns: np.ndarray, counts: np.ndarray, prior: float) -> np.ndarray:
    """Posterior probability of the class for each pattern of votes, by EM.

    Votes are independent given the class; an abstention says nothing.
    """
    cast = patterns != 2
    yes = (patterns == 1) & cast
    post = np.where(yes.any(1), 0.9, 0.05)
    for _ in range(200):
        # A class keeps a little weight on every vote, so that none is ever impossible.
        share = np.clip((counts * post).sum() / max(counts.sum(), 1), 1e-4, 0.5)
        log = np.log(share) - np.log1p(-share) + np.zeros(len(post))
        for j in range(patterns.shape[1]):
            inside, outside = counts * post * cast[:, j], counts * (1 - post) * cast[:, j]
            p = ((inside * yes[:, j]).sum() + prior) / (inside.sum() + 2 * prior)
            q = ((outside * yes[:, j]).sum() + prior * 0.02) / (outside.sum() + 2 * prior)
            log += np.where(yes[:, j], np.log(p / q), np.where(cast[:, j], np.log((1 - p) / (1 - q)), 0))
        new = 1 / (1 + np.exp(-np.clip(log, -50, 50)))
        if np.abs(new - post).max(initial=0) < 1e-7:
            break
        post = new
    return post


def _codes(votes: np.ndarray) -> np.ndarray:
    return (votes * 3 ** np.arange(votes.shape[1])).sum(1)


def _patterns(codes: np.ndarray, n: int) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(n) % 3


def _train(owner, slot, value, target, weight, n) -> np.ndarray:
    """Logistic regression by AdaGrad over batches of texts; the last weight is the offset."""
    size = (1 << HASH_BITS) + _EXTRA
    weights, seen = np.zeros(size + 1), np.full(size + 1, 1e-6)
    bounds = np.searchsorted(owner, np.arange(n + 1))  # the rows come text by text
    # Rare classes weigh as much as half of the common one.
    share = max(np.average(target, weights=weight) if n else 0.5, 1e-3)
    extra = max(min(0.5 / share, 8.0), 1.0)
    scale = np.where(target > 0.5, extra, 1.0) * weight
    step = 64
    for epoch in range(EPOCHS):
        for a in np.random.default_rng(epoch).permutation(-(-n // step)) * step:
            b = min(a + step, n)
            part = slice(bounds[a], bounds[b])
            who, what, x = owner[part] - a, slot[part], value[part]
            z = np.bincount(who, weights[what] * x, minlength=b - a) + weights[-1]
            error = (1 / (1 + np.exp(-z)) - target[a:b]) * scale[a:b]
            used, back = np.unique(what, return_inverse=True)
            slope = np.bincount(back, error[who] * x) / (b - a) + DECAY * weights[used]
            seen[used] += slope**2
            weights[used] -= RATE * slope / np.sqrt(seen[used])
            seen[-1] += error.mean() ** 2
            weights[-1] -= RATE * error.mean() / np.sqrt(seen[-1])
    weights[-1] -= np.log(extra)  # scores are probabilities again
    return weights


class Model(NamedTuple):
    """What scores a document: weights by class, telling words, posteriors by pattern of votes."""

    weights: np.ndarray
    known: np.ndarray
    posterior: dict[str, np.ndarray]


def shares(counts: np.ndarray, rows: int) -> np.ndarray:
    """The share of each stratum to draw, so that about ``rows`` come from all: small ones whole."""
    order = np.argsort(counts, kind="stable")
    out, left = np.ones(len(counts)), float(rows)
    for place, i in enumerate(order):
        own = min(float(counts[i]), left / (len(counts) - place))
        out[i] = own / max(counts[i], 1)
        left -= own
    return out


def _each_piece(batch: pa.RecordBatch, text: str):
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    for a, b in pieces(offsets):
        yield a, b, Features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _labelled(labels: DataFrame, id_col: str) -> DataFrame:
    """``<id, toxic>``: at most ``LABEL_ROWS`` of the labels, chosen by a hash of the id."""
    return (
        labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull())
        .groupBy(id_col)
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64(id_col))
        .limit(LABEL_ROWS)
    )


def telling_words(df: DataFrame, labels: DataFrame, *, text: str, id_col: str) -> np.ndarray:
    """Hashes of words and word beginnings that stand almost only in toxic documents.

    ``labels`` is what ``_labelled`` gives.
    """
    # Its limit bounds what is broadcast to two numbers a row.
    rows = df.select(F.col(id_col), F.col(text).alias("text")).join(F.broadcast(labels), id_col)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for a, b, own in _each_piece(batch, "text"):
                owner = np.concatenate([own.owner, own.stem_owner])
                both = np.concatenate([own.hashes, own.stems])
                pair = np.unique(np.stack([owner.astype(np.uint64), both], 1), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(pair[:, 1].view(np.int64)),
                        pa.array(toxic[a:b][pair[:, 0].astype(np.int64)]),
                    ],
                    ["word", "toxic"],
                )

    found = (
        rows.select("text", "toxic")
        .mapInArrow(giving_back(words), "word long, toxic int")
        .groupBy("word")
        .agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
        .where(
            (F.col("bad") >= TELLING_ROWS) & (F.col("bad") >= TELLING_SHARE * F.col("n"))
        )
        .orderBy(F.desc("bad"), "word")
        .limit(TELLING_WORDS)
        .toArrow()
    )
    return found["word"].to_numpy().view(np.uint64)


def fit(
    df: DataFrame,
    *,
    text: str = "text",
    id_col: str = "doc_id",
    labels: DataFrame | None = None,
    train_rows: int = TRAIN_ROWS,
) -> Model:
    """The scorers' weights and the posteriors of the vote patterns."""
    known = np.zeros(0, np.uint64)
    # By id and text, so that a text with many copies is drawn as often as it stands.
    drawn = F.xxhash64(*[c for c in (id_col, text) if c in df.columns])
    if labels is None:
        rows = df.select(F.col(text).alias("text"), F.lit(-1).alias("label"), drawn.alias("drawn"))
    else:
        some = _labelled(labels, id_col)
        known = telling_words(df, some, text=text, id_col=id_col)
        rows = (
            df.select(F.col(id_col), F.col(text).alias("text"), drawn.alias("drawn"))
            .join(F.broadcast(some), id_col, "left")
            .select("text", F.coalesce("toxic", F.lit(-1)).alias("label"), "drawn")
        )

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, own in _each_piece(batch, "text"):
                votes = own.votes(known)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(_codes(votes[name])) for name in CLASSES),
                        *(column[a:b] for column in batch.columns[1:]),
                    ],
                    [*strata, "drawn"],
                )

    kinds = ", ".join(f"{name} long" for name in CLASSES)
    strata = [*CLASSES, "label"]
    # The sample is drawn from it, so that the labellers read every text once.
    voted = materialize(
        rows.mapInArrow(giving_back(label), f"{kinds}, label int, drawn long"), "votes"
    )
    seen = (
        voted.groupBy(*strata)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(*strata)
        .toArrow()  # vote patterns only
    )
    rows_of = seen["n"].to_numpy()
    total = int(rows_of.sum())
    posterior = {}
    for name, width in CLASSES.items():
        codes, of = np.unique(seen[name].to_numpy(), return_inverse=True)
        counts = np.bincount(of, rows_of, minlength=len(codes))
        posterior[name] = np.zeros(3**width)
        posterior[name][codes] = estimate(_patterns(codes, width), counts, 1.0)

    chosen = rows.select("text", "label")
    part_of = np.ones(len(rows_of)) if total <= train_rows else shares(rows_of, train_rows * 10 // 11)
    share = dict(zip(zip(*(seen[c].to_pylist() for c in strata), strict=True), part_of.tolist(), strict=True))
    if total > train_rows:

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = zip(*(column.to_pylist() for column in batch.columns[:-1]), strict=True)
                part = np.fromiter(map(share.__getitem__, keys), np.float64, batch.num_rows)
                drawn = batch.column(len(strata))
                at = mix(drawn.to_numpy().view(np.uint64)) / 2.0**64
                yield pa.RecordBatch.from_arrays([drawn.filter(pa.array(at < part))], ["drawn"])

        # About train_rows numbers, as the shares bound them; equal ids and texts have one.
        picked = voted.mapInArrow(draw, "drawn long").distinct()
        chosen = (
            rows.join(F.broadcast(picked), "drawn", "left_semi")
            .select("text", "label")
            .limit(train_rows)
        )

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, own in _each_piece(batch, "text"):
                votes = own.votes(known)
                owner, slot, value = own.rows()
                order = np.argsort(owner, kind="stable")
                bounds = np.searchsorted(owner[order], np.arange(b - a + 1)).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(pa.array(bounds), column)
                    for column in (slot[order].astype(np.int32), value[order].astype(np.float32))
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(_codes(votes[name])) for name in CLASSES),
                        batch.column(1)[a:b],
                        *lists,
                    ],
                    [*strata, "slot", "value"],
                )

    sample = chosen.mapInArrow(
        giving_back(featurise), f"{kinds}, label int, slot array<int>, value array<float>"
    ).toArrow()  # at most train_rows rows
    discard(voted)
    n = sample.num_rows
    if not n:
        weights = np.zeros((len(CLASSES), (1 << HASH_BITS) + _EXTRA + 1))
        return Model(weights, known, posterior)
    sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in sample.column("slot").chunks])
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    slot, value = (
        np.concatenate([list_arrays(c)[0] for c in sample.column(name).chunks])
        for name in ("slot", "value")
    )
    targets = {name: posterior[name][sample.column(name).to_numpy()] for name in CLASSES}
    given = sample.column("label").to_numpy()
    targets["toxic"] = np.where(given >= 0, given, targets["toxic"])
    # A text stands for those of its stratum that were not drawn.
    keys = zip(*(sample.column(name).to_pylist() for name in strata), strict=True)
    weight = np.array([1 / share[k] for k in keys])
    weight /= weight.mean()
    del sample
    give_back()
    weights = np.stack([_train(owner, slot, value, targets[name], weight, n) for name in CLASSES])
    del owner, slot, value
    give_back()
    return Model(weights, known, posterior)


def score(df: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``df`` with ``junk`` and ``toxicity`` (0 to 1) and ``kept``."""
    shared = df.sparkSession.sparkContext.broadcast(
        model._replace(weights=model.weights.astype(np.float32))
    )
    rest = df.drop("junk", "toxicity", "kept")
    names = [c for c in rest.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known, posterior = shared.value
        for batch in batches:
            out = np.zeros((len(CLASSES), batch.num_rows))
            for a, b, own in _each_piece(batch, text):
                owner, slot, value = own.rows()
                votes = own.votes(known)
                for k, name in enumerate(CLASSES):
                    z = np.bincount(owner, table[k][slot] * value, minlength=b - a) + table[k][-1]
                    own_votes = posterior[name][_codes(votes[name])]
                    out[k, a:b] = np.maximum(1 / (1 + np.exp(-np.clip(z, -50, 50))), own_votes)
                out[0, a:b][own.words == 0] = 1.0
            junk, toxic = out[:2].max(0), out[2]
            kept = (junk < JUNK) & (toxic < TOXIC)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(junk), pa.array(toxic), pa.array(kept)],
                [*names, "junk", "toxicity", "kept"],
            )

    schema = T.StructType(
        [
            *rest.schema.fields,
            T.StructField("junk", T.DoubleType()),
            T.StructField("toxicity", T.DoubleType()),
            T.StructField("kept", T.BooleanType()),
        ]
    )
    return rest.mapInArrow(giving_back(run), schema)


def classify(
    df: DataFrame,
    *,
    text: str = "text",
    id_col: str = "doc_id",
    labels: DataFrame | None = None,
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """Fit on ``df`` and score it."""
    bound_batches(df.sparkSession)
    model = fit(df, text=text, id_col=id_col, labels=labels, train_rows=train_rows)
    return score(df, model, text=text)
