"""Alignment of two tokenizers over a corpus, with an identity map as fast path.

Both tokenizers cut the same bytes (a space and the text). Offsets where tokens of both
end cut a text into groups; inside a group every pair of tokens whose bytes overlap is a
link. Two array operations find all links: the offsets where either tokenizer ends a token
cut the bytes into segments, and each segment lies in exactly one token of either.

Most groups are one token of either with the same bytes. The map from an id to the other
tokenizer's id of the same bytes is computed once, so such a link is known by one id, and
the documents that hold it are counted in a vector as long as the vocabulary. Only other
links become pairs that are counted by a shuffle. (A link of equal bytes inside a larger
group, where the two tokens stand shifted, also goes to the vector, as a document must
count once for it; a one-to-one group with a second id for the same bytes is a pair.)

Texts are worked on in chunks of bounded size. A chunk keeps its documents, its links and
the distinct pairs among them; the corpus-wide counts of these come back by a join on the
pair and one row per chunk. The vectors (counts of identity links, highest count per id)
are as long as the vocabulary and are shared with all executors.

A text is cut at single spaces between other characters, where neither tokenizer lets a
token cross: fragments are encoded once per worker and gathered. Texts that have other
white space beside a space are cut at the remaining spaces only.

Defined cases: a text that is null, empty, or that either tokenizer does not give back
byte by byte has no tokens (zeros and an empty group string) and no links; special tokens'
strings are plain text; repeated rows count as documents of their own; texts of any length
are aligned whole; equal counts are all highest; null ids stay null; an empty table gives
empty results; other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmine.llm.bpe import _byte_letters
from textmine.llm.fragments import (
    KEPT_FRAGMENTS,
    cut,
    gather,
    load_tokenizer,
    loaded,
    share_file,
    text_pieces,
)
from textmine.sources.scratch import materialize

#: A pair of ids as one number: the first id times this, plus the second.
PAIR = 1 << 20

#: A space where neither tokenizer joins both sides; Python's white space includes theirs.
_SEAM = re.compile(r"(?<=\S) (?=\S)")


class _Pool:
    """The bytes of all tokens, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.decimal = np.array([str(i) for i in range(len(tokens))], object)


def byte_level_tokens(content: bytes) -> list[bytes]:
    """Token bytes by id of a byte-level tokenizer file."""
    spec = json.loads(content)
    letters = _byte_letters()
    ids = dict(spec["model"]["vocab"])
    ids |= {added["content"]: added["id"] for added in spec["added_tokens"]}
    out = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        out[i] = bytes(letters[c] for c in token)
    return out


def piece_tokens(pieces) -> list[bytes]:
    """Token bytes by id of a sentencepiece model."""
    return [
        bytes([int(pieces.id_to_piece(i)[3:5], 16)])
        if pieces.is_byte(i)
        else pieces.id_to_piece(i).replace("▁", " ").encode()
        for i in range(pieces.get_piece_size())
    ]


def identity_map(first: list[bytes], second: list[bytes], last_choice: set[int]) -> np.ndarray:
    """For each id of the first vocabulary the other's id of the same bytes, or -1.

    Ids in ``last_choice`` are taken only where no other has the bytes.
    """
    by_bytes: dict[bytes, int] = {}
    for i, token in enumerate(second):
        if token not in by_bytes or by_bytes[token] in last_choice:
            by_bytes[token] = i
    return np.array([by_bytes.get(token, -1) for token in first], np.int64)


class Aligner:
    """Both tokenizers, and the links of the fragments that were met already."""

    def __init__(self, tokenizer: bytes, pieces: bytes):
        from sentencepiece import SentencePieceProcessor

        self.encode_a = load_tokenizer(tokenizer, plain_specials=True).encode_batch_fast
        model = SentencePieceProcessor(model_proto=pieces)
        self.encode_b = lambda texts: model.encode(texts, num_threads=1)
        a, b = byte_level_tokens(tokenizer), piece_tokens(model)
        if any(0 < token.rfind(b" ") and token.strip(b" ").count(b" ") for token in b) or any(
            token.endswith(b" ") and token.strip(b" ") for token in b
        ):
            raise ValueError("a piece joins two words, so texts cannot be cut at spaces")
        self.a, self.b = _Pool(a), _Pool(b)
        bytewise = {i for i in range(len(b)) if model.is_byte(i) or model.is_control(i)}
        self.same = identity_map(a, b, bytewise)
        self.known: dict[str, tuple] = {}

    def forget(self) -> None:
        """Give back the table, as another stage may follow in the same worker."""
        self.known = {}
        pa.default_memory_pool().release_unused()

    def _learn(self, fragments: list[str]) -> None:
        """Tokens, groups and links of new fragments, each with a space before it."""
        spaced = [" " + f for f in fragments]
        raw = [s.encode() for s in spaced]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        given = (
            ([e.ids for e in self.encode_a(spaced, add_special_tokens=False)], self.a),
            (self.encode_b(fragments), self.b),
        )
        # Fragments whose tokens have as many bytes can be compared byte by byte.
        fine = np.ones(len(raw), bool)
        coded = []
        for ids, pool in given:
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            tokens = np.fromiter(chain.from_iterable(ids), np.int64, counts.sum())
            spans = np.concatenate([[0], np.cumsum(pool.sizes[tokens])])
            cuts = np.concatenate([[0], np.cumsum(counts)])
            fine &= np.diff(spans[cuts]) == lengths
            coded.append((tokens, counts))
        kept = [raw[i] for i in np.flatnonzero(fine)]
        data = np.frombuffer(b"".join(kept), np.uint8)
        bounds = np.concatenate([[0], np.cumsum(lengths[fine])])
        wrong = np.zeros(len(data) + 1, np.int64)
        flat, ends = [], []
        for (tokens, counts), (_, pool) in zip(coded, given, strict=True):
            tokens = tokens[np.repeat(fine, counts)]
            spelled, cuts = gather(pool.data, pool.firsts, pool.sizes, tokens)
            wrong[1:] += spelled != data
            flat.append(tokens)
            ends.append(cuts[1:])
        wrong = np.cumsum(wrong)[bounds]
        right = wrong[1:] == wrong[:-1]
        # Offsets where either ends a token: every segment before one is a link.
        either = np.union1d(*ends)
        both = np.intersect1d(*ends, assume_unique=True)
        links = (
            flat[0][np.searchsorted(ends[0], either)] * PAIR
            + flat[1][np.searchsorted(ends[1], either)]
        )
        group = [np.searchsorted(both, e) for e in ends]
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        side = np.repeat([0, 1], [len(flat[0]), len(flat[1])])[order]
        decimal = np.concatenate(
            [self.a.decimal[flat[0]], self.b.decimal[flat[1]]]
        )[order]
        which = np.concatenate(group)[order]
        last = np.ones(len(order), bool)
        last[:-1] = (which[1:] != which[:-1]) | (side[1:] != side[:-1])
        mark = np.array([",", ",", "|", ";"], object)[2 * last + side]
        words = (decimal + mark).tolist() if len(order) else []
        at_link = np.searchsorted(either, bounds, side="right").tolist()
        n_groups = np.diff(np.searchsorted(both, bounds, side="right")).tolist()
        at = [np.searchsorted(e, bounds, side="right") for e in ends]
        n_a, n_b = (np.diff(x).tolist() for x in at)
        at_word = (at[0] + at[1]).tolist()
        raw_links = links.tobytes()
        known = self.known
        known.update(dict.fromkeys(fragments, (None, b"", 0, 0, 0)))
        for j, i in enumerate(np.flatnonzero(fine).tolist()):
            if right[j]:
                known[fragments[i]] = (
                    "".join(words[at_word[j] : at_word[j + 1]])[:-1],
                    raw_links[8 * at_link[j] : 8 * at_link[j + 1]],
                    n_a[j],
                    n_b[j],
                    n_groups[j],
                )

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Like :func:`fragments.cut`; a text with white space beside a space is cut less."""
        which, distinct, offsets = cut(texts)
        fragments = distinct.to_pylist()
        ragged = np.array([not f or f[0].isspace() or f[-1].isspace() for f in fragments], bool)
        seen = np.concatenate([[0], np.cumsum(ragged[which])])
        odd = np.flatnonzero((seen[offsets[1:]] > seen[offsets[:-1]]) & (np.diff(offsets) > 1))
        if not len(odd):
            return which, fragments, offsets
        place = {f: i for i, f in enumerate(fragments)}
        parts = np.split(which, offsets[1:-1])
        for i in odd.tolist():
            found = _SEAM.split(texts[i].as_py())
            parts[i] = np.array([place.setdefault(f, len(place)) for f in found], np.int64)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.concatenate(parts), list(place), np.concatenate([[0], np.cumsum(sizes)])

    def chunk(self, docs: pa.Array, texts: pa.Array) -> dict:
        """What a chunk of documents keeps; see :func:`align`."""
        which, fragments, offsets = self._cut(texts)
        known = self.known
        new = [f for f in fragments if f not in known]
        if len(known) + len(new) > KEPT_FRAGMENTS:
            known.clear()
            new = fragments
        for first in range(0, len(new), 20_000):
            self._learn(new[first : first + 20_000])
        entries = [known[f] for f in fragments]
        strings = [e[0] for e in entries]
        bad = np.array([s is None for s in strings], bool)
        link_sizes = np.array([len(e[1]) // 8 for e in entries], np.int64)
        numbers = [np.array([e[k] for e in entries], np.int64) for k in (2, 3, 4)]
        flat = np.frombuffer(b"".join([e[1] for e in entries]), np.int64)

        empty = np.array([not len(t) for t in texts.to_numpy(zero_copy_only=False)], bool)
        none = empty | (np.diff(np.concatenate([[0], np.cumsum(bad[which])])[offsets]) > 0)
        totals = [
            np.where(none, 0, np.diff(np.concatenate([[0], np.cumsum(n[which])])[offsets]))
            for n in (*numbers, link_sizes)
        ]
        listed, cuts = which.tolist(), offsets.tolist()
        digests = [
            ""
            if skip
            else hashlib.sha256(";".join([strings[x] for x in listed[a:b]]).encode()).hexdigest()
            for skip, a, b in zip(none.tolist(), cuts, cuts[1:], strict=False)
        ]

        # Each document's distinct fragments, then its distinct links, with how often.
        owner = np.repeat(np.arange(len(none)), np.diff(offsets))
        counted = ~none[owner]
        code, times = np.unique(
            owner[counted] * max(len(fragments), 1) + which[counted], return_counts=True
        )
        of, fragment = np.divmod(code, max(len(fragments), 1))
        keys, _ = gather(flat, np.cumsum(link_sizes) - link_sizes, link_sizes, fragment)
        of = np.repeat(of, link_sizes[fragment])
        times = np.repeat(times, link_sizes[fragment])
        alike = self.same[keys // PAIR] == keys % PAIR
        ones = _per_document(of[alike], keys[alike] // PAIR, times[alike], len(none))
        pairs = _per_document(of[~alike], keys[~alike], times[~alike], len(none))
        return {
            "documents": _bytes(
                {
                    "doc": docs,
                    **dict(zip(("n_a", "n_b", "n_groups", "n_links"), totals, strict=True)),
                    "groups_sha256": digests,
                    "ones": ones["sizes"],
                    "pairs": pairs["sizes"],
                }
            ),
            "one_links": _bytes({"key": ones["at"].astype(np.int32), "n": ones["times"]}),
            "pair_links": _bytes({"key": pairs["at"].astype(np.int32), "n": pairs["times"]}),
            "ones": ones["values"],
            "ones_in": ones["in"],
            "pairs": pairs["values"],
            "pairs_in": pairs["in"],
        }


def _per_document(of: np.ndarray, key: np.ndarray, times: np.ndarray, docs: int) -> dict:
    """Distinct values with the documents each is in; per document its values and how often."""
    values, at = np.unique(key, return_inverse=True)
    code, back = np.unique(of * max(len(values), 1) + at, return_inverse=True)
    of, at = np.divmod(code, max(len(values), 1))
    return {
        "values": values,
        "in": np.bincount(at, minlength=len(values)),
        "sizes": np.bincount(of, minlength=docs),
        "at": at,
        "times": np.bincount(back, times, len(code)).astype(np.int64),
    }


def _bytes(columns: dict) -> bytes:
    """Columns of equal length as a compressed Arrow stream."""
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _columns(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as stream:
        return stream.read_next_batch()


@dataclass
class Alignment:
    """``documents``: one row per document; ``pairs``: ``<a, b, docs>`` of all linked ids."""

    documents: DataFrame
    pairs: DataFrame


_CHUNK = (
    "chunk long, documents binary, one_links binary, pair_links binary, ones array<long>, "
    "ones_in array<long>, pairs array<long>, pairs_in array<long>"
)


def align(
    df: DataFrame,
    tokenizer: str,
    pieces: str,
    *,
    id_col: str = "doc_id",
    text: str = "text",
) -> Alignment:
    """Align a byte-level tokenizer file (A) with a sentencepiece model (B) over all texts.

    Documents: ``<doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256>``.
    A pair's count is the number of documents that hold it; ``n_best`` are the links whose
    count is the highest of their A id, ``count_sum`` adds the counts of all links.
    """
    spark = df.sparkSession
    content_a, content_b = share_file(spark, tokenizer), share_file(spark, pieces)

    def own() -> Aligner:
        return loaded("links", content_a, lambda data: Aligner(data, content_b.value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = own()
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, texts in text_pieces(batch.column("text")):
                row = aligner.chunk(batch.column("doc").slice(first, len(texts)), texts)
                number += 1
                yield pa.RecordBatch.from_pydict(
                    {"chunk": [number]} | {k: [v] for k, v in row.items()}
                )
        aligner.forget()

    plain = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"))
    chunks = materialize(plain.mapInArrow(run, _CHUNK), "token-links")

    def summed(values: str, counts: str):
        each = chunks.select(F.explode(F.arrays_zip(values, counts)).alias("x"))
        return each.groupBy(F.col(f"x.{values}").alias("key")).agg(
            F.sum(f"x.{counts}").alias("docs")
        )

    counted = materialize(summed("pairs", "pairs_in"), "pair-counts")
    ones = materialize(summed("ones", "ones_in"), "identity-counts")
    best = ones.union(
        counted.groupBy(F.shiftright("key", 20).alias("key")).agg(F.max("docs").alias("docs"))
    )
    # Both are as long as the first vocabulary.
    aligner = Aligner(content_a.value, content_b.value)
    size = len(aligner.same)
    vectors = spark.sparkContext.broadcast(
        (_vector(ones, size), _vector(best.groupBy("key").agg(F.max("docs").alias("docs")), size))
    )
    back = (
        chunks.select("chunk", F.posexplode("pairs").alias("at", "key"))
        .join(counted, "key")
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("at", "docs")).alias("counts"))
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_one, highest = vectors.value
        for batch in batches:
            for row in range(batch.num_rows):
                value = {n: batch.column(n)[row] for n in batch.schema.names}
                yield _finished(value, of_one, highest, id_col)

    documents = chunks.drop("ones_in", "pairs_in").join(back, "chunk", "left").mapInArrow(
        finish,
        f"`{id_col}` long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
        "count_sum long, groups_sha256 string",
    )
    same = spark.createDataFrame(
        [(a, b) for a, b in enumerate(aligner.same.tolist())], "key long, b long"
    )
    pairs = ones.join(F.broadcast(same), "key").select(F.col("key").alias("a"), "b", "docs")
    other = counted.select(
        F.shiftright("key", 20).alias("a"), (F.col("key") % PAIR).alias("b"), "docs"
    )
    return Alignment(documents, pairs.union(other))


def _vector(counts: DataFrame, size: int) -> np.ndarray:
    rows = counts.select("key", "docs").toArrow()
    out = np.zeros(size, np.int64)
    out[rows["key"].to_numpy()] = rows["docs"].to_numpy()
    return out


def _finished(row: dict, of_one: np.ndarray, highest: np.ndarray, id_col: str) -> pa.RecordBatch:
    """The rows of a chunk's documents, from the corpus-wide counts of its links."""
    documents = _columns(row["documents"].as_py())
    ones, pairs = row["ones"].values.to_numpy(), row["pairs"].values.to_numpy()
    counts = np.zeros(len(pairs), np.int64)
    if row["counts"].is_valid:
        found = row["counts"].values
        counts[found.field("at").to_numpy()] = found.field("docs").to_numpy()
    n_best = np.zeros(documents.num_rows, np.int64)
    total = np.zeros(documents.num_rows, np.int64)
    for name, docs, first in (
        ("one", of_one[ones], ones),
        ("pair", counts, pairs // PAIR),
    ):
        links = _columns(row[f"{name}_links"].as_py())
        at, times = links.column("key").to_numpy(), links.column("n").to_numpy()
        bounds = np.concatenate([[0], np.cumsum(documents.column(f"{name}s").to_numpy())])
        top = docs == highest[first]
        n_best += np.diff(np.concatenate([[0], np.cumsum(times * top[at])])[bounds])
        total += np.diff(np.concatenate([[0], np.cumsum(times * docs[at])])[bounds])
    names = ["doc", "n_a", "n_b", "n_groups", "n_links"]
    return pa.RecordBatch.from_arrays(
        [
            *[documents.column(n) for n in names],
            pa.array(n_best),
            pa.array(total),
            documents.column("groups_sha256"),
        ],
        [id_col, *names[1:], "n_best", "count_sum", "groups_sha256"],
    )
