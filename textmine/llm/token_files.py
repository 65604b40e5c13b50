"""Token ids as binary files of patched frame-of-reference blocks.

The ids of all documents, each closed by an end id, form one stream in ascending order of
the document ids. It is cut into blocks. A block stores its smallest id and the distance
of every id from it, packed at the width that holds a given percentage of the distances;
the high bits of the others (the patches) stand in an exception list behind the packed
bits. A segment holds the blocks of whole documents, an index of the documents and an
index of where each block starts, so a document is read by decoding its blocks only.

Segments are the rows of a Parquet table (column ``payload``; part and segment number, and
how many ids of the part stand before it). So the files can lie in any store that Spark
reaches, and a task that is run again leaves no half-written file.

Rows are dealt by ranges of the document id, a part each; their bounds come from the id
column alone, so texts are encoded once and their ids move once. Equal ids, also null
ones, are ordered by a checksum of their tokens and dealt over several ranges if there are
many. Where a part begins in the stream follows from one sum per part.

Defined cases: a null text is an empty one, which has the end id alone; a special token's
string becomes its id, as in the tokenizer file; null document ids come first; repeated
rows are kept, each with its own place; texts of any length are encoded whole and stay in
one segment; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmine.llm.common import bound_batches, give_back
from textmine.llm.fragments import (
    KEPT_FRAGMENTS,
    cut,
    gather,
    load_tokenizer,
    loaded,
    share_file,
    text_pieces,
)

#: Ids in a block; the percentage of them that the packed width holds.
BLOCK, PERCENT = 512, 90
#: Ids and documents after which a segment is closed.
SEGMENT_IDS, SEGMENT_DOCS = 1 << 18, 1 << 16
#: Bytes of text that are encoded at once; a longer single text is a piece of its own.
CUT_BYTES = 1 << 20
#: Characters and bytes of ids that a worker's tables keep between pieces of text. Tables that
#: hold half of it, or half of the units, become the old ones, from which units that are met
#: again are taken over; the old ones before them are dropped.
KEPT_BYTES = 4 << 20
#: First bytes of a segment, which name its format.
MAGIC = b"PFR1"

_HEADER = struct.Struct("<4sIQII")  # magic, documents, ids, blocks, checksum of the rest
_BLOCK = struct.Struct("<IBH")  # smallest id, width, exceptions


# ---- blocks


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width``-bit numbers as rows of bytes, lowest bit first."""
    bits = (values[:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(
        bits.astype(np.uint8).reshape(len(values), -1), axis=1, bitorder="little"
    )


def _unpack_bits(packed: np.ndarray, width: int, count: int) -> np.ndarray:
    bits = np.unpackbits(packed, axis=1, count=count * width, bitorder="little")
    bits = bits.reshape(len(packed), count, width)
    values = np.zeros((len(packed), count), np.uint32)
    for i in range(width):
        values |= bits[:, :, i].astype(np.uint32) << np.uint32(i)
    return values


def pack_blocks(ids: np.ndarray, percent: int = PERCENT) -> tuple[bytes, np.ndarray]:
    """(bytes of all blocks, where each block starts) of unsigned 32-bit ids."""
    n_blocks = -(-len(ids) // BLOCK)
    starts = np.zeros(n_blocks + 1, np.uint64)
    out: list[bytes] = []
    at = 0
    for first in range(0, n_blocks, 256):
        part = ids[first * BLOCK : (first + 256) * BLOCK].astype(np.uint32)
        tail = -len(part) % BLOCK
        rows = np.pad(part, (0, tail), mode="edge").reshape(-1, BLOCK)
        low = rows.min(1)
        away = rows - low[:, None]
        kth = min(BLOCK - 1, BLOCK * percent // 100)
        near = np.partition(away, kth, axis=1)[:, kth]
        width = np.frexp(near.astype(np.float64))[1]  # bits of the number, 0 for 0
        packed: list[bytes] = [b""] * len(rows)
        for w in np.unique(width).tolist():
            which = np.flatnonzero(width == w)
            if w:
                bits = _pack_bits(away[which] & np.uint32((1 << w) - 1), w)
                for i, row in zip(which.tolist(), bits, strict=True):
                    packed[i] = row.tobytes()
        high = away.astype(np.uint64) >> width[:, None].astype(np.uint64)
        row_of, place = np.nonzero(high)
        bounds = np.searchsorted(row_of, np.arange(len(rows) + 1))
        for i in range(len(rows)):
            a, b = bounds[i], bounds[i + 1]
            block = (
                _BLOCK.pack(int(low[i]), int(width[i]), int(b - a))
                + packed[i]
                + place[a:b].astype("<u2").tobytes()
                + high[i, place[a:b]].astype("<u4").tobytes()
            )
            out.append(block)
            starts[first + i] = at
            at += len(block)
    starts[n_blocks] = at
    return b"".join(out), starts


def unpack_blocks(data: bytes, starts: np.ndarray, first: int, last: int) -> np.ndarray:
    """The ids of the blocks ``first`` to ``last - 1``; the last block of a stream is padded."""
    rows = np.zeros((last - first, BLOCK), np.uint32)
    heads = [_BLOCK.unpack_from(data, int(s)) for s in starts[first:last]]
    width = np.array([h[1] for h in heads], np.int64)
    body = starts[first:last].astype(np.int64) + _BLOCK.size
    raw = np.frombuffer(data, np.uint8)
    for w in np.unique(width).tolist():
        which = np.flatnonzero(width == w)
        if w:
            take = body[which, None] + np.arange(BLOCK * w // 8)
            rows[which] = _unpack_bits(raw[take], w, BLOCK)
    for i, (low, w, n) in enumerate(heads):
        if n:
            at = int(body[i]) + BLOCK * w // 8
            place = np.frombuffer(data, "<u2", n, at)
            high = np.frombuffer(data, "<u4", n, at + 2 * n)
            rows[i, place] |= high << np.uint32(w)
        rows[i] += np.uint32(low)
    return rows.ravel()


# ---- segments


def encode_segment(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment of documents: their ids, how many token ids each has, and these ids."""
    blocks, starts = pack_blocks(ids)
    known = np.array([i is not None for i in doc_ids], np.uint8)
    names = np.array([i or 0 for i in doc_ids], "<i8")
    body = b"".join(
        (
            names.tobytes(),
            known.tobytes(),
            sizes.astype("<u4").tobytes(),
            starts.astype("<u8").tobytes(),
            blocks,
        )
    )
    head = _HEADER.pack(MAGIC, len(doc_ids), len(ids), len(starts) - 1, zlib.crc32(body))
    return head + body


class Segment:
    """A segment's indexes; ids are decoded when they are asked for."""

    def __init__(self, payload: bytes):
        magic, docs, self.n_ids, blocks, check = _HEADER.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        if zlib.crc32(memoryview(payload)[_HEADER.size :]) != check:
            raise ValueError("a segment's checksum is wrong")
        at = _HEADER.size
        names = np.frombuffer(payload, "<i8", docs, at)
        at += 8 * docs
        known = np.frombuffer(payload, np.uint8, docs, at).astype(bool)
        at += docs
        self.doc_ids = pa.array(names, pa.int64(), mask=~known)
        sizes = np.frombuffer(payload, "<u4", docs, at).astype(np.int64)
        at += 4 * docs
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.starts = np.frombuffer(payload, "<u8", blocks + 1, at)
        self.blocks = payload[at + 8 * (blocks + 1) :]

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The token ids of the documents ``first`` to ``last - 1``."""
        a = int(self.bounds[first])
        b = int(self.bounds[len(self.doc_ids) if last is None else last])
        low, high = a // BLOCK, -(-b // BLOCK)
        return unpack_blocks(self.blocks, self.starts, low, high)[a - low * BLOCK : b - low * BLOCK]


# ---- texts to files and back


#: Letters before ASCII punctuation and symbols. Letters that lower-casing makes two are left
#: out, and so is the apostrophe, which the tokenizer may leave with letters.
_WORD = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-įı-ɏ]+)(?P<close>[!-&(-/:-@\[-`{-~]*)$"
#: Words that the library is given in one text.
_TOGETHER = 256


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class _Ids:
    """Token ids of texts by a tokenizer that lower-cases, drops white space and marks word ends.

    A fragment of letters and punctuation behind them is a word and a mark, which the tokenizer
    cuts apart as well; others are units of their own. Units are found by array operations,
    and only those that the worker has not met go to the library.
    """

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.encode_batch = tokenizer.encode_batch_fast
        # The same model without the steps that leave lower-case words of letters as they are.
        bare = Tokenizer(tokenizer.model)
        bare.pre_tokenizer = Sequence(
            [WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.encode_words = bare.encode_batch_fast
        size = tokenizer.get_vocab_size()
        self.closes = np.array([tokenizer.id_to_token(i).endswith("</w>") for i in range(size)])
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self._empty()

    def _empty(self) -> None:
        self.words: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_others: dict[str, bytes] = {}
        self.held = 0

    def _single(self, texts: list[str]) -> list[bytes]:
        found = self.encode_batch(texts, add_special_tokens=False)
        return [np.array(one.ids, self.kind).tobytes() for one in found]

    def _together(self, words: list[str]) -> list[bytes]:
        """Words of letters only are encoded many in one text, and parted where a word ends."""
        parts = [words[i : i + _TOGETHER] for i in range(0, len(words), _TOGETHER)]
        found = self.encode_words([" ".join(p).lower() for p in parts], add_special_tokens=False)
        width = self.kind.itemsize
        out: list[bytes] = []
        for part, one in zip(parts, found, strict=True):
            ids = np.array(one.ids, self.kind)
            ends = ((np.flatnonzero(self.closes[ids]) + 1) * width).tolist()
            if len(ends) == len(part):
                raw = ids.tobytes()
                out += [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)]
            else:
                out += self._single(part)
        return out

    def forget(self) -> None:
        """Give back the tables, as another stage may follow in the same worker."""
        self._empty()
        give_back()

    def _known(
        self, table: dict[str, bytes], old: dict[str, bytes], units: list[str], encode
    ) -> list[bytes]:
        found = list(map(table.get, units))
        missing = [i for i, ids in enumerate(found) if ids is None]
        learned = [units[i] for i in missing]
        made = list(map(old.get, learned))
        new = [i for i, ids in enumerate(made) if ids is None]
        for i, ids in zip(new, encode([learned[i] for i in new]), strict=True):
            made[i] = ids
        for i, ids in zip(missing, made, strict=True):
            found[i] = ids
        table.update(zip(learned, made, strict=True))
        self.held += sum(map(len, learned)) + sum(map(len, made))
        return found

    def _bound(self) -> None:
        """Age the tables where one has too many units, or both too many bytes."""
        units = max(len(self.words), len(self.others))
        if units > KEPT_FRAGMENTS // 2 or self.held > KEPT_BYTES // 2:
            self.old_words, self.words = self.words, {}
            self.old_others, self.others = self.others, {}
            self.held = 0

    def encode(self, texts: pa.Array, end: int) -> list[bytes]:
        """The ids of each text and the end id, as unsigned integers of the vocabulary's width."""
        which, fragments, offsets = cut(pc.replace_substring(texts, "\n", " "))
        parted = pc.extract_regex(fragments, _WORD)
        plain = parted.is_valid().to_numpy(zero_copy_only=False)
        parted = parted.drop_null()
        words = pc.ascii_lower(pc.struct_field(parted, "word")).dictionary_encode()
        marks = pc.struct_field(parted, "close").dictionary_encode()
        others = _strings(fragments.filter(pa.array(~plain)))
        shorts = _strings(marks.dictionary)
        units = [
            *self._known(
                self.words, self.old_words, _strings(words.dictionary), self._together
            ),
            *self._known(self.others, self.old_others, others, self._single),
            *self._known(self.others, self.old_others, shorts, self._single),
            b"",
        ]
        self._bound()
        n_words, n_others = len(words.dictionary), len(others)
        pair = np.full((len(fragments), 2), len(units) - 1, np.int32)
        pair[plain, 0] = words.indices.to_numpy()
        pair[plain, 1] = marks.indices.to_numpy() + (n_words + n_others)
        pair[~plain, 0] = n_words + np.arange(n_others)

        width = self.kind.itemsize
        sizes = np.fromiter(map(len, units), np.int64, len(units)) // width
        flat = np.frombuffer(b"".join(units), self.kind)
        ids, ends = gather(flat, np.cumsum(sizes) - sizes, sizes, pair[which].ravel())
        raw = ids.tobytes()
        close = np.array([end], self.kind).tobytes()
        bounds = (ends[2 * offsets] * width).tolist()
        return [raw[i:j] + close for i, j in zip(bounds, bounds[1:], strict=False)]


class _Ranges:
    """Ranges of document ids with about as many documents each, by cuts known beforehand.

    An id that many documents have stands in the cuts several times; its documents are
    then dealt over as many ranges by a checksum of their tokens, and so are null ids.
    """

    def __init__(self, cuts: list[int], nulls: int):
        self.cuts, self.nulls = np.array(cuts, np.int64), nulls

    def of(self, docs: pa.Array, ties: np.ndarray) -> np.ndarray:
        known = docs.is_valid().to_numpy(zero_copy_only=False)
        values = docs.fill_null(0).to_numpy()
        left = np.searchsorted(self.cuts, values, side="left")
        right = np.searchsorted(self.cuts, values, side="right")
        spread = np.maximum(right - left, 1)
        place = right - spread + 1 + ((ties * spread) >> 32)
        return np.where(known, self.nulls + place, (ties * self.nulls) >> 32)


def _ranges(plain: DataFrame) -> _Ranges:
    """As many ranges as the session's shuffles have parts, from the id column alone."""
    parts = int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    row = plain.agg(
        F.percentile_approx("doc", shares, 10_000).alias("cuts"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("doc").isNull()).alias("nulls"),
    ).head()
    return _Ranges(row["cuts"] or [], -(-parts * row["nulls"] // max(row["n"], 1)))


def token_bytes(
    df: DataFrame, vocabulary: str, *, id_col: str, text: str, end: int
) -> DataFrame:
    """``<range, doc, tie, width, ids>``: ids as unsigned integers of ``width`` bytes.

    Ranges follow each other as the documents do; ``tie`` is a checksum of the ids. The
    tokenizer must lower-case, drop white space and mark word ends by ``</w>``.
    """
    bound_batches(df.sparkSession)
    content = share_file(df.sparkSession, vocabulary)
    plain = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"))
    ranges = _ranges(plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded("ids", content, lambda data: _Ids(load_tokenizer(data)))
        for batch in batches:
            for first, texts in text_pieces(batch.column("text"), CUT_BYTES):
                ids = own.encode(texts, end)
                docs = batch.column("doc").slice(first, len(texts))
                ties = np.fromiter(map(zlib.crc32, ids), np.int64, len(ids))
                columns = {
                    "range": pa.array(ranges.of(docs, ties)),
                    "doc": docs,
                    "tie": pa.array(ties),
                    "width": pa.array(np.full(len(ids), own.kind.itemsize, np.int8)),
                    "ids": pa.array(ids, pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(columns)
        own.forget()

    return plain.mapInArrow(run, "range long, doc long, tie long, width byte, ids binary")


def pack(
    df: DataFrame,
    vocabulary: str,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    end: int = 1,
) -> DataFrame:
    """``<part, segment, before, docs, tokens, payload>``: the content of the files.

    ``before`` is how many ids of the same part stand before the segment. Parts follow
    each other in ascending order of the document ids. The bounds of the parts are
    looked up when this is called.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, segment = None, 0, 0
        docs: list[int | None] = []
        held: list[bytes] = []
        size = width = 0

        def close() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, held), np.int64, len(held)) // width
            ids = np.frombuffer(b"".join(held), f"<u{width}")
            payload = encode_segment(docs, sizes, ids)
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int64()),
                    "segment": pa.array([segment], pa.int32()),
                    "before": [before],
                    "docs": [len(docs)],
                    "tokens": [size],
                    "payload": pa.array([payload], pa.binary()),
                }
            )

        for batch in batches:
            width = batch.column("width")[0].as_py() if batch.num_rows else width
            names = (batch.column(n).to_pylist() for n in ("range", "doc"))
            for own, doc, ids in zip(*names, batch.column("ids"), strict=True):
                if own != part:
                    if docs:
                        yield close()
                    part, before, segment = own, 0, 0
                    docs, held, size = [], [], 0
                docs.append(doc)
                held.append(ids.as_py())
                size += len(held[-1]) // width
                if size >= SEGMENT_IDS or len(docs) >= SEGMENT_DOCS:
                    yield close()
                    before, segment = before + size, segment + 1
                    docs, held, size = [], [], 0
        if docs:
            yield close()

    ids = token_bytes(df, vocabulary, id_col=id_col, text=text, end=end)
    return (
        ids.repartition("range")
        .sortWithinPartitions("range", "doc", "tie", "ids")
        .drop("tie")
        .mapInArrow(
            run,
            "part long, segment int, before long, docs long, tokens long, payload binary",
        )
    )


def unpack(segments: DataFrame, *, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """``<doc_id, start, n_tokens, ids_crc32, token_ids>`` of every document in the segments.

    ``start`` counts the ids of all documents before it. ``with_ids=False`` leaves out
    the ids themselves.
    """
    # One row per part, of which there are as many as the write had tasks.
    spark = segments.sparkSession
    bound_batches(spark)
    sums = segments.groupBy("part").agg(F.sum("tokens").alias("all")).orderBy("part").collect()
    firsts = np.cumsum([0, *(r["all"] for r in sums)]).tolist()
    rows = [(r["part"], first) for r, first in zip(sums, firsts, strict=False)]
    parts = spark.createDataFrame(rows, "part long, first long")
    placed = segments.join(F.broadcast(parts), "part").select(
        (F.col("first") + F.col("before")).alias("start"), "payload"
    )
    names = [id_col, "start", "n_tokens", "ids_crc32"] + ["token_ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(
                batch.column("start").to_pylist(), batch.column("payload"), strict=True
            ):
                segment = Segment(payload.as_py())
                ids = segment.ids().astype("<u4", copy=False)
                bounds = segment.bounds
                raw, cuts = memoryview(ids.tobytes()), (bounds * 4).tolist()
                columns = [
                    segment.doc_ids,
                    pa.array(start + bounds[:-1]),
                    pa.array(np.diff(bounds)),
                    pa.array(
                        [zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)],
                        pa.int64(),
                    ),
                ]
                if with_ids:
                    columns.append(
                        pa.ListArray.from_arrays(
                            pa.array(bounds, pa.int32()), ids.astype(np.int64)
                        )
                    )
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long"
    return placed.mapInArrow(run, schema + ", token_ids array<long>" * with_ids)


def write_token_files(df: DataFrame, vocabulary: str, path: str, **options) -> None:
    """Encode the texts of ``df`` and write the files to a folder; see :func:`pack`."""
    pack(df, vocabulary, **options).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """The documents of a folder of token files; see :func:`unpack`."""
    return unpack(spark.read.parquet(path), **options)
