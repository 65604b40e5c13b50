"""Texts cut at single spaces, so that each distinct fragment is encoded once.

A worker keeps what a tokenizer library made of the fragments it has met, in a table of
bounded size; a text's tokens are then gathered with array operations.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import SparkSession

from textmine.llm.common import pieces, text_bytes

#: Fragments kept by a worker; the table starts anew when it is full.
KEPT_FRAGMENTS = 200_000
#: Bytes of text that are cut at once; a longer single text is a piece of its own.
CUT_BYTES = 8 << 20

_loaded: dict[tuple, Any] = {}


def share_file(spark: SparkSession, path: str) -> Broadcast:
    """A vocabulary file's content for all executors; such files have a few megabytes."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def loaded(kind: str, content: Broadcast, load: Callable[[bytes], Any]) -> Any:
    """What ``load`` makes of a shared file, once per worker; at most four are kept."""
    key = (kind, len(content.value), hash(content.value))
    if key not in _loaded:
        while len(_loaded) > 3:
            _loaded.pop(next(iter(_loaded)))
        _loaded[key] = load(content.value)
    return _loaded[key]


def load_tokenizer(content: bytes, plain_specials: bool = False):
    """A tokenizer of the tokenizers library; it uses one thread, as Spark deals the work."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(content)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = plain_specials
    return tokenizer


def text_pieces(column: pa.Array, limit: int = CUT_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(number of the first text, texts) in pieces of bounded size; a null is an empty text."""
    _, offsets = text_bytes(column)
    whole = column.cast(pa.string()).fill_null("")
    for first, last in pieces(offsets, limit):
        yield first, whole.slice(first, last - first)


def cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of each fragment's string, distinct strings, offsets of each text's fragments)."""
    lists = pc.split_pattern(texts, " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, offsets - offsets[0]


def gather(
    flat: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, which: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``flat``, one after the other, and where each begins."""
    length = sizes[which]
    ends = np.concatenate([[0], np.cumsum(length)])
    place = np.repeat(firsts[which] - ends[:-1], length)
    place += np.arange(ends[-1])
    return flat[place], ends
