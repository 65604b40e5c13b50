"""Byte-level BPE encoding and decoding: speculate, verify, repair.

A merge list defines one segmentation of a word. Greedy longest match proposes
a segmentation; it is the right one exactly if every adjacent pair of its
tokens is compatible, that is, if merging the bytes of the two tokens alone
gives these two tokens again. Compatibility is decided for all pairs of a batch
at once by undoing merges in step (see :meth:`Vocabulary.compatible`). Only
words with an incompatible pair are merged rank by rank.

Words are segmented when a task meets them and kept in tables of bounded size.

Defined cases: a null text is encoded like an empty one (no tokens); a special
token's string becomes its id, as in the tokenizer file; every text of any
length is encoded whole; repeated rows are encoded alike; an empty table gives
an empty table; an existing column with the name of the result is replaced.
A null id array decodes to an empty text, ids outside the vocabulary are an error.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from textmine.llm.common import give_back, giving_back
from textmine.llm.fragments import cut, text_pieces

# Fixed value: the pattern that cuts a text into words before merging.
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: Chunks, and bytes of chunks and ids, in a worker's table. A full table becomes the old one,
#: from which chunks that are met again are taken over; the old one before it is dropped.
KEPT_CHUNKS = 100_000
KEPT_BYTES = 8 << 20
#: Chunks in a worker's table of sizes, and bytes of text whose tokens are counted at once.
KEPT_SIZES = 200_000
COUNT_BYTES = 4 << 20
#: The size of a chunk that has white space beside its space: its text is cut whole.
_RAGGED = 1 << 40
#: Longer words are segmented one by one, as their many steps would hold up a batch.
BATCH_WORD_BYTES = 64


def _byte_letters() -> dict[str, int]:
    """The letter by which a tokenizer file writes each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _packed_ids(ids: np.ndarray) -> bytes:
    return ids.astype(np.int32).tobytes()


def _tokens(content: bytes) -> tuple[dict[bytes, int], dict[str, int]]:
    """(ids of tokens, ids of special tokens) of a tokenizer.json or of a file of base64 ranks."""
    if content.lstrip()[:1] == b"{":
        spec = json.loads(content)
        letters = _byte_letters()
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        tokens = {
            bytes(letters[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if token not in added
        }
        return tokens, added
    lines = (line.split() for line in content.splitlines() if line.strip())
    return {base64.b64decode(a): int(b) for a, b in lines}, {}


def _bytes_by_id(tokens: dict[bytes, int], special: dict[str, int]) -> list[bytes]:
    out = [b""] * (max([*tokens.values(), *special.values()]) + 1)
    for token, i in tokens.items():
        out[i] = token
    for token, i in special.items():
        out[i] = token.encode()
    return out


class Vocabulary:
    """Token bytes by id; an id is higher than those of the tokens merged into it."""

    def __init__(self, tokens: dict[bytes, int], special: dict[str, int]):
        self.ids = tokens
        self.special = special
        self.bytes = _bytes_by_id(tokens, special)
        self.size = len(self.bytes)
        self.longest = max(map(len, tokens))
        self._find_merges()
        self._build_trie()
        self.special_pattern = (
            regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))))
            if special
            else None
        )

    @classmethod
    def parse(cls, content: bytes) -> Vocabulary:
        """From the content of a tokenizer.json or of a file of base64 ranks."""
        return cls(*_tokens(content))

    def merge(self, word: bytes, below: int | None = None) -> list[int]:
        """Exact merging: the adjacent pair with the lowest id first, leftmost first."""
        ids, limit = self.ids, self.size if below is None else below
        if len(word) > BATCH_WORD_BYTES and below is None:
            return self._merge_long(word)
        parts = [word[i : i + 1] for i in range(len(word))]
        ranks = [ids.get(a + b, limit) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best >= limit:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = ids.get(parts[at] + parts[at + 1], limit)
            if at:
                ranks[at - 1] = ids.get(parts[at - 1] + parts[at], limit)
        return [ids[p] for p in parts]

    def _merge_long(self, word: bytes) -> list[int]:
        """The same for long words: pairs wait in a heap, and stale ones are passed over.

        A part is known by its first byte, and ``end`` says where it ends; a waiting
        pair is its rank and its first byte, as one number.
        """
        ids, n = self.ids, len(word)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        get = ids.get
        ranks = (get(word[i : i + 2]) for i in range(n - 1))
        waiting = [rank * n + i for i, rank in enumerate(ranks) if rank is not None]
        heapify(waiting)
        while waiting:
            rank, i = divmod(heappop(waiting), n)
            middle = end[i]
            if middle <= 0 or middle == n or get(word[i : end[middle]]) != rank:
                continue
            stop = end[i] = end[middle]
            end[middle] = 0  # no part any more
            if stop < n:
                before[stop] = i
                rank = get(word[i : end[stop]])
                if rank is not None:
                    heappush(waiting, rank * n + i)
            left = before[i]
            if left >= 0:
                rank = get(word[left:stop])
                if rank is not None:
                    heappush(waiting, rank * n + left)
        out, i = [], 0
        while i < n:
            out.append(ids[word[i : end[i]]])
            i = end[i]
        return out

    def _find_merges(self) -> None:
        """The two tokens each token was merged from, and the table of merges."""
        self.left = np.arange(self.size, dtype=np.int64)
        self.right = np.arange(self.size, dtype=np.int64)
        keys, merged = [], []
        for token, i in self.ids.items():
            if len(token) > 1:
                pair = self.merge(token, below=i)
                if len(pair) == 2:
                    self.left[i], self.right[i] = pair
                    keys.append(pair[0] * self.size + pair[1])
                    merged.append(i)
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.array(keys, np.int64)[order]
        self.pair_ids = np.array(merged, np.int64)[order]

    def _merged(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The token that two tokens merge into, or ``size`` if there is none."""
        key = first * self.size + second
        slot = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[slot] == key, self.pair_ids[slot], self.size)

    def _build_trie(self) -> None:
        """Transitions (state * 256 + byte -> state) as sorted arrays; state 0 is the root."""
        edges: dict[int, int] = {}
        accepts = [-1]
        for token, i in self.ids.items():
            state = 0
            for byte in token:
                key = state * 256 + byte
                if key not in edges:
                    edges[key] = len(accepts)
                    accepts.append(-1)
                state = edges[key]
            accepts[state] = i
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self.edge_keys = keys[order]
        self.edge_to = np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.accepts = np.array(accepts, np.int64)

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether merging their bytes gives them again.

        All pairs step together: the merge that came last on either side of the
        seam is undone, until both sides are single bytes. If at any time the
        two tokens at the seam have a merge that comes before the last undone
        one, merging would have crossed the seam.
        """
        n = len(first)
        ok = np.ones(n, bool)
        at = np.arange(n)
        a, b = first.astype(np.int64), second.astype(np.int64)
        limit = np.full(n, np.iinfo(np.int64).max)
        while len(at):
            merged = self._merged(a, b)
            crossing = (merged < self.size) & (merged < limit)
            ok[at[crossing]] = False
            splits_a, splits_b = self.right[a] != a, self.left[b] != b
            # The later merge is undone first; merges of equal rank run from the left.
            undo_a = splits_a & (~splits_b | (a > b))
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            go = ~crossing & (splits_a | splits_b)
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return ok

    def propose(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Greedy longest match for all words in step: (word number, token id) in word order."""
        word, token, place = [], [], []
        active, at = np.arange(len(start)), start.copy()
        while len(active):
            state = np.zeros(len(active), np.int64)
            best, best_end = np.full(len(active), -1, np.int64), at.copy()
            walk, here = np.arange(len(active)), at.copy()
            stop = end[active]
            while len(walk):
                key = state * 256 + data[here]
                slot = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
                found = self.edge_keys[slot] == key
                walk, state, here = walk[found], self.edge_to[slot[found]], here[found] + 1
                accepted = self.accepts[state]
                hit = accepted >= 0
                best[walk[hit]], best_end[walk[hit]] = accepted[hit], here[hit]
                more = here < stop[walk]
                walk, state, here = walk[more], state[more], here[more]
            word.append(active)
            token.append(best)
            place.append(at)
            more = best_end < stop
            active, at = active[more], best_end[more]
        word, token = np.concatenate(word), np.concatenate(token)
        order = np.argsort(np.concatenate(place), kind="stable")
        return word[order], token[order]

    def greedy(self, word: bytes, block: int = 1 << 16) -> list[int]:
        """Greedy longest match of one word, from the longest token at each of its places."""
        data = np.frombuffer(word, np.uint8)
        out, at = [], 0
        for first in range(0, len(word), block):
            walk = np.arange(first, min(first + block, len(word)))
            token = np.full(len(walk), -1, np.int64)
            size = np.zeros(len(walk), np.int64)
            state, depth = np.zeros(len(walk), np.int64), 0
            while len(walk):
                key = state * 256 + data[walk + depth]
                slot = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
                found = self.edge_keys[slot] == key
                walk, state = walk[found], self.edge_to[slot[found]]
                depth += 1
                accepted = self.accepts[state]
                hit = accepted >= 0
                token[walk[hit] - first], size[walk[hit] - first] = accepted[hit], depth
                more = walk + depth < len(word)
                walk, state = walk[more], state[more]
            token, size = token.tolist(), size.tolist()
            while at - first < len(token):
                out.append(token[at - first])
                at += size[at - first]
        return out

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Exact merging of many short words in step, one merge a word at a time; packed ids."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out: list[bytes] = [b""] * len(words)
        for size in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == size)
            flat = np.frombuffer(b"".join(words[i] for i in rows), np.uint8)
            parts = self.of_byte[flat].reshape(len(rows), size)
            ranks = self._merged(parts[:, :-1], parts[:, 1:])
            while len(rows):
                width = ranks.shape[1]
                best = ranks.argmin(1) if width else np.zeros(len(rows), np.int64)
                line = np.arange(len(rows))
                value = ranks[line, best] if width else np.full(len(rows), self.size)
                done = value >= self.size
                ids, span = _packed_ids(parts[done]), 4 * (width + 1)
                for at, i in enumerate(rows[done].tolist()):
                    out[i] = ids[at * span : (at + 1) * span]
                go = ~done
                rows, parts, ranks = rows[go], parts[go], ranks[go]
                best, value, line = best[go], value[go], np.arange(len(rows))
                if not len(rows):
                    break
                parts[line, best] = value
                columns = np.arange(width)[None, :]
                parts = np.take_along_axis(parts, columns + (columns > best[:, None]), 1)
                columns = columns[:, : width - 1]
                ranks = np.take_along_axis(ranks, columns + (columns >= best[:, None]), 1)
                for side in (best - 1, best):
                    there = np.flatnonzero((side >= 0) & (side < width - 1))
                    x, y = line[there], side[there]
                    ranks[x, y] = self._merged(parts[x, y], parts[x, y + 1])
        return out

    def segment(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word: proposed, verified, and merged exactly where that failed."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        short = np.flatnonzero((lengths <= BATCH_WORD_BYTES) & (lengths > 0))
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            data = np.frombuffer(b"".join(words[i] for i in part), np.uint8)
            end = np.cumsum(lengths[part])
            owner, token = self.propose(data, end - lengths[part], end)
            failing = self._failing(owner, token)
            bounds = (4 * np.searchsorted(owner, np.arange(len(part) + 1))).tolist()
            tokens = _packed_ids(token)
            for i, a, b in zip(part.tolist(), bounds, bounds[1:], strict=False):
                out[i] = tokens[a:b]
            redo = part[failing].tolist()
            for i, ids in zip(redo, self.merge_many([words[i] for i in redo]), strict=True):
                out[i] = ids
        for i in np.flatnonzero(lengths > BATCH_WORD_BYTES).tolist():
            ids = np.array(self.greedy(words[i]), np.int64)
            right = not len(self._failing(np.zeros(len(ids), np.int64), ids))
            out[i] = _packed_ids(ids if right else np.array(self.merge(words[i])))
        return out

    def _failing(self, owner: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The owners of token runs with an incompatible pair."""
        seam = np.flatnonzero(owner[:-1] == owner[1:])
        keys, back = np.unique(token[seam] * self.size + token[seam + 1], return_inverse=True)
        good = self.compatible(keys // self.size, keys % self.size)[back]
        return np.unique(owner[seam[~good]])


class Decoder:
    """Token ids to texts, by the bytes of each token alone."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.places = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        total = int(ends[-1])
        data = self.pool[np.repeat(self.places[ids] - ends[:-1], sizes) + np.arange(total)]
        cuts = ends[offsets].tolist()
        whole = data.tobytes()
        return [
            whole[a:b].decode("utf-8", errors="replace")
            for a, b in zip(cuts, cuts[1:], strict=False)
        ]

class Encoder:
    """Texts to token ids, with a bounded table of chunks that are segmented already.

    A chunk is what stands between single spaces. A space between two characters
    that are no white space always opens a word, so chunks can be cut
    independently; texts with other white space beside a space are cut whole.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_chunks: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.held = 0
        self.sizes: dict[str, int] = {}
        self.old_sizes: dict[str, int] = {}
        self.find = regex.compile(WORD_PATTERN).findall
        self.ragged = re.compile(r"\s | \s|^ | $").search
        self.decoder = Decoder(vocabulary.bytes)

    def _cut(self, text: str) -> list[str]:
        """Keys of the chunk table; a chunk after a space has the space as its first letter."""
        if self.ragged(text):
            return self.find(text)
        return text.replace(" ", "\0 ").split("\0") if "\0" not in text else self.find(text)

    def _turn(self) -> None:
        """Make full tables the old ones; special tokens stay in the new one."""
        special = {k: v for k, v in self.chunks.items() if k[:1] == "\0" and len(k) > 1}
        self.old_chunks, self.chunks = self.chunks, special
        self.old_words, self.words = self.words, {}
        self.held = 0

    @staticmethod
    def _missing(needed: set[str], known: dict[str, bytes], old: dict[str, bytes]) -> list[str]:
        """What neither table has; what only the old one has is taken over."""
        needed = needed.difference(known)
        again = {key for key in needed if key in old}
        known.update((key, old[key]) for key in again)
        return list(needed - again)

    def _words(self, chunks: list[str]) -> list[list[str]]:
        # Plain letters after at most one space are a single word.
        return [[c] if c.isascii() and c.lstrip(" ").isalpha() else self.find(c) for c in chunks]

    def _learn(self, chunks: list[str]) -> None:
        split = self._words(chunks)
        new = self._missing(set(chain.from_iterable(split)), self.words, self.old_words)
        self.words.update(
            zip(new, self.vocabulary.segment([w.encode() for w in new]), strict=True)
        )
        get = self.words.__getitem__
        learned = [get(w[0]) if len(w) == 1 else b"".join(map(get, w)) for w in split]
        self.chunks.update(zip(chunks, learned, strict=True))
        self.held += sum(map(len, chunks)) + sum(map(len, learned))

    def _packed(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text as the bytes of 32-bit integers."""
        special = self.vocabulary.special_pattern
        cut: list[list[str]] = []
        for text in texts:
            text = text or ""
            if special is None or not special.search(text):
                cut.append(self._cut(text) if text else [])
                continue
            keys: list[str] = []
            at = 0
            for hit in special.finditer(text):
                keys += self.find(text[at : hit.start()])
                key = "\0" + hit[0]  # never a chunk: a text with a NUL is cut into words
                self.chunks[key] = np.int32(self.vocabulary.special[hit[0]]).tobytes()
                keys.append(key)
                at = hit.end()
            cut.append(keys + self.find(text[at:]))
        if max(len(self.chunks), len(self.words)) > KEPT_CHUNKS or self.held > KEPT_BYTES:
            self._turn()
        known = self.chunks
        new = self._missing(set(chain.from_iterable(cut)), known, self.old_chunks)
        if new:
            self._learn(new)
        get = known.__getitem__
        return (b"".join(map(get, keys)) for keys in cut)

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids)."""
        packed = list(self._packed(texts))
        offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])])
        return np.frombuffer(b"".join(packed), np.int32), offsets.astype(np.int64)

    def _sizes(self, chunks: list[str]) -> np.ndarray:
        """How many ids each chunk or word has, ``_RAGGED`` for a chunk that cannot stand alone."""
        if len(self.sizes) > KEPT_SIZES:
            self.old_sizes, self.sizes = self.sizes, {}
        known, old = self.sizes, self.old_sizes
        missing = set(chunks).difference(known)
        again = {key for key in missing if key in old}
        known.update((key, old[key]) for key in again)
        missing -= again
        ragged = [c for c in missing if c[:1] == " " and (c == " " or len(c.strip()) < len(c) - 1)]
        known.update(dict.fromkeys(ragged, _RAGGED))
        new = list(missing.difference(ragged))
        split = self._words(new)
        words = list(set(chain.from_iterable(split)).difference(known))
        known.update(
            (w, len(ids) // 4)
            for w, ids in zip(
                words, self.vocabulary.segment([w.encode() for w in words]), strict=True
            )
        )
        get = known.__getitem__
        known.update((c, sum(map(get, w))) for c, w in zip(new, split, strict=True) if len(w) != 1)
        return np.fromiter(map(get, chunks), np.int64, len(chunks))

    def count(self, texts: pa.Array | Iterable[str | None]) -> np.ndarray:
        """How many ids each text has.

        Chunks between single spaces are told apart by array operations, so each distinct
        one is looked up once. The first and the last one of a text may have white space
        where others may not; a text with special tokens is encoded.
        """
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        which, distinct, offsets = cut(texts)
        after_space = pc.binary_join_element_wise("", distinct, " ")
        each = self._sizes(after_space.to_numpy(zero_copy_only=False).tolist())[which]
        first, last = offsets[:-1], offsets[1:] - 1
        each[first] = each[last] = 0
        sums = np.concatenate([[0], np.cumsum(each)])
        total = sums[offsets[1:]] - sums[offsets[:-1]]
        heads = distinct.take(pa.array(which[first])).to_pylist()
        total += self._sizes(heads)
        several = np.flatnonzero(last > first)
        tails = distinct.take(pa.array(which[last[several]])).to_pylist()
        stems = [tail.rstrip("\n\r\t") for tail in tails]  # white space at the end is one word
        total[several] += self._sizes([f" {stem}" for stem in stems])
        total[several] += self._sizes([t[len(s) :] for t, s in zip(tails, stems, strict=True)])
        whole = total >= _RAGGED
        for i in several.tolist():
            whole[i] |= not heads[i] or heads[i][-1].isspace()
        for special in self.vocabulary.special:
            whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        if whole.any():
            packed = self._packed(texts.filter(pa.array(whole)).to_pylist())
            total[whole] = [len(p) // 4 for p in packed]
        return total

    def forget(self) -> None:
        """Give back the tables, as another stage may follow in the same worker."""
        self.chunks, self.words, self.old_chunks, self.old_words = {}, {}, {}, {}
        self.sizes, self.old_sizes = {}, {}
        self.held = 0
        give_back()

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        return self.decoder.decode(ids, offsets)


_encoders: dict[tuple, Encoder] = {}
_decoders: dict[tuple, Decoder] = {}


def encoder(content: Broadcast) -> Encoder:
    """The worker's encoder for a vocabulary file's content; at most two are kept."""
    return _kept(_encoders, content, lambda: Encoder(Vocabulary.parse(content.value)))


def decoder(content: Broadcast) -> Decoder:
    """The worker's decoder, which needs no merges; at most two are kept."""
    return _kept(_decoders, content, lambda: Decoder(_bytes_by_id(*_tokens(content.value))))


def _kept(table: dict, content: Broadcast, load: Callable):
    key = (len(content.value), hash(content.value))
    if key not in table:
        while len(table) > 1:
            table.pop(next(iter(table)))
        table[key] = load()
        give_back()
    return table[key]


def share(df: DataFrame, vocabulary: str) -> Broadcast:
    """The vocabulary file's content for all executors; such files have a few megabytes."""
    with open(vocabulary, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _with(df: DataFrame, name: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    rest = df.drop(name)
    return rest, T.StructType([*rest.schema.fields, T.StructField(name, kind)])


def encode(
    df: DataFrame, vocabulary: str, *, text: str = "text", ids: str = "token_ids"
) -> DataFrame:
    """``df`` with an array of token ids per text. ``vocabulary`` is a file's path."""
    rest, schema = _with(df, ids, T.ArrayType(T.IntegerType()))
    content = share(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(content)
        for batch in batches:
            for part in _slices(batch, 500):
                found, offsets = own.encode(part.column(text).to_pylist())
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, column], [*part.schema.names, ids]
                )
        own.forget()

    return rest.mapInArrow(run, schema)


def count_tokens(
    df: DataFrame, vocabularies: dict[str, str], *, text: str = "text", asked: str | None = None
) -> DataFrame:
    """``df`` without its texts, with a count of tokens per vocabulary.

    ``vocabularies`` has a file for each new column. The first counts every text; with
    ``asked``, a boolean column, the others count only where it is true and are null
    elsewhere.
    """
    rest = df.drop(text, *vocabularies)
    new = [T.StructField(name, T.LongType()) for name in vocabularies]
    schema = T.StructType([*rest.schema.fields, *new])
    contents = [share(df, path) for path in vocabularies.values()]
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [encoder(content) for content in contents]
        for batch in batches:
            for first, texts in text_pieces(batch.column(text), COUNT_BYTES):
                part = batch.slice(first, len(texts))
                columns = [part.column(name) for name in names]
                for i, one in enumerate(own):
                    if asked is None or not i:
                        columns.append(pa.array(one.count(texts)))
                        continue
                    flags = part.column(asked).fill_null(False)
                    where = flags.to_numpy(zero_copy_only=False)
                    counts = np.zeros(len(where), np.int64)
                    if where.any():
                        counts[where] = one.count(texts.filter(flags))
                    columns.append(pa.array(counts, mask=~where))
                yield pa.RecordBatch.from_arrays(columns, [*names, *vocabularies])
        for one in own:
            one.forget()

    kept = [text, *names] if text not in names else names
    return df.select(*kept).mapInArrow(run, schema)


def decode(
    df: DataFrame, vocabulary: str, *, ids: str = "token_ids", text: str = "decoded"
) -> DataFrame:
    """``df`` with the text that its token ids stand for; bad UTF-8 becomes U+FFFD."""
    rest, schema = _with(df, text, T.StringType())
    content = share(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(content)
        for batch in batches:
            for part in _slices(batch, 500):
                lists = part.column(ids)
                if lists.null_count:
                    lists = lists.fill_null([])
                offsets = lists.offsets.to_numpy()
                values = lists.values.to_numpy()[offsets[0] : offsets[-1]]
                texts = own.decode(values, offsets - offsets[0])
                column = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, column], [*part.schema.names, text]
                )

    return rest.mapInArrow(giving_back(run), schema)
