"""Directional pair counts inside tasks: combined by chunks of lines, moved in packed blocks.

A chunk is as many lines as a task holds at once. Its words become ranks in the order of
its own vocabulary; the lines of one term after the other are paired, so equal pairs of a
chunk are one entry before anything moves, and memory is bounded by a slice of pairs. A
block holds the sorted entries of one part: its words, and ranks and counts in few bytes.
Blocks of a part are summed where they meet.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Pairs and words of a chunk, from which on it is closed.
PAIRS_PER_CHUNK, WORDS_PER_CHUNK = 1 << 27, 1 << 21
# Pairs expanded at once.
PAIRS_PER_SLICE = 1 << 21
# Entries held before they are dealt to parts, summed at once, and in a row that goes out.
ENTRIES_HELD, ENTRIES_PER_ROW, ROWS_PER_BATCH = 1 << 22, 4_096, 1 << 18
# Left-hand terms from 0 to this are all of a line's.
ALL = (1 << 31) - 1

_HEADER = struct.Struct("<4I5B")


class Chunk:
    """Lines of ``table`` (columns ``words``, ``at``, ``upto`` and keys) as ranks of words."""

    def __init__(self, table: pa.Table, keys: Sequence[str]):
        lists = table.column("words").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        flat = lists.flatten()
        line = np.repeat(np.arange(len(sizes)), sizes)
        if flat.null_count:
            valid = flat.is_valid()
            line, flat = line[valid.to_numpy(zero_copy_only=False)], flat.filter(valid)
        coded = flat.cast(pa.string()).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        self.vocabulary = coded.dictionary.take(order)
        self.width = width = max(1, len(order))
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        placed = np.sort(line * width + rank[coded.indices.to_numpy()])
        self.line, self.code = placed // width, placed % width
        self.sizes = np.bincount(self.line, minlength=len(sizes))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.group, self.groups = _grouped(table, keys)
        at, upto = (table.column(c).to_numpy().astype(np.int64) for c in ("at", "upto"))
        self.times = np.ones(len(sizes), np.int64)
        if (upto - at == ALL).all():
            self._count_copies()
        # The distinct terms of a line that are its own left-hand terms.
        first = np.concatenate([[True], placed[1:] != placed[:-1]]) if len(placed) else placed > 0
        posted = np.flatnonzero(first & (self.times[self.line] > 0))
        lines = self.line[posted]
        begins = np.searchsorted(lines, lines)
        place = np.arange(len(lines)) - begins
        posted = posted[(place >= at[lines]) & (place < upto[lines])]
        lines, terms = self.line[posted], self.code[posted]
        by_term = np.lexsort((terms, self.group[lines]))
        self.lines, self.terms = lines[by_term], terms[by_term]

    def _count_copies(self) -> None:
        """Equal lines of a group count in the first of them; the others count no times."""
        mixed = np.random.default_rng(7).integers(0, 1 << 63, (2, self.width), np.uint64)
        prints = []
        for row in mixed:
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(row[self.code])])
            prints.append(sums[self.starts + self.sizes] - sums[self.starts])
        order = np.lexsort((*prints, self.sizes, self.group))
        if not len(order):
            return
        new = np.zeros(len(order), bool)
        new[0] = True
        for column in (*prints, self.sizes, self.group):
            new[1:] |= column[order][1:] != column[order][:-1]
        model = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        copies, models = order[~new], model[~new]
        filled = self.sizes[copies] > 0
        copies, models = copies[filled], models[filled]
        if not len(copies):
            return
        # Prints tell where to look; the words decide.
        sizes = self.sizes[copies]
        step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        apart = self.code[np.repeat(self.starts[copies], sizes) + step] != self.code[np.repeat(self.starts[models], sizes) + step]
        equal = ~np.logical_or.reduceat(apart, np.cumsum(sizes) - sizes)
        self.times[copies[equal]] = 0
        np.add.at(self.times, models[equal], 1)

    def _expanded(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the postings ``low`` to ``high``: sizes of their lines, and all words of these."""
        lines = self.lines[low:high]
        sizes = self.sizes[lines]
        shift = self.starts[lines] - (np.cumsum(sizes) - sizes)
        return sizes, self.code[np.repeat(shift, sizes) + np.arange(sizes.sum())], self.times[lines]

    def entries(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(group, term, other, n) in this order, every triple once."""
        many = len(self.terms)
        if not many:
            return
        pairs = np.cumsum(self.sizes[self.lines])
        group = self.group[self.lines]
        new = np.concatenate([[True], (self.terms[1:] != self.terms[:-1]) | (group[1:] != group[:-1])])
        firsts = np.concatenate([np.flatnonzero(new), [many]])
        low = 0
        while low < many:
            done = pairs[low - 1] if low else 0
            reach = int(np.searchsorted(pairs, done + PAIRS_PER_SLICE, side="right"))
            high = int(firsts[np.searchsorted(firsts, reach, side="right") - 1])
            if high > low:
                yield self._sorted_entries(low, high, new)
            else:
                high = int(firsts[np.searchsorted(firsts, low, side="right")])
                yield self._summed_entries(low, high, pairs)
            low = high

    def _sorted_entries(self, low: int, high: int, new: np.ndarray) -> tuple[np.ndarray, ...]:
        sizes, others, times = self._expanded(low, high)
        number = np.cumsum(new[low:high]) - 1
        keys = np.repeat(number * self.width, sizes) + others
        again = np.repeat(times, sizes) if (times > 1).any() else None
        if again is None:
            keys, counts = _counted(keys)
        else:
            once = again == 1
            found = [_counted(keys[once]), _totals(keys[~once], again[~once])]
            keys, counts = _totals(*map(np.concatenate, zip(*found, strict=True)))
        heads = low + np.flatnonzero(new[low:high])
        of = heads[keys // self.width]
        return self._without_self(self.group[self.lines[of]], self.terms[of], keys % self.width, counts)

    def _summed_entries(self, low: int, high: int, pairs: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same for one term whose lines are too many to be expanded at once."""
        total = np.zeros(self.width, np.int64)
        at = low
        while at < high:
            done = pairs[at - 1] if at else 0
            end = int(np.searchsorted(pairs, done + PAIRS_PER_SLICE, side="right"))
            end = min(max(end, at + 1), high)
            sizes, others, times = self._expanded(at, end)
            for often in np.unique(times).tolist() if (times != times[0]).any() else times[:1].tolist():
                own = others if (times == often).all() else others[np.repeat(times == often, sizes)]
                total += often * np.bincount(own, minlength=self.width)
            at = end
        others = np.flatnonzero(total)
        group, term = (np.full(len(others), v) for v in (self.group[self.lines[low]], self.terms[low]))
        return self._without_self(group, term, others, total[others])

    @staticmethod
    def _without_self(group, term, other, n) -> tuple[np.ndarray, ...]:
        apart = term != other
        return group[apart], term[apart], other[apart], n[apart]

    def held_entries(self) -> Iterator[tuple[np.ndarray, ...]]:
        """The entries, many at a time."""
        held, many = [], 0
        for found in self.entries():
            held.append(found)
            many += len(found[0])
            if many >= ENTRIES_HELD:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, many = [], 0
        if many:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _starts(sorted_values: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_values), bool)
    np.not_equal(sorted_values[1:], sorted_values[:-1], out=new[1:])
    return np.flatnonzero(new)


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order and how often each is there."""
    values.sort()
    starts = _starts(values)
    return values[starts], np.diff(np.append(starts, len(values)))


def _totals(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order and the sum of each one's ``n``."""
    if not len(values):
        return values, n
    order = np.argsort(values, kind="stable")
    values = values[order]
    starts = _starts(values)
    return values[starts], np.add.reduceat(n[order], starts)


def _grouped(table: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, pa.Table]:
    """Number of each row's keys, and the keys by number."""
    if not keys:
        return np.zeros(table.num_rows, np.int64), pa.table({})
    codes = np.zeros(table.num_rows, np.int64)
    for key in keys:
        coded = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.unify_dictionaries().combine_chunks()
        column = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        codes = np.unique(codes * (column.max(initial=0) + 1) + column, return_inverse=True)[1]
    _, first = np.unique(codes, return_index=True)
    return codes, table.select(list(keys)).take(pa.array(first))


def chunks(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[Chunk]:
    """The batches of a task as chunks of bounded pairs and words."""
    held, pairs, words = [], 0, 0
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy().astype(np.int64)
        at, upto = (batch.column(c).to_numpy() for c in ("at", "upto"))
        held.append(batch)
        pairs += int((sizes * np.minimum(sizes, upto - at)).sum())
        words += int(sizes.sum())
        if pairs >= PAIRS_PER_CHUNK or words >= WORDS_PER_CHUNK:
            yield Chunk(pa.Table.from_batches(held), keys)
            held, pairs, words = [], 0, 0
    if held:
        yield Chunk(pa.Table.from_batches(held), keys)


def candidates(keys: Sequence[str], rate: float) -> Callable:
    """For ``mapInArrow``: evenly spaced entries of each chunk, and how many one stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, keys):
            for _, term, other, _ in chunk.held_entries():
                many = int(len(term) * rate) + 1
                at = (np.arange(many) * len(term)) // many
                words = (chunk.vocabulary.take(pa.array(c[at])) for c in (term, other))
                weight = pa.array(np.full(many, len(term) / many))
                yield pa.RecordBatch.from_arrays([*words, weight], names=["term", "other", "weight"])

    return run


def _local(cuts: Sequence[tuple[str, str]], chunk: Chunk) -> np.ndarray:
    """The least entries of the parts after the first, as term * width + other."""
    words = chunk.vocabulary.to_numpy(zero_copy_only=False)
    if not cuts or not len(words):
        return np.zeros(len(cuts), np.int64)
    terms, others = (np.array(c, dtype=object) for c in zip(*cuts, strict=True))
    at = np.searchsorted(words, terms)
    known = words[np.minimum(at, len(words) - 1)] == terms
    return at * chunk.width + np.where(known, np.searchsorted(words, others), 0)


def dealt(keys: Sequence[str], cuts: Sequence[tuple[str, str]], schema: pa.Schema) -> Callable:
    """For ``mapInArrow``: ``<keys..., part, block>`` of the task's lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, keys):
            limits = _local(cuts, chunk)
            place = np.full(chunk.width, -1, np.int32)
            for group, term, other, n in chunk.held_entries():
                entry = term * chunk.width + other
                ends = np.concatenate([np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
                begin = 0
                for end in ends.tolist():
                    bounds = np.concatenate([[0], np.searchsorted(entry[begin:end], limits), [end - begin]]) + begin
                    parts = np.flatnonzero(bounds[1:] > bounds[:-1])
                    blocks = [
                        _packed(chunk.vocabulary, place, *(c[bounds[p] : bounds[p + 1]] for c in (term, other, n)))
                        for p in parts.tolist()
                    ]
                    of = chunk.groups.take(pa.array(np.full(len(blocks), group[begin])))
                    own = [of.column(k).combine_chunks() for k in keys]
                    yield pa.RecordBatch.from_arrays(
                        [*own, pa.array(parts.astype(np.int32)), pa.array(blocks, pa.binary())], schema=schema
                    )
                    begin = end

    return run


def _planes(values: np.ndarray) -> tuple[int, bytes]:
    """Bytes a value needs, and the values byte by byte: all first bytes before all second ones."""
    most = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return width, values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _from_planes(data: memoryview, at: int, many: int, width: int) -> tuple[np.ndarray, int]:
    end = at + many * width
    planes = np.frombuffer(data[at:end], np.uint8).reshape(width, many)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(many).astype(np.int64), end


def _packed(words: pa.Array, place: np.ndarray, term: np.ndarray, other: np.ndarray, n: np.ndarray) -> bytes:
    """A block of sorted entries. ``place`` has room for a number per word, and is -1 before and after."""
    starts = _starts(term)
    place[other] = 0
    place[term[starts]] = 0
    used = np.flatnonzero(place >= 0)
    place[used] = np.arange(len(used))
    own = words.take(pa.array(used))
    text = b"".join(own.cast(pa.binary()).to_pylist())
    others = place[other]
    steps = np.diff(others, prepend=0)
    steps[starts] = others[starts]
    sizes = np.diff(np.append(starts, len(term)))
    lengths = pc.binary_length(own).to_numpy()
    columns = [_planes(c) for c in (lengths, place[term[starts]], sizes, steps, n)]
    place[used] = -1
    header = _HEADER.pack(len(used), len(starts), len(term), len(text), *(w for w, _ in columns))
    return header + pa.compress(b"".join([*(c for _, c in columns), text]), codec="zstd", asbytes=True)


def _unpacked(block: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and by entry the places of term and other in them and n."""
    n_words, n_terms, many, n_text, *widths = _HEADER.unpack_from(block)
    shapes = [*zip((n_words, n_terms, n_terms, many, many), widths, strict=True)]
    size = n_text + sum(m * w for m, w in shapes)
    data = memoryview(pa.decompress(block[_HEADER.size :], size, codec="zstd", asbytes=True))
    columns, at = [], 0
    for shape in shapes:
        column, at = _from_planes(data, at, *shape)
        columns.append(column)
    lengths, terms, sizes, steps, n = columns
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    words = pa.StringArray.from_buffers(n_words, pa.py_buffer(offsets), pa.py_buffer(data[at:]))
    summed = np.cumsum(steps)
    starts = np.cumsum(sizes) - sizes
    before = summed[starts] - steps[starts]
    return words, np.repeat(terms, sizes), summed - np.repeat(before, sizes), n


class Sums:
    """Entries of the blocks seen so far, equal ones as one."""

    def __init__(self) -> None:
        self.words = pa.array([], pa.string())
        self.columns = [np.zeros(0, np.int64)] * 4
        self.fresh: list[tuple] = []
        self.many = 0

    def add(self, group: int, block: bytes) -> None:
        words, *columns = _unpacked(block)
        self.fresh.append((words, np.full(len(columns[0]), group), *columns))
        self.many += len(columns[0])
        if self.many >= ENTRIES_HELD:
            self.settle()

    def settle(self) -> None:
        """Sum up what has come, in the order (group, term, other)."""
        if not self.fresh:
            return
        all_words = [self.words, *(f[0] for f in self.fresh)]
        firsts = np.cumsum([0, *(len(w) for w in all_words)])
        coded = pa.concat_arrays(all_words).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        rank = rank[coded.indices.to_numpy()]
        self.words, width = coded.dictionary.take(order), len(order)
        held = [(self.words, *self.columns), *self.fresh]
        group = np.concatenate([h[1] for h in held])
        term, other = (np.concatenate([rank[f + h[i]] for f, h in zip(firsts, held, strict=False)]) for i in (2, 3))
        n = np.concatenate([h[4] for h in held])
        self.fresh, self.many, held = [], 0, []
        if (int(group.max(initial=0)) + 1) * width * width < 1 << 63:
            entry = (group * width + term) * width + other
            order = np.argsort(entry, kind="stable")
            entry = entry[order]
            new = np.concatenate([[True], entry[1:] != entry[:-1]])
        else:
            order = np.lexsort((other, term, group))
            new = np.ones(len(order), bool)
            new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in (group, term, other)])
        starts = np.flatnonzero(new)
        kept = order[starts]
        self.columns = [group[kept], term[kept], other[kept], np.add.reduceat(n[order], starts)]


def summed(keys: Sequence[str], schema: pa.Schema) -> Callable:
    """For ``mapInArrow``: ``<keys..., term, entries>`` of the blocks of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, groups, seen = Sums(), {}, []
        for batch in batches:
            owners = batch.select(list(keys)).to_pylist() if keys else [{}] * batch.num_rows
            for row, (owner, block) in enumerate(zip(owners, batch.column("block"), strict=True)):
                known = tuple(owner.values())
                if known not in groups:
                    groups[known] = len(groups)
                    seen.append(batch.select(list(keys)).slice(row, 1))
                sums.add(groups[known], block.as_py())
        sums.settle()
        own = pa.Table.from_batches(seen) if keys and seen else None
        many, low = len(sums.columns[0]), 0
        while low < many:
            group, term, other, n = (c[low : low + ROWS_PER_BATCH] for c in sums.columns)
            low += ROWS_PER_BATCH
            new = np.concatenate([[True], (group[1:] != group[:-1]) | (term[1:] != term[:-1])])
            new[::ENTRIES_PER_ROW] = True
            starts = np.flatnonzero(new)
            entry = pa.StructArray.from_arrays([sums.words.take(pa.array(other)), pa.array(n)], names=["other", "n"])
            offsets = pa.array(np.append(starts, len(term)).astype(np.int32))
            columns = [own.column(k).take(pa.array(group[starts])).combine_chunks() for k in keys]
            columns += [sums.words.take(pa.array(term[starts])), pa.ListArray.from_arrays(offsets, entry)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return run
