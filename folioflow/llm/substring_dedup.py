"""Operator 2, substring dedup by relative Lempel-Ziv parsing.

The reference is cut into blocks around the grams that :mod:`folioflow.llm.windows` files them under, and every block
of the corpus is both a reference and a text to be factored: all blocks of a gram meet in one task, :class:`Reference`
puts their places into suffix order, and :func:`factors` walks every block from left to right and takes the longest copy
that starts at any other place, then goes on from its end. Windows inside factors of 35 words and more are duplicates. A
repeated window can also lie across a factor boundary, with yet another source; each one there is looked up. A block that
equals another one is a single factor, and so is a window of a gram too frequent for a task; they are found by equality.

Cases: a null text has no words; texts under 35 words lose none; repeated rows repeat each other's windows; overlapping
repeats inside one text count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import HEAVY_LEAST, byte_texts, merge_ranges, read_documents
from .windows import HOT, Words, repeated_ranges, with_ranges

WINDOW = 35


def window_places(offsets: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of all windows of blocks at ``offsets``."""
    first = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(offsets - first, n)


class Reference:
    """An index of blocks, each of which is also a text to be factored: places in suffix order, with ranks by their first
    1, 2, 4, ... symbols (suffixes end with their block), which tell how many symbols two places share."""

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray, lengths: np.ndarray):
        n = len(symbols)
        self.left = np.repeat(offsets + lengths, lengths) - np.arange(n)
        self.levels: list[tuple[int, np.ndarray]] = []
        # Ranks count the smaller ones of those compared: at first all places, then those that share a rank.
        rank, active, k = np.zeros(n, dtype=np.int64), np.arange(n), 1
        own, key = rank, symbols
        while len(active):
            order = np.argsort(key)
            active, own, key = active[order], own[order], key[order]
            at = np.arange(len(active))
            new_own = np.concatenate(([True], own[1:] != own[:-1]))
            new = np.concatenate(([True], key[1:] != key[:-1]))
            rank = rank.copy()
            rank[active] = own + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(new_own, at, 0))
            self.levels.append((k, rank))
            tied = ~(new & np.append(new[1:], True)) & (self.left[active] >= k)
            active = active[tied]
            own = rank[active]
            key = own * (n + 1) + np.where(self.left[active] > k, rank[np.minimum(active + k, n - 1)] + 1, 0)
            k *= 2
        self.order = np.argsort(rank, kind="stable")

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at ``i`` and ``j`` have in common at their start."""
        length = np.zeros(len(i), dtype=np.int64)
        for k, rank in reversed(self.levels):
            fits = (self.left[i] - length >= k) & (self.left[j] - length >= k)
            a, b = np.where(fits, i + length, 0), np.where(fits, j + length, 0)
            length += k * (fits & (rank[a] == rank[b]))
        return length

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """For every place the length of the longest copy that starts anywhere else, and where that is (-1 if nowhere)."""
        n = len(self.order)
        near = self.shared(self.order[:-1], self.order[1:])
        before, after = np.concatenate(([0], near)), np.concatenate((near, [0]))
        length, source = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        length[self.order] = np.maximum(before, after)
        source[self.order] = np.where(before >= after, np.roll(self.order, 1), np.roll(self.order, -1))
        return length, np.where(length > 0, source, -1)


def factors(length: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the greedy factors of all blocks: the longest copy from the end of the one before, or one new
    symbol. All blocks are walked at once."""
    at, ends = offsets, offsets + lengths
    starts, sizes = [], []
    while len(at):
        size = np.maximum(length[at], 1)
        starts.append(at)
        sizes.append(size)
        at = at + size
        at, ends = at[at < ends], ends[at < ends]
    return (np.concatenate(starts), np.concatenate(sizes)) if starts else (offsets[:0], offsets[:0])


def across_boundaries(length: np.ndarray, starts: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """Places whose window reaches over the end of a factor and is a copy of its own: each is looked up in the index."""
    first = np.repeat(offsets, lengths)[starts]
    last = np.repeat(offsets + lengths, lengths)[starts] - window
    ends = starts + sizes
    lo = np.maximum(np.maximum(starts, first), ends - window + 1)
    hi = np.minimum(ends - 1, last)
    some = hi >= lo
    at = window_places(lo[some], (hi - lo + 1)[some])
    return at[length[at] >= window]


def repeated_windows(symbols: np.ndarray, offsets: np.ndarray, n: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Windows in factors of ``window`` symbols and more, and those across factor boundaries that are copies as well."""
    lengths = n - 1 + window
    length, _ = Reference(symbols, offsets, lengths).longest()
    starts, sizes = factors(length, offsets, lengths)
    edge = np.zeros(len(symbols) + 1, dtype=np.int64)
    long = sizes >= window
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, (starts + sizes)[long] - window + 1, -1)
    found = np.cumsum(edge)[:-1] > 0
    found[across_boundaries(length, starts, sizes, offsets, lengths, window)] = True
    return found[window_places(offsets, n)]


def duplicate_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, heavy_least: int = HEAVY_LEAST) -> DataFrame:
    """``(doc_id, text, starts, stops)``: word ranges covered by windows of 35 words that occur again; unmerged, null if none."""
    ranges = repeated_ranges(Words(WINDOW), docs, repeated_windows, id_col=id_col, text_col=text_col, hot=hot)
    return with_ranges(docs, ranges, id_col, text_col, heavy_least)


def remove_words(found: DataFrame) -> DataFrame:
    """Per document: words, words removed, the words kept (joined by spaces) and their SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts, stops in zip(byte_texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words, kept, at = text.split(), [], 0
                for lo, hi in zip(*merge_ranges(np.array(starts or [], dtype=np.int64), np.array(stops or [], dtype=np.int64))):
                    kept += words[at:lo]
                    at = hi
                kept = b" ".join(kept + words[at:]) if at else b" ".join(words)
                removed = len(words) - len(kept.split())
                out.append((len(words), removed, hashlib.sha256(kept).hexdigest(), kept.decode()))
            n, removed, digest, kept = zip(*out) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return found.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_words(duplicate_words(read_documents(spark, sf_dir))).drop("kept")
