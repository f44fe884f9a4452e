"""Operator 5, suffix-array dedup by prefix-free parsing.

Texts are cut at rolling-hash triggers into phrases that overlap in the trigger; :mod:`folioflow.llm.windows` files
blocks of bytes under their phrases, and :func:`corpus_order` brings the distinct blocks of a task into suffix order the
prefix-free way: the suffixes of the distinct phrases are sorted once (the dictionary), the sequence of phrases is
sorted as a string over phrase ranks (the parse), and the two ranks together order all places of the blocks. Places next
to each other in that order with 400 equal bytes are the repeats, so highly repetitive text costs its dictionary.

Cases: a null text is empty; texts under 400 bytes lose nothing; repeated rows repeat each other; overlapping repeats
inside one text count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import HEAVY_LEAST, byte_texts, merge_ranges, read_documents
from .substring_dedup import window_places
from .windows import HOT, TRIGGER, Bytes, octets_at, prefix_sums, range_hash, repeated_ranges, triggers, with_ranges

WINDOW = 400
EVERY = 48


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Ranks in order: one more than the number of smaller keys."""
    order = np.argsort(keys)
    new = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.maximum.accumulate(np.where(new, np.arange(1, len(keys) + 1), 0))
    return out


def _doubling(rank: np.ndarray, left: np.ndarray, k: int, longest: int) -> np.ndarray:
    """Refines ranks by the first ``k`` symbols to ranks by whole strings; ``left`` symbols remain of each place's string.

    A string that has ended ranks below any that goes on. Only places that share their rank are sorted again.
    """
    rank = rank.copy()
    active = np.flatnonzero(left >= k)
    while k <= longest and len(active):
        more = np.where(left[active] > k, rank[np.minimum(active + k, len(rank) - 1)], 0)
        own = rank[active]
        order = np.argsort(own * (len(rank) + 1) + more)
        active, own, more = active[order], own[order], more[order]
        at = np.arange(len(active))
        new_own = np.concatenate(([True], own[1:] != own[:-1]))
        new = new_own | np.concatenate(([True], more[1:] != more[:-1]))
        rank[active] = own + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(new_own, at, 0))
        k *= 2
        alone = new & np.append(new[1:], True)
        active = active[~alone & (left[active] >= k)]
    return rank


def corpus_order(symbols: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, every: int = EVERY, horizon: int = WINDOW) -> np.ndarray:
    """All places of the blocks, in the order of the suffixes that start there and end with their block.

    Ties are places whose next ``horizon`` bytes agree (or whose suffixes do).
    """
    n = len(symbols)
    ends = offsets + lengths
    at = triggers(symbols, every)
    # A block starts a phrase and ends one; triggers across a block's end are none.
    block = np.searchsorted(offsets, at, side="right") - 1
    at = at[at + TRIGGER <= ends[block]] if len(at) else at
    starts = np.unique(np.concatenate((offsets, at)))
    owner = np.searchsorted(offsets, starts, side="right") - 1
    following = np.append(starts[1:], n)
    last = np.append(owner[1:] != owner[:-1], True)
    stops = np.where(last, ends[owner], np.minimum(following + TRIGGER, ends[owner]))
    # Dictionary: the distinct phrases, one after another.
    sums = prefix_sums(Bytes(horizon).weights(symbols))
    _, first, phrase = np.unique(range_hash(sums, starts, stops) ^ (stops - starts).astype(np.uint64) ^ (last.astype(np.uint64) << np.uint64(63)), return_index=True, return_inverse=True)
    d_start, d_len = starts[first], stops[first] - starts[first]
    base = np.cumsum(d_len) - d_len
    total = int(d_len.sum())
    offset = np.arange(total) - np.repeat(base, d_len)
    letters = symbols[np.repeat(d_start, d_len) + offset]
    left = np.repeat(d_len, d_len) - offset
    eight = octets_at(np.concatenate((letters, np.zeros(TRIGGER - 1, dtype=np.uint8))))
    short = np.minimum(left, TRIGGER).astype(np.uint64)
    eight &= ~np.uint64(0) << (np.uint64(8) * (np.uint64(TRIGGER) - short))
    suffix = _doubling(_ranks(_ranks(eight) * 16 + short.astype(np.int64)), left, TRIGGER, int(d_len.max(initial=0)))
    # Parse: phrases as letters, ranked by their whole string, then by what follows them in the block.
    letter = _ranks(suffix[base][phrase])
    remaining = np.zeros(len(starts), dtype=np.int64)
    tail = np.flatnonzero(last)
    remaining = tail[np.searchsorted(tail, np.arange(len(starts)))] - np.arange(len(starts)) + 1
    parse = _doubling(letter, remaining, 1, min(int(remaining.max(initial=0)), horizon))
    # Both together: the suffix of the phrase a place lies in, then the rank of the next phrase (0 at a block's end).
    q = np.searchsorted(starts, np.arange(n), side="right") - 1
    dictionary = suffix[base[phrase[q]] + np.arange(n) - starts[q]]
    follows = np.where(last[q], 0, np.append(parse, 0)[q + 1])
    return np.argsort(dictionary * (len(starts) + 1) + follows)


def _repeated(symbols: np.ndarray, offsets: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Windows whose neighbour in corpus order has the same 400 bytes."""
    places = window_places(offsets, n)
    order = corpus_order(symbols, offsets, n - 1 + WINDOW)
    window = np.full(len(symbols), -1, dtype=np.int64)
    window[places] = np.arange(len(places))
    order = order[window[order] >= 0]
    h = range_hash(prefix_sums(Bytes(WINDOW).weights(symbols)), order, order + WINDOW)
    near = np.flatnonzero(h[1:] == h[:-1])
    strings = np.lib.stride_tricks.sliding_window_view(symbols, WINDOW)
    same = np.zeros(len(near), dtype=bool)
    for lo in range(0, len(near), 4000):
        at = near[lo : lo + 4000]
        same[lo : lo + 4000] = (strings[order[at]] == strings[order[at + 1]]).all(axis=1)
    out = np.zeros(len(places), dtype=bool)
    out[window[order[near[same]]]] = True
    out[window[order[near[same] + 1]]] = True
    return out


def duplicate_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, heavy_least: int = HEAVY_LEAST) -> DataFrame:
    """``(doc_id, text, starts, stops)``: byte ranges covered by 400-byte strings that occur again; unmerged, null if none."""
    ranges = repeated_ranges(Bytes(WINDOW, EVERY), docs, _repeated, id_col=id_col, text_col=text_col, hot=hot)
    return with_ranges(docs, ranges, id_col, text_col, heavy_least)


def remove_bytes(found: DataFrame) -> DataFrame:
    """Per document: bytes, bytes removed, maximal removed runs, the bytes kept and their SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts, stops in zip(byte_texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                lo, hi = merge_ranges(np.array(starts or [], dtype=np.int64), np.array(stops or [], dtype=np.int64))
                kept = b"".join(text[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(text)]))
                out.append((len(text), len(text) - len(kept), len(lo), hashlib.sha256(kept).hexdigest(), kept))
            n, removed, spans, digest, kept = zip(*out) if out else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return found.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_bytes(duplicate_bytes(read_documents(spark, sf_dir))).drop("kept")
