"""Exact search for repeated windows over all documents, shared by operators 2 and 5.

A window is W consecutive symbols (words, bytes) of one document; one that also starts anywhere else is a repeat. Every
window is filed under the smallest-hashed gram inside it, so equal windows are filed alike, and consecutive windows under
one gram form a *block* with the symbols they span. A window of bytes without a gram takes its smallest-hashed eight bytes
for one, and the key of bytes is the gram with the half of the window on its longer side, as short strings recur in texts
that repeat nothing. Then

1. grams are counted (partial sums per task, one narrow shuffle), and those of two or more blocks go into a bit filter
   sized by their number, up to ``MOST_BITS``, broadcast to the second reading (a crowded filter lets more blocks through
   but loses none);
2. blocks under a counted gram are dealt by gram, equal blocks of a task collapsed to one row with their places. A gram
   of more than ``hot`` blocks, which no task should gather, is dealt window by window instead, each under its own
   128-bit hash; and as such a window can itself be in a third of all documents, under one of several salts, as many as
   the most frequent gram asks for;
3. each operator compares the blocks of a gram by its own method and marks the windows found elsewhere. A window under a
   salt with two places is a repeat. One that is alone there may have others under other salts: a row for each salt, and
   no more, is brought together by hash to settle it;
4. covered ranges, merged in every task, go back to their documents, which are joined by id and text hash; an id that
   many rows share is salted.

Texts longer than ``SLICE`` symbols are sliced with W - 1 symbols of overlap: each window is still filed once.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY_LEAST, byte_texts, discard, heavy_keys, materialize, merge_ranges, mix64, ranges_of, row_key, salted_join

#: Symbols that one step of a map task works on.
SLICE = 1 << 20
#: Bytes of distinct blocks that a map task gathers before it passes them on, and that a comparison works on at once.
GATHER, COMPARE = 24 << 20, 1 << 20
#: log2 of the bits of a filter: the least and the most (32 MB); in between, sixteen bits for each key.
LEAST_BITS, MOST_BITS = 16, 28
#: Blocks of one gram that a task compares with each other; blocks of a hot gram for each salt of its windows.
HOT = 4096
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_HOT_SIDE = np.uint64(0xA5A5A5A55A5A5A5A)

BLOCKS = "key bigint, n int, payload binary, met bigint, places binary"
#: What a comparison finds: ranges, or windows that are alone under their salt, or that aren't.
RANGE, ALONE, SETTLED = 0, 1, 2
FINDINGS = "k_id bigint, k_text bigint, start bigint, stop bigint, kind int, d1 bigint, d2 bigint"
NAMES = [f.split()[0] for f in FINDINGS.split(", ")]
PLACE = np.dtype([("k_id", "<i8"), ("k_text", "<i8"), ("at", "<i8")])


class Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown as needed."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            grow = lambda base: np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(n + SLICE // 4, base, dtype=np.uint64))))
            cls.up, cls.down = grow(_BASE), grow(_INVERSE)
        return cls.up, cls.down


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums: :func:`range_hash` reads the hash of any range from them."""
    up, _ = Powers.of(len(symbols) + 1)
    return np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(symbols * up[: len(symbols)], dtype=np.uint64)))


def range_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    _, down = Powers.of(len(sums))
    return mix64((sums[stop] - sums[start]) * down[start])


class WordHashes(dict):
    """Word to its XXH64, remembered for the words of late."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


@dataclass(frozen=True)
class Words:
    """Symbols are words (by their 64-bit hash); a gram is ``gram`` consecutive words at any place."""

    window: int
    gram: int = 8

    dtype = np.dtype("<u8")
    sided = False

    def reader(self) -> Callable[[bytes], np.ndarray]:
        known = WordHashes()

        def read(text: bytes) -> np.ndarray:
            words = text.split()
            return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))

        return read

    def weights(self, symbols: np.ndarray) -> np.ndarray:
        return symbols

    def grams(self, symbols: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.arange(max(0, len(symbols) - self.gram + 1))
        return start, start + self.gram


_OCTETS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@dataclass(frozen=True)
class Bytes:
    """Symbols are bytes; a gram is a phrase from one trigger through the next (see :func:`triggers`)."""

    window: int
    every: int = 48

    dtype = np.dtype("u1")
    #: Keys take in the longer side of the window.
    sided = True

    def reader(self) -> Callable[[bytes], np.ndarray]:
        return lambda text: np.frombuffer(text, dtype=np.uint8)

    def weights(self, symbols: np.ndarray) -> np.ndarray:
        return _OCTETS[symbols]

    def grams(self, symbols: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = triggers(symbols, self.every)
        return at[:-1], at[1:] + TRIGGER


#: Bytes of a trigger.
TRIGGER = 8


def octets_at(symbols: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, first byte highest, so that numbers order like the strings."""
    n = len(symbols) - TRIGGER + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    for o in range(min(TRIGGER, n)):
        part = symbols[o : o + (n - o + TRIGGER - 1) // TRIGGER * TRIGGER]
        out[o::TRIGGER] = np.ascontiguousarray(part).view(">u8")
    return out


def triggers(symbols: np.ndarray, every: int) -> np.ndarray:
    """Places whose next eight bytes have a hash in the lowest ``1 / every`` of all."""
    return np.flatnonzero(octets_at(symbols) * np.uint64(_BASE) < np.uint64((1 << 64) // every))


def _range_argmin(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Leftmost place of the least of ``values[lo:hi]`` (none empty), over a table of doubling spans."""
    out = np.empty(len(lo), dtype=np.int64)
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    place = np.arange(len(values))
    for t in range(int(level.max(initial=0)) + 1):
        if (mine := np.flatnonzero(level == t)).size:
            x, y = place[lo[mine]], place[hi[mine] - (1 << t)]
            out[mine] = np.where(values[x] <= values[y], x, y)
        x, y = place[: -(1 << t)], place[1 << t :]
        place = np.where(values[x] <= values[y], x, y)
        if not len(place):
            break
    return out


def blocks(spec: Words | Bytes, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows and gram hash of every block of the pieces that ``bounds`` cuts ``symbols`` into."""
    W = spec.window
    sums = prefix_sums(spec.weights(symbols))
    a, b = spec.grams(symbols, sums)
    first, last = bounds[:-1], bounds[1:] - W  # of the windows of a piece
    first, last = first[last >= first], last[last >= first]
    none = np.empty(0, dtype=np.int64)
    if not len(first):
        return none, none, none.astype(np.uint64)
    h = range_hash(sums, a, b) ^ (b - a).astype(np.uint64)
    cuts = np.unique(np.concatenate((a + 1, b - W, first, last + 1)))
    cuts = cuts[(cuts >= 0) & (cuts <= len(symbols))]
    ends = np.append(cuts[1:], len(symbols))
    piece = np.searchsorted(first, cuts, side="right") - 1
    valid = (piece >= 0) & (cuts <= last[np.maximum(piece, 0)])
    p, q, piece = cuts[valid], ends[valid], piece[valid]
    lo, hi = np.searchsorted(a, p, side="left"), np.searchsorted(b, p + W, side="right")
    some = hi > lo
    p1, q1, arg = p[some], q[some], _range_argmin(mix64(h ^ np.uint64(_BASE)), lo[some], hi[some])
    from_, to, piece = a[arg], b[arg], piece[some]
    if not some.all():  # windows of bytes
        bare = np.concatenate([np.arange(x, y) for x, y in zip(p[~some], q[~some])])
        least = _least_octets(symbols, bare, W)
        p1, q1 = np.concatenate((p1, bare)), np.concatenate((q1, bare + 1))
        from_, to = np.concatenate((from_, least)), np.concatenate((to, least + TRIGGER))
        piece = np.concatenate((piece, np.searchsorted(first, bare, side="right") - 1))
    new = np.ones(len(p1), dtype=bool)
    new[1:] = (from_[1:] != from_[:-1]) | (to[1:] != to[:-1]) | (p1[1:] != q1[:-1]) | (piece[1:] != piece[:-1])
    head = np.flatnonzero(new)
    start, stop, from_, to = p1[head], q1[np.append(head[1:], len(q1)) - 1], from_[head], to[head]
    if not spec.sided:
        return start, stop - start, range_hash(sums, from_, to) ^ (to - from_).astype(np.uint64)
    # From ``cut`` on, windows reach ``after`` symbols past their gram; those before it reach ``before`` ahead of it.
    after = (W - (to - from_) + 1) // 2
    before = W - (to - from_) - after + 1
    cut = to + after - W
    right, left = stop > cut, start < cut
    begin = np.concatenate((np.maximum(start, cut)[right], start[left]))
    end = np.concatenate((stop[right], np.minimum(stop, cut)[left]))
    # The string of a key may be that of a key of the other side: these are told apart by their complement.
    ahead, behind = range_hash(sums, from_[right], (to + after)[right]), ~range_hash(sums, (from_ - before)[left], to[left])
    return begin, end - begin, np.concatenate((ahead, behind))


def _least_octets(symbols: np.ndarray, windows: np.ndarray, W: int) -> np.ndarray:
    """Leftmost place of the smallest-hashed eight bytes of each window (starts in order)."""
    head = np.flatnonzero(np.append(True, windows[1:] != windows[:-1] + 1))
    run = np.diff(np.append(head, len(windows)))
    size = run + W - TRIGGER  # places of the windows of a run, one run after another
    base = np.cumsum(size) - size
    at = np.repeat(windows[head] - base, size) + np.arange(int(size.sum()))
    value = mix64(octets_at(symbols)[at] * np.uint64(_BASE))
    lo = windows + np.repeat(base - windows[head], run)
    return at[_range_argmin(value, lo, lo + W - TRIGGER + 1)]


def _pieces(spec: Words | Bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols of several texts with their bounds, and the key and offset of each piece; columns k_id, k_text, text."""
    read, parts, keys, held = spec.reader(), [], [], 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bounds = np.cumsum([0, *map(len, parts)])
        return np.concatenate(parts), bounds, np.array(keys, dtype=PLACE)

    for batch in batches:
        for k_id, k_text, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_texts(batch.column(2))):
            symbols = read(text)
            for at in range(0, len(symbols) - spec.window + 1, SLICE - spec.window + 1):
                part = symbols[at : at + SLICE]
                parts.append(part)
                keys.append((k_id, k_text, at))
                held += len(part)
                if held >= SLICE // 4:
                    yield flush()
                    parts, keys, held = [], [], 0
    if parts:
        yield flush()


def _bit_filter(grams: DataFrame) -> np.ndarray:
    """A bit array in which the bit of every ``key`` is set: sixteen bits a key, 2**MOST_BITS at most; gathered as words."""
    n = grams.count()
    bits = min(MOST_BITS, max(LEAST_BITS, int(n).bit_length() + 4))
    out = np.zeros(1 << bits - 6, dtype=np.int64)
    if n:
        at = F.shiftrightunsigned("key", 64 - bits)
        words = grams.select(F.shiftrightunsigned(at, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 63 as int))").alias("b"))
        found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        out[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return out.view(np.uint64)


def _passes(filter_: np.ndarray, key: np.ndarray) -> np.ndarray:
    bits = len(filter_).bit_length() + 5
    at = key >> np.uint64(64 - bits)
    return (filter_[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def count_grams(spec: Words | Bytes, keyed: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Filters for the grams of two or more blocks and of more than ``hot``; and the blocks of the most frequent one.

    Blocks of bytes that are equal in one step travel as one row, so they count as two however many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for symbols, bounds, _ in _pieces(spec, batches):
            start, n, key = blocks(spec, symbols, bounds)
            if spec.sided:
                whole = range_hash(prefix_sums(spec.weights(symbols)), start, start + n - 1 + spec.window)
                _, first, n = np.unique(key ^ mix64(whole), return_index=True, return_counts=True)
                key = np.concatenate((key[first], key[first[n > 1]]))
            key, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    counts = materialize(keyed.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "grams")
    found = _bit_filter(counts), _bit_filter(counts.where(F.col("n") > hot)), counts.agg(F.max("n")).first()[0] or 0
    discard(counts)
    return found


def _thinned(places: np.ndarray, long: int) -> np.ndarray:
    """Those of the sorted ``places`` of ranges ``long`` symbols long that cover what all of them cover."""
    if len(places) < 3:
        return places
    kept, rows = [0], list(zip(places["k_id"].tolist(), places["k_text"].tolist()))
    at = places["at"].tolist()
    for i in range(1, len(at)):
        # Passed over if the one before and the one after it leave no gap.
        if i + 1 < len(at) and rows[kept[-1]] == rows[i + 1] and at[i + 1] - at[kept[-1]] <= long:
            continue
        kept.append(i)
    return places[kept]


class _Held:
    """Rows of a map task under a key, with the places where they were met. With ``reach``, the symbols of a window, only
    as many places as cover the same: several places make a block a repeat at each of them."""

    def __init__(self, reach: int = 0):
        self.rows: dict[tuple, array] = {}
        self.size = 0
        self.reach = reach

    def add(self, key: tuple, place: tuple[int, int, int]) -> None:
        if (found := self.rows.get(key)) is None:
            self.rows[key] = array("q", place)
            self.size += len(key[-1]) + 400
        else:
            found.extend(place)
            self.size += 32

    def take(self) -> tuple[list[tuple], pa.Array, pa.Array]:
        """Keys, number of places, and the places as bytes, each but once (rows alike have the same)."""
        keys, met, places = list(self.rows), [], []
        for k, v in self.rows.items():
            met.append(len(v) // 3)
            if len(v) == 3:
                places.append(v.tobytes())
                continue
            each = np.unique(np.frombuffer(v, dtype=PLACE))
            places.append((_thinned(each, k[1] - 1 + self.reach) if self.reach else each).tobytes())
        self.rows, self.size = {}, 0
        return keys, pa.array(met, pa.int64()), pa.array(places, pa.binary())


def candidate_blocks(spec: Words | Bytes, keyed: DataFrame, filters: tuple[np.ndarray, np.ndarray], salts: int) -> DataFrame:
    """Blocks (:data:`BLOCKS`) under a repeated gram, equal ones of a task in one row with their places; of hot grams, the
    windows by their hash (as ``payload``) and a salt."""
    shared = keyed.sparkSession.sparkContext.broadcast(filters)
    W = spec.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, hot = shared.value
        held = _Held(W if spec.sided else 0)
        side = int(_HOT_SIDE ^ mix64(np.array([TaskContext.get().partitionId() % salts], dtype=np.uint64))[0])

        def flush() -> pa.RecordBatch:
            keys, met, places = held.take()
            kinds = (pa.int64(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], t) for i, t in enumerate(kinds)), met, places], names=["key", "n", "payload", "met", "places"])

        for symbols, bounds, places in _pieces(spec, batches):
            start, n, key = blocks(spec, symbols, bounds)
            ok = _passes(repeated, key)
            start, n, key = start[ok], n[ok], key[ok]
            piece = np.searchsorted(bounds, start, side="right") - 1
            at = start - bounds[piece] + places["at"][piece]
            apart = _passes(hot, key).tolist()
            ids, texts, signed = places["k_id"][piece].tolist(), places["k_text"][piece].tolist(), key.view(np.int64).tolist()
            data, wide = symbols.astype(spec.dtype, copy=False).tobytes(), spec.dtype.itemsize
            for i, (s, m, k, x) in enumerate(zip(start.tolist(), n.tolist(), signed, at.tolist())):
                if not apart[i]:
                    held.add((k, m, data[s * wide : (s + m - 1 + W) * wide]), (ids[i], texts[i], x))
                else:
                    for j in range(m):
                        digest = xxhash.xxh3_128_digest(data[(s + j) * wide : (s + j + W) * wide])
                        own = int.from_bytes(digest[:8], "little") ^ side
                        held.add((own - (own >> 63 << 64), 1, digest), (ids[i], texts[i], x + j))
            if held.size > GATHER:
                yield flush()
        if held.rows:
            yield flush()

    return keyed.mapInArrow(run, BLOCKS)


def _merged(k_id: np.ndarray, k_text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Ranges, those of a row key that touch made one."""
    order = np.lexsort((start, k_text, k_id))
    k_id, k_text, start, stop = (x[order] for x in (k_id, k_text, start, stop))
    new = np.concatenate(([True], (k_id[1:] != k_id[:-1]) | (k_text[1:] != k_text[:-1])))[: len(k_id)]
    row = np.cumsum(new) - 1
    # Rows one after another on a line on which no two can touch.
    shift = row * (int(stop.max(initial=0)) + 2)
    lo, hi = merge_ranges(start + shift, stop + shift)
    head = np.searchsorted(start + shift, lo, side="left")
    return pa.RecordBatch.from_arrays([pa.array(k_id[head]), pa.array(k_text[head]), pa.array(lo - shift[head]), pa.array(hi - shift[head])], names=["k_id", "k_text", "start", "stop"])


def settled(findings: DataFrame) -> DataFrame:
    """Ranges of ``findings`` (:data:`FINDINGS`, written), those of windows alone under their salt with them if there is
    another salt. A window has a row for each salt at most, so no group grows with its places."""
    by = ["d1", "d2"]
    other = findings.where(F.col("kind") != RANGE).groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*by)
    late = findings.where(F.col("kind") == ALONE).join(other.hint("shuffle_hash"), by, "left_semi")
    columns = ["k_id", "k_text", "start", "stop"]
    return findings.where(F.col("kind") == RANGE).select(*columns).unionByName(late.select(*columns))


def repeated_ranges(
    spec: Words | Bytes, docs: DataFrame, compare: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], *,
    id_col: str = "doc_id", text_col: str = "text", hot: int = HOT,
) -> DataFrame:
    """``(k_id, k_text, ranges)``: for each row key the ranges of symbols that repeated windows cover.

    ``compare(symbols, offsets, n)`` gets distinct blocks one after another, block i at ``offsets[i]`` with ``n[i]``
    windows, and returns for every window, in order, whether it also starts in another of them or again in its own.
    """
    keyed = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    repeated, frequent, most = count_grams(spec, keyed, hot)
    salts = max(1, -(-most // hot))
    found = candidate_blocks(spec, keyed, (repeated, frequent), salts)
    W = spec.window

    def decide(rows: list[tuple[int, int, bytes, int, bytes]]) -> Iterator[pa.RecordBatch]:
        """Rows of whole keys: merges equal blocks, compares the rest."""
        merged: dict[tuple[int, int, bytes], list[bytes]] = {}
        times: dict[tuple[int, int, bytes], int] = {}
        for k, n, payload, met, places in rows:
            merged.setdefault((k, n, payload), []).append(places)
            times[k, n, payload] = times.get((k, n, payload), 0) + met
        where = [np.unique(np.frombuffer(b"".join(v), dtype=PLACE)) for v in merged.values()]
        n = np.array([k[1] for k in merged], dtype=np.int64)
        # A block met in several places is a copy as a whole: the longest factor there can be.
        several = np.array([x > 1 for x in times.values()])
        keys = np.array([k[0] for k in merged], dtype=np.int64)
        whole = np.array([len(k[2]) == (k[1] - 1 + W) * spec.dtype.itemsize for k in merged])
        _, inverse, kinds = np.unique(keys, return_inverse=True, return_counts=True)
        # Compared if another block shares the gram, or if the block may repeat a window within itself.
        compared = np.flatnonzero(whole & ~(several & (kinds[inverse] == 1)))
        flags = np.repeat(several, n)
        first = np.concatenate(([0], np.cumsum(n)))
        if len(compared):
            payloads = list(merged)
            data = np.frombuffer(b"".join(payloads[i][2] for i in compared), dtype=spec.dtype)
            offsets = np.concatenate(([0], np.cumsum(n[compared] - 1 + W)))[:-1]
            got = compare(data, offsets, n[compared])
            target = np.repeat(first[compared] - np.concatenate(([0], np.cumsum(n[compared])))[:-1], n[compared]) + np.arange(len(got))
            flags[target] |= got
        # Blocks met in several places are covered whole; of the others, the runs of windows that were marked.
        places = np.concatenate(where)
        count = np.array([len(x) for x in where])
        whole_place = np.repeat(several, count)
        found = [(places[whole_place], np.zeros(int(whole_place.sum()), dtype=np.int64), np.repeat(n, count)[whole_place])]
        for i in np.flatnonzero(~several):
            own = flags[first[i] : first[i + 1]]
            if own.any():
                lo, hi = ranges_of(own)
                found.append((np.repeat(where[i], len(lo)), lo, hi))
        place, lo, hi = (np.concatenate(x) for x in zip(*found))
        if len(place):
            ranges = _merged(*(np.ascontiguousarray(x) for x in (place["k_id"], place["k_text"], place["at"] + lo, place["at"] + hi - 1 + W)))
            none = pa.array(np.zeros(ranges.num_rows, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*ranges.columns, pa.array(np.full(ranges.num_rows, RANGE, dtype=np.int32)), none, none], names=NAMES)
        if salts > 1 and not whole.all():
            hashed = np.flatnonzero(~whole)
            one = np.concatenate([where[i][:1] for i in hashed])
            halves = np.frombuffer(b"".join([k[2] for k, w in zip(merged, whole) if not w]), dtype="<i8").reshape(-1, 2)
            columns = [one["k_id"], one["k_text"], one["at"], one["at"] + W, np.where(several[hashed], SETTLED, ALONE).astype(np.int32), halves[:, 0], halves[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bytes, int, bytes]] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if size > COMPARE and row[0] != last:
                    yield from decide(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2])
                last = row[0]
        if rows:
            yield from decide(rows)

    findings = found.repartition("key").sortWithinPartitions("key").mapInArrow(run, FINDINGS)
    if salts > 1:
        findings = materialize(findings, "findings")
        ranges = settled(findings)
    else:
        ranges = findings.select("k_id", "k_text", "start", "stop")
    return ranges.groupBy("k_id", "k_text").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))


def with_ranges(docs: DataFrame, ranges: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_least: int = HEAVY_LEAST) -> DataFrame:
    """``(id, text, starts, stops)``: every row of ``docs`` with the ranges of its key; the ranges are the hashed side."""
    rows = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids = docs.select(row_key(id_col, text_col)[0]).groupBy("k_id").agg(F.count(F.lit(1)).alias("n"))
    heavy = materialize(heavy_keys(ids, docs.count(), heavy_least), "heavy-ids")
    joined = salted_join(rows, ranges, ["k_id", "k_text"], heavy, "left", heavy_on=["k_id"])
    return joined.select("doc_id", "text", F.col("ranges.start").alias("starts"), F.col("ranges.stop").alias("stops"))
