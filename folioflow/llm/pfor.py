"""Patched frame-of-reference blocks: the byte layout of a segment of token ids.

A segment holds ``n`` ids in blocks of 128. Per block the minimum is subtracted, a width is chosen that the given
percentile of the differences fits, the low ``width`` bits of all differences are packed, and the high bits of those
that do not fit go to the exception list. Layout, little endian::

    magic "PFB1" | u32 n | u32 blocks | u32 packed words | u32 exceptions
    u32 block start (in packed words) x blocks | u32 minimum x blocks | u32 exception start x blocks | u8 width x blocks
    u32 packed words | u32 exception high bits | u8 exception places in their block

The block starts let :func:`decode` read any range without touching other blocks.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"PFB1"
BLOCK = 128
_HEAD = struct.Struct("<4s4I")


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _pack(low: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 numbers under 2**width as rows of 4 * width words."""
    out = np.zeros((4 * width, len(low)), dtype=np.uint64)
    columns = low.T.astype(np.uint64)
    for j in range(BLOCK):
        word, off = divmod(j * width, 32)
        out[word] |= columns[j] << np.uint64(off)
        if off + width > 32:
            out[word + 1] |= columns[j] >> np.uint64(32 - off)
    return (out.T & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    rows = words.T.astype(np.uint64)
    out = np.empty((BLOCK, len(words)), dtype=np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(BLOCK):
        word, off = divmod(j * width, 32)
        x = rows[word] >> np.uint64(off)
        if off + width > 32:
            x = x | (rows[word + 1] << np.uint64(32 - off))
        out[j] = x & mask
    return out.T


def encode(values: np.ndarray, percentile: float = 90.0) -> bytes:
    """A segment of the uint32 array ``values`` (any length, also 0)."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return _HEAD.pack(MAGIC, 0, 0, 0, 0)
    v = np.pad(values.astype(np.uint32), (0, blocks * BLOCK - n), mode="edge").reshape(blocks, BLOCK)
    least = v.min(axis=1)
    d = v - least[:, None]
    rank = min(BLOCK - 1, max(0, int(np.ceil(BLOCK * percentile / 100)) - 1))
    width = _bit_length(np.partition(d, rank, axis=1)[:, rank])
    wide = width.astype(np.uint64)
    most = ((np.uint64(1) << wide) - np.uint64(1)).astype(np.uint32)
    late = d > most[:, None]
    owner, place = np.nonzero(late)
    high = (d[late].astype(np.uint64) >> wide[owner]).astype(np.uint32)
    place = place.astype(np.uint8)
    first_exception = np.concatenate(([0], np.cumsum(late.sum(axis=1))[:-1])).astype(np.uint32)
    low = d & most[:, None]
    sizes = 4 * width.astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    words = np.zeros(int(sizes.sum()), dtype=np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            words[starts[rows][:, None] + np.arange(4 * int(w))] = _pack(low[rows], int(w))
    parts = (starts.astype("<u4"), least.astype("<u4"), first_exception.astype("<u4"), width.astype("u1"), words.astype("<u4"), high.astype("<u4"), place)
    return _HEAD.pack(MAGIC, n, blocks, len(words), len(high)) + b"".join(p.tobytes() for p in parts)


def decode(data: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` (exclusive; the end if None) of a segment."""
    magic, n, blocks, n_words, n_high = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.empty(0, dtype=np.uint32)
    at = _HEAD.size
    take = lambda kind, count: np.frombuffer(data, dtype=kind, count=count, offset=at)
    starts = take("<u4", blocks).astype(np.int64)
    at += 4 * blocks
    least = take("<u4", blocks)
    at += 4 * blocks
    first_exception = take("<u4", blocks).astype(np.int64)
    at += 4 * blocks
    width = take("u1", blocks)
    at += blocks
    words = take("<u4", n_words)
    at += 4 * n_words
    high = take("<u4", n_high)
    at += 4 * n_high
    place = take("u1", n_high)
    b0, b1 = start // BLOCK, -(-stop // BLOCK)
    out = np.zeros((b1 - b0, BLOCK), dtype=np.uint32)
    for w in np.unique(width[b0:b1]):
        if w:
            rows = np.flatnonzero(width[b0:b1] == w)
            out[rows] = _unpack(words[starts[b0 + rows][:, None] + np.arange(4 * int(w))], int(w))
    e0, e1 = int(first_exception[b0]), int(first_exception[b1]) if b1 < blocks else n_high
    if e1 > e0:
        owner = np.searchsorted(first_exception[b0:b1], np.arange(e0, e1), side="right") - 1
        out[owner, place[e0:e1]] += (high[e0:e1].astype(np.uint64) << width[b0 + owner].astype(np.uint64)).astype(np.uint32)
    out += least[b0:b1, None]
    return out.reshape(-1)[start - b0 * BLOCK : stop - b0 * BLOCK]
