"""Operator 9, benchmark decontamination by the q-gram lemma.

A stretch of a document within ``e`` edits of a benchmark item of ``m`` characters shares at least ``m - q + 1 - q * e``
of its q-grams with it, on diagonals that lie within ``e`` of each other. Documents are read once: the places of their
q-grams are looked up in an index of the benchmark's, hits are counted per item in bands of ``2e + 1`` diagonals that
overlap by half (so one band holds all hits of a match), and bands that reach the lemma's bound are verified by
alignment within the band. Both sides are lower-cased with white space collapsed; spans are given in the original text.

The lemma holds from ``q`` characters on. Shorter items share no q-gram; they are looked for exactly, as whole words.

The index is broadcast: items come to the driver in blocks of at most ``BLOCK_CHARS`` characters (and one item). A larger
benchmark takes one reading of the documents for each block, whose findings are written and whose index is given up
before the next one is made.

Cases: null and blank texts and items match nothing; equal items are all reported; repeated rows are each reported; an
empty table on either side matches nothing; the columns of documents pass through, and where one of them is called like
the column of matches, that one gets a longer name (:func:`folioflow.shared.fresh`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, mix64, read_documents

Q = 8
#: Edits allowed for each character of an item.
EDIT_SHARE = 0.1
BLOCK_CHARS = 4_000_000
#: Characters, and pairs of a text and an item, that one step works on.
STEP, PAIRS = 1 << 19, 1 << 22
_BASE = 0x9E3779B97F4A7C15


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def origins(text: str) -> list[int]:
    """For every character of ``normal(text)`` the place in ``text`` that it comes from."""
    out: list[int] = []
    for m in re.finditer(r"\S+", text):
        if out:
            out.append(m.start() - 1)
        for k in range(m.start(), m.end()):
            out += [k] * len(text[k].lower())  # one letter can become two
    return out


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def qgram_hashes(code: np.ndarray) -> np.ndarray:
    """Hash of the eight characters from each place on, by doubling."""
    h, b = code.astype(np.uint64) + np.uint64(1), _BASE
    for k in (1, 2, 4):
        if len(h) <= k:
            return np.empty(0, dtype=np.uint64)
        h = h[:-k] * np.uint64(b) + h[k:]
        b = b * b % (1 << 64)
    return mix64(h)


def edits_allowed(m: int) -> int:
    """A tenth of the length, or less where the lemma would ask for no shared q-gram at all."""
    return max(0, min(int(EDIT_SHARE * m), (m - Q) // Q))


class Index:
    """q-grams of a block of items, by hash."""

    def __init__(self, items: list[tuple[int, str]]):
        named = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        self.items = [x for x in named if len(x[1]) >= Q]
        self.short: dict[str, list[int | None]] = {}
        for i, t in named:
            if len(t) < Q:
                self.short.setdefault(t, []).append(i)
        self.short_words = [re.compile(rf"(?<!\S){re.escape(t)}(?!\S)") for t in self.short]
        self.length = np.array([len(t) for _, t in self.items], dtype=np.int64)
        self.edits = np.array([edits_allowed(len(t)) for _, t in self.items], dtype=np.int64)
        self.bound = self.length - Q + 1 - Q * self.edits
        self.longest = int(self.length.max(initial=1))
        found = [qgram_hashes(codes(t)) for _, t in self.items]
        every = np.concatenate(found) if found else np.empty(0, dtype=np.uint64)
        order = np.argsort(every, kind="stable")
        self.hashes, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.item = np.repeat(np.arange(len(found)), [len(x) for x in found])[order]
        self.place = np.concatenate([np.arange(len(x)) for x in found] or [np.empty(0, dtype=np.int64)])[order]
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[self.hashes >> np.uint64(42)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the text, item and place in the item of every shared q-gram."""
        at = np.flatnonzero(self.bits[h >> np.uint64(42)])
        slot = np.searchsorted(self.hashes, h[at])
        slot[slot == len(self.hashes)] = 0
        ok = self.hashes[slot] == h[at] if len(self.hashes) else np.zeros(len(at), dtype=bool)
        at, slot = at[ok], slot[ok]
        n = self.count[slot]
        entry = np.repeat(self.first[slot] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(int(n.sum()))
        return np.repeat(at, n), self.item[entry], self.place[entry]


#: Bands that are aligned at once.
ALIGNED = 256


def band_distances(patterns: list[np.ndarray], texts: list[np.ndarray], low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between each pattern and a stretch of its text on diagonals ``low`` to ``low + width - 1``, and its end.

    All bands advance together, a row of the alignment for each character of the patterns. Places outside a text hold
    a letter that matches none, which costs what skipping the pattern's letter would.
    """
    m = np.array([len(p) for p in patterns])
    rows = int(m.max())
    pattern = np.zeros((len(patterns), rows), dtype=np.uint32)
    text = np.full((len(patterns), rows + width), 0xFFFFFFFF, dtype=np.uint32)
    for c, (p, t) in enumerate(zip(patterns, texts)):
        pattern[c, : len(p)] = p
        part = t[max(0, low[c]) : max(0, low[c] + rows + width)]
        text[c, max(0, -low[c]) : max(0, -low[c]) + len(part)] = part[: rows + width - max(0, -low[c])]
    step = np.arange(width)
    row = np.zeros((len(patterns), width), dtype=np.int64)
    for i in range(rows):
        new = row + (text[:, i : i + width] != pattern[:, i, None])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        new = np.minimum.accumulate(new - step, axis=1) + step
        row = np.where((i < m)[:, None], new, row)
    best = row.argmin(axis=1)
    return row[np.arange(len(row)), best], m + low + best


def short_matches(index: Index, text: str) -> Iterator[tuple[int | None, int, int]]:
    """``(item id, start, end)`` of the first place of each item of fewer than ``Q`` characters."""
    for (t, ids), pattern in zip(index.short.items(), index.short_words):
        if t in text and (m := pattern.search(text)):
            for i in ids:
                yield i, *m.span()


def matches(index: Index, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
    """``(text number, item number, start, end, edits)`` of items within their edits, the best for a text and item."""
    whole = "\x00".join(texts)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    at, item, place = index.hits(qgram_hashes(codes(whole)))
    if not len(at):
        return
    number = np.searchsorted(starts, at, side="right") - 1
    # A text that shares too few q-grams with an item has no band of it that reaches the bound.
    pair = number * len(index.items) + item
    enough = np.bincount(pair, minlength=len(texts) * len(index.items)) >= np.tile(index.bound, len(texts))
    pair, at, item, place, number = (x[enough[pair]] for x in (pair, at, item, place, number))
    diagonal = at - starts[number] - place
    band = np.floor_divide(diagonal, index.edits[item] + 1)
    least = int(band.min(initial=0)) - 1
    span = int(band.max(initial=0)) - least + 1
    key = np.concatenate((pair * span + band - least, pair * span + band - 1 - least))
    # Each q-gram of the item counts once in a band.
    key = np.unique(key * index.longest + np.tile(place, 2)) // index.longest
    key, n = np.unique(key, return_counts=True)
    pair, band = key // span, key % span + least
    t, i = pair // len(index.items), pair % len(index.items)
    ok = n >= index.bound[i]
    found = np.stack((t[ok], i[ok], band[ok]), axis=1)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    later: list[tuple[int, int, int, int]] = []
    for t, i, b in found.tolist():
        e, pattern, text = int(index.edits[i]), index.items[i][1], texts[t]
        low = b * (e + 1)
        a = max(0, low)
        if (exact := text.find(pattern, a, low + 2 * e + 1 + len(pattern))) >= 0:
            best[t, i] = (0, exact, exact + len(pattern))
        else:
            later.append((e, t, i, low))
    later = sorted(x for x in later if x[1:3] not in best)
    for lo in range(0, len(later), ALIGNED):
        part = later[lo : lo + ALIGNED]
        width = 2 * part[-1][0] + 1
        patterns = [codes(index.items[i][1]) for _, _, i, _ in part]
        # Only the band's stretch of each text is decoded.
        froms = [max(0, low) for *_, low in part]
        regions = [codes(texts[t][a : low + width + len(index.items[i][1]) + 1]) for (_, t, i, low), a in zip(part, froms)]
        edits, ends = band_distances(patterns, regions, np.array([low - a for (*_, low), a in zip(part, froms)]), width)
        for (e, t, i, _), a, d, end in zip(part, froms, edits.tolist(), ends.tolist()):
            if d <= e and d < best.get((t, i), (e + 1,))[0]:
                best[t, i] = (d, max(0, a + end - len(index.items[i][1])), min(a + end, len(texts[t])))
    for (t, i), (edits, start, end) in best.items():
        yield t, i, start, end, edits


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """Indexes of the benchmark, each of bounded size; at least one, which may be empty."""
    block, held, any_yet = [], 0, False
    for row in benchmark.select(F.col(id_col).cast("long"), text_col).toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1] or "")
        if held >= block_chars:
            yield Index(block)
            block, held, any_yet = [], 0, True
    if block or not any_yet:
        yield Index(block)


FOUND = "found array<struct<item_id:bigint,start:bigint,stop:bigint,edits:int>>"
_FOUND = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int32())]))


def with_matches(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", name: str = "found", keep: list[str] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` (or its columns ``keep``) with an array of the items found in each text, in order of item id, as the last
    column: ``name``, or a longer name where a column is called so."""
    columns = docs.columns if keep is None else keep
    name = fresh(columns, name)
    text = fresh([*columns, name], "text")
    kind = FOUND.split(" ", 1)[1]
    out = docs.select(*columns, F.col(text_col).alias(text), F.expr(f"cast(array() as {kind})").alias(name))
    place, held = len(columns), None
    for index in benchmark_blocks(benchmark, block_chars=block_chars):
        if held is not None:  # the findings so far are written, and the last block's index is given up
            out = materialize(out, "matches")
            held.destroy()
        held = shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                raw = batch.column(place).to_pylist()
                texts = [normal(t) for t in raw]
                new: list[list[dict]] = [[] for _ in texts]
                lo = 0
                while lo < len(texts):  # as many texts at once as make a step
                    hi, size = lo, 0
                    while hi < len(texts) and size < STEP and (hi - lo) * len(index.items) < PAIRS:
                        size += len(texts[hi])
                        hi += 1
                    for t, i, start, stop, edits in matches(index, texts[lo:hi]):
                        new[lo + t].append({"item_id": index.items[i][0], "start": start, "stop": stop, "edits": edits})
                    lo = hi
                found = [x or [] for x in batch.column(place + 1).to_pylist()]
                for k, (x, t) in enumerate(zip(new, texts)):
                    x += [{"item_id": i, "start": start, "stop": stop, "edits": 0} for i, start, stop in short_matches(index, t)]
                    if x:
                        origin = origins(raw[k])
                        for m in x:
                            m["start"], m["stop"] = origin[m["start"]], origin[m["stop"] - 1] + 1
                        found[k] = sorted(found[k] + x, key=lambda m: (m["item_id"] is not None, m["item_id"] or 0, m["start"]))
                yield pa.RecordBatch.from_arrays([*batch.columns[: place + 1], pa.array(found, _FOUND)], names=batch.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out.drop(text)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in whose text an item is found."""
    found = with_matches(docs, benchmark, text_col=text_col)
    return found.where(F.size(found.columns[-1]) == 0).select(*docs.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_matches(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    spans = F.transform("found", lambda x: F.concat_ws(":", *(x[c].cast("string") for c in ("item_id", "start", "stop", "edits"))))
    return found.select("doc_id", (F.size("found") > 0).alias("contaminated"), F.size("found").cast("long").alias("n_items"), F.concat_ws(",", spans).alias("matches"))
