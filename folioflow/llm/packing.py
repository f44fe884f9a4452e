"""Operator 4, best-fit packing by exact-complement hashing.

Only lengths matter to a packing, and there are at most ``capacity`` of them: the plan is made from the histogram of
lengths (so of bounded size whatever the corpus), as patterns of lengths with a count. :func:`plan_sequences` takes the
longest length left, looks up a single, pair or triple of available lengths that fills its gap exactly, uses the pattern
as often as the counts allow, and where no such sum exists fills by best fit. Pieces get their rank within their length
over salted groups with summed offsets, so a length that a third of all pieces share is numbered in parallel.

Cases: a null text is empty and has the end id alone; texts beyond the capacity are cut, the rest may be shorter; equal
lengths are taken in order of a stored row number, so ties are settled; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_texts, materialize, read_documents
from .tokens import encoder, tokenizer_path

CAPACITY = 2048
#: Pieces of one length that a task numbers.
NUMBERED = 1 << 18

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, row bigint"
PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


class _Sums:
    """Which lengths are left, as bit sets that answer sums of one, two or three of them."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n, self.capacity = dict(counts), capacity
        self.bits = self.back = 0
        for x in self.n:
            self._show(x)

    def _show(self, x: int) -> None:
        self.bits |= 1 << x
        self.back |= 1 << self.capacity - x

    def take(self, x: int, k: int) -> None:
        self.n[x] -= k
        if not self.n[x]:
            self.bits &= ~(1 << x)
            self.back &= ~(1 << self.capacity - x)
        elif k < 0:
            self._show(x)

    def largest(self, most: int) -> int:
        return (self.bits & (1 << most + 1) - 1).bit_length() - 1

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """Two available lengths of this sum, none over ``most``; the longest first."""
        found = self.bits & (self.back >> self.capacity - total) & (1 << min(most, total) + 1) - 1
        while found:
            a = found.bit_length() - 1
            if 2 * a < total:
                return None
            if 2 * a > total or self.n[a] > 1:
                return a, total - a
            found &= ~(1 << a)
        return None

    def exact(self, total: int) -> tuple[int, ...] | None:
        if self.bits >> total & 1:
            return (total,)
        if found := self.pair(total, total):
            return found
        a = self.largest(total - 2) if total > 2 else 0
        while 3 * a >= total:
            self.take(a, 1)
            rest = self.pair(total - a, a)
            self.take(a, -1)
            if rest:
                return (a, *rest)
            a = self.largest(a - 1)
        return None


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots ``(length, first rank, count, first sequence, offset)``: pieces of a length and these ranks go to these sequences."""
    left = _Sums({x: n for x, n in histogram.items() if n > 0}, capacity)
    ranks = dict.fromkeys(left.n, 0)
    slots, sequence = [], 0
    while (top := left.largest(capacity)) > 0:
        pattern: list[int] = []
        x, gap = top, capacity
        while x > 0:  # lengths are taken while the pattern is sought, given back, then used as often as they last
            pattern.append(x)
            left.take(x, 1)
            gap -= x
            if gap and (found := left.exact(gap)):
                for x in found:
                    left.take(x, 1)
                pattern += found
                break
            x = left.largest(gap) if gap else 0
        for x in pattern:
            left.take(x, -1)
        times = min(left.n[x] // pattern.count(x) for x in set(pattern))
        offset = 0
        for x in pattern:
            slots.append((x, ranks[x], times, sequence, offset))
            ranks[x] += times
            left.take(x, times)
            offset += x
        sequence += times
    return slots


def cut_pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Every whole text as ids and end id, in pieces of at most ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, tail = encoder(tokenizer).encode, np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_texts(batch.column(2))):
                ids = memoryview(ids_of(text, tail))
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), row))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, numbered: int = NUMBERED) -> DataFrame:
    """Pieces (:data:`PIECES`) with the sequence and place each one goes to."""
    pieces = materialize(pieces, "pieces")
    histogram = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    slots = np.array(sorted(plan_sequences(histogram, capacity)), dtype=np.int64).reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast(slots)
    # The pieces of a length are numbered in as many groups as its count asks for.
    groups = F.array(*[F.lit(max(1, -(-histogram.get(k, 0) // numbered))).cast("long") for k in range(capacity + 1)])
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.element_at(groups, F.col("length").cast("int") + 1)))
    counts = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row", "piece"))
    ranked = pieces.withColumn("within", within).join(base, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("within") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        order = slots[:, 0] << 48 | slots[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            own = slots[np.searchsorted(order, length << 48 | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(own[:, 3] + rank - own[:, 1]), pa.array(own[:, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, PACKED)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut_pieces(read_documents(spark, sf_dir), tokenizer_path()))
