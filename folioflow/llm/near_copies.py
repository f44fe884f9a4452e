"""Near copies for the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts of equal sets are one class. Its SimHash (64 bits, of the set) is filed under one-wildcard variants as in
:mod:`simhash`, with a wider budget: of four segments one differs by at most a bit if ``BITS`` = 7 bits differ or fewer.
Classes that a variant brings that close are connected to families. Each family's sets travel once to one task, which
decides every pair by the exact Jaccard similarity and emits a spanning forest of the links found; a family beyond
``PART`` shingles or ``MEMBERS`` classes is cut into parts, and a task gets two of them, so all pairs still meet.

Pairs of that similarity differ in up to 14 bits, and variants for these would hold as good as everything. So what the
first step leaves apart goes through a second: the MinHash signature of a class (``BANDS`` bands of ``ROWS`` values)
brings groups of the first step together; those that share a band are linked to the band's first, and the connected ones
are a family, decided likewise. Groups that share no band with another take no part.

A pair of similarity exactly 0.8 shares no band with a probability of 2e-8, one of 0.85 of 6e-14; nothing that shares a
band or lies within ``BITS`` is skipped, and nothing is linked on an estimate.

Cases: a text of up to five words is one shingle; null and wordless texts have the empty set and are copies of each
other; ids and repeated rows are treated as in :mod:`simhash`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators.graph import connected_components

from .common import HEAVY_LEAST, byte_texts, heavy_keys, materialize, mix64, row_key, salted_join
from .simhash import BUCKET, compare, majority, one_row_each

SEED = 42
WORDS = 5
#: Least similarity, as a fraction.
SHARE = (4, 5)
#: Bits in which fingerprints of the first step may differ, and the bits of a segment.
BITS, SEGMENT = 7, 16
BANDS, ROWS = 96, 8
#: Shingles and classes of a part; a task holds two parts.
PART, MEMBERS = 2_000_000, 4096

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RNG = np.random.default_rng(SEED)
_A = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_C = _RNG.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _RNG.integers(0, 2**63, BANDS, dtype=np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of ``text``."""
    w = text.translate(_LOWER).split()
    if not w:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(w) <= WORDS:
        return np.array([digest(b" ".join(w), SEED)], dtype=np.uint64)
    return np.unique(np.fromiter([digest(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(WORDS)))], dtype=np.uint64, count=len(w) - WORDS + 1))


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of the MinHash signature of a set; none of the empty set."""
    if not len(found):
        return np.empty(0, dtype=np.int64)
    x = found.astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(least, (x[at : at + 256, None] * _A + _B).min(axis=0), out=least)
    return mix64((least.reshape(BANDS, ROWS).astype(np.uint64) * _C).sum(axis=1) + _SALT).view(np.int64)


def _set_key(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect exactly what the pairs of similar ``sets`` connect: breadth first, each set is compared with
    those that no link has reached yet."""
    p, q = SHARE
    size = np.array([len(s) for s in sets])
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(size)))
    own = [ids[starts[i] : starts[i + 1]] for i in range(len(sets))]
    flag = np.zeros(len(values), dtype=np.uint8)
    left = np.argsort(size, kind="stable")  # not reached yet
    alive = np.ones(len(sets), dtype=bool)
    held, offsets = left, None
    found: list[tuple[int, int]] = []
    queue: list[int] = []
    while True:
        if not queue:
            left = left[alive[left]]
            if len(left) < 2:
                return found
            queue.append(int(left[0]))
            alive[left[0]] = False
        i = queue.pop()
        if offsets is None or 2 * alive[held].sum() < len(held):
            held = held[alive[held]]
            if not len(held):
                return found
            pool = np.concatenate([own[j] for j in held])
            offsets = np.concatenate(([0], np.cumsum(size[held])))
        # Only sizes of the given share can be similar; ``held`` is in order of size.
        a, b = np.searchsorted(size[held], -(-p * size[i] // q)), np.searchsorted(size[held], q * size[i] // p, side="right")
        if a == b:
            continue
        flag[own[i]] = 1
        both = np.add.reduceat(flag[pool[offsets[a] : offsets[b]]], offsets[a:b] - offsets[a], dtype=np.int64)
        flag[own[i]] = 0
        near = held[a:b][((p + q) * both >= p * (size[i] + size[held[a:b]])) & alive[held[a:b]]]
        alive[near] = False
        found += [(i, int(j)) for j in near]
        queue += near.tolist()


def near_prints(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)``: links that connect exactly the distinct fingerprints (column ``fp``) within ``BITS`` bits.

    A variant of more than ``bucket`` fingerprints is cut into parts, and a task gets two of them, so all pairs still meet."""
    i, low = F.col("i"), (1 << SEGMENT) - 1
    segment = F.expr(f"shiftrightunsigned(fp, i div {SEGMENT} * {SEGMENT})").bitwiseAND(low)
    wildcard = F.expr(f"shiftleft(1L, i % {SEGMENT})")
    keyed = prints.select(F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"), "fp")
    keyed = keyed.select((i.cast("long") * (low + 1) + segment - segment.bitwiseAND(wildcard)).alias("key"), "fp")
    large = keyed.groupBy("key").count().where(F.col("count") > bucket)
    large = materialize(large.select("key", F.ceil(F.col("count") / bucket).cast("int").alias("parts")), "copies-large")
    if large.isEmpty():
        return compare(keyed, BITS)
    # Fewer than four million keys in all, and large ones hold ``bucket`` rows each.
    dealt = keyed.join(large, "key").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = dealt.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "fp")
    return compare(keyed.join(large, "key", "left_anti"), BITS).unionByName(compare(pairs, BITS)).distinct()


def _first_of_band(keyed: DataFrame) -> DataFrame:
    """``(a, b)``: each ``fp`` of ``keyed`` (key, fp) with the first of its band, read in order of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_first = None
        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            new = np.concatenate(([last_key is None or key[0] != last_key], key[1:] != key[:-1]))
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            first = np.where(at >= 0, fp[at], fp[0] if last_first is None else last_first)
            last_key, last_first = key[-1], first[-1]
            other = first != fp
            if other.any():
                yield pa.RecordBatch.from_arrays([pa.array(first[other]), pa.array(fp[other])], names=["a", "b"])

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint").distinct()


def _verified(members: DataFrame) -> DataFrame:
    """``(a, b)``: links of similar classes within the groups of ``members`` (grp, fp, found)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(names: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            links = forest(sets) if len(sets) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([names[x] for x, _ in links], pa.int64()), pa.array([names[y] for _, y in links], pa.int64())], names=["a", "b"])

        now, names, sets = None, [], []
        for batch in batches:
            for grp, fp, found in zip(*(c.to_pylist() for c in batch.columns)):
                if grp != now:
                    yield from flush(names, sets)
                    now, names, sets = grp, [], []
                names.append(fp)
                sets.append(np.frombuffer(found, dtype=np.uint64))
        yield from flush(names, sets)

    return members.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "a bigint, b bigint")


def keep_one_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part: int = PART, members: int = MEMBERS, bucket: int = BUCKET, heavy_least: int = HEAVY_LEAST) -> DataFrame:
    """``docs`` with one row of each group of linked near copies: that of the smallest id, then of the smallest text hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in byte_texts(batch.column(3))]
            prints = np.array([majority(s) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
            columns = [pa.array([_set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["k_id", "k_text", "doc_id", "fp", "n", "print", "bands"])

    def read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t).tobytes() for t in byte_texts(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], names=["fp", "family", "parts", "found"])

    def verified(member: DataFrame) -> DataFrame:
        """``(a, b)``: links of similar classes within the families of ``member`` (fp, n, k_id, k_text, family; written)."""
        sizes = materialize(member.groupBy("family").agg(F.ceil(F.greatest(F.sum("n") / part, F.count(F.lit(1)) / members)).cast("int").alias("cuts"), F.count(F.lit(1)).alias("n")), "copies-sizes")
        heavy = materialize(heavy_keys(sizes.select("family", "n"), member.count(), heavy_least), "copies-heavy")
        sized = salted_join(member.drop("n"), sizes.where("n > 1").select("family", F.col("cuts")), ["family"], heavy).select("k_id", "k_text", "fp", "family", F.col("cuts").alias("parts"))
        # One text of each class: rows alike in id and text have one key.
        texts = keyed.select("k_id", "k_text", "text").join(sized.hint("shuffle_hash"), ["k_id", "k_text"])
        sets = texts.select("fp", "family", "parts", "text").mapInArrow(read_sets, "fp bigint, family bigint, parts int, found binary")
        mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        dealt = sets.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        grp = F.xxhash64("family", F.least("mine", "other"), F.greatest("mine", "other")).alias("grp")
        return materialize(_verified(dealt.select(grp, "fp", "found")), "copies-links")

    keyed = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(keyed.mapInArrow(run, "k_id bigint, k_text bigint, doc_id bigint, fp bigint, n bigint, print bigint, bands array<bigint>"), "copies-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k_id", "k_text")).alias("first")
    classes = materialize(rows.groupBy("fp").agg(first, F.first("n").alias("n"), F.first("print").alias("print")), "copies-classes")
    named = classes.where("n > 0").select("fp", "n", "print", F.col("first.k_id").alias("k_id"), F.col("first.k_text").alias("k_text"))
    # First step: fingerprints that a variant brings within ``BITS``, or that are equal.
    close = connected_components(near_prints(named.select(F.col("print").alias("fp")).distinct(), bucket))
    member = named.join(close, named["print"] == close["node"], "left").select("fp", "n", "k_id", "k_text", F.coalesce("component", "print").alias("family"))
    links = verified(materialize(member, "copies-members"))
    # Second step: groups of the first that share a band.
    groups = connected_components(links)
    rooted = materialize(named.join(groups, named["fp"] == groups["node"], "left").select("fp", "n", "k_id", "k_text", F.coalesce("component", "fp").alias("root")), "copies-rooted")
    signed = rows.select("fp", "k_id", "k_text", "bands").join(rooted.select("fp", "k_id", "k_text", "root"), ["fp", "k_id", "k_text"]).select("root", "bands")
    families = materialize(connected_components(_first_of_band(signed.select(F.explode("bands").alias("key"), F.col("root").alias("fp")))), "copies-families")
    heavy = materialize(heavy_keys(rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n")), rooted.count(), heavy_least), "copies-heavy")
    member = salted_join(rooted, families.select(F.col("node").alias("root"), F.col("component").alias("family")), ["root"], heavy).drop("root")
    links = links.unionByName(verified(materialize(member, "copies-members")))
    groups = connected_components(links)
    left = classes.join(groups, classes["fp"] == groups["node"], "left").select("first", F.coalesce("component", "fp").alias("root"))
    kept = left.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.k_id").alias("k_id"), F.col("first.k_text").alias("k_text"))
    return one_row_each(docs, kept, rows, id_col, text_col)
