"""Operator 3, SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints within 3 bits of each other, cut into two halves, have a half that differs by at most one
bit. Every distinct fingerprint is indexed under its one-wildcard variants (a half with one bit left out: 64 of them);
fingerprints that meet under a variant are verified by their full distance. Only distinct fingerprints are indexed, so
a group of equal texts costs one entry, and tasks emit a spanning forest of the links they find, never all pairs.

A variant with more than ``bucket`` fingerprints is not compared in one task: its fingerprints are dealt again by
parts of the bits still free. Three differing bits cannot touch all of four parts, so a linked pair shares one; after
three such deals at most 14 bits remain free of 32 (plus the wildcard), which bounds every group by 2**15.

Cases: null and wordless texts have fingerprint 0 and link like any other; null ids keep their row and lend no
component id unless nothing else is there; repeated rows share a fingerprint; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.graph import connected_components

from .common import HEAVY_LEAST, byte_texts, heavy_keys, keyed_rows, materialize, read_documents, row_key, salted_join

SEED = 42
#: Fingerprints under one variant that a task compares directly.
BUCKET = 2048
#: How the bits still free are cut into four at each deal.
DEALS = [[sum(1 << b for b in range(64) if b // step % 4 == g) for g in range(4)] for step in (1, 4, 16)]

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of the space-joined word shingles of ``text``, repeats included; 0 without words."""
    w = text.translate(_LOWER).split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return digest(b" ".join(w), SEED)
    h = np.fromiter([digest(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(words)))], dtype=np.uint64, count=len(w) - words + 1)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes ``h``."""
    octets = h.view(np.uint8).reshape(-1, 8)
    if len(h) < 400:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0)
    else:
        ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, fp)``: a row per document, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in byte_texts(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id bigint, fp bigint")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links a-b (no longer than the number of nodes)."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints of equal key (sorted): compares each with its d-th successor, for every d in its run."""
    at = np.arange(len(key))
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    d = 1
    while len(at):
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        x, y = fp[at], fp[at + d]
        near = (np.bitwise_count(x ^ y) <= bits) & (x != y)
        left.append(fp[at[near]])
        right.append(fp[at[near] + d])
        d += 1
        if d % 64 == 0:
            a, b = _forest(np.concatenate(left), np.concatenate(right))
            left, right = [a], [b]
    return _forest(np.concatenate(left), np.concatenate(right)) if left else (key[:0], key[:0])


def compare(keyed: DataFrame, bits: int) -> DataFrame:
    """``(a, b)`` links of ``keyed`` (key, fp): dealt by key, compared in runs of the sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            again = key[1:] == key[:-1]
            shared = np.concatenate((again, [False])) | np.concatenate(([False], again))
            a, b = _links(key[shared], fp[shared].view(np.uint64), bits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        key = fp = np.empty(0, dtype=np.int64)
        for batch in batches:
            key = np.concatenate((key, batch.column(0).to_numpy()))
            fp = np.concatenate((fp, batch.column(1).to_numpy()))
            if len(key) >= 200_000 and key[0] != key[-1]:
                cut = int(np.searchsorted(key, key[-1]))
                yield from flush(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield from flush(key, fp)

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def near_links(prints: DataFrame, bits: int = 3, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)``: links that connect exactly the distinct fingerprints (column ``fp``) within ``bits`` <= 3 bits."""
    if not 0 <= bits <= 3:
        raise ValueError("two halves with one wildcard find up to 3 differing bits")
    half = lambda i: F.when(i < 32, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("fp", 32))
    # A variant gathers two exact halves: it can be large only if one of them is.
    halves = prints.select(F.explode(F.array(F.lit(0), F.lit(32))).alias("i"), "fp").select("i", half(F.col("i")).alias("h"))
    hot = halves.groupBy("i", "h").count().where(F.col("count") > bucket // 2)
    left_out = F.expr("shiftleft(1L, i % 32)")
    hot_keys = hot.select(F.explode(F.sequence(F.col("i"), F.col("i") + 31)).alias("i"), "h")
    hot_keys = hot_keys.select((F.expr("shiftleft(cast(i as bigint), 32)") + F.col("h") - F.col("h").bitwiseAND(left_out)).alias("key")).distinct()
    hot_keys = materialize(hot_keys, "simhash-hot")
    variants = prints.select(F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"), "fp").withColumn("h", half(F.col("i")))
    keyed = variants.select((F.expr("shiftleft(cast(i as bigint), 32)") + F.col("h") - F.col("h").bitwiseAND(left_out)).alias("key"), "fp")
    if hot_keys.isEmpty():
        return compare(keyed, bits)
    links = [compare(keyed.join(hot_keys, "key", "left_anti"), bits)]
    # Free bits of a large variant: the other half and the wildcard.
    i = F.shiftrightunsigned("key", 32)
    other = F.when(i < 32, F.lit(-1 << 32)).otherwise(F.lit(0xFFFFFFFF))
    rest = keyed.join(hot_keys, "key").select("key", "fp", other.bitwiseOR(F.expr("shiftleft(1L, cast(shiftrightunsigned(key, 32) as int))")).alias("free"))
    for k, masks in enumerate(DEALS):
        parts = F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m) for m in masks])
        dealt = rest.select("key", "fp", "free", F.posexplode(parts).alias("g", "mask")).withColumn("mask", F.col("mask").bitwiseAND(F.col("free")))
        dealt = dealt.select(F.xxhash64("key", "g", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp", F.col("free").bitwiseAND(F.bitwise_not("mask")).alias("free"))
        dealt = materialize(dealt, "simhash-deal")
        large = dealt.groupBy("key").count().where(F.col("count") > bucket).select("key")
        if k == len(DEALS) - 1 or large.isEmpty():
            links.append(compare(dealt.select("key", "fp"), bits))
            break
        large = materialize(large, "simhash-hot")
        links.append(compare(dealt.join(large, "key", "left_anti").select("key", "fp"), bits))
        rest = dealt.join(large, "key")
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3, bucket: int = BUCKET, heavy_least: int = HEAVY_LEAST) -> DataFrame:
    """``(doc_id, fp, component_id)``: a row per document; the component is the smallest id reachable over links."""
    rows = materialize(fingerprints(docs, id_col, text_col, words), "simhash-rows")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-prints")
    groups = connected_components(near_links(prints.select("fp"), bits, bucket))
    member = prints.join(groups, prints["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    member = materialize(member, "simhash-members")
    names = member.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    # A component of many prints and a print of many rows are both dealt to several tasks.
    roots = materialize(heavy_keys(names.select("root", "n"), prints.count(), heavy_least), "simhash-heavy")
    named = salted_join(member.select("fp", "root"), names.select("root", "component_id"), ["root"], roots).select("fp", "component_id")
    heavy = materialize(heavy_keys(prints.select("fp", "n"), rows.count(), heavy_least), "simhash-heavy")
    return salted_join(rows, named, ["fp"], heavy).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with one row of each group of linked fingerprints: that of the smallest id, then of the smallest text hash."""
    keyed = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in byte_texts(batch.column(3))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found.view(np.int64))], names=["k_id", "k_text", "doc_id", "fp"])

    rows = materialize(keyed.mapInArrow(run, "k_id bigint, k_text bigint, doc_id bigint, fp bigint"), "simhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k_id", "k_text")).alias("first")
    prints = materialize(rows.groupBy("fp").agg(first), "simhash-prints")
    groups = connected_components(near_links(prints.select("fp"), bits, bucket))
    member = prints.join(groups, prints["fp"] == groups["node"], "left").select("first", F.coalesce("component", "fp").alias("root"))
    kept = member.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.k_id").alias("k_id"), F.col("first.k_text").alias("k_text"))
    return one_row_each(docs, kept, rows, id_col, text_col)


def one_row_each(docs: DataFrame, kept: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose key is in ``kept`` (k_id, k_text), one of those alike in id and text. ``rows`` has the
    keys of all."""
    keyed, names = keyed_rows(docs, id_col, text_col)
    out = keyed.join(kept.select(*(F.col(c).alias(n) for c, n in zip(("k_id", "k_text"), names))).hint("shuffle_hash"), names, "left_semi")
    if not rows.groupBy("k_id", "k_text").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(names)
    return out.select(*docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
