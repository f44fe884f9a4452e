"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.shared import cut as materialize
from folioflow.shared import discard, fresh, shared_path  # noqa: F401

#: The separators of ``[^\x20\x09-\x0D]+``; ``bytes.split()`` uses exactly these.
WORD_SEPARATORS = b" \t\n\x0b\x0c\r"
#: A key is heavy if it has more than one in ``HEAVY`` of all rows (and more than ``HEAVY_LEAST``): there are fewer than
#: ``HEAVY`` such keys whatever the data, so a table of them may be broadcast.
HEAVY, HEAVY_LEAST = 4096, 1024


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Columns that name a row by id and content, null-safe: rows alike in both have one key and one result."""
    return [
        F.coalesce(F.col(id_col), F.lit(-1)).cast("long").alias("k_id"),
        F.xxhash64(F.col(id_col).isNull(), F.col(text_col)).alias("k_text"),
    ]


def keyed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with :func:`row_key` under names that none of its columns has, and these names."""
    names = [fresh(docs.columns, n) for n in ("k_id", "k_text")]
    return docs.select("*", *(c.alias(n) for c, n in zip(row_key(id_col, text_col), names))), names


def heavy_keys(counts: DataFrame, total: int, least: int = HEAVY_LEAST) -> DataFrame:
    """``(key columns, parts)``: the heavy keys of ``counts`` (key columns, n), whose n sum up to ``total`` or less, and
    into how many parts each is to be dealt so that none has more rows than the limit. Fewer than ``HEAVY`` rows."""
    most = max(least, -(-total // HEAVY))
    return counts.where(F.col("n") > most).select(*(c for c in counts.columns if c != "n"), F.ceil(F.col("n") / most).cast("int").alias("parts"))


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], heavy: DataFrame, how: str = "inner", heavy_on: list[str] | None = None) -> DataFrame:
    """``rows`` joined with ``table`` (of one row per key) on ``keys``; both have only these columns in common, without nulls.

    Rows of a heavy key (:func:`heavy_keys`; by the columns ``heavy_on`` if not by all keys) are dealt over its parts, and
    the key's row of ``table`` is repeated for each part. Parts add up to less than two in ``HEAVY``, so little is repeated.
    """
    on = heavy_on or keys
    parts, salt = fresh([*rows.columns, *table.columns], "parts"), fresh([*rows.columns, *table.columns], "salt")
    few = F.broadcast(heavy.select(*on, F.col("parts").alias(parts)))
    dealt = rows.join(few, on, "left").withColumn(salt, F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col(parts).cast("long")), F.lit(0).cast("long")))
    repeated = table.join(few, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(parts).cast("long") - 1, F.lit(0).cast("long")))))
    columns = [*rows.columns, *(c for c in table.columns if c not in keys)]
    return dealt.drop(parts).join(repeated.drop(parts).hint("shuffle_hash"), [*keys, salt], how).select(*columns)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    if not pa.types.is_large_binary(column.type) and not pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return pc.fill_null(column, b"").to_pylist()


def ranges_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.diff(np.concatenate(([False], flags, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def merge_ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open ranges as disjoint ascending ranges; touching ones join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(starts) - 1]))
    return starts[new], ends[last]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (murmur3's) over an uint64 array."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
