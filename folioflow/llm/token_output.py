"""Operator 1, token-ID output: documents as patched frame-of-reference segments in ascending id order.

The output is a folder of Parquet files that carry segments of :mod:`folioflow.llm.pfor` as opaque bytes: any store
that Spark writes will do, and a lost executor's files are replaced by the commit protocol. One row is one segment:
``shard`` (ranges of ids ascend with it), ``segment`` (from 0 in its shard), ``doc_ids`` and ``lengths`` (its documents
in order, whole) and ``payload``.

Cases: a null text is empty and has the end id alone; a null id sorts first; rows that share an id stay separate and
sort by a hash of their text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pfor
from .common import byte_texts, read_documents, shared_path
from .tokens import encoder, tokenizer_path

#: A segment closes with the document that takes it to this many ids.
SEGMENT_IDS = 1 << 18

SEGMENTS = "shard int, segment int, doc_ids array<bigint>, lengths array<bigint>, payload binary"
SPANS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
    percentile: float = 90.0, segment_ids: int = SEGMENT_IDS,
) -> None:
    """Encode every whole text, append ``end_id`` and write segments to ``path``.

    Documents are range-partitioned by id (one shuffle, of the texts, which are smaller than their ids), so that
    shards follow each other in id order and each task encodes its shard in one pass with bounded memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, tail = encoder(tokenizer).encode, np.array([end_id], dtype="<u4").tobytes()
        shard, segment, ids, lengths, parts, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(parts), dtype="<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([lengths], pa.list_(pa.int64())), pa.array([pfor.encode(values, percentile)], pa.binary())],
                names=["shard", "segment", "doc_ids", "lengths", "payload"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                got = ids_of(text, tail)
                ids.append(doc_id)
                lengths.append(len(got) // 4)
                parts.append(got)
                held += len(got) // 4
                if held >= segment_ids:
                    yield flush()
                    segment, ids, lengths, parts, held = segment + 1, [], [], [], 0
        if ids:
            yield flush()

    order = ["__id", "__tie", "__row"]
    rows = docs.select(
        F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"),
        F.xxhash64(F.col(text_col)).alias("__tie"), F.monotonically_increasing_id().alias("__row"),
    )
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("__id", "__text")
    dealt.mapInArrow(run, SEGMENTS).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a token folder: id, ids before it, its number of ids and the checksum of the ids read."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    sizes = segments.select("shard", "segment", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    # One row per shard: as many as writing tasks, whatever the number of documents.
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    inner = Window.partitionBy("shard").orderBy("segment")
    starts = sizes.withColumn("inner", F.sum("n").over(inner) - F.col("n")).join(before, "shard")
    starts = starts.select("shard", "segment", (F.col("before") + F.col("inner")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, ids, lengths, payload in zip(*(batch.column(i).to_pylist() for i in range(4))):
                values = pfor.decode(payload).astype("<u4")
                ends = np.cumsum(lengths)
                begins = ends - lengths
                crc = [zlib.crc32(values[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(begins + at, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # The payload stays where it was read: the small side of the join is one row per segment.
    return segments.join(starts, ["shard", "segment"]).select("at", "doc_ids", "lengths", "payload").mapInArrow(run, SPANS)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_tokens(read_documents(spark, sf_dir), path, tokenizer_path())
    return read_tokens(spark, path)
