"""Operator 10, sharding by a two-pass external shuffle, in DataFrame functions alone.

The first pass scatters records by seeded hashes: the id and the number of shards decide the shard (the shard of the
largest hash of id and shard, so one more shard takes records only into itself), and a hash of the whole record and its
row number deals the shard's records evenly over buckets of about ``BUCKET_BYTES``, however often an id or text repeats;
how many buckets a shard has follows from its own bytes. The second pass shuffles each bucket in memory with the engine's
Fisher-Yates ``shuffle``, in one task, and writes it.

Buckets are dealt to as many partitions as have ``TASK_BYTES`` each. The number of partitions depends on the bytes alone,
a partition's buckets are in order, and a bucket's records are sorted before they are shuffled, so the engine's
generators, which start anew in each partition, see the same arrays on any cluster: what is written depends on the seed,
the records and how the input is cut into files' splits (which gives rows their numbers).

Cases: a null text counts as empty; a null id hashes like any value; repeated rows are separate records; an empty table
gives empty shards; all other columns travel along under ``record``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_documents, shared_path

SHARDS = 16
SEED = 20_240_229
#: Bytes of texts in a bucket, and in the buckets of one task.
BUCKET_BYTES, TASK_BYTES = 4 << 20, 16 << 20
#: Buckets (a row of 24 bytes each) whose offsets are broadcast; of more, they are joined by shuffle.
FEW_BUCKETS = 200_000


def shard_of(key: str, shards: int, seed: int = SEED) -> Column:
    """The shard whose hash with ``key`` is largest; ties go to the higher number."""
    scores = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), F.col(key)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return (F.greatest(*scores) if shards > 1 else scores[0])["s"]


def write_shards(
    docs: DataFrame, path: str, *, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, task_bytes: int = TASK_BYTES, seed: int = SEED
) -> None:
    """Write ``(shard, bucket, place, record)`` to ``path``, partitioned by shard; places are gapless in their bucket."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    bytes_of = {r[0]: r[1] for r in docs.select(shard_of(id_col, shards, seed).alias("shard"), size.alias("size")).groupBy("shard").agg(F.sum("size")).collect()}  # a row per shard
    buckets = [max(1, -(-bytes_of.get(s, 0) // bucket_bytes)) for s in range(shards)]
    tasks = max(1, -(-sum(bytes_of.values()) // task_bytes))
    row = F.monotonically_increasing_id()
    scattered = docs.select(shard_of(id_col, shards, seed).alias("shard"), F.struct(*[F.col(c) for c in docs.columns]).alias("record"), F.xxhash64(F.lit(~seed), F.xxhash64(id_col, text_col), row).alias("h"), row.alias("row"))
    own = F.element_at(F.array(*[F.lit(b).cast("long") for b in buckets]), F.col("shard") + 1)
    placed = scattered.select("shard", F.pmod("h", own).alias("bucket"), "row", "record").repartition(tasks, "shard", "bucket")
    gathered = placed.groupBy("shard", "bucket").agg(F.array_sort(F.collect_list(F.struct("row", "record"))).alias("records"))
    shuffled = gathered.sortWithinPartitions("shard", "bucket").select("shard", "bucket", F.posexplode(F.shuffle("records", F.lit(seed))).alias("place", "r"))
    shuffled.select("shard", "bucket", F.col("place").cast("long").alias("place"), F.col("r.record").alias("record")).write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a shard folder with ``slot``, gapless from 0 in each shard in the order written."""
    rows = spark.read.schema(schema).parquet(path)
    buckets = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    base = buckets.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("base"))
    few = buckets.limit(FEW_BUCKETS + 1).count() <= FEW_BUCKETS
    return rows.join(F.broadcast(base) if few else base, ["shard", "bucket"]).withColumn("slot", F.col("base") + F.col("place")).drop("base", "place")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    path = shared_path(spark, "shards")
    write_shards(docs, path)
    kind = docs.schema.simpleString()
    rows = read_shards(spark, path, f"bucket bigint, place bigint, record {kind}, shard int")
    text = F.coalesce(F.col("record.text"), F.lit(""))
    rows = rows.select(
        F.col("record.doc_id").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
    )
    return rows.withColumn("grown_shard", shard_of("doc_id", SHARDS + 1).cast("int"))
