"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, is written as Parquet and read again by the next. The first four return the
columns of ``documents``; the last one returns the pieces of the packed sequences.

Cases, in every stage: other columns pass through whatever they are called; an empty table gives an empty one. Null and
wordless texts fail the base rules, so the first stage drops them; given to a later stage, they are copies of each other,
match no benchmark item, hold no secret, and are packed as an end id alone. Rows alike in id and text are one document for
the second stage, and apart for the others. Null ids are kept as they are. Null languages and sources are groups (first
stage) and owners (fourth stage) of their own. A benchmark without items drops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import read_documents, shared_path
from folioflow.llm.decontaminate import drop_contaminated
from folioflow.llm.near_copies import keep_one_similar
from folioflow.llm.packing import cut_pieces, pack
from folioflow.llm.quality import keep_good
from folioflow.llm.secret_scan import redact
from folioflow.llm.tokens import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or lie far outside what is usual for their language and source."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of every group of texts with linked shingle sets (Jaccard of 0.8 or more)."""
    return keep_one_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document; credentials that look live give way to a mark, and ``n_chars`` follows; widely copied examples stay."""
    redacted = redact(docs)
    return redacted.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else redacted


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' ids into sequences."""
    return pack(cut_pieces(docs, tokenizer_path()))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Robust estimates, edit distances and a subword tokenizer are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
