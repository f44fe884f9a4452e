"""Round trips through the bibliographic formats, and the file-stream forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.shared import shared_path
from folioflow.sources import bibliography as S
from folioflow.streaming import incremental as I

from .dual import Book, works

B = Book()


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.trim(F.regexp_replace(F.regexp_replace(F.col("title"), r"[{}&@]", ""), r"\s+", " "))
    return works(spark, sf_dir).select(F.concat(F.lit("k"), "doc_id").alias("cite_key"), title.alias("title"), F.regexp_replace("authors", " and ", "; ").alias("authors"), "year", F.trim("doi").alias("doi"))


def ris_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "ris")
    S.to_ris(_titled(spark, sf_dir)).write.text(path)
    return S.read_ris(spark, path).select("title", "authors", "year", "doi")


def bibtex_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "bib")
    S.to_bibtex(_titled(spark, sf_dir)).write.text(path)
    return S.read_bibtex(spark, path).select("cite_key", "title", F.regexp_replace("authors", " and ", "; ").alias("authors"), "year", "doi")


_TITLED = r"SELECT concat('k', doc_id) AS cite_key, trim(regexp_replace(regexp_replace(title, '[{}&@]', '', 'g'), '\s+', ' ', 'g')) AS title, replace(authors, ' and ', '; ') AS authors, year, trim(doi) AS doi FROM "
B.add("ris_roundtrip", ris_roundtrip)
B.add("bibtex_roundtrip", bibtex_roundtrip)


def _with_works(sql: str) -> str:
    from .dual import WORKS

    return sql + "(" + WORKS.replace("{documents}", "documents") + ") w"


B.sql["ris_roundtrip"] = "SELECT title, authors, year, doi FROM (" + _with_works(_TITLED) + ") t"
B.sql["bibtex_roundtrip"] = _with_works(_TITLED)


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a pipe table with a header, a rule and a row for each of its lines; its data rows read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cell = F.regexp_replace(F.coalesce("source", F.lit("")), r"[|\s]", "")
    rows = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat(F.lit("| "), cell, F.lit(" |  "), i.cast("string"), F.lit(" | "), F.length(x).cast("string"), F.lit("|")))
    lines = F.concat(F.array(F.lit("prose | with a bar"), F.lit("|---|:-:|--|")), rows)
    table = docs.select("doc_id", F.posexplode(lines).alias("line_no", "line"))
    return S.read_markdown_tables(table).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.array_join("cells", "/").alias("cells"))


B.add("table_rows", table_rows, """
SELECT doc_id, n + 1 AS line_no, concat(regexp_replace(source, '[| ]', '', 'g'), '/', n - 1, '/', length(x)) AS cells
FROM (SELECT doc_id, source, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS x FROM (SELECT doc_id, coalesce(source, '') AS source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
""")


def stream_checkpoint_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended by a checkpointed file stream, run twice: the second run finds nothing new."""
    source, out, check = shared_path(spark, "in"), shared_path(spark, "out"), shared_path(spark, "check")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(source)
    for _ in range(2):
        I.checkpointed_append(I.stream_files(spark, source, events.schema, 4), out, check)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


B.add("stream_checkpoint_resume", stream_checkpoint_resume, "SELECT event_type, count(*) AS n FROM events GROUP BY 1")

QUERIES, SQL = B.queries, B.sql
