"""RIS and BibTeX readers and writers, line-parallel: records are cut by Spark's text source, fields by built-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: RIS tags and the fields they fill.
RIS_TAGS = {"TI": "title", "AU": "authors", "PY": "year", "DO": "doi", "AB": "abstract", "JO": "journal", "UR": "url"}
FIELDS = list(RIS_TAGS.values())
BIB_FIELDS = {"title": "title", "author": "authors", "year": "year", "doi": "doi", "abstract": "abstract", "journal": "journal", "url": "url"}


def _ris_field(record: Column, tag: str) -> Column:
    lines = F.filter(F.split(record, r"\r?\n"), lambda x: x.startswith(f"{tag}  - "))
    return F.array_join(F.transform(lines, lambda x: F.trim(F.substring(x, 7, 1 << 30))), "; ")


def read_ris(spark: SparkSession, path: str) -> DataFrame:
    """A row per record; repeated tags join with ``; ``; missing ones are empty. Records end at an ``ER`` line."""
    raw = spark.read.option("lineSep", "ER  - ").text(path).where(F.col("value").contains("TY  - "))
    return raw.select(F.regexp_extract("value", r"TY  - (\w+)", 1).alias("type"), *[_ris_field(F.col("value"), t).alias(f) for t, f in RIS_TAGS.items()])


def to_ris(works: DataFrame) -> DataFrame:
    """One text column ``value``, a record each; several authors (``; ``) get a line each, line breaks become blanks."""
    line = lambda tag, c: F.concat(F.lit(f"{tag}  - "), F.regexp_replace(c, r"\s+", " "))
    authors = F.array_join(F.transform(F.split("authors", "; "), lambda a: line("AU", a)), "\n")
    fields = [authors if f == "authors" else F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", line(t, F.col(f).cast("string"))) for t, f in RIS_TAGS.items() if f in works.columns]
    return works.select(F.concat(F.concat_ws("\n", F.lit("TY  - JOUR"), *fields), F.lit("\nER  - \n")).alias("value"))


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """A row per entry: key, type and fields in braces or quotes (one level); an entry starts at a line with ``@``."""
    raw = spark.read.option("lineSep", "\n@").text(path).select(F.regexp_replace("value", "^@", "").alias("e")).where(F.col("e").rlike(r"^\w+\s*\{"))
    field = lambda name: F.trim(F.coalesce(F.nullif(F.regexp_extract("e", rf"(?is)[,\s]{name}\s*=\s*\{{([^{{}}]*)\}}", 1), F.lit("")), F.regexp_extract("e", rf'(?is)[,\s]{name}\s*=\s*"?([^",{{}}]*)', 1)))
    return raw.select(F.lower(F.regexp_extract("e", r"^(\w+)", 1)).alias("entry_type"), F.trim(F.regexp_extract("e", r"^\w+\s*\{([^,]*),", 1)).alias("cite_key"), *[field(b).alias(f) for b, f in BIB_FIELDS.items()])


def to_bibtex(works: DataFrame, key: str = "cite_key") -> DataFrame:
    """One text column ``value``, an entry each; ``&`` is escaped, braces are dropped, empty fields are left out."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c.cast("string"), r"\s+", " "), r"[{}]", ""), r"(?<!\\)&", r"\\\\&")
    fields = [F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", F.concat(F.lit(f"  {b} = {{"), clean(F.regexp_replace(F.col(f).cast("string"), "; ", " and ") if b == "author" else F.col(f)), F.lit("}"))) for b, f in BIB_FIELDS.items() if f in works.columns]
    return works.select(F.concat(F.lit("@article{"), F.col(key), F.lit(",\n"), F.concat_ws(",\n", *fields), F.lit("\n}\n")).alias("value"))


def read_markdown_tables(lines: DataFrame) -> DataFrame:
    """``(doc_id, line_no, cells)`` of the data rows of pipe tables in (doc_id, line_no, line); rules are left out."""
    row = F.col("line").rlike(r"^\s*\|.*\|\s*$") & ~F.col("line").rlike(r"^[\s|:\-]+$")
    return lines.where(row).select("doc_id", "line_no", F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x)).alias("cells"))
