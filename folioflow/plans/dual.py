"""SQL that Spark and DuckDB read alike, with the few spellings that differ marked."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: A works table (title, abstract, authors, year, doi, journal, source, score) derived from the rows of ``documents``.
WORKS = """
SELECT doc_id, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS abstract,
       CASE doc_id % 3 WHEN 0 THEN concat('Ann B. Smith', doc_id % 11, '; John Doe', doc_id % 7)
                       WHEN 1 THEN concat('Smith', doc_id % 11, ', Ann and Doe', doc_id % 7, ', John') ELSE concat('Jane Roe', doc_id % 5) END AS authors,
       CASE doc_id % 6 WHEN 5 THEN 'n.d.' WHEN 4 THEN concat('c. ', 1980 + doc_id % 45, ' rev.') ELSE concat('', 1980 + doc_id % 45) END AS year,
       CASE doc_id % 4 WHEN 0 THEN concat('https://doi.org/10.1000/X', doc_id % 300) WHEN 1 THEN concat(' 10.1000/x', doc_id % 300)
                       WHEN 2 THEN concat('http://doi.org/10.1000/x', doc_id % 300, '/.') ELSE '' END AS doi,
       CASE doc_id % 5 WHEN 0 THEN 'NBER Working Paper Series' WHEN 1 THEN 'Forthcoming, Journal of Law' WHEN 2 THEN 'Journal of Widget Studies'
                       WHEN 3 THEN 'Handbook of Widgets' ELSE '' END AS journal,
       source, doc_id % 11 AS score, n_chars
FROM {documents}
"""


RAW = re.compile(r"\br'")


class Book:
    """Queries and their SQL, added under a name."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def dual(self, name: str, sql: str, *tables: str) -> None:
        """One text for both engines over ``tables``; ``{works}`` stands for :data:`WORKS`.

        ``/*g*/`` marks a replacement of all matches (Spark's only kind), ``r'...'`` a literal without escapes.
        """
        if "{works}" in sql:
            sql, tables = sql.replace("{works}", f"({WORKS})"), (*tables, "documents")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.sql(sql.replace("/*g*/", ""), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})

        self.queries[name] = run
        duck = RAW.sub("'", sql).replace("/*g*/", ", 'g'").replace("{{", "{").replace("}}", "}")
        for t in tables:
            duck = duck.replace("{" + t + "}", t)
        self.sql[name] = duck

    def add(self, name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
        self.queries[name] = query
        if sql:
            self.sql[name] = sql.replace("{works}", f"({WORKS.replace('{documents}', 'documents')})")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(WORKS, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))
