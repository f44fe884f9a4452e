"""Queries of the document readers: files, notes and labels made from the tables, read back and compared."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import fidelity as Q
from folioflow.operators import labels as L
from folioflow.operators import markers as M
from folioflow.sources import office as O

from .dual import Book

B = Book()

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _archive(parts: dict[str, str]) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return held.getvalue()


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def word_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a Word file of a paragraph per line; paragraphs with a small letter, and their characters."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                lines = [escape(re.sub(r"[^\t\x20-\uD7FF\uE000-\uFFFD\U00010000-\U0010FFFF]", "", x)) for x in text.split("\n")]
                body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{x}</w:t></w:r></w:p>' for x in lines)
                out.append((str(doc_id), _archive({"word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>'})))
            yield pd.DataFrame(out, columns=["path", "content"])

    read = O.paragraphs(_documents(spark, sf_dir).mapInPandas(made, "path string, content binary"))
    letters = F.length(F.regexp_replace("text", "[^a-z]", ""))
    return read.where(letters > 0).groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_paragraphs"), F.sum(letters).cast("long").alias("n_letters"))


B.add("word_paragraphs", word_paragraphs, """
WITH l AS (SELECT doc_id, length(regexp_replace(unnest(string_split(text, chr(10))), '[^a-z]', '', 'g')) AS n FROM documents)
SELECT doc_id, count(*) AS n_paragraphs, CAST(sum(n) AS BIGINT) AS n_letters FROM l WHERE n > 0 GROUP BY 1
""")


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as spreadsheets, a file for each batch, read back under the header's fields."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell = lambda x: f'<c t="inlineStr"><is><t>{escape(str(x))}</t></is></c>'
        for pdf in batches:
            lines = ["".join(map(cell, ("Title", "Score", "Extra"))), *("".join(map(cell, (t, s, "x"))) for t, s in zip(pdf["n_name"], pdf["n_nationkey"]))]
            yield pd.DataFrame([("nation", _archive({
                "xl/workbook.xml": f'<workbook xmlns="{SHEET}" xmlns:r="{RELATIONS}"><sheets><sheet name="s" r:id="r1"/></sheets></workbook>',
                "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
                "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{SHEET}"><sheetData>{"".join(f"<row>{x}</row>" for x in lines)}</sheetData></worksheet>',
            }))], columns=["path", "content"])

    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    cells = O.sheet(nation.select("n_name", "n_nationkey").mapInPandas(made, "path string, content binary"))
    return O.sheet_rows(cells, {"title": "title", "score": "score"}).select("title", F.col("score").cast("long").alias("score"))


B.add("sheet_rows", sheet_rows, "SELECT n_name AS title, CAST(n_nationkey AS BIGINT) AS score FROM nation")


def marker_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation as a body whose sentences end in marks, and as the notes that they mean."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("k"), "role")
    body = turns.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda k: F.concat(F.lit("It is so. "), k.cast("string"))), " ").alias("body"))
    fragments = turns.select("doc_id", F.col("k").alias("ord"), F.concat(F.col("k").cast("string"), F.lit(". By ["), F.coalesce("role", F.lit("")), F.lit("]")).alias("text"))
    return M.link_markers(body, M.number_notes(fragments)).select("doc_id", "body", F.size("linked").cast("long").alias("n_linked"))


B.add("marker_links", marker_links, r"""
SELECT conv_id AS doc_id, string_agg(concat('It is so.^[By \[', coalesce(role, ''), '\]]'), ' ' ORDER BY turn) AS body, count(*) AS n_linked FROM conversations GROUP BY 1
""")


def label_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of every document to two labels of its own and one that is missing."""
    docs = _documents(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("d"))
    aux = docs.select("doc_id", F.format_string("\\newlabel{tab:a}{{%s}{1}}\n\\newlabel{tab:b}{{B.%s}{2}}\n\\newlabel{tab:b@cref}{{[section][1][]2}{2}}", "d", "d").alias("text"))
    text = docs.select("doc_id", F.lit(r"See \cref{tab:a} and \Cref{tab:b}; \eqref{eq:x}, \crefrange{tab:a}{tab:b}.").alias("text"))
    found = L.resolve_references(text, L.aux_labels(aux))
    return found.select("doc_id", "text", F.col("n_refs").cast("long").alias("n_refs"), F.array_join("missing", ",").alias("missing"))


B.add("label_references", label_references, """
SELECT doc_id, concat('See Table ', doc_id, ' and Appendix B.', doc_id, '; (??eq:x??), Table ', doc_id, '-Appendix B.', doc_id, '.') AS text, CAST(4 AS BIGINT) AS n_refs, 'eq:x' AS missing FROM documents
""")

def fidelity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against itself without its first line and with a mark left in each ``the``."""
    docs = _documents(spark, sf_dir).withColumn("converted", F.expr(r"replace(substr(text, length(split_part(text, '\n', 1)) + 2), ' the ', ' $the ')"))
    return Q.report(docs, compiled="text")


B.add("fidelity_report", fidelity_report, r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS a, replace(substr(coalesce(text, ''), length(split_part(coalesce(text, ''), chr(10), 1)) + 2), ' the ', ' $the ') AS b FROM documents),
t AS (SELECT *, [lower(x) for x in regexp_extract_all(a, '\d[\d.,]*\d|\d|[\p{L}\p{M}]+') if length(x) > 2 or regexp_matches(x, '^\d')] AS ta, [lower(x) for x in regexp_extract_all(b, '\d[\d.,]*\d|\d|[\p{L}\p{M}]+') if length(x) > 2 or regexp_matches(x, '^\d')] AS tb FROM d),
u AS (SELECT doc_id, a, b, list_distinct(ta) AS ua, [x for x in list_distinct(ta) if not list_contains(tb, x)] AS gone FROM t),
m AS (SELECT doc_id, len(ua) AS n_tokens, len(gone) AS n_missing, len([x for x in gone if regexp_matches(x, '^\d')]) AS n_missing_numbers, CASE WHEN len(ua) > 0 THEN 100.0 * len(gone) / len(ua) ELSE 0.0 END AS pct,
  CAST(list_sum([greatest(0, (length(b) - length(replace(b, k, ''))) // length(k) - (length(a) - length(replace(a, k, ''))) // length(k)) for k in
    ['\cref', '\Cref', '\textit', '\textbf', '\begin', '\includegraphics', '\sym', '\footnote', '\multicolumn', '\multirow', '\toprule', '\cmidrule', '%%TABLE', '%%FIGURE', '%%PAGEBREAK', '$', '^{{', '_{{']]) AS BIGINT) AS n_leftover FROM u)
SELECT doc_id, n_tokens, n_missing, n_missing_numbers, round(pct, 2) AS missing_percent, n_leftover, CASE WHEN pct < 3 AND n_leftover = 0 THEN 'OK' ELSE 'FLAG' END AS verdict FROM m
""".replace("{{", "{"))

QUERIES, SQL = B.queries, B.sql
