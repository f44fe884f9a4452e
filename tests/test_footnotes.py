"""Footnotes, math blocks and page ranges on planted cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import footnotes as N


def test_extraction_and_merge(spark):
    text = r"A\footnote{See \emph{Work}; Smith (a; b).} \footnote{See Doe.} text\footnote{Id.} open\footnote{x"
    notes = N.extract_footnotes(spark.createDataFrame([(1, text), (2, None), (3, "none")], "doc_id long, text string"))
    assert [r["content"] for r in notes.orderBy("fn").collect()] == [r"See \emph{Work}; Smith (a; b).", "See Doe.", "Id."]
    assert [tuple(r) for r in N.merge_adjacent(notes).collect()] == [(1, 1, 2, r"See \emph{Work}; Smith (a; b); see Doe.")]
    parts = notes.where("fn = 1").select(N.split_citations("content").alias("p")).first()["p"]
    assert parts == [r"See \emph{Work}", "Smith (a; b)."]


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(column).collect()]


def test_restyle(spark):
    assert one(spark, N.restyle(F.col("v")), "Id.", "Id. at 350.", "Smith, supra note 1, at 347.", "Doe & Roe (Jan. 2020).", "Acme Inc.", "Smith et al., X.") == [
        "ibid", "ibid 350", "Smith, (n 1), at 347", "Doe and Roe (2020)", "Acme Inc.", "Smith and others, X",
    ]


def test_math(spark):
    assert one(spark, N.sanitize_math(F.col("v")), "a & b", "\\", "x = y", "\\begin{matrix}a & b\\end{matrix}") == ["\\begin{aligned}a & b\\end{aligned}", None, "x = y", "\\begin{matrix}a & b\\end{matrix}"]


def test_pages(spark):
    assert one(spark, N.parse_pages(F.col("v"), F.lit(9)), "1-3,2,7", None, "5-2", "8-99999999") == [[0, 1, 2, 6], list(range(9)), [], [7, 8]]
