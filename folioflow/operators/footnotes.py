"""Footnotes of LaTeX texts: extraction, citations, adjacent notes, restyling; and math blocks and page ranges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

NOTES = "doc_id long, fn int, start long, stop long, content string, gap string"


def _balanced_end(text: str, at: int) -> int:
    """The place after the brace that closes the group open at ``at``; -1 if none does."""
    depth = 1
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 1
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return at + 1
        at += 1
    return -1


def extract_footnotes(docs: DataFrame) -> DataFrame:
    """A row (:data:`NOTES`) per ``\\footnote{...}`` of (doc_id, text); ``gap`` is the text since the note before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"].fillna("")):
                last, fn, mark = 0, 0, "\\footnote{"
                at = text.find(mark)
                while at >= 0:
                    stop = _balanced_end(text, at + len(mark))
                    if stop < 0:
                        break
                    fn += 1
                    out.append((doc_id, fn, at, stop, text[at + len(mark) : stop - 1], text[last:at]))
                    last, at = stop, text.find(mark, stop)
            yield pd.DataFrame(out, columns=["doc_id", "fn", "start", "stop", "content", "gap"])

    return docs.select("doc_id", "text").mapInPandas(run, NOTES)


@F.pandas_udf(ArrayType(StringType()))
def split_citations(content: pd.Series) -> pd.Series:
    """Parts between semicolons outside braces and parentheses, trimmed; empty ones are left out."""

    def split(text: str | None) -> list[str]:
        parts, depth, at = [], 0, 0
        for i, c in enumerate(text or ""):
            depth += (c in "{(") - (c in "})")
            if c == ";" and depth <= 0:
                parts.append(text[at:i].strip())
                at = i + 1
        return [p for p in [*parts, (text or "")[at:].strip()] if p]

    return content.map(split)


def lower_signal(c: Column) -> Column:
    """A leading citation signal in lower case."""
    return F.when(c.rlike(r"^(See|Cf\.|But|Accord|Compare)\b"), F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))).otherwise(c)


def merge_adjacent(notes: DataFrame, end: str = ".") -> DataFrame:
    """Notes with nothing but white space between them as one: parts joined by ``; `` without their final periods,
    signals after the first in lower case, ``end`` once; only groups of two and more. (doc_id, first_fn, n, content)"""
    order = Window.partitionBy("doc_id").orderBy("fn")
    new = F.when((F.col("fn") == 1) | (F.trim(F.regexp_replace("gap", r"\s", "")) != ""), 1).otherwise(0)
    grouped = notes.withColumn("island", F.sum(new).over(order)).groupBy("doc_id", "island")
    merged = grouped.agg(F.min("fn").alias("first_fn"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("fn", "content"))).alias("parts")).where("n > 1")
    bare = F.transform("parts", lambda p, i: F.when(i == 0, F.regexp_replace(p["content"], r"\.$", "")).otherwise(lower_signal(F.regexp_replace(p["content"], r"\.$", ""))))
    return merged.select("doc_id", "first_fn", "n", F.concat(F.array_join(bare, "; "), F.lit(end)).alias("content"))


def restyle(c: Column) -> Column:
    """Towards a style without Id., periods, months and ampersands: the rules one after another."""
    c = F.regexp_replace(c, r"(?i)^id\. at (\d+)\.?$", "ibid $1")
    c = F.regexp_replace(c, r"(?i)^id\.$", "ibid")
    c = F.regexp_replace(F.regexp_replace(c, r"supra note (\d+)", "(n $1)"), r" & ", " and ")
    c = F.regexp_replace(F.regexp_replace(c, r"et al\.", "and others"), r"\((?:Jan|Feb|Mar|Apr|May|June|July|Aug|Sept|Oct|Nov|Dec)\.? (\d{4})\)", "($1)")
    return F.when(c.rlike(r"(?:Inc|Co|Ltd|ed|eds|v)\.$"), c).otherwise(F.regexp_replace(c, r"\.$", ""))


def sanitize_math(block: Column) -> Column:
    """The inside of a ``$$`` block: null for debris, wrapped where it aligns without an environment, otherwise kept."""
    bare = F.regexp_replace(block, r"(?s)\\begin\{(\w+\*?)\}.*?\\end\{\1\}", "")
    return F.when(F.trim(block).isin("", "\\", "\\\\"), F.lit(None).cast("string")).when(bare.rlike(r"(?<!\\)&|\\\\"), F.concat(F.lit("\\begin{aligned}"), block, F.lit("\\end{aligned}"))).otherwise(block)


def parse_pages(spec: Column, n_pages: Column) -> Column:
    """Places from 0 of a list such as ``1-3,7``: clamped, distinct, in order; all pages for null; reversed ranges are empty."""
    part = lambda p: F.transform(F.split(p, "-"), lambda x: F.trim(x).cast("int"))
    lo, hi = (lambda p: F.greatest(part(p)[0], F.lit(1))), (lambda p: F.least(F.element_at(part(p), -1), n_pages))
    ranges = F.transform(F.split(spec, ","), lambda p: F.when(lo(p) <= hi(p), F.sequence(lo(p) - 1, hi(p) - 1)).otherwise(F.expr("array()").cast("array<int>")))
    return F.when(spec.isNull(), F.sequence(F.lit(0), n_pages - 1)).otherwise(F.array_distinct(F.flatten(ranges)))
