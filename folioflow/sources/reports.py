"""Papers out of written reports: the section of key papers, its table rows and narrative entries, links in JSON, and raw
hits. Null texts and cells count as empty; the group of every window is one report."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of header cells, depth of a walk, least lengths of titles.
HEADERS = {"title": ["title"], "authors": ["authors", "author", "authors (comma-separated)"], "venue": ["venue", "journal", "venue or journal", "venue/journal"]}
DEPTH, LINK_TITLE, HIT_TITLE = 200, 9, 6
DOI = r"10\.\d{4,9}/\S+"

_FENCE = r"^\s*(?:```|~~~)"


def _strip(c: Column, extra: str = "") -> Column:
    return F.regexp_replace(c, rf"^[\s{extra}]+|[\s{extra}]+$", "")


def _emphasis(c: Column) -> Column:
    return _strip(_strip(c), "*_")


def year(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"((?:19|20)\d{2})", 1)


def doi_url(c: Column) -> Column:
    found = F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), f"({DOI})", 1), r"[).,;]+$", "")
    return F.when(found != "", F.concat(F.lit("https://doi.org/"), found)).otherwise("")


def doi_or_url(c: Column) -> Column:
    """``struct<doi, url>`` of a cell: its DOI as an address, else the address that it is."""
    cell, doi = _strip(F.coalesce(c, F.lit(""))), doi_url(c)
    return F.struct(doi.alias("doi"), F.when((doi == "") & cell.startswith("http"), cell).otherwise("").alias("url"))


def clean_authors(c: Column) -> Column:
    """``struct<authors, year>`` of a cell such as ``*A and B* [cite: 1] (2020)``."""
    text = F.regexp_replace(_emphasis(F.coalesce(c, F.lit(""))), r"(?i)\s*\[cite[:\s][^\]]*\]", "")
    names = F.trim(F.regexp_replace(text, r"\s*\([^()]*\)\s*$", ""))
    names = F.regexp_replace(F.regexp_replace(names, r",?\s+and\s+", ", "), r"\s*,\s*,\s*", ", ")
    return F.struct(_strip(names, ",").alias("authors"), year(text).alias("year"))


def key_papers_section(lines: DataFrame) -> DataFrame:
    """The lines (doc_id, line_no, line) after a report's first heading ``key papers`` up to the next heading of the first
    or second level; what is between code fences is no heading."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    whole, fence = Window.partitionBy("doc_id"), F.col("line").rlike(_FENCE)
    outside = lambda counted: ~fence & (F.coalesce(F.sum(F.when(counted, 1).otherwise(0)).over(order), F.lit(0)) % 2 == 0)
    head = F.col("line").rlike(r"(?i)^\s*[#*>\-\s]*key papers\s*[:*]*\s*$")
    begun = lines.withColumn("begin", F.min(F.when(outside(fence) & head, F.col("line_no"))).over(whole)).where("line_no > begin")
    ended = begun.withColumn("end", F.min(F.when(outside(fence) & F.col("line").rlike(r"^\s{0,3}#{1,2}\s+\S"), F.col("line_no"))).over(whole))
    return ended.where("`end` is null or line_no < `end`").select("doc_id", "line_no", "line")


def pipe_rows(lines: DataFrame) -> DataFrame:
    """``(doc_id, line_no, title, authors, year, journal, doi, url)`` of lines ``title | authors | year | venue | DOI or URL``
    with four cells at least; rules and header rows are left out."""
    cells = F.transform(F.split(_strip(F.col("line"), "|"), r"\|"), lambda p: _strip(p))
    rows = lines.where(F.length("line") - F.length(F.replace("line", F.lit("|"), F.lit(""))) >= 3).select("doc_id", "line_no", cells.alias("c"))
    rows = rows.where((F.size("c") >= 4) & ~F.forall("c", lambda p: p.rlike(r"^:?-{2,}:?$")))
    cell = lambda k, kind: F.when(F.lower(F.col("c")[k]).isin(HEADERS[kind]), "").otherwise(F.col("c")[k])
    title = _emphasis(F.regexp_replace(F.regexp_replace(F.col("c")[0], r"^[-*\s]+", ""), r"^\d+\s*[.)]\s+", ""))
    found = rows.select("doc_id", "line_no", title.alias("title"), clean_authors(cell(1, "authors")).alias("a"), year(F.col("c")[2]).alias("y"), cell(3, "venue").alias("journal"), doi_or_url(F.get("c", F.lit(4))).alias("d"))
    return found.where((F.col("title") != "") & ~F.lower("title").isin(HEADERS["title"])).select("doc_id", "line_no", "title", "a.authors", F.when(F.col("y") != "", F.col("y")).otherwise(F.col("a.year")).alias("year"), "journal", "d.doi", "d.url")


def narrative_entries(lines: DataFrame) -> DataFrame:
    """The same columns of entries under a heading of the third level or lower, with lines ``Authors:`` and ``Venue:``
    below it; a heading without a number counts only if it has authors."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    head = F.col("line").rlike(r"^\s{0,3}#{3,6}\s+\S")
    marked = lines.withColumn("head", head).withColumn("block", F.sum(F.when(head, 1).otherwise(0)).over(order)).where("block > 0")
    label = lambda names: rf"(?i)^\s*[*_]*\s*(?:{names})\s*[*_]*\s*[:\-]\s*(.+)$"
    by, venue = label("authors?"), label("venue|journal|publication|outlet")
    text = lambda pattern: F.when(~F.col("head") & F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 1))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("line_no")))
    raw = marked.select("*", text(by).alias("by"), text(venue).alias("at"), F.when(~F.col("head") & F.col("line").rlike(r"\((?:19|20)\d{2}\)"), F.regexp_extract("line", r"\(((?:19|20)\d{2})\)", 1)).alias("y"))
    blocks = raw.groupBy("doc_id", "block").agg(F.min("line_no").alias("line_no"), F.max(F.when(F.col("head"), F.col("line"))).alias("h"), first(F.col("by")).alias("by"), first(F.col("at")).alias("at"), first(F.col("y")).alias("y"))
    heading = F.trim(F.regexp_replace("h", r"^\s{0,3}#{3,6}\s+", ""))
    title = _emphasis(F.regexp_replace(F.regexp_replace(heading, r"^\s*\d+\s*[.):\-]\s*", ""), r"(?i)\s*\[cite[:\s][^\]]*\]", ""))
    found = blocks.select("doc_id", "line_no", title.alias("title"), clean_authors(F.regexp_replace("by", r"^[\s*_]+", "")).alias("a"), F.coalesce(_emphasis(F.col("at")), F.lit("")).alias("journal"), F.coalesce("y", F.lit("")).alias("y"), heading.rlike(r"^\s*\d+\s*[.):\-]\s+\S").alias("numbered"))
    found = found.where((F.col("title") != "") & ~F.lower("title").isin(HEADERS["title"]) & (F.col("numbered") | (F.col("a.authors") != "")))
    return found.select("doc_id", "line_no", "title", "a.authors", F.when(F.col("a.year") != "", F.col("a.year")).otherwise(F.col("y")).alias("year"), "journal", F.lit("").alias("doi"), F.lit("").alias("url"))


def linked_titles(raw: DataFrame) -> DataFrame:
    """``(doc_id, n, title, url)`` of every object in JSON texts (doc_id, text) with a title or name of nine characters or
    more and an address, in the order of a walk to a depth of 200. Broken JSON gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                try:
                    stack = [(json.loads(text or "null"), 0)]
                except (ValueError, RecursionError):
                    continue
                n = 0
                while stack:
                    node, depth = stack.pop()
                    if depth > DEPTH or not isinstance(node, (dict, list)):
                        continue
                    if isinstance(node, dict):
                        url, title = node.get("url") or node.get("uri") or "", node.get("title") or node.get("name") or ""
                        if isinstance(url, str) and isinstance(title, str) and url.startswith("http") and len(title.strip()) >= LINK_TITLE:
                            out.append((doc_id, n, title.strip(), url.strip()))
                            n += 1
                    children = list(node.values() if isinstance(node, dict) else node)
                    stack += [(c, depth + 1) for c in reversed(children)]
            yield pd.DataFrame(out, columns=["doc_id", "n", "title", "url"])

    return raw.select("doc_id", "text").mapInPandas(run, "doc_id long, n int, title string, url string")


def raw_hits(hits: DataFrame) -> DataFrame:
    """Hits (title, authors, year, doi, abstract, journal, url) in the schema of records; titles under six characters go."""
    text = lambda c: _strip(F.coalesce(F.col(c).cast("string"), F.lit("")))
    title = F.regexp_replace(text("title"), r"\s+", " ")
    doi = F.when(doi_url(F.col("doi")) != "", doi_url(F.col("doi"))).otherwise(doi_url(F.col("url")))
    same = {c: text(c).alias(c) for c in ("authors", "abstract", "journal", "url")}
    return hits.where(F.length(title) >= HIT_TITLE).select(title.alias("title"), same["authors"], year(F.col("year")).alias("year"), doi.alias("doi"), same["abstract"], same["journal"], same["url"], F.lit("websearch").alias("source"))
