"""Reference files of several dialects: RIS by tag and in one line, BibTeX with nested braces, JSON arrays.

Files are read whole, one row each, and cut into records by built-in functions; only BibTeX's braces are matched in
Python. Records are (path, number, type, title, authors, year, journal, doi, abstract, url); what is missing is empty.
Records without a title are left out, as is a file without records. A DOI that is no address gets the resolver's, and an
empty address takes the DOI.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.authors import join_authors
from folioflow.operators.footnotes import _balanced_end

# Tags by field; tags only some exports use.
TAGS = {"title": ["T1", "TI"], "journal": ["JO"], "year": ["PY"], "doi": ["DO"], "abstract": ["AB"], "url": ["UR"]}
MORE_TAGS = TAGS | {"journal": ["JO", "JF", "T2"], "abstract": ["AB", "N2"]}
ONE_LINE = ["TI", "PY", "AU", "DO", "JO", "AB"]
FIELDS = ["title", "authors", "year", "journal", "doi", "abstract", "url"]
RECORDS = "path string, number int, type string, " + ", ".join(f"{f} string" for f in FIELDS)

_STRIP = r"^\s+|\s+$"


def files(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """``(path, text)`` of whole files."""
    return spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _completed(df: DataFrame) -> DataFrame:
    doi = F.when((F.col("doi") != "") & ~F.col("doi").startswith("http"), F.concat(F.lit("https://doi.org/"), F.col("doi"))).otherwise(F.col("doi"))
    found = df.withColumn("doi", doi).withColumn("url", F.when(F.coalesce("url", F.lit("")) == "", F.col("doi")).otherwise(F.col("url")))
    return found.where("title <> ''").select("path", "number", "type", *FIELDS)


def _tagged(record: Column, wrapped: bool) -> Column:
    """The tags and values of a record's lines; a line without a tag goes on with the one before if ``wrapped``."""
    lines = F.filter(F.transform(F.split(record, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, _STRIP, "")), lambda x: x != "")
    pair = lambda t, v: F.array(F.struct(t.alias("tag"), v.alias("value")))

    def step(a: Column, x: Column) -> Column:
        own = F.concat(a, pair(F.substring(x, 1, 2), F.trim(F.substring(x, 7, 1 << 30))))
        last = F.element_at(a, -1)
        longer = F.concat(F.slice(a, 1, F.size(a) - 1), pair(last["tag"], F.trim(F.concat_ws(" ", last["value"], x))))
        return F.when(x.rlike(r"^..  - ."), own).when(F.lit(wrapped) & (F.size(a) > 0), longer).otherwise(a)

    return F.aggregate(lines, F.expr("cast(array() as array<struct<tag:string,value:string>>)"), step)


def parse_ris(texts: DataFrame, dialect: str = "plain") -> DataFrame:
    """Records of ``(path, text)``.

    ``plain``: a record ends at a line ``ER  -`` and one without it is dropped; lines without a tag are skipped; several
    abstracts are joined; authors are listed as they are. ``wrapped``: lines without a tag go on with the value before;
    more tags are known; a last record needs no end; the last abstract counts; names are turned to First Last.
    ``wrapped-as-is`` leaves names alone. A file of ``TY - GEN ... ER -`` lines is read line by line in every dialect.
    """
    wrapped, tags = dialect != "plain", TAGS if dialect == "plain" else MORE_TAGS
    one_line = F.col("text").contains("TY - GEN") & ~F.col("text").contains("TY  - ")
    ends = r"(?m)^[ \t]*ER  -[^\n]*$" if wrapped else r"(?m)^[ \t]*ER  -[ \t\r]*$"
    parts = F.split("text", ends)
    whole = texts.where(~one_line).select("path", F.posexplode(parts if wrapped else F.slice(parts, 1, F.size(parts) - 1)).alias("number", "record"))
    read = whole.select("path", "number", _tagged(F.col("record"), wrapped).alias("ps"))
    of = lambda names: F.transform(F.filter("ps", lambda p: p["tag"].isin(names)), lambda p: p["value"])
    last = lambda names: F.coalesce(F.try_element_at(of(names), F.lit(-1)), F.lit(""))
    authors = join_authors(of(["AU"])) if dialect == "wrapped" else F.array_join(of(["AU"]), ", ")
    abstract = F.array_join(of(tags["abstract"]), " ") if dialect == "plain" else last(tags["abstract"])
    own = {f: last(t) for f, t in tags.items()} | {"authors": authors, "abstract": abstract}
    tagged = read.select("path", "number", last(["TY"]).alias("type"), *(own[f].alias(f) for f in FIELDS))

    lines = texts.where(one_line).select("path", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("number", "line")).withColumn("line", F.regexp_replace("line", _STRIP, "")).where("startswith(line, 'TY - ')")
    until = lambda tag, *stops: F.trim(F.regexp_extract("line", rf" {tag} - (.*?)(?= (?:{'|'.join(stops)}) - | ER -|$)", 1))
    year, stops = F.regexp_extract("line", r" PY - (\d*)", 1), [t for t in ONE_LINE if t != "TI"]
    read = {"title": until("TI", *stops), "authors": until("AU", "TI", "PY", "DO", "JO"), "year": year, "doi": until("DO", "TI", "PY", "AU", "JO", "AB")}
    single = lines.select("path", "number", F.lit("GEN").alias("type"), *(read.get(f, F.lit("")).alias(f) for f in FIELDS))
    return _completed(tagged.unionByName(single))


def detex(c: Column) -> Column:
    """Escaped signs without their backslash, accented letters without their accent."""
    return F.regexp_replace(F.regexp_replace(c, r"\\([&%_#$\{\}])", "$1"), r"""\\[`'^"~=.]\s*\{?([A-Za-z])\}?""", "$1")


def _plain(value: str) -> str:
    return " ".join(value.replace("{", "").replace("}", "").split())


def _bibtex_fields(entry: str) -> dict[str, str]:
    """Fields of an entry's inside: values in balanced braces or in quotes, or bare up to a comma or the line's end."""
    fields, at = {}, 0
    for m in re.finditer(r"(\w+)\s*=\s*", entry):
        if m.start() < at:
            continue  # inside the value before
        begin = m.end()
        opener = entry[begin : begin + 1]
        if opener == "{":
            end = _balanced_end(entry, begin + 1)
            at, value = (end, entry[begin + 1 : end - 1]) if end >= 0 else (len(entry), entry[begin + 1 :])
        elif opener == '"':
            end = entry.find('"', begin + 1)
            at, value = (end + 1, entry[begin + 1 : end]) if end >= 0 else (len(entry), entry[begin + 1 :])
        else:
            stop = re.search(r"[,\n]", entry[begin:])
            at = begin + stop.start() if stop else len(entry)
            value = entry[begin:at]
        fields[m[1].lower()] = value
    return fields


def parse_bibtex(texts: DataFrame, *, tex: bool = False, flip: bool = True) -> DataFrame:
    """Records of ``(path, text)``, braces matched at any depth; ``tex`` resolves escapes; ``flip`` turns names to First
    Last. Authors are parted at `` and ``; a book's title stands for a journal that is missing. The key is no column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, text in zip(pdf["path"], pdf["text"].fillna("")):
                for number, m in enumerate(re.finditer(r"@(\w+)\s*\{", text)):
                    end = _balanced_end(text, m.end())
                    f = _bibtex_fields(text[m.end() : end - 1 if end >= 0 else len(text)])
                    out.append((path, number, m[1].lower(), *(f.get(k, "") for k in ("title", "author", "year", "journal", "booktitle", "doi", "abstract", "url"))))
            yield pd.DataFrame(out, columns=["path", "number", "type", "title", "authors", "year", "journal", "book", "doi", "abstract", "url"])

    raw = texts.select("path", "text").mapInPandas(run, RECORDS + ", book string")
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(detex(F.col(c)) if tex else F.col(c), r"[{}]", ""), r"\s+", " "))
    found = raw.select("path", "number", "type", *(clean(f).alias(f) for f in [*FIELDS, "book"]))
    names = F.split("authors", " and ")
    found = found.withColumn("authors", F.when(F.col("authors") == "", "").otherwise(join_authors(names) if flip else F.array_join(names, ", ")))
    return _completed(found.withColumn("journal", F.when(F.col("journal") == "", F.col("book")).otherwise(F.col("journal"))))


def read_references(texts: DataFrame, dialect: str = "wrapped") -> DataFrame:
    """Records of files in either format: by the path's ending, else by a leading ``@``; a file that yields nothing in
    its own format is read in the other one."""
    lower = F.lower("path")
    is_bib = F.when(lower.rlike(r"\.bib(tex)?$"), True).when(lower.endswith(".ris"), False).otherwise(F.regexp_replace("text", r"^\s+", "").startswith("@"))
    marked = texts.select("path", "text", is_bib.alias("bib"))
    bib, ris = parse_bibtex(marked), parse_ris(marked, dialect)
    both = bib.withColumn("as_bib", F.lit(True)).unionByName(ris.withColumn("as_bib", F.lit(False))).join(marked.select("path", "bib"), "path")
    # What each file yields in its own format decides; the count is of one file's records.
    own = both.where("as_bib = bib").select("path").distinct().withColumn("own", F.lit(True))
    return both.join(own, "path", "left").where("coalesce(own, false) = (as_bib = bib)").drop("own", "bib", "as_bib")


#: Sources that name themselves.
NAMED_SOURCES = ["ssrn", "heinonline", "nber", "forthcoming", "citation_chain", "google_scholar"]


def detect_source(source: Column, score: Column, stem: Column, named: list[str] | None = None) -> Column:
    """A record's source: one of the named ones; ``undermind`` for a score in per cent without a source, or for a source
    (or a file's name in its place) that holds that word; else the source, or the file's name."""
    own = F.coalesce(source, F.lit(""))
    fallback = F.when(own != "", own).otherwise(F.coalesce(stem, F.lit("")))
    by_score = F.coalesce(score.cast("string"), F.lit("")).contains("%") & (own == "")
    return F.when(own.isin(named or NAMED_SOURCES), own).when(by_score | fallback.contains("undermind"), F.lit("undermind")).otherwise(fallback)


JSON_RECORD = "title string, authors string, year string, journal string, doi string, abstract string, url string, source string, score string"


def load_all(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of all ``*.json`` and ``*.ris`` files of a folder, with ``source``; a JSON file that is no array of records
    gives none."""
    stem = lambda c: F.regexp_extract(c, r"([^/]*?)(?:\.[^./]*)?$", 1)
    arrays = files(spark, path, "*.json").where(F.col("text").rlike(r"^\s*\["))
    each = arrays.select("path", F.posexplode(F.from_json("text", f"array<struct<{JSON_RECORD.replace(' string', ':string')}>>")).alias("number", "r"))
    text = lambda f: F.coalesce(F.col(f"r.{f}"), F.lit("")).alias(f)
    found = each.where("r is not null").select("path", "number", F.lit("").alias("type"), *(text(f) for f in FIELDS), detect_source(F.col("r.source"), F.col("r.score"), stem(F.col("path"))).alias("source"))
    ris = parse_ris(files(spark, path, "*.ris")).withColumn("source", detect_source(F.lit(""), F.lit(""), stem(F.col("path"))))
    return found.unionByName(ris)


def to_ris(records: DataFrame, layout: str = "title-first") -> DataFrame:
    """One text column ``value``, a record each. ``title-first``: T1, then an AU line for each author; ``authors-first``:
    AU lines, then TI, and ``ER  - `` with a blank at its end. Empty fields are left out; the DOI goes without resolver."""
    first = layout == "title-first"
    text = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("")) if f in records.columns else F.lit("")
    line = lambda tag, v: F.when(v != "", F.concat(F.lit(f"{tag}  - "), v))
    names = F.filter(F.transform(F.split(text("authors"), ", " if first else ","), lambda x: F.trim(x)), lambda a: a != "")
    authors = F.when(F.size(names) > 0, F.array_join(F.transform(names, lambda a: F.concat(F.lit("AU  - "), a)), "\n"))
    title = line("T1" if first else "TI", text("title"))
    doi = line("DO", F.regexp_replace(text("doi"), r"^https?://doi\.org/", ""))
    rest = [line("JO", text("journal")), line("PY", text("year")), doi, line("AB", text("abstract")), line("UR", text("url"))]
    return records.select(F.concat(F.concat_ws("\n", F.lit("TY  - JOUR"), *([title, authors] if first else [authors, title]), *rest, F.lit("ER  -" if first else "ER  - ")), F.lit("\n")).alias("value"))
