"""Names of authors and citation keys, as Column functions.

Null and blank inputs give empty results. Lists of authors are arrays of ``struct<last, first>``.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Title words that no key is made of.
SKIPPED = ["a", "an", "the", "on", "of", "in", "for", "to", "and", "with"]
_NONE = "cast(array() as array<struct<last:string,first:string>>)"


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


@F.pandas_udf(StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without its combining marks; null stays null."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def flip_author(c: Column) -> Column:
    """``Last, First, Jr.`` as ``First Jr. Last``; without a surname or a given name, the commas become blanks."""
    parts = F.transform(F.split(_text(c), ","), lambda x: F.trim(x))
    given = F.array_join(F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p != ""), " ")
    bare = F.trim(F.replace(_text(c), F.lit(","), F.lit(" ")))
    return F.when(F.size(parts) == 1, _text(c)).when((parts[0] == "") | (given == ""), bare).otherwise(F.concat_ws(" ", given, parts[0]))


def join_authors(names: Column) -> Column:
    """An array of names, each flipped, joined by ``, ``; blank ones are left out."""
    return F.array_join(F.filter(F.transform(names, flip_author), lambda a: F.coalesce(a, F.lit("")) != ""), ", ")


def author(c: Column) -> Column:
    """One name as ``struct<last, first>``: around the first comma, or the last word and those before it."""
    name = _text(c)
    first = F.trim(F.regexp_extract(name, r"^(.*?)\s*(\S+)$", 1))
    by_comma = F.struct(F.trim(F.regexp_extract(name, r"^([^,]*),", 1)).alias("last"), F.trim(F.regexp_extract(name, r"(?s)^[^,]*,(.*)$", 1)).alias("first"))
    by_word = F.struct(F.regexp_extract(name, r"(\S+)$", 1).alias("last"), F.regexp_replace(first, r"\s+", " ").alias("first"))
    return F.when(name.contains(","), by_comma).otherwise(by_word)


def author_list(c: Column) -> Column:
    """A list of names: parted at `` and `` if there is one, else at ``;``, else at ``,``. Two words around a lone comma
    are one author."""
    raw = _text(c)
    pieces = lambda sep: F.transform(F.split(raw, sep), lambda x: F.trim(x))
    filled = lambda parts: F.filter(parts, lambda p: p != "")
    commas = pieces(",")
    lone = (F.size(commas) == 2) & ~commas[0].contains(" ") & ~commas[1].contains(" ")
    names = F.when(raw.contains(" and "), pieces(" and ")).when(raw.contains(";"), filled(pieces(";"))).when(lone, F.array(raw)).when(F.size(commas) == 2, commas).otherwise(filled(commas))
    return F.when(raw == "", F.expr(_NONE)).otherwise(F.transform(names, author))


def authors_bibtex(authors: Column) -> Column:
    return F.array_join(F.transform(authors, lambda a: F.when(a["first"] != "", F.concat_ws(", ", a["last"], a["first"])).otherwise(a["last"])), " and ")


def base_key(authors: Column, year: Column, title: Column) -> Column:
    """Surname of the first author (or ``unknown``), year (or ``nd``), and the first word of the title that tells something."""
    last = F.regexp_replace(F.lower(strip_accents(F.get(authors, F.lit(0))["last"])), "[^a-z]", "")
    words = F.transform(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit("([a-zA-Z]+)"), 1), F.lower)
    telling = F.filter(words, lambda w: ~w.isin(SKIPPED))
    word = F.coalesce(F.get(telling, F.lit(0)), F.get(words, F.lit(0)), F.lit(""))
    when = F.when(_text(year.cast("string")) == "", F.lit("nd")).otherwise(_text(year.cast("string")))
    return F.concat(F.when(F.size(authors) > 0, last).otherwise(F.lit("unknown")), when, word)


def _first_word(authors: Column) -> Column:
    return F.regexp_extract(F.trim(F.regexp_extract(_text(authors), r"^([^,]*)", 1)), r"(\S+)$", 1)


def screening_key(authors: Column, year: Column) -> Column:
    """Last word before the first comma, letters alone (``Unknown`` if none), and the year."""
    name = F.regexp_replace(_first_word(authors), "[^a-zA-Z]", "")
    return F.concat(F.when(name == "", F.lit("Unknown")).otherwise(name), _text(year.cast("string")))


def numbered_key(authors: Column, year: Column, number: Column) -> Column:
    """The same word and year with letters and digits alone (``ref`` if none), and a row's number."""
    stem = F.regexp_replace(F.concat(F.when(_text(authors) == "", F.lit("ref")).otherwise(_first_word(authors)), F.coalesce(year.cast("string"), F.lit(""))), "[^A-Za-z0-9]", "")
    return F.concat(F.when(stem == "", F.lit("ref")).otherwise(stem), number.cast("string"))
