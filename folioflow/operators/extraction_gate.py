"""The quality gate of extracted pages: leaked glyphs, merged table rows, broken and flattened equations, by line.

A page is one row and everything is said of its lines as an array, so the gate is a map: no shuffle, and in the JVM but for
:func:`protected_lines`. Cases: null texts count as empty; without a formula density no equation is called flattened;
repeated rows are each judged; an empty table has no issues; of other columns only the id is kept.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

# What counts as a number, a value with its error, a flag, a sign of mathematics, and how many of them tell.
NUMBER = r"^\(?[-+]?\$?\d[\d,]*\.?\d*%?\)?[∗*]{0,3}$"
VALUE = r"-?\d[\d.,]*\s*[a-z%]*\s*[∗*]{0,3}\s*(?:\([\d.,]+\))?"
VALUE_AND_MORE = r"\)\s+\S|\([\d.,]+\).*\([\d.,]+\)"
FLAG, FLAG_AFTER_VALUE = r"\b(Yes|No)\b", r"\d\s*[a-z%]*\s+(Yes|No)\b"
MATH = r"[=Φφθγµλαβπσ∑∫∈≥≤≠×·±√]|\\[A-Za-z]+|\b\w_\{|\^\{|\b[A-Za-z]\s*_\s*\{?\s*i\s*t\b"
MATH_SURE = r"[Φθγµλαβ=≥×]"
STACKED_NUMBERS, LABEL_WORDS, CELL_WORDS, MATH_SIGNS, FLAT_LENGTH, DENSE, FLAT_SHOWN = 5, 3, 3, 4, 200, 0.2, 8

PRIVATE = r"[\x{E000}-\x{F8FF}]"
ISSUE = "array<struct<line:bigint,kind:string,detail:string>>"


def _u(pattern: str) -> str:
    """A pattern whose classes know all scripts."""
    return f"(?U){pattern}"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, _u(r"^\s+|\s+$"), "")


def _count(c: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(_u(pattern)), F.lit(0)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _issue(line: Column, kind: str, detail: Column) -> Column:
    return F.struct(line.cast("bigint").alias("line"), F.lit(kind).alias("kind"), detail.alias("detail"))


def _numbered(lines: Column, judge: Callable[[Column, Column], Column]) -> Column:
    """What ``judge`` (line, its number) says, nulls left out."""
    return F.filter(F.transform(lines, lambda s, i: judge(s, i + 1)), lambda x: x.isNotNull())


def strip_private_lines(text: Column) -> Column:
    """The text without lines of private-use glyphs and nothing else; blank lines stay."""
    return F.array_join(F.filter(_lines(text), lambda s: ~(s.rlike(PRIVATE) & s.rlike(_u(r"^[\x{E000}-\x{F8FF}\s]+$")))), "\n")


def stray_glyphs(lines: Column) -> Column:
    """An issue for each line with private-use glyphs, which its detail lists."""
    glyphs = lambda s: F.array_sort(F.array_distinct(F.regexp_extract_all(s, F.lit(PRIVATE), F.lit(0))))
    named = lambda s: F.array_join(F.transform(glyphs(s), lambda g: F.concat(F.lit("U+"), F.hex(F.encode(g, "UTF-16BE")))), ", ")
    return _numbered(lines, lambda s, i: F.when(s.rlike(PRIVATE), _issue(i, "stray-glyph", named(s))))


def table_cells(line: Column) -> Column:
    """The cells of a pipe table's row; null for other lines and for the rule under the head."""
    s = _strip(line)
    row = s.startswith("|") & s.endswith("|") & (F.length(s) >= 2) & ~s.rlike(_u(r"^\|[\s:|-]+\|$"))
    return F.when(row, F.transform(F.split(F.regexp_replace(s, r"^\|+|\|+$", ""), r"\|", -1), _strip))


def longest_number_run(cell: Column) -> Column:
    """How many numbers follow each other at most, with nothing but blanks between them."""
    step = lambda a, w: F.struct(F.when(w.rlike(_u(NUMBER)), a["now"] + 1).otherwise(F.lit(0)).alias("now"), F.greatest(a["most"], F.when(w.rlike(_u(NUMBER)), a["now"] + 1).otherwise(F.lit(0))).alias("most"))
    return F.aggregate(F.split(_strip(F.coalesce(cell, F.lit(""))), _u(r"\s+")), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])


def _merged(cell: Column, at: Column) -> Column:
    """Which rule says that a cell (``at`` from 0) holds two rows; null if none does."""
    words = F.size(F.filter(F.regexp_extract_all(cell, F.lit("[A-Za-z]{3,}"), F.lit(0)), lambda w: ~w.isin("Yes", "No")))
    two_values = (_count(cell, VALUE) >= 2) & cell.rlike(_u(VALUE_AND_MORE))
    stacked = (words <= CELL_WORDS) & (two_values | (_count(cell, FLAG) >= 2) | cell.rlike(_u(FLAG_AFTER_VALUE)))
    label = cell.rlike(_u(FLAG)) & (_count(cell, r"\S+") >= LABEL_WORDS)
    data = F.when(longest_number_run(cell) >= STACKED_NUMBERS, "column in a cell").when(stacked, "two values")
    return F.when(at >= 1, data).when(label, "flag in a label")


def merged_rows(lines: Column) -> Column:
    """An issue for each table row that holds two, by its first cell that shows it."""

    def judge(line: Column, i: Column) -> Column:
        told = F.transform(table_cells(line), lambda c, at: F.struct((at + 1).alias("at"), _merged(c, at).alias("rule"), c.alias("cell")))
        first = F.get(F.filter(told, lambda x: x["rule"].isNotNull()), F.lit(0))
        return F.when(first.isNotNull(), _issue(i, "merged-table-row", F.concat(F.lit("col "), first["at"], F.lit(", "), first["rule"], F.lit(": "), first["cell"])))

    return _numbered(lines, judge)


def _delimiters(stripped: Column) -> Column:
    """Places (from 0) of the lines that open and close blocks of display mathematics, by turns."""
    return F.filter(F.transform(stripped, lambda s, i: F.when(s == "$$", i)), lambda i: i.isNotNull())


def broken_equations(stripped: Column, marks: Column) -> Column:
    """An issue for each closed block that is empty or debris of a formula model, at its first line."""

    def judge(k: Column) -> Column:
        start, end = F.get(marks, 2 * k), F.get(marks, 2 * k + 1)
        body = _strip(F.array_join(F.slice(stripped, start + 2, end - start - 1), " "))
        why = F.when(body == "", "empty block").when(body.contains("\\intertext"), "intertext")
        return F.when(why.isNotNull(), _issue(start + 1, "broken-equation", why))

    blocks = F.filter(F.sequence(F.lit(0), F.floor(F.size(marks) / 2).cast("int")), lambda k: 2 * k + 1 < F.size(marks))
    return F.filter(F.transform(blocks, judge), lambda x: x.isNotNull())


def flattened_equations(stripped: Column, marks: Column, density: Column, most: int = FLAT_SHOWN) -> Column:
    """The first ``most`` lines that read like mathematics outside of any block, on a page dense in formulas with one block
    at most."""
    places = F.transform(stripped, lambda s, i: F.struct((i + 1).alias("line"), s.alias("s")))
    # Stretches between blocks: before the first mark, and after every second one.
    begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(marks, k - 1) + 1)
    end = lambda k: F.coalesce(F.get(marks, k), F.size(stripped))
    outside = F.flatten(F.transform(F.sequence(F.lit(0), F.size(marks), F.lit(2)), lambda k: F.slice(places, begin(k) + 1, end(k) - begin(k))))
    plain = lambda s: ~s.startswith("|") & ~s.startswith("#") & ~s.startswith("![") & ~s.contains("$")
    dense = lambda s: (_count(s, MATH) >= MATH_SIGNS) & (F.length(s) < FLAT_LENGTH) & s.rlike(MATH_SURE)
    flat = F.slice(F.filter(outside, lambda x: plain(x["s"]) & dense(x["s"])), 1, most)
    found = F.transform(flat, lambda x: _issue(x["line"], "flattened-equation", x["s"]))
    return F.when((density > DENSE) & (F.floor(F.size(marks) / 2) <= 1), found).otherwise(F.array().cast(ISSUE))


def gate(pages: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", density_col: str | None = None) -> DataFrame:
    """``(id, line, kind, detail)``: all issues of all pages; a blank page has the one issue that it is empty."""
    lines = pages.select(F.col(id_col), _lines(F.col(text_col)).alias("_lines"), (F.col(density_col).cast("double") if density_col else F.lit(None).cast("double")).alias("_density"))
    stripped = lines.withColumn("_stripped", F.transform("_lines", _strip))
    marked = stripped.withColumn("_marks", _delimiters(F.col("_stripped")))
    blank = ~F.exists("_stripped", lambda s: s != "")
    parts = [stray_glyphs(F.col("_lines")), merged_rows(F.col("_lines")), broken_equations(F.col("_stripped"), F.col("_marks")), flattened_equations(F.col("_stripped"), F.col("_marks"), F.col("_density"))]
    empty = F.array(_issue(F.lit(1), "empty-output", F.lit("")))
    found = F.when(blank, empty.cast(ISSUE)).otherwise(F.concat(*(p.cast(ISSUE) for p in parts)))
    return marked.select(F.col(id_col), F.explode(found).alias("_issue")).select(F.col(id_col), "_issue.*")


@F.pandas_udf(ArrayType(BooleanType()))
def protected_lines(text: pd.Series) -> pd.Series:
    """For each line of a text, whether it lies in a code fence or a block of display mathematics, delimiters included.
    What opens first holds until its own kind closes it, which takes a state; null texts have one line, not protected."""

    def fold(t: str | None) -> list[bool]:
        held, out = "", []
        for s in ((t or "").split("\n")):
            s = s.strip()
            fence, dollars = s.startswith(("```", "~~~")), s.startswith("$$") and (s == "$$" or not s.endswith("$$"))
            opened = held or ("fence" if fence else "math" if dollars else "")
            out.append(bool(opened))
            closed = held and (fence if held == "fence" else s.endswith("$$"))
            held = "" if closed else opened
        return out

    return text.map(fold) if len(text) else pd.Series([], dtype=object)


def image_references(text: Column) -> Column:
    """How many images a Markdown text asks for outside of code fences."""
    prose = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)```.*?```", "")
    return _count(prose, r"!\[") + _count(prose, r"(?i)<img\b")
