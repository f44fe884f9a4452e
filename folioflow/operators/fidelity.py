"""How faithful a converted text is to the compiled one: tokens that went missing, leftover markup, counts and a verdict.

Input is a row per document with both texts. The table of missing tokens is one aggregate by (document, token),
pre-aggregated in the scan's tasks; the report takes each row's tokens, markup and labels on the row. Cases: null texts
count as empty; a compiled text without tokens misses nothing; in the table repeated documents would add up, so ids must be
unique there, while the report gives each row its own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tokens, labels, markup that must not be left, and what is still good.
TOKEN = r"\d[\d.,]*\d|\d|[^\W\d_]+"
LEAST_LETTERS = 3
LABELS = ["Table", "Figure", "Equation"]
MARKUP = [
    r"\cref", r"\Cref", r"\textit", r"\textbf", r"\begin", r"\includegraphics", r"\sym", r"\footnote", r"\multicolumn", r"\multirow", r"\toprule", r"\cmidrule",
    "%%TABLE", "%%FIGURE", "%%PAGEBREAK", "$", "^{", "_{",
]
MISSING_PERCENT = 3.0
NUMBERS_SHOWN = 20


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def significant_tokens(text: Column) -> Column:
    """Numbers as they stand and words of three letters or more in lower case, in order."""
    found = F.regexp_extract_all(_text(text), F.lit(f"(?U){TOKEN}"), F.lit(0))
    return F.transform(F.filter(found, lambda t: t.rlike(r"(?U)^\d") | (F.length(t) >= LEAST_LETTERS)), F.lower)


def _occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("bigint")


def label_counts(text: Column) -> Column:
    """``map<label, n>`` of the words that head floats and equations."""
    return F.create_map(*(x for name in LABELS for x in (F.lit(name), F.size(F.regexp_extract_all(_text(text), F.lit(rf"(?U)\b{name}\b"), F.lit(0))).cast("bigint"))))


def leftover_markup(converted: Column, compiled: Column) -> Column:
    """``map<marker, n>``: how often each marker occurs more in the converted text than in the compiled one; the rest are left out."""
    extra = [F.struct(F.lit(m).alias("key"), (_occurrences(_text(converted), m) - _occurrences(_text(compiled), m)).alias("value")) for m in MARKUP]
    return F.map_from_entries(F.filter(F.array(*extra), lambda e: e["value"] > 0))


def missing_tokens(docs: DataFrame, *, id_col: str = "doc_id", compiled: str = "compiled", converted: str = "converted") -> DataFrame:
    """``(id, token, n, first)``: the tokens of the compiled text that the converted one has nowhere, how often and where first."""
    side = lambda c, there: docs.select(F.col(id_col), F.posexplode(significant_tokens(F.col(c))).alias("at", "token"), F.lit(there).alias("there"))
    counted = side(compiled, False).unionByName(side(converted, True)).groupBy(id_col, "token").agg(F.count_if(~F.col("there")).alias("n"), F.min(F.when(~F.col("there"), F.col("at"))).cast("bigint").alias("first"), F.bool_or("there").alias("there"))
    return counted.where("not there and n > 0").drop("there")


def ranked_missing(missing: DataFrame, most: int, *, id_col: str = "doc_id") -> DataFrame:
    """The ``most`` commonest tokens of :func:`missing_tokens` for each document, of equally common ones the earlier, under ``rank``."""
    order = Window.partitionBy(id_col).orderBy(F.desc("n"), "first", "token")
    return missing.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def report(docs: DataFrame, *, id_col: str = "doc_id", compiled: str = "compiled", converted: str = "converted", unresolved: str | None = None, failed: str | None = None) -> DataFrame:
    """A row per document: distinct tokens, how many are missing and what share of them, numbers among them, leftover markup
    and the verdict, ``OK`` below :data:`MISSING_PERCENT` with nothing left over, unresolved or failed."""
    extra = F.aggregate(F.map_values(leftover_markup(F.col(converted), F.col(compiled))), F.lit(0).cast("bigint"), lambda a, n: a + n)
    # Both token lists of a row stay with it: no table of tokens, no shuffle, and a task holds one row's tokens at a time.
    # A generator of one row keeps Spark from taking the tokens anew for every column that uses them.
    tokens = F.struct(F.array_distinct(significant_tokens(F.col(compiled))).alias("_tokens"), significant_tokens(F.col(converted)).alias("_there"))
    each = docs.select(
        F.col(id_col), F.inline(F.array(tokens)), extra.alias("n_leftover"),
        F.coalesce(F.col(unresolved).cast("bigint") if unresolved else F.lit(0), F.lit(0)).alias("_open"), F.coalesce(F.col(failed).cast("boolean") if failed else F.lit(False), F.lit(False)).alias("_failed"),
    )
    gone = F.array_except("_tokens", "_there").alias("_gone")
    lost = each.select(id_col, "n_leftover", "_open", "_failed", F.size("_tokens").cast("bigint").alias("n_tokens"), F.inline(F.array(F.struct(gone))))
    numbers = F.filter("_gone", lambda t: t.rlike(r"(?U)^\d"))
    joined = lost.withColumns({"n_missing": F.size("_gone").cast("bigint"), "n_missing_numbers": F.size(numbers).cast("bigint")})
    percent = F.when(F.col("n_tokens") > 0, 100.0 * F.col("n_missing") / F.col("n_tokens")).otherwise(0.0)
    good = (percent < MISSING_PERCENT) & (F.col("n_leftover") == 0) & (F.col("_open") == 0) & ~F.col("_failed")
    return joined.select(id_col, "n_tokens", "n_missing", "n_missing_numbers", F.round(percent, 2).alias("missing_percent"), "n_leftover", F.when(good, "OK").otherwise("FLAG").alias("verdict"))


def log_count(log: Column, label: str) -> Column:
    """The number in the first line ``label: number`` of a log; null if there is none."""
    found = F.regexp_extract(_text(log), rf"(?m)^\Q{label}\E:\s*(\d+)\s*$", 1)
    return F.when(found != "", found.cast("bigint"))


def first_present(*values: Column) -> Column:
    """The first value that is there, as a whole number; 0 if none is or it is no number."""
    return F.coalesce(F.coalesce(*(v.cast("string") for v in values)).try_cast("double").cast("bigint"), F.lit(0).cast("bigint"))


def command_counts(source: Column, commands: list[str]) -> Column:
    """``map<command, n>`` of the commands that a LaTeX source uses."""
    each = [F.struct(F.lit(c).alias("key"), F.size(F.regexp_extract_all(_text(source), F.lit(rf"\\\Q{c}\E(?![A-Za-z])"), F.lit(0))).cast("bigint").alias("value")) for c in commands]
    return F.map_from_entries(F.filter(F.array(*each), lambda e: e["value"] > 0))
