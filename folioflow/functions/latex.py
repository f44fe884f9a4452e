"""LaTeX texts: comments, document parts, commands with balanced arguments, sections, counters, includes.

Null texts count as empty.
"""

from __future__ import annotations

import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from folioflow.operators.footnotes import _balanced_end
from folioflow.shared import cut

# Commands that open a section, and the numerals of a counter.
SECTIONS = ["section", "subsection", "subsubsection", "chapter", "paragraph"]
NUMERALS = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]
_OPTION = r"\s*(?:\[[^\]]*\])?\s*\{"


def strip_comments(c: Column) -> Column:
    """Each line up to its first ``%`` that no backslash precedes."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?m)(?<!\\)%[^\n]*", "")


def preamble(c: Column) -> Column:
    """What stands before the document, without blanks at its end; empty without a document."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)^(.*?)\\begin\{document\}", 1), r"\s+$", "")


def body(c: Column) -> Column:
    """The inside of the document, or all after its start, or the whole text."""
    text = F.coalesce(c, F.lit(""))
    opened = F.when(text.contains("\\begin{document}"), F.regexp_extract(text, r"(?s)^.*?\\begin\{document\}(.*)$", 1)).otherwise(text)
    closed = F.when(text.contains("\\begin{document}") & opened.contains("\\end{document}"), F.regexp_extract(opened, r"(?s)^(.*?)\\end\{document\}", 1)).otherwise(opened)
    return F.regexp_replace(closed, r"^\s+|\s+$", "")


def combine(parts: DataFrame, order: str = "ord") -> DataFrame:
    """One row (text, n): the bodies of ``parts`` (order, text) under the first one's preamble."""
    each = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), preamble(F.col("text")).alias("head"), body(F.col("text")).alias("body"))))
    joined = parts.agg(each.alias("p"), F.count(F.lit(1)).alias("n"))
    text = F.concat(F.coalesce(F.get("p", F.lit(0))["head"], F.lit("")), F.lit("\n\\begin{document}\n"), F.array_join(F.col("p.body"), "\n\n"), F.lit("\n\\end{document}\n"))
    return joined.select(text.alias("text"), "n")


def _arguments(text: str, names: str) -> list[tuple[int, int, int, str]]:
    """``(start, argument's start, end, command)`` of commands one after another; one that never closes ends the text."""
    found, at, pattern = [], 0, re.compile(rf"\\({names})\*?{_OPTION}")
    while m := pattern.search(text, at):
        end = _balanced_end(text, m.end())
        found.append((m.start(), m.end(), end if end >= 0 else len(text) + 1, m[1]))
        at = min(found[-1][2], len(text))
    return found


def command(c: Column, name: str) -> Column:
    """The argument of the first ``\\name``; null if there is none."""

    @F.pandas_udf(StringType())
    def first(text: pd.Series) -> pd.Series:
        def of(t: str | None) -> str | None:
            got = _arguments(t or "", re.escape(name))
            return t[got[0][1] : got[0][2] - 1] if got else None

        return text.map(of)

    return first(c)


@F.pandas_udf(StructType().add("text", StringType()).add("notes", ArrayType(StringType())))
def take_footnotes(text: pd.Series) -> pd.DataFrame:
    """A text without its footnotes, and these in order."""
    out = []
    for t in text.fillna(""):
        kept, notes, at = [], [], 0
        for start, inner, end, _ in _arguments(t, "footnote"):
            kept.append(t[at:start])
            notes.append(t[inner : end - 1])
            at = end
        out.append(("".join([*kept, t[at:]]), notes))
    return pd.DataFrame(out, columns=["text", "notes"])


@F.pandas_udf(ArrayType(StructType().add("heading", StringType()).add("text", StringType())))
def sections(text: pd.Series) -> pd.Series:
    """A text at its section commands: ``(intro)`` before the first, ``(body)`` for one without any."""

    def of(t: str | None) -> list[dict]:
        t = t or ""
        found = _arguments(t, "|".join(SECTIONS))
        stops = [*(f[0] for f in found[1:]), len(t)]
        parts = [(t[inner : end - 1].strip(), t[end:stop].strip()) for (_, inner, end, _), stop in zip(found, stops)]
        lead = t[: found[0][0]].strip() if found else t.strip()
        if not found or lead:
            parts.insert(0, ("(intro)" if found else "(body)", lead))
        return [{"heading": h, "text": x} for h, x in parts]

    return text.map(of)


def roman(c: Column) -> Column:
    """A counter in small roman numerals; what is no positive number stays as it is."""
    steps = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(s).alias("s")) for n, s in NUMERALS])
    start = F.struct(c.cast("long").alias("left"), F.lit("").alias("out"))
    walked = F.aggregate(steps, start, lambda a, x: F.struct((a["left"] % x["n"]).alias("left"), F.concat(a["out"], F.repeat(x["s"], (a["left"] / x["n"]).cast("int"))).alias("out")), lambda a: a["out"])
    return F.when(c > 0, walked).otherwise(c.cast("string"))


def letters(c: Column) -> Column:
    """A counter in letters: a to z, then aa and on; what is no positive number stays as it is."""
    # Seven letters hold any 32-bit counter; places of higher value come first.
    start = F.struct(c.cast("long").alias("left"), F.lit("").alias("out"))
    step = lambda a: F.struct(F.floor((a["left"] - 1) / 26).cast("long").alias("left"), F.concat(F.char(97 + (a["left"] - 1) % 26), a["out"]).alias("out"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, lambda a, _: F.when(a["left"] > 0, step(a)).otherwise(a), lambda a: a["out"])
    return F.when(c > 0, walked).otherwise(c.cast("string"))


def scientific(c: Column) -> Column:
    """``1.5e-03`` as a power of ten in LaTeX; other texts stay, trimmed."""
    pattern = r"^([+-]?(?:\d+(?:\.\d*)?|\.\d+))[eE]([+-]?\d+)$"
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t.rlike(pattern), F.concat(F.regexp_extract(t, pattern, 1), F.lit("×10\\textsuperscript{"), F.regexp_extract(t, pattern, 2).cast("long").cast("string"), F.lit("}"))).otherwise(t)


@F.pandas_udf(StringType())
def uncertainty(text: pd.Series) -> pd.Series:
    """``1.23(4)`` as ``1.23 ± 0.04``: the digits in parentheses count in the last places; other texts stay."""

    def of(t: str | None) -> str | None:
        m = re.fullmatch(r"([+-]?\d+(?:\.(\d+))?)\((\d+)\)", (t or "").strip())
        return t if m is None else f"{m[1]} ± {Decimal(m[3]).scaleb(-len(m[2] or '')):f}"

    return text.map(of)


def inline_includes(files: DataFrame, roots: DataFrame, *, depth: int = 8, missing: str = "keep") -> DataFrame:
    """``(path, text)``: each root's text with its ``\\input`` and ``\\include`` commands replaced by the files they name.

    ``files`` is (path, text), ``roots`` (path). A name is looked up in the including root's folder as it is and with
    ``.tex``. Each of at most ``depth`` rounds is one join on the path over the commands found; a command whose file is
    missing stays (``keep``) or goes (``drop``), as do those left after the last round. Includes that lead back to
    themselves end with the rounds. Null texts are empty.
    """
    pattern = r"\\(?:input|include)\s*\{([^}]*)\}"
    table = files.groupBy("path").agg(F.coalesce(F.first("text"), F.lit("")).alias("found"))
    now = cut(roots.select("path").distinct().join(table, "path").select("path", F.col("found").alias("text")), "includes")
    for _ in range(depth):
        pieces = now.where(F.col("text").rlike(pattern)).select("path", F.split("text", pattern).alias("gaps"), F.concat(F.regexp_extract_all("text", F.lit(f"({pattern})"), 1), F.array(F.lit(""))).alias("commands"))
        if pieces.isEmpty():
            break
        each = pieces.select("path", F.posexplode(F.arrays_zip("gaps", "commands")).alias("k", "z")).select("path", "k", F.col("z.gaps").alias("gap"), F.col("z.commands").alias("command"))
        folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
        named = each.withColumn("name", F.concat(folder, F.trim(F.regexp_extract("command", pattern, 1))))
        plain, with_tex = table.withColumnRenamed("path", "name"), table.select(F.regexp_replace("path", r"\.tex$", "").alias("name"), F.col("found").alias("found_tex")).where(table["path"].endswith(".tex"))
        other = F.col("command") if missing == "keep" else F.lit("")
        # A command that stays must not be found again in the next round: its backslash is doubled by a mark until the end.
        held = F.regexp_replace(other, r"^\\", "\x00")
        filled = named.join(plain, "name", "left").join(with_tex, "name", "left").withColumn("put", F.when(F.col("command") == "", F.lit("")).otherwise(F.coalesce("found", "found_tex", held)))
        done = filled.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("k", "gap", "put"))).alias("ps")).select("path", F.array_join(F.transform("ps", lambda p: F.concat(p["gap"], p["put"])), "").alias("text"))
        now = cut(now.where(~F.col("text").rlike(pattern)).unionByName(done), "includes")
    left = F.regexp_replace("text", pattern, "") if missing == "drop" else F.col("text")
    return now.select("path", F.replace(left, F.lit("\x00"), F.lit("\\")).alias("text"))
