"""Replies of language models and requests to them, as Column functions; null replies count as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCREENED = "relevance_score double, rationale string, paper_type string, identification_strategy string, relationship string"


def strip_fences(c: Column) -> Column:
    """A text without the code fence around it."""
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""))
    return F.when(text.startswith("```"), F.regexp_replace(text, r"^```(?:json)?\s*|\s*```$", "")).otherwise(text)


def pair_verdict(c: Column) -> Column:
    """``struct<decision, confidence, rationale>`` of a reply in three labelled lines, the last of each label; where there
    is neither confidence nor rationale, the first word decides."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    last = lambda label: F.coalesce(F.element_at(F.filter(F.regexp_extract_all(text, F.lit(rf"(?im)^[ \t]*{label}:(.*)$"), 1), lambda x: x.isNotNull()), -1), F.lit(""))
    safe = lambda label: F.when(text.rlike(rf"(?im)^[ \t]*{label}:"), F.trim(last(label))).otherwise(F.lit(""))
    confidence, rationale = F.lower(safe("confidence")), safe("rationale")
    labelled = (confidence != "") | (rationale != "")
    yes = F.when(labelled, F.lower(safe("decision")).startswith("yes")).otherwise(F.lower(text).startswith("yes"))
    return F.struct(F.when(yes, "yes").otherwise("no").alias("decision"), confidence.alias("confidence"), rationale.alias("rationale"))


def screening(c: Column) -> Column:
    """``struct<score, rationale, paper_type, identification_strategy, relationship>`` of a JSON reply; null if it is none."""
    found = F.from_json(strip_fences(c), SCREENED)
    named = lambda f, other: F.coalesce(found[f], F.lit(other)).alias(f)
    fields = F.struct(F.coalesce(found["relevance_score"], F.lit(0)).cast("int").alias("score"), named("rationale", ""), *(named(f, "N/A") for f in ("paper_type", "identification_strategy", "relationship")))
    return F.when(F.to_json(found) != "{}", fields)


def labelled_fields(**columns: Column) -> Column:
    """A line ``Label: value`` for each field that is not empty."""
    return F.concat_ws("\n", *(F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{label}: "), c.cast("string"))) for label, c in columns.items()))


def fit_query(c: Column, limit: int = 280) -> Column:
    """A query in one line; a longer one is its first sentence if that fits, else cut at the last blank."""
    line = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    first = F.regexp_extract(line, r"^(.*?[.?!])(?:\s|$)", 1)
    head = F.substring(line, 1, limit)
    cut = F.when(head.contains(" "), F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return F.when(F.length(line) <= limit, line).when((first != "") & (F.length(first) <= limit), first).otherwise(cut)
