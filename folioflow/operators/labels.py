"""Labels of LaTeX runs: the table of an auxiliary file, and references resolved against it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds by a label's prefix, names by kind.
KINDS = {
    "tab": "table", "tbl": "table", "fig": "figure", "eq": "equation", "alg": "algorithm", "algorithm": "algorithm", "algocf": "algorithm",
    "sec": "section", "subsec": "subsection", "subsubsec": "subsubsection", "app": "appendix",
}
NAMES = {
    "table": ("Table", "Tables"), "figure": ("Figure", "Figures"), "section": ("Section", "Sections"), "subsection": ("Section", "Sections"),
    "subsubsection": ("Section", "Sections"), "equation": ("Equation", "Equations"), "algorithm": ("algorithm", "algorithms"),
    "appendix": ("Appendix", "Appendices"), "reference": ("Reference", "References"),
}
COMMAND = re.compile(r"\\(?:([Cc]refrange)\s*\{([^{}]*)\}\s*\{([^{}]*)\}|([Cc]ref|eqref|autoref|ref)\s*\{([^{}]*)\})")
RESOLVED = "doc_id long, text string, n_refs int, missing array<string>"


def label_kind(label: Column) -> Column:
    prefix = F.split_part(label, F.lit(":"), F.lit(1))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[prefix], F.lit("reference"))


def aux_labels(aux: DataFrame) -> DataFrame:
    """``(doc_id, label, number, page, kind)`` of the ``\\newlabel`` lines in (doc_id, text); a label's last line counts,
    and the kind is that of its ``@cref`` line, else of its prefix."""
    lines = aux.select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line")).where(F.col("line").startswith("\\newlabel{"))
    part = lambda pattern, k: F.regexp_extract("line", pattern, k)
    plain, cref = r"^\\newlabel\{([^}]+)\}\{\{([^{}]*)\}\{([^{}]*)\}", r"^\\newlabel\{([^}]+)@cref\}\{\{\[([^\]]+)\]"
    is_cref = F.col("line").rlike(cref)
    read = lines.select("doc_id", "n", is_cref.alias("c"), F.when(is_cref, part(cref, 1)).otherwise(part(plain, 1)).alias("label"), part(plain, 2).alias("number"), part(plain, 3).alias("page"), part(cref, 2).alias("kind"))
    good = read.where((F.col("label") != "") & ~F.col("label").endswith("@cref"))
    last = lambda c, when: F.max_by(F.col(c), F.when(when, F.col("n")))
    one = good.groupBy("doc_id", "label").agg(last("number", ~F.col("c")).alias("number"), last("page", ~F.col("c")).alias("page"), last("kind", F.col("c")).alias("kind"))
    return one.where("number is not null").withColumn("kind", F.coalesce("kind", label_kind(F.col("label"))))


def _listed(items: list[str]) -> str:
    """Items as English lists them."""
    return " and ".join(items) if len(items) < 3 else f"{', '.join(items[:-1])}, and {items[-1]}"


def render(command: str, labels: list[str], known: dict[str, tuple[str, str]], names: dict[str, tuple[str, str]]) -> str:
    """A reference's text; a label that is not known shows as ``??label??``."""

    def kind(label: str) -> str:
        number, k = known.get(label, ("", KINDS.get(label.split(":", 1)[0], "reference")))
        return "appendix" if k in ("section", "subsection", "subsubsection") and re.match("[A-Z]", number) else k

    numbers = [known[x][0] if x in known else f"??{x}??" for x in labels]
    kinds = [kind(x) for x in labels]
    name = [names.get(k) or names.get(KINDS.get(k, ""), ("Reference", "References")) for k in kinds]
    if command == "eqref":
        return _listed([f"({n})" for n in numbers])
    if command == "ref" or not labels:
        return _listed(numbers)
    if command.endswith("range"):
        return f"{name[0][1]} {numbers[0]}-{numbers[1]}" if kinds[0] == kinds[1] else f"{name[0][0]} {numbers[0]}-{name[1][0]} {numbers[1]}"
    if len(set(kinds)) == 1:
        return f"{name[0][len(labels) > 1]} {_listed(numbers)}"
    return _listed([f"{x[0]} {n}" for x, n in zip(name, numbers)])


def resolve_references(docs: DataFrame, labels: DataFrame, names: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Texts (doc_id, text) with their references written out (:data:`RESOLVED`) by the labels of the same document;
    ``names`` overrides names by kind. Null texts are empty; labels that are missing are listed once, in order."""
    called = NAMES | (names or {})
    entries = labels.groupBy("doc_id").agg(F.collect_list(F.struct("label", "number", "kind")).alias("labels"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text, held in zip(pdf["doc_id"], pdf["text"], pdf["labels"]):
                known = {x["label"]: (x["number"], x["kind"]) for x in held} if held is not None else {}
                missing: set[str] = set()
                n = 0

                def write(m: re.Match) -> str:
                    nonlocal n
                    n += 1
                    asked = [m[2].strip(), m[3].strip()] if m[1] else [x.strip() for x in m[5].split(",") if x.strip()]
                    missing.update(x for x in asked if x and x not in known)
                    return render(m[1] or m[4], asked, known, called)

                written = COMMAND.sub(write, text or "")
                out.append((doc_id, written, n, sorted(missing)))
            yield pd.DataFrame(out, columns=["doc_id", "text", "n_refs", "missing"])

    return docs.select("doc_id", "text").join(entries, "doc_id", "left").mapInPandas(run, RESOLVED)
