"""Rules on tables of their awkward cases: what they must give is written down by hand and is the query's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import authors as A
from folioflow.functions import latex as X
from folioflow.functions import replies as R
from folioflow.operators import extraction_gate as G
from folioflow.operators import fidelity as Q
from folioflow.operators import markers as M
from folioflow.sources import references as S
from folioflow.sources import reports as P

from .dual import Book

B = Book()


def _literal(v: object) -> str:
    if v is None:
        return "CAST(NULL AS VARCHAR)"
    return f"CAST({v} AS BIGINT)" if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def add(name: str, query: Callable[[SparkSession], DataFrame], columns: list[str], expected: list[tuple]) -> None:
    """``query`` must give the rows ``expected``."""
    values = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in expected)
    B.add(name, lambda spark, _: query(spark), f"SELECT * FROM (VALUES {values}) t({', '.join(columns)})")


def table(schema: str, rows: list[tuple]) -> Callable[[SparkSession], DataFrame]:
    return lambda spark: spark.createDataFrame(rows, schema)


_NAMES = table("id long, a string", list(enumerate([None, "", "Smith, John, Jr.", "John Smith", ", John", "Smith,", "Smith, John and Doe, Jane", "Ann Lee; Bob Ray;", "Smith, John", "Ann Lee, Bob Ray", "A B, C D, E F", "Plato", "José Núñez and X"])))
add("author_flip_cases", lambda s: _NAMES(s).select("id", A.flip_author(F.col("a")).alias("flipped")), ["id", "flipped"], [
    (0, ""), (1, ""), (2, "John Jr. Smith"), (3, "John Smith"), (4, "John"), (5, "Smith"), (6, "John and Doe Jane Smith"), (7, "Ann Lee; Bob Ray;"), (8, "John Smith"), (9, "Bob Ray Ann Lee"), (10, "C D E F A B"), (11, "Plato"), (12, "José Núñez and X")])
add("author_list_cases", lambda s: _NAMES(s).select("id", A.authors_bibtex(A.author_list(F.col("a"))).alias("bibtex"), F.size(A.author_list(F.col("a"))).cast("long").alias("n")), ["id", "bibtex", "n"], [
    (0, "", 0), (1, "", 0), (2, "Smith and John and Jr.", 3), (3, "Smith, John", 1), (4, ", John", 1), (5, "Smith", 1), (6, "Smith, John and Doe, Jane", 2), (7, "Lee, Ann and Ray, Bob", 2), (8, "Smith, John", 1),
    (9, "Lee, Ann and Ray, Bob", 2), (10, "B, A and D, C and F, E", 3), (11, "Plato", 1), (12, "Núñez, José and X", 2)])
_KEYS = table("id long, a string, y string, t string", [(1, "José Núñez and X", "2020", "On the Law of Things"), (2, None, None, "The"), (3, "O'Neil, Pat", "", "A 3rd View"), (4, "Ann Lee, Bob Ray", "1999", ""), (5, "!!", "2001", None)])
add("cite_key_cases", lambda s: _KEYS(s).select("id", A.base_key(A.author_list(F.col("a")), F.col("y"), F.col("t")).alias("base"), A.screening_key(F.col("a"), F.col("y")).alias("screening"), A.numbered_key(F.col("a"), F.col("y"), F.col("id")).alias("numbered")), ["id", "base", "screening", "numbered"], [
    (1, "nunez2020law", "X2020", "X20201"), (2, "unknownndthe", "Unknown", "ref2"), (3, "oneilndrd", "ONeil", "ONeil3"), (4, "lee1999", "Lee1999", "Lee19994"), (5, "2001", "Unknown2001", "20015")])
add("accent_cases", lambda s: table("id long, t string", [(1, "Éçøß ﬁ ñ"), (2, None), (3, "")])(s).select("id", A.strip_accents("t").alias("t")), ["id", "t"], [(1, "Ecøß fi n"), (2, None), (3, "")])

_REPLIES = table("id long, r string", [(1, "DECISION: Yes\nCONFIDENCE: High\nRATIONALE: same: DOI"), (2, "yes, they are"), (3, None), (4, " decision: no\nrationale: x"), (5, "Decision: yes\nDecision: no\nConfidence: low"), (6, "DECISION: yes")])
add("verdict_cases", lambda s: _REPLIES(s).select("id", R.pair_verdict(F.col("r")).alias("v")).select("id", "v.*"), ["id", "decision", "confidence", "rationale"], [
    (1, "yes", "high", "same: DOI"), (2, "yes", "", ""), (3, "no", "", ""), (4, "no", "", "x"), (5, "no", "low", ""), (6, "no", "", "")])
_SCREENED = table("id long, r string", [(1, '```json\n{"relevance_score": 7, "rationale": "fits", "paper_type": "empirical"}\n```'), (2, "no json"), (3, '{"relevance_score": 0}')])
add("screening_cases", lambda s: _SCREENED(s).select("id", R.screening(F.col("r")).alias("v")).select("id", F.col("v.score").cast("long").alias("score"), "v.rationale", "v.paper_type", "v.relationship"), ["id", "score", "rationale", "paper_type", "relationship"], [
    (1, 7, "fits", "empirical", "N/A"), (3, 0, "", "N/A", "N/A")])
B.sql["screening_cases"] += " UNION ALL SELECT CAST(2 AS BIGINT), CAST(NULL AS BIGINT), NULL, NULL, NULL"
add("prompt_cases", lambda s: table("id long, t string, a string, y int", [(1, "T", "", 2020), (2, None, "A", None)])(s).select("id", R.labelled_fields(Title=F.col("t"), Authors=F.col("a"), Year=F.col("y")).alias("text")), ["id", "text"], [(1, "Title: T\nYear: 2020"), (2, "Authors: A")])
_QUERIES = table("id long, q string", [(1, "  what\n is  it? "), (2, "Short one. " + "word " * 20), (3, "abcdefgh " * 6 + "."), (4, "x" * 40), (5, None)])
add("query_fit_cases", lambda s: _QUERIES(s).select("id", R.fit_query(F.col("q"), 30).alias("q")), ["id", "q"], [(1, "what is it?"), (2, "Short one."), (3, "abcdefgh abcdefgh abcdefgh"), (4, "x" * 30), (5, "")])

_TEX = table("id long, t string", [(1, "a % gone\n50\\% kept % gone\n%all"), (2, None), (3, "\\begin{document} x \\end{document} y"), (4, "head  \n\\begin{document}\nbody"), (5, " plain ")])
add("tex_part_cases", lambda s: _TEX(s).select("id", X.strip_comments(F.col("t")).alias("plain"), X.preamble(F.col("t")).alias("head"), X.body(F.col("t")).alias("body")), ["id", "plain", "head", "body"], [
    (1, "a \n50\\% kept \n", "", "a % gone\n50\\% kept % gone\n%all"), (2, "", "", ""), (3, "\\begin{document} x \\end{document} y", "", "x"), (4, "head  \n\\begin{document}\nbody", "head", "body"), (5, " plain ", "", "plain")])
_NOTED = table("id long, t string", [(1, "\\title[S]{A {b} \\{ c}x\\footnote{one {1}}y\\footnote[2]{two}"), (2, "none"), (3, "a\\footnote{open"), (4, None)])
add("tex_command_cases", lambda s: _NOTED(s).select("id", X.command(F.col("t"), "title").alias("title"), X.take_footnotes("t").alias("f")).select("id", "title", "f.text", F.array_join("f.notes", "|").alias("notes")), ["id", "title", "text", "notes"], [
    (1, "A {b} \\{ c", "\\title[S]{A {b} \\{ c}xy", "one {1}|two"), (2, None, "none", ""), (3, None, "a", "open"), (4, None, "", "")])
_SECTIONED = table("id long, t string", [(1, "lead \\section*{One} text \\subsection[s]{Two {x}}\nmore"), (2, "none "), (3, "\\section{A}"), (4, None)])
add("tex_section_cases", lambda s: _SECTIONED(s).select("id", F.posexplode(X.sections("t")).alias("n", "x")).select("id", F.col("n").cast("long").alias("n"), "x.heading", "x.text"), ["id", "n", "heading", "text"], [
    (1, 0, "(intro)", "lead"), (1, 1, "One", "text"), (1, 2, "Two {x}", "more"), (2, 0, "(body)", "none"), (3, 0, "A", ""), (4, 0, "(body)", "")])
_COUNTERS = table("n long", [(k,) for k in (-1, 0, 1, 4, 26, 27, 52, 702, 703, 1994)])
add("counter_cases", lambda s: _COUNTERS(s).select("n", X.roman(F.col("n")).alias("roman"), X.letters(F.col("n")).alias("letters")), ["n", "roman", "letters"], [
    (-1, "-1", "-1"), (0, "0", "0"), (1, "i", "a"), (4, "iv", "d"), (26, "xxvi", "z"), (27, "xxvii", "aa"), (52, "lii", "az"), (702, "dccii", "zz"), (703, "dcciii", "aaa"), (1994, "mcmxciv", "bxr")])
_NUMBERS = table("id long, t string", [(1, " 1.5e-03 "), (2, "7"), (3, "-2E10"), (4, "1.23(4)"), (5, "12(3)"), (6, None), (7, "1.0(12)")])
add("number_cases", lambda s: _NUMBERS(s).select("id", X.scientific(F.col("t")).alias("scientific"), X.uncertainty("t").alias("uncertain")), ["id", "scientific", "uncertain"], [
    (1, "1.5×10\\textsuperscript{-3}", " 1.5e-03 "), (2, "7", "7"), (3, "-2×10\\textsuperscript{10}", "-2E10"), (4, "1.23(4)", "1.23 ± 0.04"), (5, "12(3)", "12 ± 3"), (6, "", None), (7, "1.0(12)", "1.0 ± 1.2")])
_FILES = table("path string, text string", [("m/main.tex", "A \\input{one} B \\include{ sub/two } C \\input{gone}"), ("m/one.tex", "1\\input{sub/two}"), ("m/sub/two.tex", "2"), ("m/loop.tex", "l\\input{loop}"), ("m/null.tex", None)])
_ROOTS = table("path string", [("m/main.tex",), ("m/null.tex",), ("m/loop.tex",)])
add("include_cases", lambda s: X.inline_includes(_FILES(s), _ROOTS(s), depth=3).select("path", "text"), ["path", "text"], [("m/main.tex", "A 12 B 2 C \\input{gone}"), ("m/null.tex", ""), ("m/loop.tex", "llll\\input{loop}")])
add("include_drop_cases", lambda s: X.inline_includes(_FILES(s), _ROOTS(s), depth=2, missing="drop").select("path", "text"), ["path", "text"], [("m/main.tex", "A 12 B 2 C "), ("m/null.tex", ""), ("m/loop.tex", "lll")])
_PARTS = table("ord long, text string", [(2, "\\begin{document}two\\end{document}"), (1, "HEAD\n\\begin{document}one\\end{document}"), (3, "three")])
add("combine_cases", lambda s: X.combine(_PARTS(s)), ["text", "n"], [("HEAD\n\\begin{document}\none\n\ntwo\n\nthree\n\\end{document}\n", 3)])

_RIS = "TY  - JOUR\nT1  - One\nAU  - Lee, Ann\nAU  - Ray, Bob, Jr.\nPY  - 2020\nDO  - 10.1/a\nAB  - first\nAB  - second\nKW  - skip\n  wrapped\nJF  - Journal F\nER  -\n\nTY  - RPRT\nTI  - Two\ngoes on\nN2  - note\nUR  - http://x\n"
_ONE_LINE = "TY - GEN ID - B1 TI - A Title PY - 2021 AU - Ann Lee, Bob DO - 10.2/b ER -\nnoise\nTY - GEN ID - B2 TI - Last"
_REFERENCES = table("path string, text string", [("a.ris", _RIS), ("b.txt", _ONE_LINE), ("e.ris", None)])
_COLUMNS = ["path", "type", "title", "authors", "year", "journal", "doi", "abstract", "url"]


def _ris(dialect: str) -> Callable[[SparkSession], DataFrame]:
    return lambda s: S.parse_ris(_REFERENCES(s), dialect).select(_COLUMNS)


_SINGLES = [("b.txt", "GEN", "A Title", "Ann Lee, Bob", "2021", "", "https://doi.org/10.2/b", "", "https://doi.org/10.2/b"), ("b.txt", "GEN", "Last", "", "", "", "", "", "")]
_TWO = ("a.ris", "RPRT", "Two goes on", "", "", "", "", "note", "http://x")
add("ris_plain_cases", _ris("plain"), _COLUMNS, [("a.ris", "JOUR", "One", "Lee, Ann, Ray, Bob, Jr.", "2020", "", "https://doi.org/10.1/a", "first second", "https://doi.org/10.1/a"), *_SINGLES])
add("ris_wrapped_cases", _ris("wrapped"), _COLUMNS, [("a.ris", "JOUR", "One", "Ann Lee, Bob Jr. Ray", "2020", "Journal F", "https://doi.org/10.1/a", "second", "https://doi.org/10.1/a"), _TWO, *_SINGLES])
add("ris_as_is_cases", _ris("wrapped-as-is"), _COLUMNS, [("a.ris", "JOUR", "One", "Lee, Ann, Ray, Bob, Jr.", "2020", "Journal F", "https://doi.org/10.1/a", "second", "https://doi.org/10.1/a"), _TWO, *_SINGLES])

_BIB = '@article{a, title = {The {US} {Co{de}}}, author="Lee, Ann and Ray, Bob", year = 2020,\n journal={J \\& K}, doi={10.1/c}}\n@misc{b, note={x = {title = y}}, title = "B, c", booktitle = {Book}}\n@misc{c, author={X}}\n@book{d, title={Open'
_BIBS = table("path string, text string", [("a.bib", _BIB), ("x.bib", "TY  - JOUR\nTI  - Mislabelled\nER  - \n"), ("y.dat", " @misc{k, title={Sniffed}}"), ("z.ris", "@misc{k, title={Other}}"), ("n.bib", None)])
_MORE = [("a.bib", "misc", "B, c", "", "", "Book", "", "", ""), ("a.bib", "book", "Open", "", "", "", "", "", ""), ("y.dat", "misc", "Sniffed", "", "", "", "", "", "")]
_ANN = ("2020", "J \\& K", "https://doi.org/10.1/c", "", "https://doi.org/10.1/c")
add("bibtex_cases", lambda s: S.parse_bibtex(_BIBS(s)).select(_COLUMNS), _COLUMNS, [("a.bib", "article", "The US Code", "Ann Lee, Bob Ray", *_ANN), *_MORE, ("z.ris", "misc", "Other", "", "", "", "", "", "")])
add("bibtex_tex_cases", lambda s: S.parse_bibtex(_BIBS(s).where("path = 'a.bib'"), tex=True, flip=False).select(_COLUMNS), _COLUMNS, [("a.bib", "article", "The US Code", "Lee, Ann, Ray, Bob", "2020", "J & K", *_ANN[2:]), *_MORE[:2]])
add("reference_file_cases", lambda s: S.read_references(_BIBS(s)).select(_COLUMNS), _COLUMNS, [
    ("a.bib", "article", "The US Code", "Ann Lee, Bob Ray", *_ANN), *_MORE, ("z.ris", "misc", "Other", "", "", "", "", "", ""), ("x.bib", "JOUR", "Mislabelled", "", "", "", "", "", "")])
add("detex_cases", lambda s: table("id long, t string", [(1, "A \\& B 5\\% \\'{e}t\\`a \\\"o"), (2, "\\{x\\}")])(s).select("id", S.detex(F.col("t")).alias("t")), ["id", "t"], [(1, "A & B 5% eta o"), (2, "{x}")])
_SOURCES = table("id long, s string, c string, f string", [(1, "ssrn", "9%", "x"), (2, None, "95%", "x"), (3, "", "7", "my_undermind_2"), (4, "own", "95%", "x"), (5, None, None, "stem"), (6, "undermind-old", None, "x")])
add("detect_source_cases", lambda s: _SOURCES(s).select("id", S.detect_source(F.col("s"), F.col("c"), F.col("f")).alias("source")), ["id", "source"], [(1, "ssrn"), (2, "undermind"), (3, "undermind"), (4, "own"), (5, "stem"), (6, "undermind")])
_WRITTEN = table("title string, authors string, year string, journal string, doi string, abstract string, url string", [("T", "Ann Lee, Bob", "2020", "J", "https://doi.org/10.1/x", "", "u"), (None, "", None, None, None, None, None)])
add("ris_layout_cases", lambda s: S.to_ris(_WRITTEN(s)).union(S.to_ris(_WRITTEN(s), "authors-first")), ["value"], [
    ("TY  - JOUR\nT1  - T\nAU  - Ann Lee\nAU  - Bob\nJO  - J\nPY  - 2020\nDO  - 10.1/x\nUR  - u\nER  -\n",), ("TY  - JOUR\nER  -\n",),
    ("TY  - JOUR\nAU  - Ann Lee\nAU  - Bob\nTI  - T\nJO  - J\nPY  - 2020\nDO  - 10.1/x\nUR  - u\nER  - \n",), ("TY  - JOUR\nER  - \n",)])

_REPORT = """intro | a | b | c
```
# KEY PAPERS
```
## Key Papers:
| Title | Authors | Year | Venue | DOI |
|---|:--:|---|---|---|
| 1. *1984 and Markets* | Ann Lee and Bob Ray (2019) | 2020 | J Law | doi 10.1234/ab.c). |
- Second | Authors | n.d. | Venue | http://x.y
too | few
### 2. **Third Paper** [cite: 4]
**Authors:** Cy Dee, and Eve (2001)
*Venue:* _Outlet_
### Methodological note
prose (1999)
### Fourth
Author - Guy
seen (1998) here
# Next
| not | in | the | section |"""
_REPORTS = table("doc_id long, text string", [(1, _REPORT), (2, "no section | a | b | c"), (3, None)])


def _report_lines(spark: SparkSession) -> DataFrame:
    return P.key_papers_section(_REPORTS(spark).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")))


_PAPER = ["doc_id", "title", "authors", "year", "journal", "doi", "url"]
add("key_papers_cases", lambda s: P.pipe_rows(_report_lines(s)).unionByName(P.narrative_entries(_report_lines(s))).select(_PAPER), _PAPER, [
    (1, "1984 and Markets", "Ann Lee, Bob Ray", "2020", "J Law", "https://doi.org/10.1234/ab.c", ""), (1, "Second", "", "", "", "", "http://x.y"),
    (1, "Third Paper", "Cy Dee, Eve", "2001", "Outlet", "", ""), (1, "Fourth", "Guy", "1998", "", "", "")])
_JSON = table("doc_id long, text string", [(1, '{"a": [{"title": "A long title", "url": "http://a", "sub": {"name": "Nested name", "uri": "https://b"}}, {"title": "short", "url": "http://c"}], "b": {"title": "No address", "url": "ftp://d"}}'), (2, "broken"), (3, None)])
add("json_walk_cases", lambda s: P.linked_titles(_JSON(s)).select("doc_id", F.col("n").cast("long").alias("n"), "title", "url"), ["doc_id", "n", "title", "url"], [(1, 0, "A long title", "http://a"), (1, 1, "Nested name", "https://b")])
_HITS = table("title string, authors string, year string, doi string, abstract string, journal string, url string", [(" A  good\ttitle ", "X ", "c. 2019", "", None, "J", "http://doi.org/10.1000/z.,"), ("short", "", "", "", "", "", ""), ("Longer", None, None, "10.5555/Q", None, None, None)])
add("raw_hit_cases", lambda s: P.raw_hits(_HITS(s)).select("title", "authors", "year", "doi", "journal", "source"), ["title", "authors", "year", "doi", "journal", "source"], [
    ("A good title", "X", "2019", "https://doi.org/10.1000/z", "J", "websearch"), ("Longer", "", "", "https://doi.org/10.5555/Q", "", "websearch")])
_NOTES = table(M.NOTES, [(1, 0, "*", "star"), (1, 1, "10", "ten"), (1, 2, "2", "two"), (1, 3, "", "loose"), (2, 0, "1", " ")])
add("endnote_cases", lambda s: M.endnotes(_NOTES(s)), ["doc_id", "text"], [(1, "[^2]: two\n[^10]: ten\n[^*]: star")])

_PAGES = table("doc_id long, text string, density double", [
    (1, "| |(1)|(2)|(3)|\n|---|---|---|---|\n|Market Cap R-squared|0.216|0.444|1.359 ∗∗∗ (0.310) 0.572|\n|Observations|1.47m|1.47m Yes Yes|1.44m|\n|Country FE|No|Yes||", None),
    (2, "|Macro|κ|\n|United States|0.7396 0.7063 0.6956 0.6331 0.5782|\n|CLI|An index from 0 to 1 over 1980 to 2005 (Chilton 2018).|\n|Fixed effects Yes|1|\n|FE Yes|1|", None),
    (3, "a \ue001 b \ue000\ue001\nplain", 0.5), (4, "$$\n\n$$\n$$\nx = y\n$$\n$$\n\\intertext { l }\n$$\n$$\nopen", None),
    (5, "I _ { it } = \\Phi \\theta + \\gamma ≥ 2.66 × x\n$x = 1 + \\a \\b \\c$\n$$\na = b = c = d = e\n$$\na = b = c = d = e\n# a = b = c = d", 0.6),
    (6, "a = b = c = d = e", 0.2), (7, " \n\u00a0", 0.9), (8, None, None), (9, "$$\nx\n$$\n$$\ny\n$$\na = b = c = d = e", 0.9)])
add("extraction_gate_cases", lambda s: G.gate(_PAGES(s), density_col="density"), ["doc_id", "line", "kind", "detail"], [
    (1, 3, "merged-table-row", "col 4, two values: 1.359 ∗∗∗ (0.310) 0.572"), (1, 4, "merged-table-row", "col 3, two values: 1.47m Yes Yes"),
    (2, 2, "merged-table-row", "col 2, column in a cell: 0.7396 0.7063 0.6956 0.6331 0.5782"), (2, 4, "merged-table-row", "col 1, flag in a label: Fixed effects Yes"),
    (3, 1, "stray-glyph", "U+E000, U+E001"), (4, 1, "broken-equation", "empty block"), (4, 7, "broken-equation", "intertext"),
    (5, 1, "flattened-equation", "I _ { it } = \\Phi \\theta + \\gamma ≥ 2.66 × x"), (5, 6, "flattened-equation", "a = b = c = d = e"), (7, 1, "empty-output", ""), (8, 1, "empty-output", "")])
_RUNS = table("id long, cell string", [(1, "0.7396 1,528 42.4% (0.310) -0.05 0.137***"), (2, "from 0 to 1"), (3, None), (4, "$5 x 6 7")])
add("number_run_cases", lambda s: _RUNS(s).select("id", G.longest_number_run(F.col("cell")).cast("long").alias("n")), ["id", "n"], [(1, 6), (2, 1), (3, 0), (4, 2)])
_GLYPHS = table("id long, text string", [(1, "a\n\ue000 \uf8ff\nb \ue000\n\n "), (2, None), (3, "\ue123")])
add("private_line_cases", lambda s: _GLYPHS(s).select("id", G.strip_private_lines(F.col("text")).alias("text")), ["id", "text"], [(1, "a\nb \ue000\n\n "), (2, ""), (3, "")])
_GUARDED = table("id long, text string", [(1, "a\n```\n$$\n```\nb"), (2, "$$ x\n```\ny $$\nz"), (3, "$$x$$\n$$\nx"), (4, None)])
add("protected_line_cases", lambda s: _GUARDED(s).select("id", F.array_join(F.transform(G.protected_lines("text"), lambda b: b.cast("int").cast("string")), "").alias("mask")), ["id", "mask"], [(1, "01110"), (2, "1110"), (3, "011"), (4, "0")])
add("image_cases", lambda s: table("id long, text string", [(1, "![a](b) <IMG src> ```![no]``` ![c"), (2, None)])(s).select("id", G.image_references(F.col("text")).cast("long").alias("n")), ["id", "n"], [(1, 3), (2, 0)])

_PAIRED = table("doc_id long, compiled string, converted string, refs long, broken boolean", [
    (1, "Table 1,234.5 of the Law law of 7 7 cats cats zebras", "table 1,234.5 the LAW", None, None), (2, "alpha beta", "alpha beta \\textit{x} $", 0, False), (3, "cost $5 gamma", "cost $5 gamma", 0, False),
    (4, None, None, None, None), (5, "", "extra words", 0, False), (6, "alpha", "alpha", 2, False), (7, "alpha", "alpha", 0, True), (8, "A_b \u00c9t\u00e9 x9", "\u00e9t\u00e9 9", 0, False)])
add("fidelity_cases", lambda s: Q.report(_PAIRED(s), unresolved="refs", failed="broken").withColumn("missing_percent", F.col("missing_percent").cast("long")), ["doc_id", "n_tokens", "n_missing", "n_missing_numbers", "missing_percent", "n_leftover", "verdict"], [
    (1, 7, 3, 1, 42, 0, "FLAG"), (2, 2, 0, 0, 0, 2, "FLAG"), (3, 3, 0, 0, 0, 0, "OK"), (4, 0, 0, 0, 0, 0, "OK"), (5, 0, 0, 0, 0, 0, "OK"), (6, 1, 0, 0, 0, 0, "FLAG"), (7, 1, 0, 0, 0, 0, "FLAG"), (8, 2, 0, 0, 0, 0, "OK")])
add("missing_token_cases", lambda s: Q.ranked_missing(Q.missing_tokens(_PAIRED(s)), 2).withColumn("rank", F.col("rank").cast("long")), ["doc_id", "token", "n", "first", "rank"], [(1, "7", 2, 5, 1), (1, "cats", 2, 7, 2)])
add("label_count_cases", lambda s: _PAIRED(s).where("doc_id in (1, 4)").select("doc_id", F.explode(Q.label_counts(F.col("compiled"))).alias("label", "n")), ["doc_id", "label", "n"], [(1, "Table", 1), (1, "Figure", 0), (1, "Equation", 0), (4, "Table", 0), (4, "Figure", 0), (4, "Equation", 0)])
_LOGS = table("id long, log string, given string", [(1, "Tables detected: 4\nTables inserted: 3 \nTables detected: 9", None), (2, "x Tables detected: 4", "7"), (3, None, "none"), (4, "Tables detected: x", None)])
add("log_count_cases", lambda s: _LOGS(s).select("id", Q.log_count(F.col("log"), "Tables detected").alias("logged"), Q.first_present(F.col("given"), Q.log_count(F.col("log"), "Tables detected")).alias("n")).fillna(-1), ["id", "logged", "n"], [(1, 4, 4), (2, -1, 7), (3, -1, 0), (4, -1, 0)])
add("command_count_cases", lambda s: table("id long, t string", [(1, "\\cite{a} \\citep{b} \\cite[x]{c}"), (2, None)])(s).select("id", F.explode(Q.command_counts(F.col("t"), ["cite", "ref"])).alias("command", "n")), ["id", "command", "n"], [(1, "cite", 2)])

QUERIES, SQL = B.queries, B.sql
