"""Word and spreadsheet files as tables: a file is one binary row, opened by one task with the standard library.

A file that is no archive, breaks the archive limits, or whose part a reader needs is missing or broken gives that reader
no rows and :func:`audit` a line; the others are not touched by it. A job's memory is bounded by the archive limits.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of an archive, name spaces, and the symbols of custom footnote marks.
MOST_PARTS, MOST_PART, MOST_BYTES, MOST_RATIO = 5000, 100 << 20, 400 << 20, 200
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
SYMBOLS = {"F02A": "*", "F020": "†", "F021": "‡", "F0A7": "§"}

#: Rows that go to Spark together.
ROWS = 4096

PARAGRAPHS = "path string, body_child int, paragraph int, in_document int, style string, text string"
CELLS = "path string, tbl int, row int, cell int, text string"
COMMENTS = "path string, comment_id string, source_id string, author string, date string, text string, paragraph int"
REVISIONS = "path string, revision_id string, type string, author string, date string, text string, in_document int"
NOTES = "path string, footnote_id int, text string"
REFERENCES = "path string, footnote_id int, display string, symbol boolean, paragraph int, preview string"
AUDIT = "path string, level string, part string, message string, n_bytes long"
SHEET = "path string, row int, header string, value string"


class BadArchive(ValueError):
    pass


def open_archive(content: bytes) -> zipfile.ZipFile:
    """The archive, if it keeps the limits."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, OSError) as e:
        raise BadArchive("not an archive") from e
    parts = z.infolist()
    if len(parts) > MOST_PARTS:
        raise BadArchive("too many parts")
    if any(p.file_size > MOST_PART for p in parts) or sum(p.file_size for p in parts) > MOST_BYTES:
        raise BadArchive("too large")
    if any(p.file_size > MOST_RATIO * max(1, p.compress_size) for p in parts):
        raise BadArchive("packed too tightly")
    return z


def part(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    """The root of a part; null if there is none. Parts that declare entities are refused."""
    if name not in z.namelist():
        return None
    try:
        data = z.read(name)
        if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
            raise BadArchive(f"{name} declares a document type")
        return ET.fromstring(data)
    except (ET.ParseError, zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError) as e:
        raise BadArchive(f"{name} is broken") from e


def run_text(e: ET.Element, *tags: str) -> str:
    """Text of an element's runs, inserted and deleted ones alike unless ``tags`` names some; tabs and breaks count."""
    wanted = tags or ("t", "delText", "tab", "br")
    return "".join({"tab": "\t", "br": "\n"}.get(x.tag[len(W) :], x.text or "") for x in e.iter() if x.tag.startswith(W) and x.tag[len(W) :] in wanted)


def squeeze(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def reader(schema: str, parse: Callable[[zipfile.ZipFile], Iterator[tuple]]) -> Callable[[DataFrame], DataFrame]:
    """Turns ``parse`` (an archive to rows without their path) into a step over (path, content)."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    held += [(path, *r) for r in list(parse(open_archive(content or b"")))]
                except BadArchive:
                    continue
                if len(held) >= ROWS:
                    yield pd.DataFrame(held, columns=names).astype(object)
                    held = []
        yield pd.DataFrame(held, columns=names).astype(object)

    def over(files: DataFrame) -> DataFrame:
        return files.select("path", "content").mapInPandas(run, schema)

    over.__doc__ = parse.__doc__
    return over


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``(path, content)`` of the files under ``path`` whose names match the glob ``pattern``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def _body(z: zipfile.ZipFile) -> ET.Element:
    root = part(z, "word/document.xml")
    if root is None or (body := root.find(f"{W}body")) is None:
        raise BadArchive("no body")
    return body


def _paragraphs(z: zipfile.ZipFile) -> Iterator[tuple]:
    """Paragraphs of the body with their three numbers: among the body's paragraphs, among those with text (null for an
    empty one), and among all of the file, tables included."""
    styles = part(z, "word/styles.xml")
    names = {s.get(f"{W}styleId"): n.get(f"{W}val") for s in (styles.iter(f"{W}style") if styles is not None else ()) if (n := s.find(f"{W}name")) is not None}
    body = _body(z)
    number = {id(p): k for k, p in enumerate(body.iter(f"{W}p"))}
    filled = 0
    for k, p in enumerate(body.findall(f"{W}p")):
        text = run_text(p).strip()
        style = p.find(f"{W}pPr/{W}pStyle")
        yield k, filled if text else None, number[id(p)], names.get(style.get(f"{W}val"), style.get(f"{W}val")) if style is not None else "Normal", text
        filled += bool(text)


def _cells(z: zipfile.ZipFile) -> Iterator[tuple]:
    """Cells of the body's tables; a cell's paragraphs are joined by a blank."""
    for t, table in enumerate(_body(z).findall(f"{W}tbl")):
        for r, row in enumerate(table.findall(f"{W}tr")):
            for c, cell in enumerate(row.findall(f"{W}tc")):
                yield t, r, c, " ".join(x for p in cell.iter(f"{W}p") if (x := run_text(p).strip()))


def _comments(z: zipfile.ZipFile) -> Iterator[tuple]:
    """Comments in their part's order, with the body paragraph they stand at: that of their range's start, else of their
    reference; a start between paragraphs belongs to the next one. Null if there is none."""
    root = part(z, "word/comments.xml")
    if root is None:
        return
    starts: dict[str, int] = {}
    marks: dict[str, int] = {}
    between: dict[str, int] = {}
    k = 0
    for child in _body(z):
        if child.tag == f"{W}p":
            starts |= {x.get(f"{W}id"): k for x in child.iter(f"{W}commentRangeStart")}
            for x in child.iter(f"{W}commentReference"):
                marks.setdefault(x.get(f"{W}id"), k)
            k += 1
        elif child.tag == f"{W}commentRangeStart":
            between[child.get(f"{W}id")] = k
    places = {c: n for c, n in between.items() if n < k} | marks | starts
    for n, c in enumerate((c for c in root.iter(f"{W}comment") if c.get(f"{W}id")), 1):
        text = " ".join(t.text or "" for t in c.iter(f"{W}t")).strip()
        yield f"C{n:03d}", c.get(f"{W}id"), c.get(f"{W}author", ""), c.get(f"{W}date", ""), text, places.get(c.get(f"{W}id"))


def _properties(e: ET.Element | None) -> str:
    """Properties by name, with their value where they have one."""
    known = [] if e is None else [x for x in e if x.tag.startswith(W) and not x.tag.endswith("Change")]
    return ", ".join(x.tag[len(W) :] + (f"={x.get(f'{W}val')}" if x.get(f"{W}val") else "") for x in known)


def _revisions(z: zipfile.ZipFile) -> Iterator[tuple]:
    """Tracked changes, numbered in document order; a paragraph's own ones come before those of its runs."""
    inline = {"ins": ("insertion", "t"), "del": ("deletion", "delText"), "moveFrom": ("move_from", "t", "delText"), "moveTo": ("move_to", "t")}
    n = 0

    def row(kind: str, e: ET.Element, text: str, k: int) -> tuple:
        nonlocal n
        n += 1
        return f"R{n:03d}", kind, e.get(f"{W}author", ""), e.get(f"{W}date", ""), text, k

    for k, p in enumerate(_body(z).iter(f"{W}p")):
        parent = {id(c): e for e in p.iter() for c in e}
        if (own := p.find(f"{W}pPr")) is not None:
            for e in own.findall(f"{W}rPr/{W}del"):
                yield row("paragraph_mark_deletion", e, "¶", k)
            for e in own.findall(f"{W}pPrChange"):
                yield row("paragraph_property_change", e, f"from [{_properties(e.find(f'{W}pPr'))}] to [{_properties(own)}]", k)
        for e in p.iter():
            kind = e.tag[len(W) :] if e.tag.startswith(W) else ""
            above = parent.get(id(e))
            if kind in inline and (kind == "ins" or above is None or above.tag != f"{W}rPr"):
                yield row(inline[kind][0], e, squeeze(run_text(e, *inline[kind][1:])), k)
            elif kind == "rPrChange" and above is not None:
                holder = parent.get(id(above))
                inside = "¶" if holder is not None and holder.tag == f"{W}pPr" else "".join(t.text or "" for t in holder.findall(f"{W}t")) if holder is not None else ""
                yield row("run_property_change", e, f"'{inside}' from [{_properties(e.find(f'{W}rPr'))}] to [{_properties(above)}]", k)


def _number(text: str | None) -> int:
    return int(text) if re.fullmatch(r"-?\d{1,9}", text or "") else 0


def _footnotes(z: zipfile.ZipFile) -> Iterator[tuple]:
    """Footnotes by id; separators (their type, or an id of 0 or less) are none. Paragraphs join by a blank."""
    root = part(z, "word/footnotes.xml")
    for e in () if root is None else root.findall(f"{W}footnote"):
        if _number(e.get(f"{W}id")) > 0 and e.get(f"{W}type") not in ("separator", "continuationSeparator"):
            yield _number(e.get(f"{W}id")), " ".join(x for p in e.findall(f"{W}p") if (x := run_text(p).strip()))


def _references(z: zipfile.ZipFile) -> Iterator[tuple]:
    """Footnote references in document order with the number or symbol shown; references with a mark of their own take
    no number. Body paragraph and its first 80 characters are null in a table."""
    shown = 0
    k = -1
    for child in _body(z):
        k += child.tag == f"{W}p"
        preview = run_text(child).strip()[:80] if child.tag == f"{W}p" else None
        marks = {id(x): run.find(f"{W}sym") for run in child.iter(f"{W}r") for x in run.findall(f"{W}footnoteReference")}
        for x in child.iter(f"{W}footnoteReference"):
            if _number(x.get(f"{W}id")) <= 0:
                continue
            symbol = x.get(f"{W}customMarkFollows") == "1"
            shown += not symbol
            sym = marks.get(id(x))
            display = SYMBOLS.get(sym.get(f"{W}char", "") if sym is not None else "", "*") if symbol else str(shown)
            yield _number(x.get(f"{W}id")), display, symbol, k if preview is not None else None, preview


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _sheet(z: zipfile.ZipFile) -> Iterator[tuple]:
    """Filled cells of the first sheet, under the header row's names; columns without a name and empty cells are left out."""
    book, links, strings = part(z, "xl/workbook.xml"), part(z, "xl/_rels/workbook.xml.rels"), part(z, "xl/sharedStrings.xml")
    if book is None or links is None or (first := book.find(f"{S}sheets/{S}sheet")) is None:
        raise BadArchive("no sheet")
    target = next((x.get("Target", "") for x in links if x.get("Id") == first.get(RELATION)), "")
    sheet = part(z, target.lstrip("/") if target.startswith("/") else f"xl/{target}")
    if sheet is None:
        raise BadArchive("no sheet")
    plain = lambda e: "".join(t.text or "" for t in e.iter(f"{S}t"))
    shared = [plain(e) for e in strings.findall(f"{S}si")] if strings is not None else []
    headers: dict[int, str] | None = None
    for n, row in enumerate(sheet.iter(f"{S}row")):
        cells, at = {}, -1
        for c in row.findall(f"{S}c"):
            at = _column(c.get("r")) if c.get("r") else at + 1
            value = c.findtext(f"{S}v", "")
            if c.get("t") == "s":
                value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
            elif c.get("t") == "inlineStr":
                value = plain(c)
            if value.strip():
                cells[at] = value.strip()
        if headers is None:
            headers = cells
        else:
            yield from ((n, headers[k], v) for k, v in cells.items() if k in headers)


paragraphs, cells, comments, revisions = reader(PARAGRAPHS, _paragraphs), reader(CELLS, _cells), reader(COMMENTS, _comments), reader(REVISIONS, _revisions)
footnotes, references, sheet = reader(NOTES, _footnotes), reader(REFERENCES, _references), reader(SHEET, _sheet)


def sheet_rows(cells: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``(path, row, ...)`` of :func:`sheet`'s cells: a column for each of ``columns`` (header in lower case to field), the
    first non-empty one where headers repeat; empty where missing. Rows without a title are dropped if there is one."""
    name = F.lower(F.trim("header"))
    fields = {f: [h for h, g in columns.items() if g == f] for f in dict.fromkeys(columns.values())}
    made = cells.groupBy("path", "row").agg(*[F.coalesce(F.min(F.when(name.isin(*hs), F.col("value"))), F.lit("")).alias(f) for f, hs in fields.items()])
    return made.where(F.col("title") != "") if "title" in fields else made


def audit(files: DataFrame) -> DataFrame:
    """A row per part (level ``info``) and per fault (``error``) of every file: no archive, limits, missing or broken parts."""
    names = [f.split()[0] for f in AUDIT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    z = open_archive(content or b"")
                except BadArchive as e:
                    out.append((path, "error", None, str(e), len(content or b"")))
                    continue
                out += [(path, "info", p.filename, "", p.file_size) for p in z.infolist()]
                out += [(path, "error", m, "missing", 0) for m in ("[Content_Types].xml", "word/document.xml") if m not in z.namelist()]
                for p in z.infolist():
                    if p.filename.endswith((".xml", ".rels")):
                        try:
                            part(z, p.filename)
                        except BadArchive as e:
                            out.append((path, "error", p.filename, str(e), p.file_size))
            yield pd.DataFrame(out, columns=names)

    return files.select("path", "content").mapInPandas(run, AUDIT)
