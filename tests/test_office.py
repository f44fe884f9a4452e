"""Word and spreadsheet files made here, read back by every reader."""

from __future__ import annotations

import io
import zipfile

import pytest

from folioflow.sources import office

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCUMENT = f"""<w:document {NS}><w:body>
<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p>
<w:p/>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>
<w:commentRangeStart w:id="7"/>
<w:p><w:pPr><w:rPr><w:del w:author="B" w:date="d"/></w:rPr><w:pPrChange w:author="B"><w:pPr><w:jc w:val="left"/></w:pPr></w:pPrChange></w:pPr>
<w:r><w:t>Old </w:t></w:r><w:ins w:author="A" w:date="d1"><w:r><w:t>new  word</w:t></w:r></w:ins><w:del w:author="A"><w:r><w:delText>gone</w:delText></w:r></w:del>
<w:commentRangeStart w:id="8"/><w:r><w:footnoteReference w:id="2"/></w:r><w:r><w:footnoteReference w:id="3" w:customMarkFollows="1"/><w:sym w:char="F021"/></w:r>
<w:r><w:rPr><w:b/><w:rPrChange w:author="C"><w:rPr><w:i/></w:rPr></w:rPrChange></w:rPr><w:t>bold</w:t></w:r></w:p>
<w:p><w:r><w:commentReference w:id="9"/><w:footnoteReference w:id="4"/></w:r></w:p>
</w:body></w:document>"""
PARTS = {
    "[Content_Types].xml": "<Types/>",
    "word/document.xml": DOCUMENT,
    "word/styles.xml": f'<w:styles {NS}><w:style w:styleId="H1"><w:name w:val="Heading 1"/></w:style></w:styles>',
    "word/comments.xml": f'<w:comments {NS}>' + "".join(f'<w:comment w:id="{i}" w:author="A{i}" w:date="x"><w:p><w:r><w:t>note</w:t></w:r><w:r><w:t>{i}</w:t></w:r></w:p></w:comment>' for i in (7, 8, 9, 10)) + "</w:comments>",
    "word/footnotes.xml": f'<w:footnotes {NS}><w:footnote w:id="0" w:type="separator"><w:p/></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>See A.</w:t></w:r></w:p><w:p><w:r><w:t>And B.</w:t></w:r></w:p></w:footnote></w:footnotes>',
}
X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
BOOK = {
    "xl/workbook.xml": f'<workbook {X}><sheets><sheet name="s" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {X}><si><t>Title</t></si><si><t>Wid</t><t>gets</t></si></sst>",
    "xl/worksheets/sheet1.xml": f'<worksheet {X}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Year</t></is></c></row>'
    '<row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>9</v></c><c r="C2"><v>2020</v></c></row><row><c r="C3"><v>2021</v></c></row></sheetData></worksheet>',
}


def archive(parts: dict[str, str]) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return held.getvalue()


@pytest.fixture(scope="module")
def word(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("office")
    (root / "a.docx").write_bytes(archive(PARTS))
    (root / "b.docx").write_bytes(b"no archive")
    (root / "c.docx").write_bytes(archive(PARTS | {"word/document.xml": "<broken"}))
    (root / "d.docx").write_bytes(archive(PARTS | {"word/media/x.bin": "\0" * (1 << 20)}))
    (root / "s.xlsx").write_bytes(archive(BOOK))
    return f"file://{root}"


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_word(spark, word):
    files = office.files(spark, word, "*.docx")
    assert rows(office.paragraphs(files), "body_child", "paragraph", "in_document", "style", "text") == [
        (0, 0, 0, "Heading 1", "Title"), (1, None, 1, "Normal", ""), (2, 1, 5, "Normal", "Old new  wordgonebold"), (3, None, 6, "Normal", "")
    ]
    assert rows(office.cells(files), "tbl", "row", "cell", "text") == [(0, 0, 0, "a b"), (0, 0, 1, "")]
    assert rows(office.comments(files), "comment_id", "source_id", "author", "text", "paragraph") == [
        ("C001", "7", "A7", "note 7", 2), ("C002", "8", "A8", "note 8", 2), ("C003", "9", "A9", "note 9", 3), ("C004", "10", "A10", "note 10", None)
    ]
    assert rows(office.revisions(files), "revision_id", "type", "author", "text", "in_document") == [
        ("R001", "paragraph_mark_deletion", "B", "¶", 5), ("R002", "paragraph_property_change", "B", "from [jc=left] to [rPr]", 5), ("R003", "insertion", "A", "new word", 5),
        ("R004", "deletion", "A", "gone", 5), ("R005", "run_property_change", "C", "'bold' from [i] to [b]", 5),
    ]
    assert rows(office.footnotes(files), "footnote_id", "text") == [(2, "See A. And B.")] * 2  # the third file's notes are whole
    assert rows(office.references(files), "footnote_id", "display", "symbol", "paragraph") == [(2, "1", False, 2), (3, "‡", True, 2), (4, "2", False, 3)]


def test_audit(spark, word):
    found = {(r["path"][-6:], r["part"], r["message"]) for r in office.audit(office.files(spark, word, "*.docx")).collect() if r["level"] == "error"}
    assert found == {("b.docx", None, "not an archive"), ("c.docx", "word/document.xml", "word/document.xml is broken"), ("d.docx", None, "packed too tightly")}


def test_sheet(spark, word):
    cells = office.sheet(office.files(spark, word, "*.xlsx"))
    assert sorted(rows(cells, "row", "header", "value")) == [(1, "Title", "Widgets"), (1, "Year", "2020"), (2, "Year", "2021")]
    assert rows(office.sheet_rows(cells, {"title": "title", "year": "year", "doi": "doi"}), "title", "year", "doi") == [("Widgets", "2020", "")]
