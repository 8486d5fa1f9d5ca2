"""Workbooks made here against the same rows as csv."""

import csv
import zipfile
from xml.sax.saxutils import escape

import pytest

from dialoom.operators import scales
from dialoom.plans.build import build_folder
from dialoom.sources import files, workbooks

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def letters(n):
    return (letters(n // 26 - 1) if n >= 26 else "") + chr(65 + n % 26)


def make(path, rows, shared=True, sheets=("answers",), references=True):
    """A workbook of strings, numbers, truths and gaps; the sheet of rows is the first."""
    strings: list[str] = []

    def cell(at, r, value):
        place = f' r="{letters(at)}{r}"' if references else ""
        if value is None:
            return "" if references else "<c/>"
        if isinstance(value, bool):
            return f'<c{place} t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f"<c{place}><v>{value}</v></c>"
        if shared:
            strings.append(value)
            return f'<c{place} t="s"><v>{len(strings) - 1}</v></c>'
        return f'<c{place} t="inlineStr"><is><t>{escape(value)}</t></is></c>'

    body = "".join(f'<row r="{r}">{"".join(cell(at, r, v) for at, v in enumerate(row))}</row>' for r, row in enumerate(rows, 1))
    items = "".join(f"<si><r><t>{escape(s[:2])}</t></r><r><t xml:space='preserve'>{escape(s[2:])}</t></r><rPh><t>hint</t></rPh></si>" for s in strings)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{REL}"><sheets>{"".join(f"<sheet name={n!r} sheetId={str(i)!r} r:id={f'rId{i}'!r}/>" for i, n in enumerate(sheets, 1))}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships>{"".join(f"<Relationship Id={f'rId{i}'!r} Target={f'worksheets/sheet{i}.xml'!r}/>" for i in range(1, len(sheets) + 1))}</Relationships>')
        for i in range(1, len(sheets) + 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet {MAIN}><sheetData>{body if i == 1 else "<row><c t=" + chr(34) + "str" + chr(34) + "><v>other</v></c></row><row><c><v>7</v></c></row>"}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst {MAIN}>{items}</sst>')


HEADER = [scales.ID_COLUMN, *[f"G{i}. {scales.ITEM_PHRASE}，x" for i in range(1, 8)], *[f"P{i}. {scales.ITEM_PHRASE}" for i in range(1, 10)], "备注 <&>"]
ROWS = [[9, *[1] * 7, *[2] * 9, "a, \"b\"\nc"], ["12", *["0"] * 15, 1, None], [13, 3.0, *[3] * 15, " kept "], [None] * 17 + ["only"], [14, True, *[None] * 15, "x" * 5000]]


@pytest.mark.parametrize("shared", [True, False])
@pytest.mark.parametrize("references", [True, False])
def test_equals_its_csv(spark, tmp_path, shared, references):
    make(f"{tmp_path}/s.xlsx", [HEADER, *ROWS], shared, references=references)
    with open(f"{tmp_path}/s.csv", "w", encoding="utf-8", newline="") as f:
        csv.writer(f).writerows([HEADER, *[[int(v) if isinstance(v, bool) else v for v in r] for r in ROWS]])
    got, want = files.sheet(spark, f"{tmp_path}/s.xlsx"), files.sheet(spark, f"{tmp_path}/s.csv")
    assert got.columns == want.columns == HEADER
    rows = [[None if v is None else v.strip(" ") for v in r] for r in want.collect()]
    assert [[None if v is None else v.strip(" ") for v in r] for r in got.collect()] == rows and len(rows) == 5
    assert got.collect()[2][-1] == " kept "
    scored = {r.respondent_id: (r.gad7_total, r.phq9_total, r.error) for r in scales.scale_rows(got).collect()}
    assert scored[9] == (7, 18, None) and scored[13] == (21, 27, None) and scored[14][2] == "bad_item"


def test_build_with_a_workbook(spark, tmp_path):
    make(f"{tmp_path}/s.xlsx", [HEADER, *ROWS])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "9 x.txt").write_text("[医生]：问", encoding="utf-8")
    (row,) = build_folder(spark, f"{tmp_path}/in", f"{tmp_path}/s.xlsx").collect()
    assert [(s["GAD-7"].total, s["PHQ-9"].total) for s in row.scales] == [(7, 18)]


def test_sheets_folders_and_many_rows(spark, tmp_path):
    many = [["id", "v", "v"], *[[i, f"v{i % 7}", i % 3 or None] for i in range(5000)]]
    (tmp_path / "all.xlsx").mkdir()
    make(f"{tmp_path}/all.xlsx/a.xlsx", many, sheets=("one", "two"))
    make(f"{tmp_path}/all.xlsx/b.xlsx", [["v", "more", "id"], ["w", 1, -1]], shared=False)
    df = files.sheet(spark, f"{tmp_path}/all.xlsx")
    assert df.columns == ["id", "v", "v.1"] and df.rdd.getNumPartitions() == 2
    rows = df.collect()
    assert [tuple(r) for r in rows] == [*[(str(i), f"v{i % 7}", str(i % 3) if i % 3 else None) for i in range(5000)], ("-1", "w", None)]
    assert [tuple(r) for r in workbooks.read(spark, f"{tmp_path}/all.xlsx/a.xlsx", "two").collect()] == [("7",)]
    make(f"{tmp_path}/none.xlsx", [HEADER])
    assert files.sheet(spark, f"{tmp_path}/none.xlsx").count() == 0
    with pytest.raises(Exception, match="no sheet"):
        workbooks.read(spark, f"{tmp_path}/all.xlsx/a.xlsx", "three").collect()


def test_strings_by_offset():
    held = workbooks.SharedStrings()
    texts = ["", "a", "中文", "", "\U0001f600x"]
    for t in texts:
        held.add(t)
    assert [held[i] for i in range(5)] == texts and len(held.ends) == 5
    assert [workbooks.column_number(c) for c in ("A1", "Z9", "AA10", "XFD1")] == [0, 25, 26, 16383]
