import io
import zipfile

import pytest

from gridloom.sources import package, xlsx

BOOK = [
    {"title": "Old", "cells": {(0, 0): ("number", 1.0, None), (1, 0): ("text", "x", None)}},
    {"title": "Other", "cells": {(0, 0): ("number", 2.0, "Old!A1*2"), (0, 1): ("text", "Old!A1", None)}},
]


def parts(data):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {n: z.read(n) for n in z.namelist()}


@pytest.fixture
def data():
    base = xlsx.write(BOOK, [(None, "First", "Old!$A$1")])
    out = io.BytesIO(base)
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("xl/vbaProject.bin", b"\x00macro\xff")
    return out.getvalue()


def cells(data):
    return {(c[1], c[3], c[4]): (c[5], c[6] if c[6] is not None else c[7], c[10]) for c in xlsx.read(data).cells}


def test_untouched_parts_stay(data):
    editor = package.Editor(data)
    editor.set_cell_value("Old", 0, 0, 9)
    after = parts(editor.save())
    same = {n for n, raw in parts(data).items() if after.get(n) == raw}
    assert same >= {"xl/vbaProject.bin", "xl/worksheets/sheet2.xml", "xl/styles.xml", "xl/sharedStrings.xml"}
    assert cells(editor.save())["Old", 0, 0] == ("number", 9.0, None)


def test_cells_rows_and_ranges(data):
    e = package.Editor(data)
    e.set_cell_formula("Old", 0, 2, "=A1+1", 2)
    assert e.append_row("Old", ["a & b", True, None, 2.5]) == 2
    e.clear_range("Old", 1, 0, 1, 0)
    got = cells(e.save())
    assert got["Old", 0, 2][2] == "A1+1" and got["Old", 2, 0] == ("text", "a & b", None) and got["Old", 2, 3][1] == 2.5 and ("Old", 1, 0) not in got
    with pytest.raises(package.EditError):
        e.set_cell_value("Old", 0, 0, float("nan"))
    with pytest.raises(package.EditError):
        e.clear_range("Old", 0, 0, 200, 200)


def test_rename_add_delete(data):
    e = package.Editor(data)
    e.rename_sheet("Old", "My Sheet")
    book = xlsx.read(e.save())
    assert [s[1] for s in book.sheets] == ["My Sheet", "Other"] and book.names == [(None, "First", "'My Sheet'!$A$1")]
    assert cells(e.save())["Other", 0, 0][2] == "'My Sheet'!A1*2" and cells(e.save())["Other", 0, 1][1] == "Old!A1"
    e.add_sheet("New")
    e.set_cell_value("New", 0, 0, "n")
    e.delete_sheet("My Sheet")
    book = xlsx.read(e.save())
    assert [s[1] for s in book.sheets] == ["Other", "New"] and cells(e.save())["Other", 0, 0][2] == "#REF!A1*2"
    for bad in ("other", "a/b", ""):
        with pytest.raises(package.EditError):
            e.add_sheet(bad)


def test_layout(data):
    e = package.Editor(data)
    e.merge_cells("Old", 3, 0, 3, 2)
    with pytest.raises(package.EditError):
        e.merge_cells("Old", 3, 2, 4, 2)
    e.set_freeze_panes("Old", 1, 2)
    e.set_column_width("Old", 1, 20)
    e.set_row_height("Old", 0, 30, hidden=True)
    e.set_sheet_tab_color("Old", "ff0000")
    e.set_data_validation("Old", "A1:A9", "list", '"a,b"')
    e.set_sheet_visibility("Other", "hidden")
    e.set_defined_name("First", None)
    book = xlsx.read(e.save())
    assert [(r[1], r[3:7]) for r in book.ranges] == [("merge", (3, 0, 3, 2)), ("validation", (0, 0, 8, 0))]
    assert book.sheets[0][4:6] == (1, 2) and book.sheets[0][9] == "FFFF0000" and book.sheets[1][3] == "hidden" and not book.names
    with pytest.raises(package.EditError):
        e.set_sheet_visibility("Old", "hidden")
    e.unmerge_cells("Old", 3, 0, 3, 2)
    e.delete_data_validation("Old", "A1:A9")
    e.set_freeze_panes("Old", 0, 0)
    assert not xlsx.read(e.save()).ranges


def test_transaction_is_all_or_nothing(data):
    e = package.Editor(data)
    before = e.save()
    with pytest.raises(package.EditError):
        e.transaction(lambda t: (t.set_cell_value("Old", 0, 0, 7), t.set_cell_value("Gone", 0, 0, 7)))
    assert e.save() == before


def test_many_files(spark, data):
    files = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"PK none"))], "path string, content binary")
    got = {r.path: r for r in package.edit_workbooks(files, [("set_cell_value", {"sheet": "Old", "row": 0, "col": 0, "value": 5})]).collect()}
    assert got["a"].error is None and cells(bytes(got["a"].content))["Old", 0, 0][1] == 5 and got["b"].error


def test_links(data):
    e = package.Editor(data)
    e.set_hyperlink("Old", 0, 0, target="https://example.org/?a=1&b=2", tooltip="go")
    e.set_hyperlink("Old", 1, 0, location="#Other!A1")
    e.set_hyperlink("Old", 0, 0, target="https://example.org/new")
    found = {(r[3], r[4]): r[7] for r in xlsx.read(e.save()).ranges if r[1] == "hyperlink"}
    assert found[0, 0] == "https://example.org/new" and "Other!A1" in (found[1, 0] or "")
    assert b"a=1" not in package.Package(e.save()).parts["xl/worksheets/_rels/sheet1.xml.rels"]
    e.rename_sheet("Other", "My Sheet")
    assert b"'My Sheet'!A1" in package.Package(e.save()).parts["xl/worksheets/sheet1.xml"].replace(b"&apos;", b"'")
    e.delete_hyperlink("Old", 0, 0)
    e.delete_hyperlink("Old", 1, 0)
    assert not [r for r in xlsx.read(e.save()).ranges if r[1] == "hyperlink"]
    for bad in ({}, {"target": " "}, {"target": "x", "location": "y"}):
        with pytest.raises(package.EditError):
            e.set_hyperlink("Old", 0, 0, **bad)
    with pytest.raises(package.EditError):
        e.delete_hyperlink("Old", 5, 5)


def test_comments(data):
    e = package.Editor(data)
    e.set_comment("Old", 2, 1, "second  <note>", "Ann")
    e.set_comment("Old", 0, 1, "first", "Bo")
    e.set_comment("Old", 2, 1, "changed", "Bo")
    found = [(r[3], r[4], r[7], r[8]) for r in xlsx.read(e.save()).ranges if r[1] == "comment"]
    assert found == [(0, 1, "first", "Bo"), (2, 1, "changed", "Bo")]
    parts = package.Package(e.save()).parts
    assert parts["xl/drawings/vmlDrawing1.vml"].count(b"ObjectType") == 2 and b"legacyDrawing" in parts["xl/worksheets/sheet1.xml"]
    e.delete_comment("Old", 0, 1)
    again = package.Editor(e.save())
    again.set_comment("Old", 3, 3, "more")
    assert [(r[3], r[7]) for r in xlsx.read(again.save()).ranges if r[1] == "comment"] == [(2, "changed"), (3, "more")]
    with pytest.raises(package.EditError):
        again.delete_comment("Old", 9, 9)


def test_print_area(data):
    e = package.Editor(data)
    e.set_print_area("Old", (0, 0, 4, 27))
    e.set_print_area("Other", (1, 1, 1, 1))
    e.set_print_area("Old", (0, 0, 2, 27))
    raw = package.Package(e.save()).parts["xl/workbook.xml"].decode()
    assert "'Old'!$A$1:$AB$3" in raw.replace("&apos;", "'") and raw.count("_xlnm.Print_Area") == 2
    e.set_print_area("Old", None)
    e.set_print_area("Other", None)
    assert "_xlnm" not in package.Package(e.save()).parts["xl/workbook.xml"].decode()
    with pytest.raises(package.EditError):
        e.set_print_area("Old", (2, 0, 1, 0))


def test_table_range(data):
    e = package.Editor(data)
    root = e.package
    table = f'<table xmlns="{package.MAIN}" id="1" name="T" displayName="Sales" ref="A1:B3"><autoFilter ref="A1:B3"/><tableColumns count="2"><tableColumn id="1" name="a"/><tableColumn id="2" name="b"/></tableColumns></table>'
    e._linked_part("Old", "table", "xl/tables/table", "xml", table, "application/vnd.openxmlformats-officedocument.spreadsheetml.table+xml")
    e.set_table_range("sales", 0, 0, 9, 1)
    raw = package.Package(e.save()).parts["xl/tables/table1.xml"].decode()
    assert raw.count('ref="A1:B10"') == 2 and root.parts
    for bad in ((0, 0, 9, 2), (1, 0, 9, 1), (0, 0, 0, 1)):
        with pytest.raises(package.EditError):
            e.set_table_range("Sales", *bad)
    with pytest.raises(package.EditError):
        e.set_table_range("None", 0, 0, 2, 1)
