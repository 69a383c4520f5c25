import pytest
from pyspark.sql import functions as F

from gridloom.operators import cells as C
from gridloom.operators import edit, export, graph, report, validate
from gridloom.sources import workbook, xlsx
from gridloom.streaming import arrivals

CELL = "workbook_id string, sheet_index int, sheet string, seq long, row int, col int, kind string, num double, str string, bool boolean, err string, formula string, cached struct<kind:string,num:double,str:string,bool:boolean,err:string>, display string, style_id int"


def text_cells(spark, *cells):
    """(row, col, text) or (row, col, text, formula)."""
    rows = [("w", 0, "Old", i, c[0], c[1], "formula" if len(c) > 3 else "text", None, c[2], None, None, c[3] if len(c) > 3 else None, None, c[2], 0) for i, c in enumerate(cells)]
    return spark.createDataFrame(rows, CELL)


def test_last_write_slice_and_headers(spark):
    cells = text_cells(spark, (0, 0, " a "), (0, 2, "b"), (1, 0, "x"), (1, 0, "y"), (2, 2, "z"))
    last = C.effective(cells)
    assert {(r.row, r.col): r.str for r in last.collect()} == {(0, 0): " a ", (0, 2): "b", (1, 0): "y", (2, 2): "z"}
    assert C.slice_range(last, 1, 0, 0, 5).count() == 0
    assert sorted((r.row, r.a, r.b) for r in C.read_rows(last, {"a": "string", "b": "string"}).collect()) == [(1, "y", None), (2, None, "z")]
    with pytest.raises(ValueError, match="missing range header: c"):
        C.read_rows(last, {"c": "string"})
    assert C.read_rows(last, {"a": "string", "c": "string"}, skip_missing=True).columns[-1] == "a"
    assert C.densify(last, 0, 2).count() == 9


def test_csv_gaps_quotes_and_formulas(spark):
    cells = text_cells(spark, (0, 1, 'say "hi"'), (0, 3, "=1+1"), (2, 0, "a,b"))
    line = lambda **k: [r.line for r in export.csv_rows(cells, **k).orderBy("row").collect()]
    assert line() == ['"say ""hi""",,=1+1', '"a,b"']
    assert line(pad_leading=True, escape_formulas=True) == [',"say ""hi""",,"\'=1+1"', '"a,b"']
    assert [r.line for r in export.text_rows(cells).orderBy("row").collect()] == ['say "hi"\t=1+1', "a,b"]
    with pytest.raises(ValueError):
        export.csv_rows(cells, delimiter='"')


def test_html_merges_and_markdown(spark):
    cells = text_cells(spark, (0, 0, "<a>"), (0, 2, "c"), (1, 2, "p|q\nr"))
    merges = spark.createDataFrame([("w", 0, 0, 0, 1, 1)], "workbook_id string, sheet_index int, r0 int, c0 int, r1 int, c1 int")
    html = [r.line for r in export.html_rows(cells, F.lit(3), merges).orderBy("row").collect()]
    assert html == ['<tr><td rowspan="2" colspan="2">&lt;a&gt;</td><td>c</td></tr>', "<tr><td>p|q\nr</td></tr>"]
    assert [r.line for r in export.markdown_rows(cells, F.lit(3)).orderBy("row").collect()] == ["| <a> |  | c |", "|  |  | p\\|q<br>r |"]


@pytest.mark.parametrize(
    "source,new,want",
    [("Old!A1+1", "New", "New!A1+1"), ("'Old'!A1", "New", "'New'!A1"), ("old!A1", "My Sheet", "'My Sheet'!A1"), ('"Old!A1"&Old!B2', "N", '"Old!A1"&N!B2'), ("Old:Z!A1", "N", "N:Z!A1"),
     ("[1]Old!A1", "N", "[1]Old!A1"), ("Older!A1", "N", "Older!A1"), ("Old!A1", None, "#REF!A1"), ("A:Old!B1*2", None, "#REF!B1*2"), ("Old+1", "N", "Old+1")],
)
def test_rewritten(source, new, want):
    assert edit.rewritten(source, "Old", new) == want


def test_rename_upsert_and_append(spark):
    cells = text_cells(spark, (0, 0, "x"), (0, 1, "y", "Old!A1&1"))
    got = edit.rename_sheet(cells, "Old", "New").collect()
    assert {r.sheet for r in got} == {"New"} and {r.formula for r in got} == {None, "New!A1&1"}
    with pytest.raises(ValueError):
        edit.rename_sheet(cells, "Old", "a/b")
    assert C.upsert(cells, cells.where("col = 0").withColumn("str", F.lit("z"))).where("str = 'z'").count() == 1
    assert edit.append_rows(cells, text_cells(spark, (0, 0, "next"))).where("row = 1").count() == 1
    assert C.clear(cells, 0, 0, 0, 0).count() == 1


def test_violations(spark):
    cells = text_cells(spark, (0, 0, "top"), (0, 1, "covered"), (2_000_000, 0, "out"), (3, 0, "x\x01"), (4, 0, "y" * 40_000))
    sheets = spark.createDataFrame([("w", 0, "Old", 100), ("w", 1, "OLD", 5), ("w", 2, "a/b", None)], "workbook_id string, sheet_index int, name string, zoom int")
    names = spark.createDataFrame([("w", None, "ok"), ("w", None, "A1"), ("w", "Gone", "x")], "workbook_id string, scope_sheet string, name string")
    ranges = spark.createDataFrame([("w", 0, "merge", None, 0, 0, 0, 1, None), ("w", 0, "table", "T", 0, 0, 1, 2, "a\tb"), ("w", 0, "hyperlink", None, 0, 0, 0, 0, " ")], "workbook_id string, sheet_index int, kind string, name string, r0 int, c0 int, r1 int, c1 int, text string")
    found = validate.violations(cells, sheets, names, ranges)
    got = {r.rule for r in found.collect()}
    assert got == {"InvalidSheetName", "DuplicateSheetName", "InvalidDefinedName", "UnknownDefinedNameSheet", "CellOutOfGrid", "InvalidXmlText", "CellTextTooLong", "InvalidHyperlinkTarget", "CellUnderMergedRange", "InvalidSheetViewZoom", "TableRangeColumnsMismatch"}
    assert validate.first_violation(found).first().rule == "InvalidSheetName"


def test_compare_and_levels(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "n")], "k int, v string")
    assert {(r.k, r.change) for r in report.compare(a, b, ["v"], ["k"]).collect()} == {(1, "removed"), (2, "changed"), (4, "added")}
    nodes = spark.createDataFrame([(i,) for i in range(7)], "node int")
    edges = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 4), (4, 3), (6, 0), (6, 3)], "node int, needs int")
    assert {r.node: r.level for r in graph.levels(nodes, edges).collect()} == {0: 0, 1: 1, 2: 2, 3: None, 4: None, 5: 0, 6: None}


def test_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    data = xlsx.write([{"title": "S", "cells": {(0, 0): ("text", "hi", None)}}])
    for name in ("a.xlsx", "b.xlsx"):
        (tmp_path / "in" / name).write_bytes(data)
    made = arrivals.tables(arrivals.arrivals(spark, str(tmp_path / "in")))
    run = made.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [r.str for r in spark.table("arrived").collect()] == ["hi"]


def test_entry_and_catalogue():
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80
    assert workbook.TABLES.keys() >= {"cells", "sheets", "errors"}
