"""Strict and date casts, and exports as documents, on values at the edges."""

import pytest
from pyspark.sql import functions as F

from gridloom.functions import casts
from gridloom.operators import cells as C
from gridloom.operators import export as X
from gridloom.operators import report as R
from gridloom.operators.validate import active_sheet_violations, valid_timestamp

CELL = "struct<kind:string,num:double,str:string,bool:boolean,err:string,display:string>"


def cell(kind=None, num=None, str=None, bool=None, err=None, display=""):
    return kind and (kind, num, str, bool, err, display)


def one(spark, cell_, column):
    return spark.createDataFrame([(cell_,)], f"c {CELL}").select(column(F.col("c")).alias("x")).first()["x"]


STRICT = [
    ("f64", cell("number", 1.5), 1.5, None), ("f64", cell("text", str="1e3"), 1000.0, None), ("f64", cell("text", str=" 1"), None, "expected f64"), ("f64", cell("bool", bool=True), None, "expected f64"),
    ("f64", None, None, "empty cell"), ("i64", cell("number", 1.5), None, "expected i64"), ("i64", cell("number", -2.0), -2, None), ("i64", cell("number", 1e30), (1 << 63) - 1, None),
    ("i64", cell("text", str="9223372036854775808"), None, "expected i64"), ("i8", cell("number", 128.0), None, "out of range"), ("u8", cell("text", str="255"), 255, None), ("u16", cell("number", -1.0), None, "out of range"),
    ("f32", cell("number", 1e39), None, "out of range"), ("bool", cell("bool", bool=False), False, None), ("bool", cell("number", 1.0), None, "expected bool"), ("str", cell("date", 1.0, display="1900-01-01"), "1900-01-01", None),
    ("str", cell("error", err="#N/A"), "#N/A", None), ("i32", cell("number", float("nan")), None, "expected i32"),
]


def test_strict(spark):
    for kind, given, value, error in STRICT:
        got = one(spark, given, lambda c: casts.strict(kind, c))
        assert (got["value"], got["error"]) == (value, error), (kind, given)
    assert one(spark, None, lambda c: casts.optional("f64", c))["error"] is None
    with pytest.raises(Exception, match="expected bool"):
        one(spark, cell("text", str="TRUE"), lambda c: casts.required("bool", c))


def test_formulas_cast_by_their_cache(spark):
    made = spark.sql("SELECT named_struct('kind', 'formula', 'num', CAST(NULL AS DOUBLE), 'str', CAST(NULL AS STRING), 'bool', CAST(NULL AS BOOLEAN), 'err', CAST(NULL AS STRING), 'display', '7', 'cached', named_struct('kind', 'number', 'num', 7.0D, 'str', CAST(NULL AS STRING), 'bool', CAST(NULL AS BOOLEAN), 'err', CAST(NULL AS STRING))) AS c")
    assert made.select(casts.strict("i32", casts.effective(F.col("c"), True)).alias("x")).first()["x"]["value"] == 7


MOMENTS = [
    ("date", 60.0, False, "1900-02-28"), ("date", 61.0, False, "1900-03-01"), ("datetime", 45366.999999999, False, "2024-03-16 00:00:00"), ("time", 0.75, False, "18:00:00"), ("date", 0.0, True, "1904-01-01"),
    ("datetime", 2958466.0, False, "None"), ("duration", 1.5, False, "129600000"), ("duration", -0.5, False, "-43200000"), ("duration", float("inf"), False, "None"),
]


def test_moments(spark):
    for kind, serial, date1904, want in MOMENTS:
        assert str(one(spark, cell("number", serial), lambda c: casts.moment_or_none(kind, c, date1904).cast("string"))) == want, (kind, serial)
    got = one(spark, cell("text", str="soon", display="soon"), lambda c: casts.moment_or_string("date", c))
    assert (got["value"], got["text"]) == (None, "soon") and one(spark, None, lambda c: casts.moment_or_string("date", c))["text"] == ""


def grid(spark, rows):
    """rows: workbook, sheet, row, col, display."""
    return spark.createDataFrame(rows, "workbook_id string, sheet_index int, row int, col int, display string")


def texts(df):
    return {(r.workbook_id, r.sheet_index): r.text for r in df.collect()}


def test_documents(spark):
    cells = grid(spark, [("w", 0, 0, 0, "a|b"), ("w", 0, 0, 2, "x\r\ny"), ("w", 0, 3, 1, "\\"), ("w", 1, 0, 0, "<&>"), ("w", 1, 0, 1, "in"), ("w", 1, 1, 3, '"'), ("w", 2, 0, 256, "wide")])
    merges = spark.createDataFrame([("w", 1, 0, 0, 0, 1)], "workbook_id string, sheet_index int, r0 int, c0 int, r1 int, c1 int")
    got = texts(X.markdown_document(cells, merges))
    assert got["w", 0] == "| a\\|b |  | x<br><br>y |\n| --- | --- | --- |\n|  | \\ |  |"
    assert got["w", 1] == '<table><tr><td colspan="2">&lt;&amp;&gt;</td></tr><tr><td></td><td></td><td></td><td>&quot;</td></tr></table>'
    assert got["w", 2] == "<table><tr>" + "<td></td>" * 256 + "<td>wide</td></tr></table>"
    assert texts(X.html_document(cells))["w", 0].startswith("<table><tr><td>a|b</td><td></td><td>x")
    assert texts(X.document(X.csv_rows(cells), bom=True))["w", 1].startswith("﻿")
    with pytest.raises(Exception, match="larger than its limit"):
        X.document(X.csv_rows(cells), max_bytes=10).collect()
    assert X.document(X.csv_rows(cells.limit(0))).count() == 0


def test_workbook_text(spark):
    cells = grid(spark, [("w", 0, 0, 0, "a"), ("w", 0, 0, 5, "b"), ("w", 0, 2, 0, ""), ("w", 1, 0, 0, "no"), ("v", 0, 0, 0, "--")])
    sheets = spark.createDataFrame([("w", 0, "One", "WorkSheet"), ("w", 1, "Chart", "ChartSheet"), ("w", 2, "Empty", "WorkSheet"), ("v", 0, "!", "WorkSheet")], "workbook_id string, sheet_index int, name string, sheet_type string")
    got = {r.workbook_id: (r.text, r.error) for r in X.extract_text(cells, sheets).collect()}
    assert got == {"w": ("# One\na\tb\n\n# Empty\n\n", None), "v": (None, "no_text")}


def test_headers_cover_the_used_columns(spark):
    cells = grid(spark, [("w", 0, 1, 1, "name"), ("w", 0, 1, 3, None), ("w", 0, 2, 4, "x")])
    assert [(r.col, r.header) for r in C.headers(cells).orderBy("col").collect()] == [(1, "name"), (2, ""), (3, ""), (4, "")]
    assert [r.header for r in C.headers(cells, 9).orderBy("col").collect()] == [""] * 4


def test_warnings_and_limits(spark):
    rows = spark.createDataFrame([("w", 0, i, 0, "fallback" if i == 5 else "computed") for i in range(R.MAX_EVALUATED + 2)], "workbook_id string, sheet_index int, row int, col int, status string")
    got = R.bounded_outcomes(rows.withColumn("value", F.struct(F.lit("number").alias("kind")))).first()
    assert (got.computed, got.cached, got.truncated) == (R.MAX_EVALUATED - 1, 1, True)
    books = spark.createDataFrame([("a", 2), ("b", None), ("c", 1)], "workbook_id string, active int")
    sheets = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("c", 0), ("c", 1)], "workbook_id string, sheet_index int")
    assert [r.workbook_id for r in active_sheet_violations(books, sheets).collect()] == ["a"]
    stamps = {"2024-02-29T00:00:00": True, "2023-02-29T00:00:00": False, "2024-01-01T00:00:61": False, "2024-01-01": False, "0000-01-01T00:00:00": False, "2024-01-01T00:00:00 whatever": True}
    found = spark.createDataFrame([(s,) for s in stamps], "s string").select("s", valid_timestamp(F.col("s")).alias("ok")).collect()
    assert {r.s: r.ok for r in found} == stamps
