"""Sheets of many cells: what a task holds while it writes and reads them."""

import tracemalloc
from collections.abc import Iterator

from gridloom.sources import model, workbook, xlsx


def cells(n: int) -> Iterator[tuple]:
    for row in range(n):
        yield (row, 0), ("number", row / 2, None)
        yield (row, 1), ("text", f"name {row % 50}", None)
        yield (row, 2), ("number", float(row), f"A{row + 1}*2")


def peak(f):
    tracemalloc.start()
    made = f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return made, most


def test_a_sheet_is_written_and_read_in_little_memory(monkeypatch):
    n = 8_000
    monkeypatch.setattr(model.Packed, "BLOCK", 1_000)
    monkeypatch.setattr(xlsx, "HELD_XML", 1 << 10)
    data, most = peak(lambda: xlsx.write([{"title": "S", "cells": cells(n)}]))
    assert most < 4 << 20
    assert data == xlsx.write([{"title": "S", "cells": dict(cells(n))}])
    book, most = peak(lambda: xlsx.read(data))
    # 10.3 MB with all of its cells as tuples.
    assert most < 8 << 20 and len(book.cells) == 3 * n
    assert [c[2:5] for c in book.cells] == [(i, i // 3, i % 3) for i in range(3 * n)] and book.cells[2_999][10] == "A1000*2" and book.cells[-1][4] == 2
    assert len(list(workbook.rows("f", data, "cells"))) == 3 * n


def test_workbooks_of_one_task_do_not_mix(spark):
    """A workbook that cannot be written ends at its cell; those around it in the stream are whole."""
    rows = [(book, sheet, f"S{sheet}", row, 0, "text", "x" * (40_000 if (book, sheet, row) == ("b", 0, 1) else row + 1)) for book in "abc" for sheet in (1, 0) for row in (2, 0, 1)]
    made = spark.createDataFrame(rows, "workbook_id string, sheet_index int, sheet string, row int, col int, kind string, str string").coalesce(1)
    full = made.selectExpr("*", "CAST(NULL AS double) AS num", "CAST(NULL AS boolean) AS bool", "CAST(NULL AS string) AS err", "CAST(NULL AS string) AS formula", "CAST(NULL AS struct<kind:string,num:double,str:string,bool:boolean,err:string>) AS cached")
    got = {r.workbook_id: r for r in workbook.to_workbooks(full).collect()}
    assert got["b"].content is None and got["b"].error == "CellTextTooLong: S0!A2" and len(got) == 3
    for book in "ac":
        assert [(c[0], c[1], c[3], c[7]) for c in xlsx.read(bytes(got[book].content)).cells] == [(s, f"S{s}", r, "x" * (r + 1)) for s in (0, 1) for r in range(3)]
