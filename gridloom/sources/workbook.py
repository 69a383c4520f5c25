"""The data source "workbook": spreadsheets as tables.

    spark.dataSource.register(WorkbookSource)
    spark.read.format("workbook").option("table", "cells").load("folder-or-glob")

One input partition a file. Options: table (cells, sheets, names, ranges, parts,
workbooks or errors), mode (PERMISSIVE skips a file that cannot be read, which table errors
lists; FAILFAST raises), sheet (only that sheet's cells), codepage (for .xls).
Paths are listed and read through Spark's file systems with workbooks(); load()
by path is for folders that driver and executors mount alike.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom import schema
from gridloom.sources import ods, xls, xlsb, xlsx
from gridloom.sources.model import ReadError, Workbook

#: Rows that go out together.
BATCH = 10_000
TABLES = {"cells": schema.CELLS, "sheets": schema.SHEETS, "names": schema.NAMES, "ranges": schema.RANGES, "parts": schema.PARTS, "workbooks": schema.WORKBOOKS, "errors": schema.ERRORS}


def open_bytes(data: bytes, codepage: int | None = None) -> Workbook:
    """A workbook of any known container, by its first bytes and parts."""
    if data[:2] == b"PK":
        kind, reader = ("xlsb", xlsb.read) if xlsb.is_xlsb(data) else ("ods", ods.read) if ods.is_ods(data) else ("xlsx", xlsx.read)
        book = reader(data)
        macros = kind == "xlsx" and any(name.endswith("vbaProject.bin") for name, *_ in book.parts)
        book.format = "xlsm" if macros else kind
        return book
    book = xls.read(data, codepage)
    book.format = "xls"
    return book


def all_rows(path: str, data: bytes, mode: str = "PERMISSIVE", sheet: str | None = None, codepage: int | None = None) -> Iterator[tuple[str, Iterator[tuple]]]:
    """The rows of each table of one file."""
    try:
        book = open_bytes(data, codepage)
    except Exception as e:  # whatever a damaged file leads to is that file's error, not the scan's
        if mode.upper() == "FAILFAST":
            raise
        kind = e.kind if isinstance(e, ReadError) else "xml" if data[:2] == b"PK" else "biff"
        yield "errors", iter([(path, kind, str(e) or type(e).__name__)])
        return
    if book.truncated:
        yield "errors", iter([(path, "text_truncated", "text beyond the limit was left out")])
    for table in TABLES:
        if table != "errors":
            yield table, ((path, *row) for row in getattr(book, table) if table != "cells" or sheet is None or row[1] == sheet)


def rows(path: str, data: bytes, table: str, mode: str = "PERMISSIVE", sheet: str | None = None, codepage: int | None = None) -> Iterator[tuple]:
    for name, found in all_rows(path, data, mode, sheet, codepage):
        if name == table:
            yield from found


class _File(InputPartition):
    pass


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        path = self.options.get("path", "")
        found = [os.path.join(path, f) for f in os.listdir(path)] if os.path.isdir(path) else glob.glob(path)
        return [_File(f) for f in sorted(found) if os.path.isfile(f)]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            data = f.read()
        o = self.options
        page = o.get("codepage")
        yield from rows(partition.value, data, o.get("table", "cells"), o.get("mode", "PERMISSIVE"), o.get("sheet"), int(page) if page else None)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "cells")]

    def reader(self, schema) -> DataSourceReader:
        return WorkbookReader(dict(self.options))


def workbooks(spark: SparkSession, path: str, table: str = "cells", **options) -> DataFrame:
    """The same tables from any file system that Spark reads."""
    return read_files(spark.read.format("binaryFile").load(path), table, **options)


def read_files(files: DataFrame, table: str = "cells", **options) -> DataFrame:
    """The same tables of files at hand: columns path and content. Rows go out in bounded batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    files = files.select("path", "content")
    kind = StructType.fromDDL(TABLES[table])
    arrow = to_arrow_schema(kind)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                found = rows(name.as_py(), content.as_py(), table, **options)
                while made := list(islice(found, BATCH)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), arrow.types)], schema=arrow)

    return files.mapInArrow(run, kind)


def read_tables(files: DataFrame, **options) -> dict[str, DataFrame]:
    """All tables of files (path, content), each file parsed once: one pass gives the rows of every
    table with the union of their columns. It is persisted, in memory or on disk; a lost executor
    costs another parse of its files."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructField, StructType

    kinds = {t: StructType.fromDDL(ddl) for t, ddl in TABLES.items()}
    fields = {f.name: f for kind in kinds.values() for f in kind.fields}
    whole = StructType([StructField("__table", StringType()), *fields.values()])
    arrow = to_arrow_schema(whole)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                path = name.as_py()
                for table, found in all_rows(path, content.as_py(), **options):
                    found = iter(found)
                    while made := list(islice(found, BATCH)):
                        held = dict(zip(kinds[table].names, zip(*made))) | {"__table": [table] * len(made)}
                        yield pa.RecordBatch.from_arrays([pa.array(held[f.name], f.type) if f.name in held else pa.nulls(len(made), f.type) for f in arrow], schema=arrow)

    tagged = files.select("path", "content").mapInArrow(run, whole).persist(StorageLevel.MEMORY_AND_DISK)
    return {t: tagged.where(F.col("__table") == t).select(*kind.names) for t, kind in kinds.items()}


#: What a row is of the stream that a workbook is written from.
NAMES, HEAD, MERGES, CELL = range(4)


def to_workbooks(cells: DataFrame, sheets: DataFrame | None = None, names: DataFrame | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """workbook_id, content (an .xlsx file) and error for each workbook of a cells table (effective cells).

    The tables sheets, names and ranges (schema.py), where given, add the sheets' states, order
    and frozen panes, defined names and merges; a sheet without cells is written too. A workbook
    with a cell that no sheet can hold has no content, and error says which rule and where.
    A task writes its workbooks from a sorted stream of cells and never holds a sheet's cells.
    """
    formula = F.col("kind") == "formula"
    value = [F.when(formula, F.col(f"cached.{c}")).otherwise(F.col(c)).cast(kind).alias(c) for c, kind in (("kind", "string"), ("num", "double"), ("str", "string"), ("bool", "boolean"), ("err", "string"))]
    # One stream a workbook, in order: its names, then of each sheet its head, its merges and its cells.
    rows = cells.select("workbook_id", "sheet_index", F.lit(CELL).alias("part"), "row", "col", F.col("sheet").alias("title"), *value, F.when(formula, F.col("formula")).alias("formula"))
    if sheets is not None:
        rows = rows.unionByName(sheets.select("workbook_id", "sheet_index", F.lit(HEAD).alias("part"), F.col("name").alias("title"), F.struct(F.coalesce("visible", F.lit("visible")).alias("visible"), "freeze_row", "freeze_col").alias("head")), True)
    if ranges is not None:
        merges = ranges.where("kind = 'merge'").groupBy("workbook_id", "sheet_index").agg(F.collect_list(F.array("r0", "c0", "r1", "c1")).alias("merges"))
        rows = rows.unionByName(merges.withColumn("part", F.lit(MERGES)), True)
    if names is not None:
        told = names.groupBy("workbook_id").agg(F.array_sort(F.collect_list(F.struct("scope_sheet", "name", "refers_to"))).alias("names"))
        rows = rows.unionByName(told.withColumns({"sheet_index": F.lit(-1), "part": F.lit(NAMES)}), True)
    ordered = rows.repartition("workbook_id").sortWithinPartitions("workbook_id", "sheet_index", "part", "row", "col")

    def cell(kind, num, text, bool_, err) -> tuple:
        return kind or "text", {"text": text, "bool": bool_, "error": err}.get(kind or "text", num)

    def placed(found):
        """Place and cell of each row; of two at one place the later one."""
        for place, same in groupby(found, key=lambda r: (r["row"], r["col"])):
            *_, r = same
            yield place, (*cell(*(r[c] for c in ("kind", "num", "str", "bool", "err"))), r["formula"])

    def parts(found):
        """The sheets of a workbook, each with its cells still to be read."""
        for _, own in groupby(found, key=lambda r: r["sheet_index"]):
            head, merges, first = None, [], None
            for first in own:
                if first["part"] == CELL:
                    break
                if first["part"] == HEAD:
                    head, first = first, None
                else:
                    merges, first = first["merges"], None
            if head is None and first is None:
                continue
            state = head["head"] if head else {"visible": "visible", "freeze_row": None, "freeze_col": None}
            title = head["title"] if head and head["title"] is not None else first and first["title"]
            yield {
                "title": title, "state": state["visible"], "merges": [tuple(m) for m in merges], "freeze": (state["freeze_row"] or 0, state["freeze_col"] or 0),
                "cells": placed(chain([first], own)) if first else (),
            }

    def run(batches):
        every = (dict(zip(batch.schema.names, r)) for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for book, found in groupby(every, key=lambda r: r["workbook_id"]):
            told, first = [], next(found)
            if first["part"] == NAMES:
                told, first = [(n["scope_sheet"], n["name"], n["refers_to"]) for n in first["names"]], next(found, None)
            sheets_ = parts(chain([first], found) if first else ())
            try:
                if (some := next(sheets_, None)) is None:
                    continue
                made = book, xlsx.write(chain([some], sheets_), told), None
            except xlsx.WriteError as e:
                made = book, None, str(e)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(made, (pa.string(), pa.binary(), pa.string()))], ["workbook_id", "content", "error"])

    return ordered.mapInArrow(run, "workbook_id string, content binary, error string")
