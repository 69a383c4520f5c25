"""Checks before a workbook is written: one table of violations.

Each rule is a filter, a duplicate check, an anti-join or a blocked range join;
first_violation() gives the first by rule, sheet, row and column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.values import finite
from gridloom.operators.cells import SHEET, covering

#: The grid, the longest cell text in UTF-16 units, the most sheets, the largest output.
ROWS, COLS, CELL_UNITS, SHEETS, OUTPUT = 1_048_576, 16_384, 32_767, 255, 256 << 20
#: The shapes of names and time stamps.
TABLE_NAME = r"^[\p{L}_\\][\p{L}\p{N}_.\\]{0,254}$"
CELL_LIKE = r"(?i)^[A-Z]{1,3}[0-9]+$|^R[0-9]*C[0-9]*$|^[RC]$"
TIMESTAMP = r"(?s)^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60).*$"
NOT_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]"


def _found(rows: DataFrame, order: int, rule: str, detail: Column, row: Column | None = None, col: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("int")
    sheet = F.col("sheet_index") if "sheet_index" in rows.columns else none
    return rows.select("workbook_id", F.lit(order).alias("rule_order"), F.lit(rule).alias("rule"), sheet.alias("sheet_index"), (none if row is None else row).alias("row"), (none if col is None else col).alias("col"), detail.cast("string").alias("detail"))


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def violations(cells: DataFrame, sheets: DataFrame, names: DataFrame, ranges: DataFrame) -> DataFrame:
    """workbook_id, rule_order, rule, sheet_index, row, col, detail of the tables of schema.py."""
    name, row, col = F.col("name"), F.col("row"), F.col("col")
    lower = sheets.withColumn("key", F.lower("name"))
    scoped = names.where("scope_sheet IS NOT NULL").withColumn("name_", F.col("name"))
    texts = F.coalesce("str", F.lit(""))
    number = F.coalesce("num", "cached.num")
    under = covering(cells, ranges.where("kind = 'merge'").select(*SHEET, "r0", "c0", "r1", "c1")).where((row != F.col("r0")) | (col != F.col("c0")))
    tables = ranges.where("kind = 'table'")
    bad_name = (F.length("name") < 1) | (F.length("name") > 31) | (F.trim("name") != name) | name.rlike(r"[:\\/?*\[\]]")
    bad_box = (F.col("r0") < 0) | (F.col("c0") < 0) | (F.col("r1") >= ROWS) | (F.col("c1") >= COLS) | (F.col("r0") > F.col("r1")) | (F.col("c0") > F.col("c1"))
    bad_defined = ~name.rlike(TABLE_NAME) | name.rlike(CELL_LIKE)
    checks = [
        _found(sheets.groupBy("workbook_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHEETS), 1, "TooManySheets", F.col("n")),
        _found(sheets.where(bad_name), 3, "InvalidSheetName", name),
        _found(_repeated(lower, "workbook_id", "key"), 4, "DuplicateSheetName", F.col("key")),
        _found(names.where(bad_defined & ~name.startswith("_xlnm.")), 5, "InvalidDefinedName", name),
        _found(_repeated(names.withColumn("key", F.lower("name")), "workbook_id", "scope_sheet", "key"), 6, "DuplicateDefinedName", F.col("key")),
        _found(scoped.join(sheets.select("workbook_id", F.col("name").alias("scope_sheet")), ["workbook_id", "scope_sheet"], "left_anti"), 7, "UnknownDefinedNameSheet", F.col("name_")),
        _found(cells.where((row < 0) | (row >= ROWS) | (col < 0) | (col >= COLS)), 8, "CellOutOfGrid", F.lit(None), row, col),
        _found(cells.where(number.isNotNull() & ~finite(number)), 9, "NonFiniteNumber", number, row, col),
        _found(cells.where(texts.rlike(NOT_XML)), 10, "InvalidXmlText", F.lit(None), row, col),
        _found(cells.where(F.octet_length(F.encode(texts, "UTF-16BE")) > 2 * CELL_UNITS), 11, "CellTextTooLong", F.length(texts), row, col),
        _found(ranges.where((F.col("kind") == "hyperlink") & (F.coalesce(F.trim("text"), F.lit("")) == "")), 12, "InvalidHyperlinkTarget", F.col("text"), F.col("r0"), F.col("c0")),
        _found(ranges.where(bad_box), 13, "MergeOutOfGrid", F.col("kind"), F.col("r0"), F.col("c0")),
        _found(under, 14, "CellUnderMergedRange", F.lit(None), row, col),
        _found(sheets.where(~F.col("zoom").between(10, 400)), 15, "InvalidSheetViewZoom", F.col("zoom")),
        _found(tables.where(~name.rlike(TABLE_NAME) | name.rlike(CELL_LIKE)), 16, "InvalidTableName", name),
        _found(tables.where(F.size(F.split("text", "\t")) != F.col("c1") - F.col("c0") + 1), 17, "TableRangeColumnsMismatch", name),
        _found(_repeated(tables.withColumn("key", F.lower("name")), "workbook_id", "key"), 19, "DuplicateTableName", F.col("key")),
        _found(cells.groupBy("workbook_id").agg(F.sum(F.octet_length(texts) + F.octet_length(F.coalesce("formula", F.lit(""))) + 40).alias("n")).where(F.col("n") > OUTPUT), 21, "OutputTooLarge", F.col("n")),
    ]
    return reduce(DataFrame.unionByName, checks)


def valid_timestamp(text: Column) -> Column:
    """Whether a text starts as YYYY-MM-DDThh:mm:ss with a date of the calendar and a time of day
    (a leap second too); what follows is not looked at."""
    day = F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))
    return text.rlike(TIMESTAMP) & day.isNotNull() & (F.substring(text, 1, 4) != "0000")


def timestamp_violations(properties: DataFrame) -> DataFrame:
    """Rule 20, InvalidTimestamp: of workbook_id, created and modified (texts, NULL if not given)."""
    each = properties.select("workbook_id", F.explode(F.array("created", "modified")).alias("at"))
    return _found(each.where(~valid_timestamp(F.col("at"))), 20, "InvalidTimestamp", F.col("at"))


def active_sheet_violations(books: DataFrame, sheets: DataFrame) -> DataFrame:
    """Rule 2, ActiveSheetOutOfRange: of workbook_id and active (a sheet index, NULL if not given)."""
    n = sheets.groupBy("workbook_id").agg(F.count(F.lit(1)).alias("n"))
    rows = books.join(n, "workbook_id", "left").where((F.col("active") < 0) | (F.col("active") >= F.coalesce("n", F.lit(0))))
    return _found(rows, 2, "ActiveSheetOutOfRange", F.col("active"))


def first_violation(found: DataFrame) -> DataFrame:
    """The first violation of each workbook."""
    order = F.struct("rule_order", F.coalesce("sheet_index", F.lit(-1)), F.coalesce("row", F.lit(-1)), F.coalesce("col", F.lit(-1)))
    others = F.struct("rule", "sheet_index", "row", "col", "detail")
    return found.groupBy("workbook_id").agg(F.min_by(others, order).alias("v")).select("workbook_id", "v.*")
