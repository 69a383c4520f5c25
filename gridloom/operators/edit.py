"""Edits of sheets across a cells table: renaming and deleting with their formulas.

Formulas are rewritten once for each distinct text and joined back.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A sheet qualifier, quoted or bare, maybe of a span of sheets.
_QUALIFIER = re.compile(r"(?P<quoted>'(?:[^']|'')*')!|(?P<bare>[\w.]+(?::[\w.]+)?)!")


def _quoted(name: str) -> str:
    plain = re.fullmatch(r"[^\W\d][\w.]*", name)
    return name if plain else "'" + name.replace("'", "''") + "'"


def rewritten(formula: str, old: str, new: str | None) -> str:
    """A formula after sheet old became new, or was deleted (None): its references become #REF!.

    Strings stay as they are, and formulas that refer to other workbooks too.
    """
    if "[" in formula or "]" in formula:
        return formula

    def change(m: re.Match) -> str:
        quoted = m["quoted"] is not None
        name = m["quoted"][1:-1].replace("''", "'") if quoted else m["bare"]
        ends = name.split(":")
        hit = [e.lower() == old.lower() for e in ends]
        if not any(hit) or len(ends) > 2:
            return m[0]
        if new is None:
            return "#REF!"
        joined = ":".join(new if h else e for e, h in zip(ends, hit))
        if quoted or any(_quoted(e) != e for e in joined.split(":")):
            return "'" + joined.replace("'", "''") + "'!"
        return joined + "!"

    pieces = re.split(r'("(?:[^"]|"")*")', formula)
    return "".join(p if i % 2 else _QUALIFIER.sub(change, p) for i, p in enumerate(pieces))


def rewrite_formulas(cells: DataFrame, old: str, new: str | None, column: str = "formula") -> DataFrame:
    @F.pandas_udf("string")
    def change(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: rewritten(t, old, new))

    touched = cells.where(F.col(column).isNotNull() & F.lower(column).contains(old.lower()) & F.col(column).contains("!"))
    table = touched.select(column).distinct().withColumn("__new", change(column))
    joined = cells.join(table, column, "left")
    return joined.withColumn(column, F.coalesce("__new", column)).drop("__new").select(*cells.columns)


def rename_sheet(cells: DataFrame, old: str, new: str) -> DataFrame:
    """Cells after a rename; names differ from others ignoring case and are valid."""
    if not 1 <= len(new) <= 31 or re.search(r"[:\\/?*\[\]]", new) or new.strip() != new:
        raise ValueError(f"invalid sheet name: {new}")
    if not cells.where(F.lower("sheet") == new.lower()).where(F.col("sheet") != old).isEmpty():
        raise ValueError(f"there is a sheet {new}")
    changed = rewrite_formulas(cells, old, new)
    return changed.withColumn("sheet", F.when(F.col("sheet") == old, new).otherwise(F.col("sheet")))


def delete_sheet(cells: DataFrame, name: str) -> DataFrame:
    return rewrite_formulas(cells.where(F.col("sheet") != name), name, None)


def append_rows(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """rows: cells whose row counts from 0; they go below the last row of their sheet."""
    from gridloom.operators.cells import SHEET, next_row

    placed = rows.join(next_row(cells), SHEET, "left").withColumn("row", F.col("row") + F.coalesce("next_row", F.lit(0))).drop("next_row")
    return cells.unionByName(placed, allowMissingColumns=True)
