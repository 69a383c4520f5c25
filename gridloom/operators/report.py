"""Profiles and differences of workbooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.cells import PLACE


def stats(cells: DataFrame) -> DataFrame:
    """Cells, formulas and kinds of each workbook; every write counts."""
    kinds = ("text", "number", "date", "bool", "error")
    return cells.groupBy("workbook_id").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("kind") == "formula").alias("formulas"), *[F.count_if(F.col("kind") == k).alias(f"{k}_cells") for k in kinds]
    )


def features(sheets: DataFrame, ranges: DataFrame, names: DataFrame) -> DataFrame:
    """What each workbook holds besides cells, as counts."""
    kinds = ("merge", "hyperlink", "comment", "table", "validation", "conditional", "image", "chart", "sparkline")
    a = sheets.groupBy("workbook_id").agg(F.count(F.lit(1)).alias("sheets"), F.count_if(F.col("visible") != "visible").alias("hidden_sheets"), F.count("autofilter").alias("autofilters"))
    b = ranges.groupBy("workbook_id").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in kinds])
    c = names.groupBy("workbook_id").agg(F.count(F.lit(1)).alias("defined_names"))
    joined = a.join(b, "workbook_id", "left").join(c, "workbook_id", "left")
    return joined.na.fill(0)


def outcomes(evaluated: DataFrame) -> DataFrame:
    """How many formulas of each workbook were computed, were errors, or fell back and why."""
    return evaluated.groupBy("workbook_id", "status", "reason").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value.kind") == "error").alias("errors"))


#: Formulas of a workbook that a report evaluates.
MAX_EVALUATED = 10_000


def bounded_outcomes(evaluated: DataFrame, most: int | None = MAX_EVALUATED) -> DataFrame:
    """workbook_id, computed, errors (computed ones that are errors), cached (fallbacks), truncated
    (whether formulas beyond the first most of a workbook, in order of sheet and place, were
    left out) and reasons (of the fallbacks). With None for most all formulas count.

    evaluated has sheet_index, row, col, status, value and perhaps reason.
    """
    if most is None:
        counted = evaluated.withColumn("__in", F.lit(True))
    else:
        place = Window.partitionBy("workbook_id").orderBy("sheet_index", "row", "col")
        ranked = evaluated.withColumn("__at", F.row_number().over(place))
        counted = ranked.where(F.col("__at") <= most + 1).withColumn("__in", F.col("__at") <= most)
    is_in, ok = F.col("__in"), F.col("status") == "computed"
    return counted.groupBy("workbook_id").agg(
        F.count_if(is_in & ok & (F.col("value.kind") != "error")).alias("computed"), F.count_if(is_in & ok & (F.col("value.kind") == "error")).alias("errors"),
        F.count_if(is_in & ~ok).alias("cached"), F.bool_or(~is_in).alias("truncated"), F.collect_list(F.when(is_in & ~ok, F.col("reason"))).alias("reasons") if "reason" in evaluated.columns else F.lit(None).alias("reasons"),
    )


def warnings(report: DataFrame) -> DataFrame:
    """workbook_id and warnings, in this order, of a report's rows: cached and truncated (as in
    bounded_outcomes), text_truncated, vba_project and pivot_tables."""
    named = {
        "FormulaFallbackPresent": F.col("cached") > 0, "FormulaEvaluationTruncated": F.col("truncated"), "TextTruncated": F.col("text_truncated"),
        "MacrosPresentNotExecuted": F.col("vba_project"), "PivotTablesPreservedNotModeled": F.col("pivot_tables") > 0,
    }
    return report.select("workbook_id", F.array_compact(F.array(*[F.when(c, name) for name, c in named.items()])).alias("warnings"))


#: The features of a report in order, and of each the kind of range that it counts.
FEATURES = {
    "comments": "comment", "data_validations": "validation", "tables": "table", "merged_ranges": "merge", "hyperlinks": "hyperlink", "images": "image", "charts": "chart", "sparklines": "sparkline",
    "conditional_formatting": "conditional", "hidden_sheets": None, "frozen_panes": None, "page_setup": None, "protection": None, "pivot_tables": None, "vba_project": None,
    "threaded_comments": None, "external_links": None, "custom_xml": None,
}
#: The parts of a package that some features count.
FEATURE_PARTS = {
    "pivot_tables": r"(?i)^xl/pivotTables/pivotTable[^/]*\.xml$", "vba_project": r"(?i)vbaProject\.bin$", "threaded_comments": r"(?i)^xl/threadedComments/[^/]*\.xml$",
    "external_links": r"(?i)^xl/externalLinks/externalLink[^/]*\.xml$", "custom_xml": r"(?i)^customXml/item[0-9]+\.xml$",
}


def report_v1(tables: dict[str, DataFrame], evaluated: DataFrame, most: int | None = MAX_EVALUATED) -> DataFrame:
    """workbook_id and report: the JSON report of each workbook, schema version 1, keys in their order.

    tables: workbooks, sheets, cells (every write counts), names, ranges and parts of schema.py.
    most: how many formulas of a workbook count, None for all (bounded_outcomes).
    Page setups are not read and count as none.
    """
    key = "workbook_id"
    books = tables["workbooks"]
    sheets = tables["sheets"].groupBy(key).agg(
        F.count(F.lit(1)).alias("sheets"), F.count_if(F.col("visible") != "visible").alias("hidden_sheets"),
        F.count_if((F.coalesce("freeze_row", F.lit(0)) > 0) | (F.coalesce("freeze_col", F.lit(0)) > 0)).alias("frozen_panes"), F.count_if("protected").alias("protection"),
    )
    cells = tables["cells"].groupBy(key).agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("kind") == "formula").alias("formulas"))
    ranges = tables["ranges"].groupBy(key).agg(*[F.count_if(F.col("kind") == kind).alias(name) for name, kind in FEATURES.items() if kind])
    names = tables["names"].groupBy(key).agg(F.count_if(F.col("scope_sheet").isNull()).alias("defined_names_count"), F.count("scope_sheet").alias("local_defined_names_count"))
    parts = tables["parts"].groupBy(key).agg(*[F.count_if(F.col("part").rlike(p)).alias(name) for name, p in FEATURE_PARTS.items()])
    done = bounded_outcomes(evaluated, most)
    rows = books
    for other in (sheets, cells, ranges, names, parts, done):
        rows = rows.join(other, key, "left")
    counts = [c for df in (sheets, cells, ranges, names, parts) for c in df.columns if c != key] + ["computed", "errors", "cached"]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    rows = rows.withColumns({"truncated": F.coalesce("truncated", F.lit(False)), "vba_project": F.col("vba_project") > 0, "page_setup": F.lit(0), "reasons": F.array_sort(F.coalesce("reasons", F.array().cast("array<string>")))})
    told = F.transform(F.array_distinct("reasons"), lambda r: F.struct(r, F.size(F.filter("reasons", lambda x: x == r))))
    made = F.struct(
        F.lit(1).alias("schema_version"), "format", F.struct("sheets", "cells", "formulas", "text_truncated").alias("stats"),
        F.struct("title", "subject", "creator", "keywords", "description", "last_modified_by", "company", "created").alias("properties"), "defined_names_count", "local_defined_names_count",
        F.struct(*FEATURES).alias("features"), F.struct("computed", "errors", "cached", F.col("cached").alias("unsupported"), "truncated", F.map_from_entries(told).alias("by_reason")).alias("evaluation"), "warnings",
    )
    rows = rows.join(warnings(rows), key)
    return rows.select(key, F.to_json(made, {"ignoreNullFields": "false"}).alias("report"))


def head_and_total(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows, each with the number of all rows: counted past the limit."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).limit(n).join(F.broadcast(total))


def to_json(report: DataFrame) -> DataFrame:
    """One JSON text a workbook, fields in the order of the columns, nulls kept."""
    return report.select("workbook_id", F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"}).alias("report"))


def compare(left: DataFrame, right: DataFrame, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """Places where two tables differ, null-safe: change is added, removed or changed."""
    keys = keys or PLACE
    a = left.select(*keys, F.struct(*values).alias("a"))
    b = right.select(*keys, F.struct(*values).alias("b"))
    joined = a.join(b, keys, "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return joined.where(~F.col("a").eqNullSafe(F.col("b"))).withColumn("change", change)


def compare_lists(left: DataFrame, right: DataFrame, keys: list[str], items: str) -> DataFrame:
    """Positions where two lists differ; a missing item shows as 'missing'."""
    a = left.select(*keys, F.posexplode(items).alias("at", "a"))
    b = right.select(*keys, F.posexplode(items).alias("at", "b"))
    joined = a.join(b, [*keys, "at"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return joined.select(*keys, "at", F.coalesce("a", F.lit("missing")).alias("a"), F.coalesce("b", F.lit("missing")).alias("b"))


def head(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows and whether there were more (truncated)."""
    rows = df.orderBy(*order).limit(n + 1)
    place = Window.orderBy(*order)
    return rows.withColumns({"__at": F.row_number().over(place), "truncated": F.count(F.lit(1)).over(Window.partitionBy()) > n}).where(F.col("__at") <= n).drop("__at")


#: The codes of what can be wrong with a file, and what each means for a corpus.
DECISIONS = {
    "encrypted": "expected_rejection", "encrypted_package": "expected_rejection", "encrypted_open_document": "expected_rejection",
    "legacy_biff": "unsupported_format", "not_ole2": "not_a_workbook", "missing_workbook": "not_a_workbook", "zip": "damaged", "xml": "damaged",
    "biff": "damaged", "cfb": "damaged", "invalid_cfb": "damaged", "unsupported_compression": "unsupported_format", "no_text": "empty", "sheet_out_of_range": "request",
}


def corpus(opened: DataFrame) -> DataFrame:
    """Files, opened and failed by extension, by error kind and in total, in one pass.

    opened: path, ext, error_kind (NULL if it opened).
    """
    known = F.create_map(*[F.lit(x) for kv in DECISIONS.items() for x in kv])
    rows = opened.withColumn("decision", F.try_element_at(known, F.coalesce("error_kind", F.lit(""))))
    counts = [F.count(F.lit(1)).alias("files"), F.count_if(F.col("error_kind").isNull()).alias("opened"), F.count("error_kind").alias("failed")]
    sets = [["ext"], ["error_kind"], ["decision"], []]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], "ext", "error_kind", "decision").agg(F.grouping_id().alias("level"), *counts)
