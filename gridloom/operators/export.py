"""Sheets as text, CSV, HTML and Markdown.

Each row is put together within its own group; the lines of a sheet are only
joined where one document a sheet is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.cells import SHEET

#: The largest export, and the widest Markdown table.
MAX_BYTES, MARKDOWN_COLUMNS = 256 << 20, 256


def quoted(text: Column, delimiter: str = ",") -> Column:
    special = F.contains(text, F.lit(delimiter)) | text.rlike('["\r\n]')
    return F.when(special, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def safe(text: Column) -> tuple[Column, Column]:
    """Text that a spreadsheet would take for a formula, with an apostrophe before; and whether it was."""
    risky = F.substring(text, 1, 1).isin("=", "+", "-", "@", "\t", "\r", "\n")
    return F.when(risky, F.concat(F.lit("'"), text)).otherwise(text), risky


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def markdown_escape(text: Column) -> Column:
    """Bars with a backslash before; each CR and each LF is a line break. Backslashes stay single."""
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), "[\r\n]", "<br>")


def dump_escape(text: Column) -> Column:
    """Tabs and line ends as \\t, \\n and \\r, so that a cell stays on its line."""
    for a, b in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def worksheets(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """The cells of worksheets only: chart, dialog and macro sheets are not exported."""
    return cells.join(sheets.where("sheet_type = 'WorkSheet'").select(*SHEET), SHEET, "left_semi")


def _row_cells(cells: DataFrame, keep: list[str] = ()) -> DataFrame:
    return cells.groupBy(*SHEET, "row", *keep).agg(F.array_sort(F.collect_list(F.struct("col", F.coalesce("display", F.lit("")).alias("display")))).alias("cells"))


def text_rows(cells: DataFrame) -> DataFrame:
    """The non-empty texts of each row with tabs between; gaps close up."""
    rows = _row_cells(cells.where("display IS NOT NULL AND display != ''"))
    return rows.select(*SHEET, "row", F.array_join(F.col("cells.display"), "\t").alias("line"))


def csv_rows(cells: DataFrame, delimiter: str = ",", pad_leading: bool = False, escape_formulas: bool = False) -> DataFrame:
    """One CSV line a populated row. Gaps between cells are kept; a gap before the first one
    only with pad_leading."""
    if delimiter in ('"', "\r", "\n") or len(delimiter) != 1:
        raise ValueError("the delimiter cannot be a quote or a line end")
    rows = _row_cells(cells)

    def field(c: Column) -> Column:
        if not escape_formulas:
            return quoted(c["display"], delimiter)
        made, risky = safe(c["display"])
        forced = F.concat(F.lit('"'), F.replace(made, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(risky, forced).otherwise(quoted(made, delimiter))

    def add(acc: Column, c: Column) -> Column:
        gap = F.repeat(F.lit(delimiter), F.greatest(F.lit(0), c["col"] - acc["next"]))
        return F.struct(F.concat(acc["line"], gap, field(c)).alias("line"), c["col"].alias("next"))

    start = F.lit(0) if pad_leading else F.get("cells", F.lit(0))["col"]
    line = F.aggregate("cells", F.struct(F.lit("").alias("line"), start.cast("int").alias("next")), add, lambda acc: acc["line"])
    return rows.select(*SHEET, "row", line.alias("line"))


def html_rows(cells: DataFrame, width: Column | None = None, merges: DataFrame | None = None) -> DataFrame:
    """One <tr> a populated row, from column 0 to width - 1, by default to its own last cell.
    merges (r0, c0, r1, c1) span."""
    width = F.element_at("cells", -1)["col"] + 1 if width is None else width
    rows = _row_cells(cells).withColumn("by", F.map_from_entries(F.transform("cells", lambda c: F.struct(c["col"], c["display"]))))
    none = F.array().cast("array<struct<r0:int,c0:int,r1:int,c1:int>>")
    if merges is None:
        rows = rows.withColumn("spans", none)
    else:
        spans = merges.select(*SHEET, F.struct("r0", "c0", "r1", "c1").alias("m"), F.explode(F.sequence("r0", "r1")).alias("row"))
        rows = rows.join(spans.groupBy(*SHEET, "row").agg(F.collect_list("m").alias("spans")), [*SHEET, "row"], "left").withColumn("spans", F.coalesce("spans", none))

    def cell(c: Column) -> Column:
        over = F.get(F.filter("spans", lambda m: c.between(m["c0"], m["c1"])), F.lit(0))
        anchor = (over["r0"] == F.col("row")) & (over["c0"] == c)
        down, across = over["r1"] - over["r0"] + 1, over["c1"] - over["c0"] + 1
        attrs = F.concat(F.when(anchor & (down > 1), F.concat(F.lit(' rowspan="'), down.cast("string"), F.lit('"'))).otherwise(""), F.when(anchor & (across > 1), F.concat(F.lit(' colspan="'), across.cast("string"), F.lit('"'))).otherwise(""))
        text = html_escape(F.coalesce(F.try_element_at("by", c), F.lit("")))
        return F.when(over.isNotNull() & ~anchor, "").otherwise(F.concat(F.lit("<td"), attrs, F.lit(">"), text, F.lit("</td>")))

    line = F.array_join(F.transform(F.sequence(F.lit(0), width - 1), cell), "")
    return rows.select(*SHEET, "row", F.concat(F.lit("<tr>"), line, F.lit("</tr>")).alias("line"))


def markdown_rows(cells: DataFrame, width: Column, keep: list[str] = ()) -> DataFrame:
    """One line a populated row, from column 0 to width - 1; columns to keep are the same in all of a row's cells."""
    rows = _row_cells(cells, keep=keep).withColumn("by", F.map_from_entries(F.transform("cells", lambda c: F.struct(c["col"], c["display"]))))
    texts = F.transform(F.sequence(F.lit(0), width - 1), lambda c: markdown_escape(F.coalesce(F.try_element_at("by", c), F.lit(""))))
    return rows.select(*SHEET, "row", *keep, F.concat(F.lit("| "), F.array_join(texts, " | "), F.lit(" |")).alias("line"))


def document(lines: DataFrame, newline: str = "\n", max_bytes: int = MAX_BYTES, bom: bool = False) -> DataFrame:
    """The lines of each sheet as one text; one that is too long is an error, not cut.

    The lengths are summed first, so no task gathers the lines of a sheet that is too long.
    """
    mark = "\ufeff" if bom else ""
    each = F.octet_length("line") + len(newline.encode())
    sizes = lines.groupBy(*SHEET).agg((F.sum(each) - len(newline.encode()) + len(mark.encode())).alias("bytes"))
    fits = F.when(F.col("bytes") <= max_bytes, True).otherwise(F.raise_error(F.lit("export is larger than its limit")).cast("boolean"))
    whole = lines.join(sizes.where(fits), SHEET).groupBy(*SHEET).agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("lines"))
    return whole.select(*SHEET, F.concat(F.lit(mark), F.array_join(F.col("lines.line"), newline)).alias("text"))


def html_document(cells: DataFrame, merges: DataFrame | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Each sheet as one <table> fragment."""
    text = document(html_rows(cells, None, merges), "", max_bytes)
    return text.select(*SHEET, F.concat(F.lit("<table>"), "text", F.lit("</table>")).alias("text"))


def markdown_document(cells: DataFrame, merges: DataFrame | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Each sheet as a Markdown table, the first populated row as its header; sheets with merges
    or of more than MARKDOWN_COLUMNS columns, which Markdown cannot hold, as HTML."""
    widths = cells.groupBy(*SHEET).agg((F.max("col") + 1).alias("width"), F.min("row").alias("first"))
    if merges is not None:
        merged = merges.select(*SHEET).distinct().withColumn("merged", F.lit(True))
        widths = widths.join(merged, SHEET, "left")
    else:
        widths = widths.withColumn("merged", F.lit(None).cast("boolean"))
    widths = widths.withColumn("html", F.coalesce("merged", F.lit(False)) | (F.col("width") > MARKDOWN_COLUMNS))
    plain = widths.where(~F.col("html")).select(*SHEET, "width", "first")
    rows = markdown_rows(cells.join(plain.select(*SHEET, "width"), SHEET), F.col("width"), ["width"])
    rows = rows.join(plain.select(*SHEET, "first"), SHEET)
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("width")))
    rows = rows.select(*SHEET, "row", F.when(F.col("row") == F.col("first"), F.concat("line", F.lit("\n"), rule)).otherwise(F.col("line")).alias("line"))
    other = cells.join(widths.where("html").select(*SHEET), SHEET, "left_semi")
    return document(rows, "\n", max_bytes).unionByName(html_document(other, merges, max_bytes))


def workbook_text(cells: DataFrame, sheets: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """workbook_id and text: the texts of its worksheets in order, each under a line '# name'."""
    own = sheets.where("sheet_type = 'WorkSheet'").select(*SHEET, "name")
    each = own.join(document(text_rows(cells), "\n", max_bytes), SHEET, "left")
    block = F.concat(F.lit("# "), "name", F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    whole = each.groupBy("workbook_id").agg(F.array_sort(F.collect_list(F.struct("sheet_index", block.alias("text")))).alias("parts"))
    return whole.select("workbook_id", F.array_join(F.col("parts.text"), "\n").alias("text"))


def extract_text(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """workbook_id, text and error: no_text, and no text, where there is no letter or digit in it."""
    some = F.col("text").rlike(r"[\p{IsAlphabetic}\p{N}]")
    return workbook_text(cells, sheets).select("workbook_id", F.when(some, F.col("text")).alias("text"), F.when(~some, "no_text").alias("error"))
