"""Command line: python -m gridloom COMMAND PATH [...].

Commands: info, dump, sheet, metadata, formula, csv, diagnose, inspect-package, compare, corpus-report.
Exit codes: 0 done, 1 differences or unreadable files, 64 usage.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.operators import cells as C
from gridloom.operators import export, report
from gridloom.plans import grid
from gridloom.sources.workbook import read_tables, workbooks


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridloom", description=__doc__.splitlines()[0])
    parser.add_argument("command", choices=["info", "dump", "sheet", "metadata", "formula", "csv", "diagnose", "inspect-package", "compare", "corpus-report"])
    parser.add_argument("path")
    parser.add_argument("other", nargs="?")
    parser.add_argument("--sheet")
    parser.add_argument("--limit", type=int, default=100)
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return 64 if e.code else 0
    if (args.command == "compare") != bool(args.other):
        print("compare takes two paths", file=sys.stderr)
        return 64
    spark = SparkSession.builder.getOrCreate()
    errors = workbooks(spark, args.path, "errors").where("error_kind != 'text_truncated'")
    if args.command == "corpus-report":
        ids = spark.read.format("binaryFile").load(args.path).select("path", F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("ext"))
        opened = ids.join(errors.select(F.col("workbook_id").alias("path"), "error_kind"), "path", "left")
        report.corpus(opened).orderBy("level", "ext", "error_kind").show(200, False)
        return 0
    for r in errors.limit(args.limit).collect():
        print(f"{r.workbook_id}: {r.error_kind}: {r.message}", file=sys.stderr)
    cells = C.effective(workbooks(spark, args.path, "cells"))
    if args.sheet is not None:
        cells = cells.where(F.col("sheet") == args.sheet)
    order = ["workbook_id", "sheet_index", "row", "col"]
    if args.command == "info":
        sheets = workbooks(spark, args.path, "sheets")
        sheets.join(C.bounds(cells), C.SHEET, "left").orderBy(*order[:2]).show(args.limit, False)
    elif args.command == "sheet":
        chosen = workbooks(spark, args.path, "sheets").where(F.col("name") == (args.sheet or ""))
        chosen.show(args.limit, False)
        workbooks(spark, args.path, "ranges").join(chosen, C.SHEET, "left_semi").orderBy(*order[:2], "kind", "r0", "c0").show(args.limit, False)
    elif args.command == "metadata":
        tables = (workbooks(spark, args.path, t) for t in ("sheets", "ranges", "names"))
        report.features(*tables).orderBy("workbook_id").show(args.limit, False)
    elif args.command == "dump":
        shown = cells.select(*order[:2], "sheet", C.a1(F.col("row"), F.col("col")).alias("at"), "kind", "display", "formula", "row", "col")
        report.head(shown, args.limit, *order).drop("row", "col").show(args.limit, False)
    elif args.command == "formula":
        done = grid.evaluate(C.effective(workbooks(spark, args.path, "cells")), workbooks(spark, args.path, "names"))
        done.orderBy("workbook_id", "sheet", "row", "col").show(args.limit, False)
    elif args.command == "csv":
        for r in export.document(export.csv_rows(cells, pad_leading=True)).orderBy(*order[:2]).toLocalIterator():
            print(r.text)
    elif args.command == "diagnose":
        tables = read_tables(spark.read.format("binaryFile").load(args.path))
        done = grid.evaluate(C.effective(tables["cells"]), tables["names"])
        done = done.join(tables["sheets"].select("workbook_id", "sheet_index", F.col("name").alias("sheet")), ["workbook_id", "sheet"])
        for r in report.report_v1(tables, done).orderBy("workbook_id").toLocalIterator():
            print(r.report)
    elif args.command == "inspect-package":
        workbooks(spark, args.path, "parts").orderBy("workbook_id", "part").show(args.limit, False)
    else:
        other = C.effective(workbooks(spark, args.other, "cells"))
        found = report.compare(cells, other, ["kind", "num", "str", "bool", "err", "formula", "display"], ["sheet_index", "row", "col"])
        found.orderBy("sheet_index", "row", "col").show(args.limit, False)
        return int(not found.isEmpty())
    return int(not errors.isEmpty())


if __name__ == "__main__":
    sys.exit(main())
