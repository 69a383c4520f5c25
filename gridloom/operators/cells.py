"""Operators on the cells table (schema.CELLS): tables to cells and back.

Cells are sparse: a missing row is a blank. Every operator is a filter, a
grouped aggregate or an equi-join on the coordinates, whose key spreads the
cells of even one large sheet over tasks by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import values as V

SHEET = ["workbook_id", "sheet_index"]
PLACE = [*SHEET, "row", "col"]


def melt(df: DataFrame, columns: Sequence[str], row: Column, sheet: str = "Data", workbook: str = "table") -> DataFrame:
    """A table as cells: one for each non-null value, in the given order of columns; row numbers the rows."""
    kinds = {f.name: f.dataType for f in df.schema}
    made = []
    for i, name in enumerate(columns):
        v = V.from_column(F.col(name), kinds[name])
        date = isinstance(kinds[name], (T.DateType, T.TimestampType, T.TimestampNTZType))
        kind = F.lit("date") if date else v.kinds()
        made.append(F.struct(F.lit(i).alias("col"), F.when(F.col(name).isNotNull(), kind).alias("kind"), *[v.part(p).alias(n) for p, n in (("number", "num"), ("text", "str"), ("bool", "bool"), ("error", "err"))], v.display().alias("display")))
    rows = df.select(row.cast("int").alias("row"), F.explode(F.array(*made)).alias("c"))
    return rows.where("c.kind IS NOT NULL").select(F.lit(workbook).alias("workbook_id"), F.lit(0).alias("sheet_index"), F.lit(sheet).alias("sheet"), F.lit(0).cast("long").alias("seq"), "row", "c.*")


def effective(cells: DataFrame) -> DataFrame:
    """The last write of each place; max_by needs no sort and is aggregated partially."""
    others = [c for c in cells.columns if c not in PLACE]
    last = cells.groupBy(*PLACE).agg(F.max_by(F.struct(*others), "seq").alias("last"))
    return last.select(*PLACE, *[F.col(f"last.{c}").alias(c) for c in others])


def slice_range(cells: DataFrame, r0: int, c0: int, r1: int, c1: int) -> DataFrame:
    """The cells of a rectangle; reversed bounds give none."""
    return cells.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))


def bounds(cells: DataFrame, *keys: str) -> DataFrame:
    """The used rectangle and its size of each sheet (or of each of keys)."""
    out = cells.groupBy(*(keys or SHEET)).agg(F.min("row").alias("r0"), F.min("col").alias("c0"), F.max("row").alias("r1"), F.max("col").alias("c1"))
    return out.withColumns({"height": F.expr("r1 - r0 + 1"), "width": F.expr("c1 - c0 + 1")})


def densify(cells: DataFrame, c0: int, c1: int) -> DataFrame:
    """Every column from c0 to c1 of every populated row, missing cells as NULL.

    Columns are generated within each row's own group, not by a cross join.
    """
    others = [c for c in cells.columns if c not in PLACE]
    rows = cells.where(F.col("col").between(c0, c1)).groupBy(*SHEET, "row")
    grouped = rows.agg(F.map_from_entries(F.collect_list(F.struct("col", F.struct(*others)))).alias("by"))
    wide = grouped.select(*SHEET, "row", "by", F.explode(F.sequence(F.lit(c0), F.lit(c1))).alias("col"))
    return wide.select(*PLACE, *[F.try_element_at("by", F.col("col"))[c].alias(c) for c in others])


def headers(cells: DataFrame, header_row: int | None = None) -> DataFrame:
    """col and header of each sheet's header row, by default the first populated one: one for each
    column of the sheet's used rectangle, '' where the row has no cell."""
    used = bounds(cells)
    if header_row is None:
        top = cells.join(used.select(*SHEET, F.col("r0").alias("row")), [*SHEET, "row"], "left_semi")
    else:
        top = cells.where(F.col("row") == header_row)
    by = top.groupBy(*SHEET).agg(F.map_from_entries(F.collect_list(F.struct("col", F.coalesce("display", F.lit(""))))).alias("by"))
    wide = used.join(by, SHEET, "left").select(*SHEET, "by", F.explode(F.sequence("c0", "c1")).alias("col"))
    return wide.select(*SHEET, "col", F.coalesce(F.try_element_at("by", F.col("col")), F.lit("")).alias("header"))


def value_as(kind: str, c: Column) -> Column:
    """A cell struct (kind, num, str, bool, err, display) as a type; NULL where it does not convert.

    i64 truncates, f64 reads text untrimmed, string is for text and numbers only.
    """
    number = F.when(c["kind"].isin("number", "date"), c["num"]).when(c["kind"] == "bool", c["bool"].cast("double")).when(c["kind"] == "text", V.parsed(c["str"]))
    if kind == "f64":
        return number
    if kind == "i64":
        whole = F.when(c["kind"] == "text", F.when(c["str"].rlike(r"^[+-]?\d+$"), c["str"].try_cast("long")))
        return F.when(c["kind"] == "text", whole).otherwise(F.when(V.finite(number), V.truncated(number).try_cast("long")))
    if kind == "string":
        return F.when(c["kind"] == "text", c["str"]).when(c["kind"] == "number", V.format_number(c["num"]))
    if kind == "bool":
        return F.when(c["kind"] == "bool", c["bool"])
    if kind == "display":
        return c["display"]
    raise ValueError(f"no such type: {kind}")


def typed_rows(cells: DataFrame, wanted: dict[str, tuple[int, str]], first_row: int = 0) -> DataFrame:
    """A row a sheet row: each wanted name from its column as its type. One shuffle, no pivot pass."""
    body = cells.where((F.col("row") >= first_row) & F.col("col").isin(*{c for c, _ in wanted.values()}))
    whole = F.struct("kind", "num", "str", "bool", "err", "display")
    picked = body.groupBy(*SHEET, "row").agg(*[F.max_by(F.when(F.col("col") == c, whole), F.when(F.col("col") == c, 1)).alias(f"__{n}") for n, (c, _) in wanted.items()])
    return picked.select(*SHEET, "row", *[value_as(k, F.col(f"__{n}")).alias(n) for n, (_, k) in wanted.items()])


def read_rows(cells: DataFrame, wanted: dict[str, str], skip_missing: bool = False) -> DataFrame:
    """Rows of each sheet by the names in its own first populated row (trimmed, the first of equal
    ones); types as in value_as. A sheet without a wanted name is an error or, with skip_missing,
    has NULL there; a name that no sheet has is then left out.
    """
    named = headers(cells).withColumn("__name", F.trim("header")).where(F.col("__name").isin(*wanted))
    found = named.groupBy(*SHEET, "__name").agg(F.min("col").alias("col"))
    tops = bounds(cells).select(*SHEET, F.col("r0").alias("__top"))
    if skip_missing:
        held = {r["__name"] for r in found.select("__name").distinct().collect()}
        wanted = {n: k for n, k in wanted.items() if n in held}
    else:
        told = found.groupBy(*SHEET).agg(F.collect_set("__name").alias("__names"))
        lacking = F.array_except(F.array(*map(F.lit, wanted)), F.coalesce("__names", F.array().cast("array<string>")))
        first_ = tops.join(told, SHEET, "left").select(lacking.alias("lacking")).where(F.size("lacking") > 0).first()
        if first_:
            raise ValueError(f"missing range header: {first_['lacking'][0]}")
    body = cells.join(found, [*SHEET, "col"]).join(tops, SHEET).where(F.col("row") > F.col("__top"))
    whole = F.struct("kind", "num", "str", "bool", "err", "display")
    mine = lambda n: F.col("__name") == n
    picked = body.groupBy(*SHEET, "row").agg(F.first("__top"), *[F.max_by(F.when(mine(n), whole), F.when(mine(n), 1)).alias(f"__{i}") for i, n in enumerate(wanted)])
    return picked.select(*SHEET, "row", *[value_as(k, F.col(f"__{i}")).alias(n) for i, (n, k) in enumerate(wanted.items())])


def a1(row: Column, col: Column) -> Column:
    """The A1 label of a place."""
    letter = lambda n: F.chr((F.pmod(n, F.lit(26)) + 65).cast("int"))
    third, second = F.floor((col - 702) / 676), F.floor((col - 26) / 26)
    letters = F.when(col < 26, letter(col)).when(col < 702, F.concat(letter(second), letter(col))).otherwise(F.concat(letter(third), letter(second), letter(col)))
    return F.concat(letters, (row + 1).cast("string"))


def from_a1(label: Column) -> tuple[Column, Column]:
    """(row, column) of an A1 label, NULL where it is none or out of the grid."""
    plain = F.upper(F.regexp_extract(label, r"^\$?([A-Za-z]{1,3})\$?([0-9]{1,7})$", 1))
    col = F.aggregate(F.split(plain, ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64)) - 1
    row = F.regexp_extract(label, r"^\$?([A-Za-z]{1,3})\$?([0-9]{1,7})$", 2).try_cast("int") - 1
    ok = (plain != "") & row.between(0, 1_048_575) & (col < 16_384)
    return F.when(ok, row), F.when(ok, col)


def covering(cells: DataFrame, ranges: DataFrame, block: int = 64) -> DataFrame:
    """Pairs of cells and the rectangles (r0, c0, r1, c1) of their sheet that cover them.

    Rectangles are cut into blocks of rows, so the range condition rides on an
    equi-join and neither side is multiplied by the other.
    """
    cut = ranges.withColumn("__block", F.explode(F.sequence(F.floor(F.col("r0") / block), F.floor(F.col("r1") / block))))
    keyed = cells.withColumn("__block", F.floor(F.col("row") / block))
    joined = keyed.join(cut, [*SHEET, "__block"])
    return joined.where(F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))).drop("__block")


def resolve_names(names: DataFrame, uses: DataFrame) -> DataFrame:
    """refers_to of each use (workbook_id, sheet, name): a sheet's own name goes before a global one."""
    n = names.select("workbook_id", V.ascii_upper(F.col("scope_sheet")).alias("scope"), V.ascii_upper(F.col("name")).alias("key"), "refers_to")
    own = n.where("scope IS NOT NULL").withColumnRenamed("refers_to", "own")
    shared = n.where("scope IS NULL").drop("scope").withColumnRenamed("refers_to", "shared")
    keyed = uses.withColumns({"scope": V.ascii_upper(F.col("sheet")), "key": V.ascii_upper(F.col("name"))})
    joined = keyed.join(own, ["workbook_id", "scope", "key"], "left").join(shared, ["workbook_id", "key"], "left")
    return joined.withColumn("refers_to", F.coalesce("own", "shared")).drop("scope", "key", "own", "shared")


def upsert(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """Cells with edits (same columns) written over them."""
    return cells.join(edits.select(*PLACE), PLACE, "left_anti").unionByName(edits, allowMissingColumns=True)


def clear(cells: DataFrame, r0: int, c0: int, r1: int, c1: int) -> DataFrame:
    if (r1 - r0 + 1) * (c1 - c0 + 1) > 10_000:
        raise ValueError("a range of at most 10,000 cells can be cleared")
    return cells.where(~(F.col("row").between(r0, r1) & F.col("col").between(c0, c1)))


def next_row(cells: DataFrame) -> DataFrame:
    """Where a row would be appended to each sheet."""
    return cells.groupBy(*SHEET).agg((F.max("row") + 1).alias("next_row"))
