"""Cells as typed values, strictly: a value or the reason why there is none.

A cell is a struct with kind, num, str, bool, err and display, and a formula also
with cached; NULL is a missing cell. strict() gives struct<value, error>, so a
mismatch is data; required() raises on one instead. The date, time and duration
casts read numbers and dates as day serials of either epoch; each has a form
that gives NULL and one that keeps the display text of what does not convert.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import dates
from gridloom.functions import values as V

#: The ranges of whole-number types.
WIDTHS = {
    "i8": (-(1 << 7), (1 << 7) - 1), "i16": (-(1 << 15), (1 << 15) - 1), "i32": (-(1 << 31), (1 << 31) - 1), "i64": (-(1 << 63), (1 << 63) - 1),
    "u8": (0, (1 << 8) - 1), "u16": (0, (1 << 16) - 1), "u32": (0, (1 << 32) - 1), "u64": (0, (1 << 63) - 1),
}
#: The largest 32-bit float.
MOST_F32 = 3.4028234663852886e38
TIMES = ("date", "time", "datetime", "duration")


def effective(c: Column, formulas: bool = False) -> Column:
    """The cell itself or, of a formula (where cells have cached), its cached value."""
    if not formulas:
        return c
    same = F.struct(c["kind"].alias("kind"), c["num"].alias("num"), c["str"].alias("str"), c["bool"].alias("bool"), c["err"].alias("err"), c["display"].alias("display"))
    told = F.struct(*[c["cached"][n].alias(n) for n in ("kind", "num", "str", "bool", "err")], c["display"].alias("display"))
    return F.when(c["kind"] == "formula", told).when(c.isNotNull(), same)


def _whole(c: Column) -> Column:
    """A whole number of a number, a date or a text, NULL for others and for fractions. Numbers beyond
    64 bits are held at their ends."""
    n, ends = c["num"], float(1 << 63)
    inside = F.when(n >= ends, F.lit((1 << 63) - 1)).when(n <= -ends, F.lit(-(1 << 63))).otherwise(F.when(F.abs(n) < ends, n).cast("long"))
    of_number = F.when(V.finite(n) & (n == V.whole_part(n)), inside)
    of_text = F.when(c["str"].rlike(r"^[+-]?[0-9]+$"), c["str"].try_cast("long"))
    return F.when(c["kind"].isin("number", "date"), of_number).when(c["kind"] == "text", of_text)


def strict(kind: str, c: Column) -> Column:
    """struct<value, error>: error is empty cell, expected <kind>, or out of range, NULL with a value.

    Kinds: f64, f32, bool, str and the whole numbers of WIDTHS. Only whole numbers
    are whole (none is cut), booleans are no numbers, and str of a number, date or
    boolean is what it shows. u64 is held in 63 bits.
    """
    empty = c.isNull() | (c["kind"] == "blank")
    if kind in ("f64", "f32"):
        value = F.when(c["kind"].isin("number", "date"), c["num"]).when(c["kind"] == "text", V.parsed(c["str"]))
        beyond = ~V.finite(value) | (F.abs(value) > MOST_F32) if kind == "f32" else F.lit(False)
    elif kind in WIDTHS:
        value, (low, high) = _whole(c), WIDTHS[kind]
        beyond = ~value.between(F.lit(low), F.lit(high))
    elif kind == "bool":
        value, beyond = F.when(c["kind"] == "bool", c["bool"]), F.lit(False)
    elif kind == "str":
        value = F.when(c["kind"] == "text", c["str"]).when(c["kind"] == "error", c["err"]).when(c["kind"].isin("number", "date", "bool"), F.coalesce(c["display"], F.lit("")))
        beyond = F.lit(False)
    else:
        raise ValueError(f"no such type: {kind}")
    error = F.when(empty, "empty cell").when(value.isNull(), f"expected {kind}").when(beyond, "out of range")
    value = F.when(error.isNull(), value)
    return F.struct((value.cast("float") if kind == "f32" else value).alias("value"), error.alias("error"))


def required(kind: str, c: Column) -> Column:
    """The strict value; anything else fails the query."""
    return F.when(strict(kind, c)["error"].isNull(), strict(kind, c)["value"]).otherwise(F.raise_error(F.concat(F.lit("cell: "), strict(kind, c)["error"])))


def optional(kind: str, c: Column) -> Column:
    """The strict value and error, a missing cell being NULL without an error."""
    got = strict(kind, c)
    return F.struct(got["value"].alias("value"), F.when(got["error"] != "empty cell", got["error"]).alias("error"))


def moment_or_none(kind: str, c: Column, date1904: bool = False) -> Column:
    """A date, a time of day (HH:mm:ss), a datetime (timestamp without zone, whole seconds) or a
    duration (milliseconds) of a number or a date; NULL for all else."""
    serial = F.when(c["kind"].isin("number", "date"), c["num"])
    if kind == "duration":
        ms = F.when(serial < 0, -F.floor(-serial * dates.DAY_MS + 0.5)).otherwise(F.floor(serial * dates.DAY_MS + 0.5))
        return F.when(V.finite(serial) & (F.abs(serial) < float(1 << 62) / dates.DAY_MS), ms.cast("long"))
    form = "yyyy-MM-dd HH:mm:ss"
    at = F.to_timestamp_ntz(F.date_format(dates.moment(serial, date1904), form), F.lit(form))
    if kind == "datetime":
        return at
    if kind == "date":
        return at.cast("date")
    if kind == "time":
        return F.date_format(at, "HH:mm:ss")
    raise ValueError(f"no such type: {kind}")


def or_string(value: Column, c: Column) -> Column:
    """struct<value, text>: the value, or the display text of the cell ('' of a missing one)."""
    return F.struct(value.alias("value"), F.when(value.isNull(), F.coalesce(c["display"], F.lit(""))).alias("text"))


def moment_or_string(kind: str, c: Column, date1904: bool = False) -> Column:
    return or_string(moment_or_none(kind, c, date1904), c)
