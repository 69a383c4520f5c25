"""Date serials, number-format classes and rendering, as Columns.

A serial is days since the epoch with the time as a fraction. In the 1900 system
serial 60 is a day that never was; it counts as 28 February 1900.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.values import finite, format_number

#: Ids of built-in number formats by class.
DATE_IDS = (*range(14, 18), *range(27, 32), *range(34, 37), *range(50, 59), *range(75, 79))
TIME_IDS = (*range(18, 22), 32, 33, 45, 46, 47, 79, 80)
DATETIME_IDS, PERCENT_IDS = (22, 81), (9, 10, 71, 72)
DAY_MS = 86_400_000


def serial(moment: Column, date1904: bool = False) -> Column:
    """The serial of a date or timestamp."""
    at = moment.cast("timestamp_ntz")
    days = F.datediff(at, F.lit("1970-01-01").cast("timestamp_ntz")).cast("double")
    clock = (F.hour(at) * 3600 + F.minute(at) * 60).cast("double") + F.extract(F.lit("SECOND"), at).cast("double")
    if date1904:
        return days + 24107.0 + clock / 86400.0
    whole = days + 25569.0
    return F.when(whole < 61, whole - 1).otherwise(whole) + clock / 86400.0


def moment(x: Column, date1904: bool = False) -> Column:
    """The timestamp (without zone) of a serial, to the millisecond; NULL if out of range."""
    ms = F.round(x * DAY_MS).cast("long")
    if date1904:
        base, low, high = F.lit(-24107), -695_055.0, 2_957_004.0
    else:
        base, low, high = F.when((x >= 0) & (x < 60), -25568).otherwise(-25569), -693_593.0, 2_958_466.0
    at = F.timestamp_millis(base.cast("long") * DAY_MS + ms)
    return F.when(finite(x) & (x >= low) & (x < high), F.to_timestamp_ntz(F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("yyyy-MM-dd HH:mm:ss.SSS")))


def far_day(x: Column, date1904: bool = False) -> Column:
    """yyyy-MM-dd of a serial after the year 9999, which moment() leaves out; NULL up to then."""
    low, base = (2_957_004.0, -24107) if date1904 else (2_958_466.0, -25569)
    days = F.when(finite(x) & (x >= low), F.floor(F.round(x * DAY_MS) / DAY_MS) + base).try_cast("int")
    day = F.date_from_unix_date(days)
    return F.concat(F.year(day).cast("string"), *[F.concat(F.lit("-"), F.lpad(f(day).cast("string"), 2, "0")) for f in (F.month, F.day)])


def elapsed(x: Column) -> Column:
    """[h]:mm:ss of a duration in days; the plain number if negative."""
    seconds = F.round(x * 86400).cast("long")
    parts = [F.floor(seconds / 3600).cast("string"), *[F.lpad(F.floor(F.pmod(F.floor(seconds / d), F.lit(60))).cast("string"), 2, "0") for d in (60, 1)]]
    return F.when((x < 0) | ~finite(x), format_number(x)).otherwise(F.concat_ws(":", *parts))


def class_of_id(ident: Column) -> Column:
    """Plain, Percent, Date, Time, ElapsedTime or DateTime of a built-in format id."""
    named = ((DATE_IDS, "Date"), (TIME_IDS, "Time"), (DATETIME_IDS, "DateTime"), (PERCENT_IDS, "Percent"))
    out = F.lit("Plain")
    for ids, name in named:
        out = F.when(ident.isin(*ids), name).otherwise(out)
    return out


def class_of_code(code: Column) -> Column:
    """The class of a format code, from its first section."""
    bare = F.regexp_replace(F.lower(code), r'"[^"]*"?|[\\_*].', "")
    # A bracket may hold a semicolon, so brackets of lapsed time are marked before the section is cut.
    marked = F.regexp_replace(F.regexp_replace(bare, r"\[[hms]+\]?", "\x01"), r"\[[^\]]*\]?", "")
    section = F.substring_index(marked, ";", 1)
    body = F.regexp_replace(section, "am/pm|a/p", "")
    time = body.rlike("[hs]")
    months = F.length(body) - F.length(F.translate(body, "m", ""))
    day = body.rlike("[yd]") | (months >= 3) | ((months >= 1) & ~time)
    return (
        F.when(section.contains("%"), "Percent")
        .when(section.contains("\x01"), "ElapsedTime")
        .when(day & time, "DateTime")
        .when(day, "Date")
        .when(time, "Time")
        .otherwise("Plain")
    )


def render(x: Column, kind: Column, date1904: bool = False, far: bool = False) -> Column:
    """What a number shows under a class of number format. Days after the year 9999 are plain
    numbers, as a workbook shows them; with far they are days of the calendar."""
    at = moment(x, date1904)
    made = (
        F.when(kind == "Percent", F.concat(format_number(x * 100), F.lit("%")))
        .when(kind == "ElapsedTime", elapsed(x))
        .when(kind.isin("Date", "DateTime") & (x == 0) & F.lit(not date1904), "00:00:00")
        .when(kind == "Date", F.coalesce(F.date_format(at, "yyyy-MM-dd"), far_day(x, date1904)) if far else F.date_format(at, "yyyy-MM-dd"))
        .when(kind == "Time", F.date_format(at, "HH:mm:ss"))
        .when(kind == "DateTime", F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
    )
    return F.coalesce(made, format_number(x))
