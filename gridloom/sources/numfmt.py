"""Number formats while a file is read: the classes of functions/dates.py, for one code or value."""

from __future__ import annotations

import datetime as dt
import math
import re
from functools import lru_cache

from gridloom.functions.dates import DATE_IDS, DATETIME_IDS, PERCENT_IDS, TIME_IDS
from gridloom.plans.grid import number_text

_BUILT_IN = {i: name for ids, name in ((DATE_IDS, "Date"), (TIME_IDS, "Time"), (DATETIME_IDS, "DateTime"), (PERCENT_IDS, "Percent")) for i in ids}


@lru_cache(maxsize=4096)
def class_of(ident: int, code: str | None) -> str:
    if code is None:
        return _BUILT_IN.get(ident, "Plain")
    bare = re.sub(r'"[^"]*"?|[\\_*].', "", code.lower())
    section = re.sub(r"\[[^\]]*\]?", "", re.sub(r"\[[hms]+\]?", "\x01", bare)).split(";")[0]
    if "%" in section:
        return "Percent"
    if "\x01" in section:
        return "ElapsedTime"
    body = re.sub("am/pm|a/p", "", section)
    time = bool(re.search("[hs]", body))
    day = bool(re.search("[yd]", body)) or body.count("m") >= 3 or ("m" in body and not time)
    return "DateTime" if day and time else "Date" if day else "Time" if time else "Plain"


def is_date(kind: str) -> bool:
    return kind in ("Date", "DateTime", "Time", "ElapsedTime")


def moment(x: float, date1904: bool) -> dt.datetime | None:
    low, high = (-695_055, 2_957_004) if date1904 else (-693_593, 2_958_466)
    if not math.isfinite(x) or not low <= x < high:
        return None
    base = dt.datetime(1904, 1, 1) if date1904 else dt.datetime(1899, 12, 31) if 0 <= x < 60 else dt.datetime(1899, 12, 30)
    try:
        return base + dt.timedelta(milliseconds=math.floor(x * 86_400_000 + 0.5))
    except OverflowError:
        return None


def render(x: float, kind: str, date1904: bool = False) -> str:
    if kind == "Percent":
        return number_text(x * 100) + "%"
    if kind == "ElapsedTime" and math.isfinite(x) and x >= 0:
        s = math.floor(x * 86400 + 0.5)
        return f"{s // 3600}:{s // 60 % 60:02}:{s % 60:02}"
    if kind in ("Date", "DateTime") and x == 0 and not date1904:
        return "00:00:00"
    at = moment(x, date1904) if kind in ("Date", "Time", "DateTime") else None
    if at is None:
        return number_text(x)
    parts = {"Date": (at.date(),), "Time": (at.time(),), "DateTime": (at.date(), at.time())}[kind]
    return " ".join(p.isoformat() if isinstance(p, dt.date) else p.strftime("%H:%M:%S") for p in parts)


def serial_of(text: str) -> float | None:
    """The 1900 serial of an ISO date, time or both."""
    m = re.fullmatch(r"(?:(\d{4})-(\d\d)-(\d\d))?(?:T?(\d\d):(\d\d)(?::(\d\d(?:\.\d+)?))?Z?)?", text.strip())
    if not m or not text.strip():
        return None
    clock = (int(m[4] or 0) * 3600 + int(m[5] or 0) * 60 + float(m[6] or 0)) / 86400
    if not m[1]:
        return clock
    try:
        days = (dt.date(int(m[1]), int(m[2]), int(m[3])) - dt.date(1899, 12, 30)).days
    except ValueError:
        return None
    return (days if days >= 61 else days - 1) + clock
