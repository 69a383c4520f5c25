"""Formula aggregates over a column of values, as grouped aggregates.

In a range only numbers count; text, booleans and blanks do not (COUNTA counts
all but blanks). An error passes on, the first by the given order, but for COUNT
and COUNTA. All are partial aggregates, so groups of any size spread.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import values as V
from gridloom.functions.values import Value


def _error(v: Value, order: Column | None) -> Column:
    err = F.when(v.is_kind("error"), v.part("error"))
    return F.first(err, ignorenulls=True) if order is None else F.min_by(err, F.when(err.isNotNull(), order))


def over(name: str, v: Value, order: Column | None = None) -> Value:
    """The aggregate of a range; order names each value's place, for the first error."""
    number = F.when(v.is_kind("number"), v.part("number"))
    real = F.when(~F.isnan(number), number)
    may_fail = not isinstance(v.kind, str) or v.err is not None
    err = _error(v, order) if may_fail else None
    if name == "COUNT":
        return V.number(F.count(number).cast("double"))
    if name == "COUNTA":
        return V.number(F.count_if(~v.is_kind("blank")).cast("double"))
    if name in ("AND", "OR"):
        b = F.when(v.is_kind("bool"), v.part("bool")).when(v.is_kind("number"), v.part("number") != 0)
        bad = F.max(F.when(v.is_kind("number") & ~V.finite(v.part("number")), "#NUM!"))
        made = F.bool_and(b) if name == "AND" else F.bool_or(b)
        err = V.first(err, bad, F.when(made.isNull(), "#VALUE!"))
        return V.boolean(F.when(err.isNull(), made), err)
    if name == "AVERAGE":
        err = V.first(err, F.when(F.count(number) == 0, "#DIV/0!"))
        return V.number(F.when(err.isNull(), F.avg(number)), err)
    made = {"SUM": F.sum(number), "MIN": F.min(real), "MAX": F.max(real), "PRODUCT": F.product(number)}[name]
    made = F.coalesce(made, F.lit(0.0))
    return V.number(V.guarded(made, err), err)
