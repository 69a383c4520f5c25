"""The evaluated functions and operators on Values (see values.py).

Each takes Values and gives a Value; errors pass on in argument order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import values as V
from gridloom.functions.values import Value, bool_of, first, guarded, number_of, text_of

REGISTRY: dict[str, Callable[..., Value]] = {}


def function(name: str):
    def register(f):
        REGISTRY[name] = f
        return f

    return register


def _errors(v: Value) -> Column:
    return v.part("error")


# Operators


def arithmetic(sign: str, a: Value, b: Value) -> Value:
    (x, x_err), (y, y_err) = number_of(a), number_of(b)
    if sign == "/":
        # The divisor counts first: 0 gives #DIV/0! whatever is divided.
        err = first(y_err, F.when(y == 0, "#DIV/0!"), x_err)
        return V.number(F.when(err.isNull(), x / F.when(y != 0, y)), err)
    if sign == "^":
        return _finite(F.pow(x, y), first(x_err, y_err))
    made = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[sign]()
    err = first(x_err, y_err)
    return V.number(guarded(made, err), err)


def _finite(x: Column, err: Column | None) -> Value:
    """x, or #NUM! where it is no finite number."""
    err = first(err, F.when(~V.finite(x), "#NUM!"))
    return V.number(F.when(err.isNull(), x), err)


def negative(v: Value) -> Value:
    x, err = number_of(v)
    return V.number(guarded(-x, err), err)


def percent(v: Value) -> Value:
    x, err = number_of(v)
    return V.number(guarded(x / 100.0, err), err)


def joined(*args: Value) -> Value:
    err = first(*[_errors(v) for v in args if not isinstance(v.kind, str) or v.err is not None])
    return V.text(guarded(F.concat(*[text_of(v) for v in args]), err), err)


def compare(sign: str, a: Value, b: Value) -> Value:
    """Numbers and blanks come before text, text before booleans; case counts for no ASCII letter."""
    err = first(*[_errors(v) for v in (a, b) if not isinstance(v.kind, str) or v.err is not None])
    test: dict[str, Callable[[Column, Column], Column]] = {
        "=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y,
        "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y,
    }
    at = test[sign]
    order = {"number": 0, "blank": 0, "text": 1, "bool": 2, "error": 3}

    def rank(v: Value) -> Column:
        if isinstance(v.kind, str):
            return F.lit(order[v.kind]) if v.kind in ("blank", "error") else F.when(v.part(v.kind).isNull(), 0).otherwise(order[v.kind])
        kind = v.kinds()
        return F.when(kind.isin("number", "blank"), 0).when(kind == "text", 1).when(kind == "bool", 2).otherwise(3)

    as_number = lambda v: F.coalesce(v.part("number"), F.lit(0.0))
    nan = F.isnan(as_number(a)) | F.isnan(as_number(b))
    if a.known("number") and b.known("number"):
        made = at(as_number(a), as_number(b))
    else:
        p, q = rank(a), rank(b)
        key = lambda v: V.ascii_upper(v.part("text"))
        made = F.when(p != q, at(p, q)).when(p == 0, at(as_number(a), as_number(b))).when(p == 1, at(key(a), key(b))).otherwise(at(a.part("bool").cast("int"), b.part("bool").cast("int")))
    if any(v.known("number") or not isinstance(v.kind, str) for v in (a, b)):
        err = first(err, F.when(nan, "#VALUE!"))
    return V.boolean(guarded(made, err), err)


# Logic


@function("IF")
def if_(condition: Value, yes: Value, no: Value | None = None) -> Value:
    test, err = bool_of(condition)
    return V.choose(test, err, yes, no or V.boolean(F.lit(False)))


@function("IFERROR")
def iferror(v: Value, instead: Value) -> Value:
    return V.choose(_errors(v).isNotNull() & v.is_kind("error"), None, instead, v)


@function("IFNA")
def ifna(v: Value, instead: Value) -> Value:
    return V.choose(_errors(v).eqNullSafe("#N/A") & v.is_kind("error"), None, instead, v)


@function("NOT")
def not_(v: Value) -> Value:
    b, err = bool_of(v)
    return V.boolean(guarded(~b, err), err)


@function("AND")
def and_(*args: Value) -> Value:
    return _all_of(args, lambda a, b: a & b)


@function("OR")
def or_(*args: Value) -> Value:
    return _all_of(args, lambda a, b: a | b)


def _all_of(args: tuple[Value, ...], both) -> Value:
    if not args:
        return V.error("#VALUE!")
    parts = [bool_of(v) for v in args]
    made = parts[0][0]
    for p, _ in parts[1:]:
        made = both(made, p)
    err = first(*[e for _, e in parts])
    return V.boolean(guarded(made, err), err)


@function("ISNA")
def isna(v: Value) -> Value:
    return V.boolean(v.is_kind("error") & _errors(v).eqNullSafe("#N/A"))


@function("ISERROR")
def iserror(v: Value) -> Value:
    return V.boolean(v.is_kind("error"))


@function("ISNUMBER")
def isnumber(v: Value) -> Value:
    """Text that is a number counts, without trimming."""
    return V.boolean(v.is_kind("number") | (v.is_kind("text") & V.parsed(v.part("text")).isNotNull()))


@function("ISTEXT")
def istext(v: Value) -> Value:
    return V.boolean(v.is_kind("text"))


@function("ISBLANK")
def isblank(v: Value) -> Value:
    """Empty text counts as blank."""
    return V.boolean(v.is_kind("blank") | (v.is_kind("text") & F.coalesce(v.part("text") == "", F.lit(False))))


@function("EXACT")
def exact(a: Value, b: Value) -> Value:
    err = first(_errors(a), _errors(b))
    return V.boolean(F.when(err.isNull(), text_of(a) == text_of(b)), err)


# Numbers


def _unary(v: Value, f: Callable[[Column], Column]) -> Value:
    x, err = number_of(v)
    return V.number(guarded(f(x), err), err)


@function("ABS")
def abs_(v: Value) -> Value:
    return _unary(v, F.abs)


@function("INT")
def int_(v: Value) -> Value:
    return _unary(v, V.whole_part)


@function("SIGN")
def sign(v: Value) -> Value:
    return _unary(v, lambda x: F.when(x > 0, 1.0).when(x < 0, -1.0).otherwise(0.0))


@function("SQRT")
def sqrt(v: Value) -> Value:
    x, err = number_of(v)
    err = first(err, F.when(x < 0, "#NUM!"))
    return V.number(F.when(err.isNull(), F.sqrt(x)), err)


@function("POWER")
def power(a: Value, b: Value) -> Value:
    return arithmetic("^", a, b)


@function("MOD")
def mod(a: Value, b: Value) -> Value:
    """The sign is the divisor's."""
    (n, n_err), (d, d_err) = number_of(a), number_of(b)
    err = first(n_err, d_err, F.when(d == 0, "#DIV/0!"))
    q = n / F.when(d != 0, d)
    return V.number(F.when(err.isNull(), n - d * V.whole_part(q)), err)


def _scale(digits: Column) -> Column:
    """10 to the digits, from exact literals: a reciprocal below 0."""

    def power(whole: Column) -> Column:
        return F.when(whole < 0, F.lit(1.0) / F.pow(F.lit(10.0), -whole)).otherwise(F.pow(F.lit(10.0), whole))

    return V.let(V.truncated(digits), power, 400)


def _half_away(p: Column) -> Column:
    """Nearest whole number, halves away from zero."""

    def nearest(p: Column) -> Column:
        size = F.abs(p)
        low = V.whole_part(size)
        return F.signum(p) * F.when(size >= V.WHOLE, size).when(size - low >= 0.5, low + 1).otherwise(low)

    return V.let(p, nearest)


def _rounded(v: Value, digits: Value | None, how: Callable[[Column], Column]) -> Value:
    (x, x_err), (d, d_err) = number_of(v), number_of(digits) if digits else (F.lit(0.0), None)
    scale = _scale(d)
    return _finite(how(x * scale) / scale, first(x_err, d_err, F.when(~V.finite(d), "#NUM!")))


@function("ROUND")
def round_(v: Value, digits: Value) -> Value:
    return _rounded(v, digits, _half_away)


@function("ROUNDUP")
def roundup(v: Value, digits: Value) -> Value:
    return _rounded(v, digits, lambda p: V.let(p, lambda p: F.when(p >= 0, V.ceiling(p)).otherwise(V.whole_part(p))))


@function("ROUNDDOWN")
def rounddown(v: Value, digits: Value) -> Value:
    return _rounded(v, digits, V.truncated)


@function("TRUNC")
def trunc(v: Value, digits: Value | None = None) -> Value:
    return _rounded(v, digits, V.truncated)


@function("VALUE")
def value(v: Value) -> Value:
    n = V.parsed(F.trim(text_of(v)))
    err = first(_errors(v), F.when(n.isNull(), "#VALUE!"))
    return V.number(F.when(err.isNull(), n), err)


# Text


def _texts(v: Value, f: Callable[[Column], Column]) -> Value:
    err = None if isinstance(v.kind, str) and v.err is None else _errors(v)
    return V.text(guarded(f(text_of(v)), err), err)


@function("LEN")
def len_(v: Value) -> Value:
    err = None if isinstance(v.kind, str) and v.err is None else _errors(v)
    return V.number(guarded(F.length(text_of(v)).cast("double"), err), err)


@function("TRIM")
def trim(v: Value) -> Value:
    """Spaces only: none at the ends, one between."""
    return _texts(v, lambda t: F.regexp_replace(F.trim(t), " +", " "))


@function("UPPER")
def upper(v: Value) -> Value:
    return _texts(v, F.upper)


@function("LOWER")
def lower(v: Value) -> Value:
    return _texts(v, F.lower)


def _count(v: Value | None) -> tuple[Column, Column | None]:
    if v is None:
        return F.lit(1), None
    n, err = number_of(v)
    err = first(err, F.when(~V.finite(n) | (n < 0), "#VALUE!"))
    return F.least(V.truncated(n), F.lit(float(2**31 - 1))).cast("int"), err


@function("LEFT")
def left(v: Value, count: Value | None = None) -> Value:
    n, n_err = _count(count)
    err = first(_errors(v), n_err)
    return V.text(F.when(err.isNull(), F.substr(text_of(v), F.lit(1), n)), err)


@function("RIGHT")
def right(v: Value, count: Value | None = None) -> Value:
    n, n_err = _count(count)
    err = first(_errors(v), n_err)
    t = text_of(v)
    return V.text(F.when(err.isNull(), F.substr(t, F.greatest(F.lit(0), F.length(t) - n) + 1)), err)


@function("MID")
def mid(v: Value, start: Value, count: Value) -> Value:
    (s, s_err), (n, n_err) = number_of(start), number_of(count)
    bad = ~V.finite(s) | ~V.finite(n) | (s <= 0) | (n < 0)
    err = first(_errors(v), s_err, n_err, F.when(bad, "#VALUE!"))
    top = float(2**31 - 1)
    at, size = F.least(V.truncated(s), F.lit(top)).cast("int"), F.least(V.truncated(n), F.lit(top)).cast("int")
    return V.text(F.when(err.isNull(), F.when(s < 1, "").otherwise(F.substr(text_of(v), at, size))), err)


@function("CONCATENATE")
def concatenate(*args: Value) -> Value:
    return joined(*args)


# Aggregates over one row's arguments; over columns see plans/aggregate.py.


def _numbers(args: tuple[Value, ...]) -> tuple[list[Column], Column | None]:
    """Numbers of direct arguments: booleans count, text if it is a number, blanks do not."""
    out = []
    for v in args:
        kind = v.kinds()
        made = F.when(kind == "number", v.part("number")).when(kind == "bool", v.part("bool").cast("double")).when(kind == "text", V.parsed(F.trim(v.part("text"))))
        out.append(made)
    return out, first(*[F.when(v.is_kind("error"), _errors(v)) for v in args if not isinstance(v.kind, str) or v.err is not None])


def _folded(args: tuple[Value, ...], fold: Callable[[Column], Column], average: bool = False) -> Value:
    parts, err = _numbers(args)
    array = F.array_compact(F.array(*parts)) if parts else F.array().cast("array<double>")
    none = F.size(array) == 0
    if average:
        err = first(err, F.when(none, "#DIV/0!"))
        return V.number(guarded(F.when(~none, fold(array)), err), err)
    return V.number(guarded(F.when(none, 0.0).otherwise(fold(array)), err), err)


def _reduce(array: Column, zero: float, f) -> Column:
    return F.aggregate(array, F.lit(zero), f)


@function("SUM")
def sum_(*args: Value) -> Value:
    return _folded(args, lambda a: _reduce(a, 0.0, lambda x, y: x + y))


@function("PRODUCT")
def product(*args: Value) -> Value:
    return _folded(args, lambda a: _reduce(a, 1.0, lambda x, y: x * y))


@function("MIN")
def min_(*args: Value) -> Value:
    return _folded(args, lambda a: F.coalesce(F.array_min(F.filter(a, lambda x: ~F.isnan(x))), F.lit(float("inf"))))


@function("MAX")
def max_(*args: Value) -> Value:
    return _folded(args, lambda a: F.coalesce(F.array_max(F.filter(a, lambda x: ~F.isnan(x))), F.lit(float("-inf"))))


@function("AVERAGE")
def average(*args: Value) -> Value:
    return _folded(args, lambda a: _reduce(a, 0.0, lambda x, y: x + y) / F.size(a), average=True)


@function("COUNT")
def count(*args: Value) -> Value:
    """Errors are passed over; text is not trimmed."""
    total = F.lit(0.0)
    for v in args:
        hit = v.is_kind("number") | v.is_kind("bool") | (v.is_kind("text") & V.parsed(v.part("text")).isNotNull())
        total = total + hit.cast("double")
    return V.number(total)


@function("COUNTA")
def counta(*args: Value) -> Value:
    total = F.lit(0.0)
    for v in args:
        total = total + (~v.is_kind("blank")).cast("double")
    return V.number(total)
