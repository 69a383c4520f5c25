"""Spreadsheet values as Columns.

A Value holds a kind and one Column a kind. Where the kind is known while the
plan is made, the Columns are plain typed expressions that Catalyst folds and
compiles; a struct is only built where a kind depends on the row. Errors are
data: err is the error literal or NULL, and never a Spark exception.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that is a number: no type suffix, no underscores.
NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity|nan)$"
#: Above this a double has no fraction, and floor() of it may not fit a long.
WHOLE = float(1 << 53)

_NONE = {"number": "double", "text": "string", "bool": "boolean", "error": "string"}


def null(kind: str) -> Column:
    return F.lit(None).cast(_NONE[kind])


@dataclass
class Value:
    """kind: number, text, bool, blank or error, or a Column that says which.

    err may be set beside a known kind; the value is then that error. A known
    kind's own Column is NULL where the value is blank.
    """

    kind: str | Column
    num: Column | None = None
    text: Column | None = None
    bool: Column | None = None
    err: Column | None = None

    def part(self, kind: str) -> Column:
        own = {"number": self.num, "text": self.text, "bool": self.bool, "error": self.err}[kind]
        return null(kind) if own is None else own

    def known(self, kind: str) -> bool:
        return isinstance(self.kind, str) and self.kind == kind

    def kinds(self) -> Column:
        """The kind as a Column, errors and blanks considered."""
        if not isinstance(self.kind, str):
            return self.kind
        if self.kind in ("blank", "error"):
            return F.lit(self.kind)
        kind = F.when(self.part(self.kind).isNull(), "blank").otherwise(self.kind)
        return kind if self.err is None else F.when(self.err.isNotNull(), "error").otherwise(kind)

    def is_kind(self, kind: str) -> Column:
        if isinstance(self.kind, str) and kind not in (self.kind, "blank", "error"):
            return F.lit(False)
        if isinstance(self.kind, str) and kind == "error" and self.err is None:
            return F.lit(False)
        return self.kinds() == kind

    def struct(self) -> Column:
        kind = self.kinds()
        fields = {"kind": kind, "num": self.part("number"), "str": self.part("text"), "bool": self.part("bool"), "err": self.part("error")}
        of = {"num": "number", "str": "text", "bool": "bool", "err": "error"}
        return F.struct(*[(c if n == "kind" else F.when(kind == of[n], c)).alias(n) for n, c in fields.items()])

    def display(self) -> Column:
        """What a cell with this value shows."""
        return F.coalesce(self.part("error"), text_of(self))


def number(c: Column, err: Column | None = None) -> Value:
    return Value("number", num=c, err=err)


def text(c: Column, err: Column | None = None) -> Value:
    return Value("text", text=c, err=err)


def boolean(c: Column, err: Column | None = None) -> Value:
    return Value("bool", bool=c, err=err)


def error(literal: str) -> Value:
    return Value("error", err=F.lit(literal))


def from_struct(s: Column) -> Value:
    return Value(s["kind"], s["num"], s["str"], s["bool"], s["err"])


def from_column(c: Column, kind: T.DataType) -> Value:
    """A typed column as values: NULL is blank, dates are serial numbers."""
    from gridloom.functions.dates import serial

    if isinstance(kind, T.StructType) and kind.fieldNames() == ["kind", "num", "str", "bool", "err"]:
        return from_struct(c)
    if isinstance(kind, T.BooleanType):
        return boolean(c)
    if isinstance(kind, T.NumericType):
        return number(c.cast("double"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return number(serial(c))
    return text(c.cast("string"))


def first(*errors: Column | None) -> Column | None:
    """The first error there is, in argument order."""
    some = [e for e in errors if e is not None]
    return None if not some else some[0] if len(some) == 1 else F.coalesce(*some)


def guarded(value: Column, err: Column | None) -> Column:
    """NULL where there is an error."""
    return value if err is None else F.when(err.isNull(), value)


def let(x: Column, f: Callable[[Column], Column], longest: int = 160) -> Column:
    """f(x), with x computed once if its expression is long: f may name it many times,
    and nested expressions would otherwise grow as a power of their depth."""
    return f(x) if len(str(x)) <= longest else F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))


def whole_part(x: Column) -> Column:
    """floor(x) as a double, also where it would not fit a long."""
    return let(x, lambda x: F.when(F.abs(x) >= WHOLE, x).otherwise(F.floor(x).cast("double")))


def ceiling(x: Column) -> Column:
    return -whole_part(-x)


def truncated(x: Column) -> Column:
    return let(x, lambda x: F.when(x < 0, ceiling(x)).otherwise(whole_part(x)))


def parsed(t: Column) -> Column:
    """The number that a text is, or NULL; no trimming."""
    return let(t, lambda t: F.when(t.rlike(NUMERIC), F.regexp_replace(F.lower(t), "inf$", "infinity").try_cast("double")))


def finite(x: Column) -> Column:
    return let(x, lambda x: ~(F.isnan(x) | (F.abs(x) == float("inf"))))


def format_number(x: Column) -> Column:
    """Shortest text of a double: whole numbers without a point, exponents as e-05 and e+20."""
    return let(x, lambda x: let(x.cast("string"), lambda java: _formatted(x, java), 0), 40)


def _formatted(x: Column, java: Column) -> Column:
    plain = F.format_string("%.0f", x)
    exponent = F.substring_index(java, "E", -1).try_cast("int")
    digits = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$|[-.]", "")
    sign = F.when(x < 0, "-").otherwise("")

    def placed(e: Column) -> Column:
        # Java goes over to exponents below 1e-3 and from 1e7 on; the plain form holds from 1e-4 to 1e16.
        small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
        mantissa = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", "")
        scientific = F.concat(mantissa, F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
        shifted = F.concat(sign, F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substr(digits, e + 2))
        return F.when(e == -4, small).when((e >= 7) & (e < 16) & (F.length(digits) > e + 1), shifted).otherwise(scientific)

    fraction = F.when(java.contains("E"), let(exponent, placed, 0)).otherwise(F.regexp_replace(java, r"\.0$", ""))
    special = F.when(F.isnan(x), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.coalesce(special, F.when(x == 0, "0").when((F.abs(x) <= float(2**63)) & (x == whole_part(x)), plain).otherwise(fraction))


def number_of(v: Value) -> tuple[Column, Column | None]:
    """As a number: blank 0, booleans 1 and 0, text if it is one."""
    if v.known("number"):
        return F.coalesce(v.num, F.lit(0.0)), v.err
    if v.known("blank"):
        return F.lit(0.0), None
    if v.known("error"):
        return null("number"), v.err
    if v.known("bool"):
        return F.coalesce(v.bool.cast("double"), F.lit(0.0)), v.err
    if v.known("text"):
        n = F.when(v.text.isNull(), 0.0).otherwise(parsed(F.trim(v.text)))
        return n, first(v.err, F.when(n.isNull(), "#VALUE!"))
    kind = v.kinds()
    n = F.when(kind == "number", v.part("number")).when(kind == "bool", v.part("bool").cast("double")).when(kind == "blank", 0.0).when(kind == "text", parsed(F.trim(v.part("text"))))
    return n, F.when(kind == "error", v.part("error")).when(n.isNull(), "#VALUE!")


def text_of(v: Value) -> Column:
    """As text, NULL for an error."""
    of_bool = lambda b: F.when(b, "TRUE").otherwise("FALSE")
    if v.known("text"):
        return guarded(F.coalesce(v.text, F.lit("")), v.err)
    if v.known("number"):
        return guarded(F.coalesce(format_number(v.num), F.lit("")), v.err)
    if v.known("bool"):
        return guarded(F.when(v.bool.isNull(), "").otherwise(of_bool(v.bool)), v.err)
    if v.known("blank"):
        return F.lit("")
    if v.known("error"):
        return null("text")
    kind = v.kinds()
    return F.when(kind == "text", v.part("text")).when(kind == "number", format_number(v.part("number"))).when(kind == "bool", of_bool(v.part("bool"))).when(kind == "blank", "")


def bool_of(v: Value) -> tuple[Column, Column | None]:
    """As a boolean: numbers if not 0, text TRUE, FALSE, empty or a number."""

    def of_number(n: Column) -> tuple[Column, Column]:
        return n != 0, F.when(~finite(n), "#NUM!")

    def of_text(t: Column) -> tuple[Column, Column]:
        word = ascii_upper(F.trim(t))
        n = parsed(F.trim(t))
        value = F.when(word.isin("", "FALSE"), False).when(word == "TRUE", True).when(n.isNotNull() & finite(n), n != 0)
        return value, F.when(value.isNull() & n.isNotNull(), "#NUM!").when(value.isNull(), "#VALUE!")

    if v.known("bool"):
        return F.coalesce(v.bool, F.lit(False)), v.err
    if v.known("blank"):
        return F.lit(False), None
    if v.known("error"):
        return null("bool"), v.err
    if v.known("number"):
        value, err = of_number(F.coalesce(v.num, F.lit(0.0)))
        return value, first(v.err, err)
    if v.known("text"):
        value, err = of_text(F.coalesce(v.text, F.lit("")))
        return value, first(v.err, err)
    kind = v.kinds()
    (n, n_err), (t, t_err) = of_number(v.part("number")), of_text(v.part("text"))
    value = F.when(kind == "bool", v.part("bool")).when(kind == "number", n).when(kind == "text", t).when(kind == "blank", False)
    return value, F.when(kind == "error", v.part("error")).when(kind == "number", n_err).when(kind == "text", t_err)


def ascii_upper(t: Column) -> Column:
    """Upper case of a-z only: comparisons ignore the case of no other letter."""
    return F.translate(t, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def choose(condition: Column, err: Column | None, yes: Value, no: Value) -> Value:
    """yes where the condition holds, else no; err where that is set. Columns merge by kind."""
    if isinstance(yes.kind, str) and isinstance(no.kind, str) and yes.kind == no.kind and yes.kind not in ("blank", "error"):
        part = F.when(condition, yes.part(yes.kind)).otherwise(no.part(yes.kind))
        inner = None if yes.err is None and no.err is None else F.when(condition, yes.part("error")).otherwise(no.part("error"))
        out = Value(yes.kind, err=first(err, inner))
        setattr(out, {"number": "num", "text": "text", "bool": "bool"}[yes.kind], part)
        return out
    kind = F.when(condition, yes.kinds()).otherwise(no.kinds())
    parts = [F.when(condition, yes.part(k)).otherwise(no.part(k)) for k in ("number", "text", "bool", "error")]
    if err is not None:
        kind = F.when(err.isNotNull(), "error").otherwise(kind)
        parts[3] = F.coalesce(err, parts[3])
    return Value(kind, *parts)
