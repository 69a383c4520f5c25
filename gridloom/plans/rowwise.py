"""Formulas over the columns of a row, compiled to one Column each.

Names are columns of the DataFrame; references to cells have no meaning here.
The whole expression stays in the JVM, so Catalyst prunes columns, pushes
filters on it down and compiles it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.functions import values as V
from gridloom.functions.values import Value
from gridloom.plans import formula as A


class Unsupported(ValueError):
    """A formula that has no row-wise form; .reason is the fallback code."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


def literal(value) -> Value:
    if isinstance(value, A.Error):
        return V.error(str(value))
    if isinstance(value, bool):
        return V.boolean(F.lit(value))
    return V.number(F.lit(float(value))) if isinstance(value, (int, float)) else V.text(F.lit(value))


def compile_tree(tree, names: Mapping[str, Value]) -> Value:
    if isinstance(tree, A.Literal):
        return literal(tree.value)
    if isinstance(tree, A.Name):
        found = names.get(tree.name.upper())
        if found is None:
            raise Unsupported("unresolved_name")
        return found
    if isinstance(tree, A.Ref):
        raise Unsupported("unresolved_name")
    if isinstance(tree, A.Op):
        args = [compile_tree(x, names) for x in tree.args]
        if len(args) == 1:
            return {"+": lambda v: v, "-": scalar.negative, "%": scalar.percent}[tree.sign](args[0])
        if tree.sign == "&":
            return scalar.joined(*args)
        return (scalar.arithmetic if tree.sign in "+-*/^" else scalar.compare)(tree.sign, *args)
    low, high = A.FUNCTIONS[tree.name]
    args = [compile_tree(x, names) for x in tree.args]
    return scalar.REGISTRY[tree.name](*args) if low <= len(args) <= high else V.error("#VALUE!")


def compile_formula(text: str, df: DataFrame, **more: Value) -> Value:
    """The value of a formula over the columns of df (names ignore ASCII case) and of more."""
    tree = A.parse(text)
    if reason := A.first_fallback(tree):
        raise Unsupported(reason)
    names = {f.name.upper(): V.from_column(F.col(f"`{f.name}`"), f.dataType) for f in df.schema}
    return compile_tree(tree, names | {k.upper(): v for k, v in more.items()})


def result(value: Value) -> Column:
    """A plain Column where the kind is known and no error can occur, else the value struct."""
    if isinstance(value.kind, str) and value.kind not in ("blank", "error") and value.err is None:
        return value.part(value.kind)
    return value.struct()


def fallback(text: str) -> str | None:
    """Why a formula is not evaluated, from its text alone; None if it may be."""
    return A.first_fallback(A.parse(text))


def with_formula(df: DataFrame, name: str, text: str) -> DataFrame:
    return df.withColumn(name, result(compile_formula(text, df)))
