"""Metadata filters that compile to one Catalyst column.

Leaves test one key. A missing key makes every leaf false; a key that is present with a null
makes ``ne``, ``nin`` and ``not_contains`` true. Numbers equal numbers of any width, strings
strings, booleans booleans, nothing else equals anything. There is no negation of a subtree,
so SQL's null is as good as false under ``and_`` and ``or_``, and leaves over typed columns
stay bare comparisons that reach the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _kind(value) -> str | None:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else None


@dataclass(frozen=True)
class Filter:
    """``op`` with a key and a value, or with ``parts``."""

    op: str
    key: str = ""
    value: object = None
    parts: tuple[Filter, ...] = ()

    def column(self, df: DataFrame, variant: str | None = None) -> Column:
        """The predicate over the columns of ``df``, or over keys of its VARIANT column ``variant``."""
        if self.op == "and":
            return reduce(lambda a, b: a & b, (p.column(df, variant) for p in self.parts), F.lit(True))
        if self.op == "or":
            return reduce(lambda a, b: a | b, (p.column(df, variant) for p in self.parts), F.lit(False))
        source = _Variant(variant, self.key) if variant else _Typed(df, self.key)
        return source.leaf(self.op, self.value)

    def apply(self, df: DataFrame, variant: str | None = None) -> DataFrame:
        return df.where(self.column(df, variant))


def eq(key, value):
    return Filter("eq", key, value)


def ne(key, value):
    return Filter("ne", key, value)


def gt(key, value):
    return Filter("gt", key, value)


def gte(key, value):
    return Filter("gte", key, value)


def lt(key, value):
    return Filter("lt", key, value)


def lte(key, value):
    return Filter("lte", key, value)


def in_(key, *values):
    return Filter("in", key, values)


def nin(key, *values):
    return Filter("nin", key, values)


def contains(key, part: str):
    return Filter("contains", key, part)


def not_contains(key, part: str):
    return Filter("not_contains", key, part)


def and_(*parts: Filter):
    return Filter("and", parts=parts)


def or_(*parts: Filter):
    return Filter("or", parts=parts)


_ORDER = {"gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v}


class _Source:
    """What a leaf needs of a key: is it there, does it equal a value, its number, its string."""

    def leaf(self, op: str, value) -> Column:
        if op == "eq":
            return self.equals(value)
        if op == "in":
            return reduce(lambda a, b: a | b, map(self.equals, value), F.lit(False))
        if op in ("ne", "nin"):
            values = value if op == "nin" else (value,)
            return self.present() & ~F.coalesce(reduce(lambda a, b: a | b, map(self.equals, values), F.lit(False)), F.lit(False))
        if op in _ORDER:
            number = float(value)
            # nothing compares with a number that isn't one
            return F.lit(False) if number != number else self.ordered(_ORDER[op], number)
        if op == "contains":
            return self.holds(value)
        if op == "not_contains":
            return self.present() & ~F.coalesce(self.holds(value), F.lit(False))
        raise ValueError(f"unknown operator {op!r}")


class _Typed(_Source):
    """A column of a declared type; null and missing can't be told apart and count as missing."""

    def __init__(self, df: DataFrame, key: str):
        self.field = next((f for f in df.schema.fields if f.name == key), None)
        self.c = F.col(f"`{key}`") if self.field else F.lit(None)
        of = self.field.dataType if self.field else None
        self.kind = "number" if isinstance(of, _NUMBERS) else "string" if isinstance(of, T.StringType) else "boolean" if isinstance(of, T.BooleanType) else None
        self.float = isinstance(of, (T.FloatType, T.DoubleType))

    def present(self) -> Column:
        return self.c.isNotNull() if self.field else F.lit(False)

    def equals(self, value) -> Column:
        if _kind(value) is None or _kind(value) != self.kind or value != value:
            return F.lit(False)
        # a literal of the column's own kind is pushed to the scan
        return self.c == (F.lit(float(value)) if self.float else F.lit(value))

    def ordered(self, compare, number: float) -> Column:
        if self.kind != "number":
            return F.lit(False)
        # a whole number that a column's own type can hold is pushed to the scan; a larger one is compared as a double
        whole = number.is_integer() and not self.float
        found = compare(self.c.cast("double"), F.lit(number)) if whole and abs(number) >= 1 << 63 else compare(self.c, F.lit(int(number) if whole else number))
        return found & ~F.isnan(self.c) if self.float else found

    def holds(self, part: str) -> Column:
        return F.contains(self.c, F.lit(part)) if self.kind == "string" else F.lit(False)


class _Variant(_Source):
    """A key of a VARIANT column; values keep the types they have row by row."""

    def __init__(self, column: str, key: str):
        quoted = key.replace("\\", "\\\\").replace("'", "\\'")
        self.x = F.variant_get(F.col(column), f"$['{quoted}']", "variant")
        self.type = F.schema_of_variant(self.x)
        self.number = self.type.rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)")

    def present(self) -> Column:
        return self.x.isNotNull()

    def _as(self, kind: str) -> Column:
        return F.try_variant_get(self.x, "$", kind)

    def equals(self, value) -> Column:
        # the type is asked first: a cast would take '30' for 30
        kind = _kind(value)
        if kind == "number":
            return self.number & (self._as("double") == F.lit(float(value)))
        if kind == "boolean":
            return (self.type == "BOOLEAN") & (self._as("boolean") == F.lit(value))
        return (self.type == "STRING") & (self._as("string") == F.lit(value)) if kind else F.lit(False)

    def ordered(self, compare, number: float) -> Column:
        return self.number & compare(self._as("double"), F.lit(number))

    def holds(self, part: str) -> Column:
        return (self.type == "STRING") & F.contains(self._as("string"), F.lit(part))
