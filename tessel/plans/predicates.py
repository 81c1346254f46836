"""Predicates on one property as Spark columns. A scalar counts as a list of one; an array matches if any element does."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import DATETIME
from .query import COMPARE, DATE_PARTS, LOGIC, QueryError


def timestamp_of(value: Any) -> Column:
    """A literal time: an ISO text, or an object of parts whose missing ones are their least."""
    if isinstance(value, (dt.datetime, dt.date)):
        return F.lit(value)
    if isinstance(value, str):
        if not re.match(DATETIME, value):
            raise QueryError(f"{value} is not a datetime")
        return F.lit(value).cast("timestamp")
    if isinstance(value, dict) and value and set(value) <= set(DATE_PARTS):
        p = {k[1:]: v for k, v in value.items()}
        micros = p.get("millisecond", 0) * 1000 + p.get("microsecond", 0) + p.get("nanosecond", 0) // 1000
        when = dt.datetime(p.get("year", 1), p.get("month", 1), p.get("day", 1), p.get("hour", 0), p.get("minute", 0), p.get("second", 0), micros, dt.timezone.utc)
        return F.lit(when.isoformat()).cast("timestamp")
    raise QueryError(f"{value} is not a datetime")


def is_parts(value: Any) -> bool:
    return isinstance(value, dict) and bool(value) and set(value) <= set(DATE_PARTS)


class Property:
    """One property of one record: its column, whether it is an array, and its logical type."""

    def __init__(self, column: Column, array: bool, kind: str | None, stored_as_time: bool):
        self.column, self.array, self.kind, self.stored_as_time = column, array, kind, stored_as_time

    def any(self, test: Callable[[Column], Column]) -> Column:
        return F.exists(self.column, test) if self.array else test(self.column)

    def all(self, test: Callable[[Column], Column]) -> Column:
        return F.forall(self.column, test) if self.array else test(self.column)

    def as_time(self, x: Column) -> Column:
        return x if self.stored_as_time else F.try_to_timestamp(x)

    def value(self, v: Any) -> tuple[Callable[[Column], Column], Column]:
        """How to read an element for equality, and the literal: texts of times stay texts unless stored as times."""
        if is_parts(v):
            return self.as_time, timestamp_of(v)
        if self.stored_as_time:
            return (lambda x: x), timestamp_of(v)
        return (lambda x: x), F.lit(v)

    def comparable(self, v: Any) -> bool:
        """Types are strict: a number never equals a text."""
        if is_parts(v) or self.kind is None:
            return True
        kind = "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"
        return kind == self.kind or (self.kind == "datetime" and kind == "string")

    def equal(self, v: Any) -> Column:
        if not self.comparable(v):
            return F.when(self.column.isNotNull(), F.lit(False))
        read, lit = self.value(v)
        return self.any(lambda x: read(x) == lit)

    def differs(self, v: Any) -> Column:
        if not self.comparable(v):
            return F.when(self.column.isNotNull(), F.lit(True))
        read, lit = self.value(v)
        return self.any(lambda x: read(x) != lit)

    def ordered(self, op: str, v: Any) -> Column:
        as_time = isinstance(v, (str, dict, dt.datetime, dt.date))
        if isinstance(v, bool) or not (as_time or isinstance(v, (int, float))):
            raise QueryError(f"{op} needs a number or a datetime")
        if as_time != (self.kind == "datetime"):
            if as_time:
                timestamp_of(v)
            return F.lit(None).cast("boolean")
        read, lit = (self.as_time, timestamp_of(v)) if as_time else ((lambda x: x), F.lit(v))
        return self.any({
            "$gt": lambda x: read(x) > lit, "$gte": lambda x: read(x) >= lit, "$lt": lambda x: read(x) < lit, "$lte": lambda x: read(x) <= lit,
        }[op])

    def among(self, values: list, negated: bool) -> Column:
        if not isinstance(values, list) or not values:
            raise QueryError("$in and $nin need a list that isn't empty")
        known = [v for v in values if v is not None]
        if len({"n" if isinstance(v, (int, float)) and not isinstance(v, bool) else type(v).__name__ for v in known}) > 1:
            raise QueryError("$in and $nin need values of one type")
        null = self.column.isNull() if len(known) < len(values) else None
        if not known:
            return ~null if negated else null
        same = [v for v in known if self.comparable(v)]
        if not same:
            out = F.when(self.column.isNotNull(), F.lit(negated))
        else:
            read = self.value(same[0])[0]
            lits = [self.value(v)[1] for v in same]
            out = self.all(lambda x: ~read(x).isin(*lits)) if negated else self.any(lambda x: read(x).isin(*lits))
        if null is None:
            return out
        return out & ~null if negated else out | null

    def text(self, op: str, v: str, pattern: bool) -> Column:
        if not isinstance(v, str):
            raise QueryError(f"{op} needs a text")
        if self.kind not in ("string", "datetime", None) or self.stored_as_time:
            return F.when(self.column.isNotNull(), F.lit(False))
        if op == "$contains":
            if pattern:
                return self.any(lambda x: x.rlike(f"(?i)^.*{v}.*$"))
            return self.any(lambda x: F.lower(x).contains(v.lower()))
        return self.any(lambda x: x.startswith(v) if op == "$startsWith" else x.endswith(v))

    def test(self, op: str, v: Any, pattern: bool) -> Column:
        if op == "$eq":
            return self.column.isNull() if v is None else self.equal(v)
        if op == "$ne":
            return self.column.isNotNull() if v is None else self.differs(v)
        if op in ("$gt", "$gte", "$lt", "$lte"):
            return self.ordered(op, v)
        if op in ("$in", "$nin"):
            return self.among(v, op == "$nin")
        if op in ("$contains", "$startsWith", "$endsWith"):
            return self.text(op, v, pattern)
        if op == "$exists":
            return self.column.isNotNull() if v else self.column.isNull()
        if op == "$type":
            if v == "null":
                return self.column.isNull()
            if v not in ("string", "number", "boolean", "datetime"):
                raise QueryError(f"unknown type {v}")
            return self.column.isNotNull() if v == self.kind else F.lit(False)
        raise QueryError(f"unknown operator {op}")


def combine(op: str, parts: list[Column]) -> Column:
    """$and, $or, $not (of all), $nor, and $xor as parity; nulls spread as in three-valued logic."""
    if not parts:
        return F.lit(op in ("$and", "$nor"))
    if op == "$and":
        return reduce(lambda a, b: a & b, parts)
    if op == "$or":
        return reduce(lambda a, b: a | b, parts)
    if op == "$not":
        return ~reduce(lambda a, b: a & b, parts)
    if op == "$nor":
        return ~reduce(lambda a, b: a | b, parts)
    return reduce(lambda a, b: a != b, parts)


def criteria(prop: Property, value: Any, pattern: bool = False) -> Column:
    """A property's criteria: a literal, null, or an object of operators that must all hold."""
    if value is None:
        return prop.column.isNull()
    if isinstance(value, list):
        raise QueryError("a list needs $in")
    if not isinstance(value, dict) or is_parts(value):
        return prop.equal(value)
    parts = []
    for op, v in value.items():
        if op in LOGIC:
            parts.append(combine(op, [criteria(prop, x, pattern) for x in (v if isinstance(v, list) else [v])]))
        elif op in COMPARE:
            parts.append(prop.test(op, v, pattern))
        else:
            raise QueryError(f"unknown operator {op}")
    return combine("$and", parts)
