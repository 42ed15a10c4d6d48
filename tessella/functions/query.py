"""Conjunctive queries: AND of clauses, each an OR of conditions."""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.schema import EQUALITY, FLOAT, UINT, Attr, Schema

OPS = {"=": operator.eq, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@dataclass(frozen=True)
class Condition:
    """attr op value; attr is a name or a position."""

    attr: int | str
    op: str
    value: object

    def __str__(self) -> str:
        name = f"a{self.attr}" if isinstance(self.attr, int) else self.attr
        value = self.value.decode("utf-8", "backslashreplace") if isinstance(self.value, bytes) else self.value
        return f"{name}{self.op}'{value}'"


@dataclass(frozen=True)
class Query:
    """No clause at all selects every live row."""

    clauses: tuple[tuple[Condition, ...], ...] = ()

    @classmethod
    def of(cls, *clauses) -> Query:
        """Each argument is a clause: a condition, a tuple (attr, op, value), or a list of these."""
        one = lambda c: c if isinstance(c, Condition) else Condition(*c)
        return cls(tuple(tuple(map(one, c)) if isinstance(c, list) else (one(c),) for c in clauses))

    @classmethod
    def between(cls, attr: int | str, low: object, high: object) -> Query:
        return cls.of((attr, ">=", low), (attr, "<=", high))

    @classmethod
    def isin(cls, attr: int | str, values: list) -> Query:
        return cls.of([(attr, "=", v) for v in values])

    def __and__(self, other: Query) -> Query:
        return Query(self.clauses + other.clauses)

    def __str__(self) -> str:
        return " AND ".join("(" + " OR ".join(map(str, c)) + ")" for c in self.clauses)

    def validate(self, schema: Schema) -> Query:
        for clause in self.clauses:
            if not clause:
                raise ValueError("an empty clause")
            for c in clause:
                attr = schema.attr(c.attr)
                if c.op not in OPS:
                    raise ValueError(f"operator {c.op!r}")
                if attr.index == EQUALITY and c.op != "=":
                    raise ValueError(f"{attr.name} serves = only")
                attr.check_literal(c.value)
        return self

    def to_column(self, schema: Schema) -> Column:
        """The filter. Catalyst pushes it to the Parquet scan and generates code for it."""
        self.validate(schema)
        clauses = [reduce(operator.or_, [condition_column(schema.attr(c.attr), c) for c in clause]) for clause in self.clauses]
        return reduce(operator.and_, clauses) if clauses else F.lit(True)


def condition_column(attr: Attr, c: Condition) -> Column:
    value = c.value.encode() if isinstance(c.value, str) else c.value
    if attr.physical == FLOAT and math.isnan(value):
        return F.lit(False)
    if attr.physical == FLOAT:
        literal = F.lit(value).cast("double")
    elif attr.physical == UINT and attr.width == 8:
        literal = F.lit(str(value)).cast("decimal(38,0)" if value >= 1 << 64 else "decimal(20,0)")
    elif isinstance(value, int) and not -(1 << 63) <= value < 1 << 63:
        literal = F.lit(str(value)).cast("decimal(38,0)")
    else:
        literal = F.lit(value)
    out = OPS[c.op](F.col(attr.name), literal)
    # IEEE comparison: a stored NaN satisfies nothing. Spark holds it above all numbers, so only > and >= need an upper end, and
    # unlike isnan a comparison is pushed down to the files.
    return out & (F.col(attr.name) <= F.lit(math.inf)) if attr.physical == FLOAT and c.op in (">", ">=") else out


def matches(query: Query, schema: Schema, row: dict) -> bool:
    """Row evaluation in plain Python; null and NaN satisfy nothing."""
    def holds(c: Condition) -> bool:
        v, x = row[schema.attr(c.attr).name], c.value.encode() if isinstance(c.value, str) else c.value
        return v is not None and OPS[c.op](v, x)

    return all(any(holds(c) for c in clause) for clause in query.clauses)
