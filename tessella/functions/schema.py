"""Typed, named attributes of a keyed table."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import types as T

RANGE, EQUALITY = "range", "equality"
INT, UINT, FLOAT, BINARY, VARBINARY = "int", "uint", "float", "binary", "varbinary"
_WIDTHS = {INT: (1, 2, 4, 8), UINT: (1, 2, 4, 8), FLOAT: (4, 8)}
_SPARK = {
    (INT, 1): T.ByteType(), (INT, 2): T.ShortType(), (INT, 4): T.IntegerType(), (INT, 8): T.LongType(),
    (UINT, 1): T.ShortType(), (UINT, 2): T.IntegerType(), (UINT, 4): T.LongType(), (UINT, 8): T.DecimalType(20, 0),
    (FLOAT, 4): T.FloatType(), (FLOAT, 8): T.DoubleType(),
}


@dataclass(frozen=True)
class Attr:
    """An attribute: its name, which predicates it serves, its physical type, its width in bytes, whether it may be null.

    `range` attributes serve = < <= > >=, `equality` attributes serve = only. Width 0 means variable length.
    """

    name: str
    index: str = RANGE
    physical: str = INT
    width: int = 8
    nullable: bool = False

    def __post_init__(self) -> None:
        if self.index not in (RANGE, EQUALITY):
            raise ValueError(f"{self.name}: unknown index type {self.index!r}")
        allowed = _WIDTHS.get(self.physical)
        good = self.width in allowed if allowed else (self.width == 0 if self.physical == VARBINARY else self.physical == BINARY and self.width > 0)
        if not good:
            raise ValueError(f"{self.name}: width {self.width} is not allowed for {self.physical}")

    @property
    def is_bytes(self) -> bool:
        return self.physical in (BINARY, VARBINARY)

    @property
    def spark_type(self) -> T.DataType:
        return T.BinaryType() if self.is_bytes else _SPARK[self.physical, self.width]

    def limits(self) -> tuple[int, int] | None:
        """Smallest and largest integer that fits."""
        if self.physical == INT:
            return -(1 << (8 * self.width - 1)), (1 << (8 * self.width - 1)) - 1
        return (0, (1 << (8 * self.width)) - 1) if self.physical == UINT else None

    def check_literal(self, value: object) -> None:
        """A literal has exactly the attribute's type; widths of byte strings are free."""
        wanted = bytes if self.is_bytes else float if self.physical == FLOAT else int
        if isinstance(value, str) and wanted is bytes:
            return
        if isinstance(value, bool) or not isinstance(value, wanted):
            raise ValueError(f"{self.name}: literal {value!r} is not {wanted.__name__}")
        if self.physical == UINT and value < 0:
            raise ValueError(f"{self.name}: unsigned attribute, negative literal {value!r}")

    def check_value(self, value: object) -> object:
        """A value to be stored. Nulls in non-nullable attributes and integers that do not fit are refused, not altered."""
        if value is None:
            if not self.nullable:
                raise ValueError(f"{self.name} is not nullable")
            return None
        if self.is_bytes:
            value = value.encode() if isinstance(value, str) else bytes(value)
            if self.physical == BINARY and len(value) != self.width:
                raise ValueError(f"{self.name}: {len(value)} bytes, not {self.width}")
            return value
        self.check_literal(value)
        if (limits := self.limits()) and not limits[0] <= value <= limits[1]:
            raise ValueError(f"{self.name}: {value} does not fit {self.width} bytes")
        return value


@dataclass(frozen=True)
class Schema:
    """The attributes of a table; rho: a bin holds about this share of a segment's rows; segment_rows: larger ingests and
    compactions are dealt by key range into segments of about this many rows."""

    attrs: tuple[Attr, ...]
    rho: float = 0.001
    estimator: bool = False
    segment_rows: int = 4_000_000

    def __post_init__(self) -> None:
        object.__setattr__(self, "attrs", tuple(self.attrs))
        names = [a.name.lower() for a in self.attrs]
        if len(set(names)) != len(names) or {"pk", "payload", "_seq", "_op", "_age", "_segment", "_row"} & set(names):
            raise ValueError(f"attribute names clash: {names}")
        if not 0 < self.rho <= 1:
            raise ValueError(f"rho {self.rho}")
        if self.segment_rows < 1:
            raise ValueError(f"segment_rows {self.segment_rows}")

    def attr(self, ref: int | str) -> Attr:
        """By name or by position."""
        if isinstance(ref, int):
            if not 0 <= ref < len(self.attrs):
                raise ValueError(f"attribute {ref} of {len(self.attrs)}")
            return self.attrs[ref]
        for a in self.attrs:
            if a.name == ref:
                return a
        raise ValueError(f"no attribute {ref!r}")

    @property
    def rows(self) -> T.StructType:
        fields = [T.StructField("pk", T.BinaryType(), False)]
        fields += [T.StructField(a.name, a.spark_type, True) for a in self.attrs]
        return T.StructType([*fields, T.StructField("payload", T.BinaryType())])

    @property
    def versions(self) -> T.StructType:
        return T.StructType([*self.rows.fields, T.StructField("_seq", T.LongType(), False), T.StructField("_op", T.ByteType(), False)])

    @property
    def stored(self) -> T.StructType:
        """Versions as segments hold them: _age is 1 for a key's newest version in its segment."""
        return T.StructType([*self.versions.fields, T.StructField("_age", T.IntegerType(), False)])

    def to_json(self) -> dict:
        return {"attrs": [asdict(a) for a in self.attrs], "rho": self.rho, "estimator": self.estimator, "segment_rows": self.segment_rows}

    @classmethod
    def from_json(cls, d: dict) -> Schema:
        return cls(tuple(Attr(**a) for a in d["attrs"]), d["rho"], d["estimator"], d["segment_rows"])
