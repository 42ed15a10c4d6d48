"""Indexes of segments: their bins, what they hold, and which of them a condition can match.

The index of all segments that one job writes is a Parquet table beside them, of three kinds of rows: `bins` (an attribute's bins
with their boundaries as order keys), `values` (the dictionaries of equality attributes) and `summary` (one row for each
segment and attribute). The driver holds the summaries only: bounds, counts, and dictionaries of at most KEYS values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.intervals import Encoded, EncodedQuery, from_order_key
from tessella.functions.schema import FLOAT, RANGE, UINT, Attr, Schema
from tessella.operators.binning import EqualityBins, RangeCuts, bin_budget, equality_bins
from tessella.runtime import ship_package

SIDECAR = "segment string, attr string, bin int, low binary, high binary, last boolean, text string, n long, distinct long, keys array<binary>, kind string"
_KINDS = (pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.string())
SIDE_TYPES = pa.schema([(c.split()[0], kind) for c, kind in zip(SIDECAR.split(", "), _KINDS, strict=True)])
#: Largest dictionary that a summary holds.
KEYS = 256
#: Values that a task of the planning sorts, or those of one attribute of a segment if they are more.
TASK_VALUES = 250_000


@dataclass(frozen=True)
class AttrSummary:
    """What the driver knows of an attribute in a segment."""

    rows: int = 0
    distinct: int = 0
    bins: int = 1
    least: bytes = b""
    most: bytes = b""
    keys: tuple[bytes, ...] | None = None

    def possible(self, e: Encoded) -> bool:
        if not self.rows:
            return False
        if e.interval is not None:
            return e.interval.meets(self.least, self.most)
        return e.key in self.keys if self.keys is not None else self.least <= e.key <= self.most

    def to_json(self) -> list:
        return [self.rows, self.distinct, self.bins, self.least.hex(), self.most.hex(), None if self.keys is None else [k.hex() for k in self.keys]]

    @classmethod
    def from_json(cls, d: list) -> AttrSummary:
        return cls(d[0], d[1], d[2], bytes.fromhex(d[3]), bytes.fromhex(d[4]), None if d[5] is None else tuple(map(bytes.fromhex, d[5])))


def can_match(summaries: dict[str, AttrSummary], query: EncodedQuery) -> bool:
    """Whether a segment can hold a match: no clause may be impossible in all its members."""
    return not query.unsat and all(any(summaries[e.attr].possible(e) for e in clause) for clause in query.clauses)


def value_text(attr: Attr) -> Column:
    """A value as text, the same for equal values: dictionaries are joined on it."""
    if attr.is_bytes:
        return F.hex(attr.name)
    return (F.col(attr.name).cast("double") + F.lit(0.0) if attr.physical == FLOAT else F.col(attr.name)).cast("string")  # both zeros are one


def order_keys(attr: Attr, values: pa.RecordBatch) -> pa.Array:
    """The order keys of values in the columns of `_placed`."""
    if attr.is_bytes:
        return values.column("bin")
    if attr.physical == FLOAT:
        bits = values.column("dbl").to_numpy(zero_copy_only=False).view(np.uint64)
        bits = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))
    else:
        bits = values.column("big").to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(1 << 63)
    ends = np.arange(len(bits) + 1, dtype=np.int32) * 8
    return pa.Array.from_buffers(pa.binary(), len(bits), [None, pa.py_buffer(ends), pa.py_buffer(bits.astype(">u8").tobytes())])


def _placed(attr: Attr) -> list[Column]:
    """A value in the one of three columns whose order is the attribute's; equal values are one, unsigned integers lie 1 << 63 lower."""
    value = F.col(attr.name)
    if attr.is_bytes:
        place = {"bin": value}
    elif attr.physical == FLOAT:
        place = {"dbl": value.cast("double") + F.lit(0.0)}  # both zeros are one
    else:
        place = {"big": (value.cast("decimal(20,0)") - F.lit(Decimal(1 << 63)) if attr.physical == UINT else value).cast("long")}
    return [place.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in (("dbl", "double"), ("big", "long"), ("bin", "binary"))]


def _text(attr: Attr) -> Column:
    """value_text of a value in the columns of `_placed`."""
    if attr.is_bytes:
        return F.hex("bin")
    big = F.col("big").cast("decimal(20,0)") + F.lit(Decimal(1 << 63)) if attr.physical == UINT else F.col("big")
    return (F.col("dbl") if attr.physical == FLOAT else big).cast("string")


@dataclass(frozen=True)
class Part:
    """An attribute of a segment: its bins, its rows and how many distinct values they have."""

    segment: str
    pos: int
    bins: int
    rows: int
    distinct: int


class _Plan:
    """The index rows of a part, whose values come in batches: by value for a range, by falling count for an equality attribute."""

    def __init__(self, part: Part, attr: Attr):
        self.part, self.attr = part, attr
        self.ranges = RangeCuts(part.distinct, part.rows, part.bins) if attr.index == RANGE else None
        self.of = None if self.ranges else EqualityBins(part.bins)
        self.keys: list[bytes] = []
        self.least = self.most = None

    def add(self, values: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, counts = order_keys(self.attr, values), values.column("n")
        if self.ranges:
            self.least = keys[0].as_py() if self.least is None else self.least
            self.most = keys[-1].as_py()
            self.ranges.add(lambda i: keys[i].as_py(), counts.to_numpy())
            return
        ends = pc.min_max(keys)
        least, most = ends["min"].as_py(), ends["max"].as_py()
        self.least = least if self.least is None else min(self.least, least)
        self.most = most if self.most is None else max(self.most, most)
        if self.part.distinct <= KEYS:
            self.keys += keys.to_pylist()
        yield self._rows("values", len(keys), bin=self.of.add(counts.to_pylist()), low=keys, text=values.column("text"), n=counts)

    def done(self) -> Iterator[pa.RecordBatch]:
        bins = list(range(self.part.bins))
        if self.ranges:
            cuts, sizes = self.ranges.done()
            yield self._rows("bins", len(bins), bin=bins, low=cuts[:-1], high=cuts[1:], last=[b == bins[-1] for b in bins], n=sizes)
        else:
            yield self._rows("bins", len(bins), bin=bins, n=self.of.sizes())
        keys = sorted(self.keys) if self.keys else None
        yield self._rows("summary", 1, bin=[len(bins)], low=[self.least], high=[self.most], n=[self.part.rows], distinct=[self.part.distinct], keys=[keys])

    def _rows(self, kind: str, size: int, **columns) -> pa.RecordBatch:
        columns |= {"segment": [self.part.segment] * size, "attr": [self.attr.name] * size, "kind": [kind] * size}
        made = [columns.get(f.name, pa.nulls(size, f.type)) for f in SIDE_TYPES]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, SIDE_TYPES, strict=True)], schema=SIDE_TYPES)


def build(rows: DataFrame, schema: Schema, path: str) -> dict[str, dict[str, AttrSummary]]:
    """Writes the index of rows (versions with a column _segment) to path; returns the summaries by segment and attribute. The numbers of
    rows of all values stay beside it, at path-runs, for the caller to delete.

    All tasks count values; Spark sorts them, and a task that plans bins reads them in batches: its memory holds a batch and the
    bins of one attribute of one segment, however many values there are.
    """
    ship_package(rows.sparkSession)
    attrs = schema.attrs
    values = F.array(*[F.struct(F.lit(i).alias("pos"), *_placed(a)) for i, a in enumerate(attrs)])
    runs = rows.where("_op = 0").select(F.col("_segment").alias("segment"), F.explode(values).alias("v")).select("segment", "v.pos", "v.dbl", "v.big", "v.bin").where("coalesce(dbl, big) IS NOT NULL OR bin IS NOT NULL")
    runs.groupBy("segment", "pos", "dbl", "big", "bin").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}-runs")  # looked at twice
    runs = rows.sparkSession.read.schema("segment string, pos int, dbl double, big long, bin binary, n long").parquet(f"{path}-runs")
    parts = _parts(runs, schema)

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, plan = None, None
        for batch in batches:
            of = batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo < hi:
                    if at != of[lo]:
                        if plan:
                            yield from plan.done()
                        at, plan = of[lo], _Plan(parts[of[lo]], attrs[parts[of[lo]].pos])
                    yield from plan.add(batch.slice(lo, hi - lo))
        if plan:
            yield from plan.done()

    if parts:
        tasks = min(len(parts), math.ceil(sum(p.distinct for p in parts) / TASK_VALUES))
        task = equality_bins([(i, p.distinct) for i, p in enumerate(parts)], tasks)
        dealt = rows.sparkSession.createDataFrame([(p.segment, p.pos, i, task[i]) for i, p in enumerate(parts)], "segment string, pos int, part int, task int")
        equal = [i for i, a in enumerate(attrs) if a.index != RANGE]
        weight = F.when(F.col("pos").isin(equal), -F.col("n")).otherwise(0)
        text = reduce(lambda found, i: F.when(F.col("pos") == i, _text(attrs[i])).otherwise(found), equal, F.lit(None).cast("string"))
        runs = runs.join(F.broadcast(dealt), ["segment", "pos"]).select("part", "pos", "task", weight.alias("weight"), "dbl", "big", "bin", "n")  # a row for each part
        runs = runs.repartitionById(tasks, F.col("task")).sortWithinPartitions("part", "weight", "dbl", "big", "bin")
        runs.select("part", "dbl", "big", "bin", text.alias("text"), "n").mapInArrow(planned, SIDECAR).write.parquet(path)
    else:
        rows.sparkSession.createDataFrame([], SIDECAR).write.parquet(path)
    out: dict[str, dict[str, AttrSummary]] = {}
    for r in read(rows.sparkSession, [path]).where("kind = 'summary'").collect():  # a row for each segment and attribute
        keys = None if r.keys is None else tuple(map(bytes, r.keys))
        out.setdefault(r.segment, {})[r.attr] = AttrSummary(r.n, r.distinct, r.bin, bytes(r.low), bytes(r.high), keys)
    return out


def _parts(runs: DataFrame, schema: Schema) -> list[Part]:
    """From the numbers of distinct values alone, one for each segment and attribute with values."""
    found: dict[str, dict[int, Row]] = {}
    for r in runs.groupBy("segment", "pos").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("rows")).collect():
        found.setdefault(r.segment, {})[r.pos] = r
    parts = []
    for segment, by in sorted(found.items()):
        budget = bin_budget([by[i].distinct if i in by else 0 for i in range(len(schema.attrs))], schema.rho)
        parts += [Part(segment, i, budget[i], r.rows, r.distinct) for i, r in sorted(by.items())]
    return parts


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The index rows at the given places; it needs no schema of the table."""
    return spark.read.schema(SIDECAR).parquet(*paths) if paths else spark.createDataFrame([], SIDECAR)


def _literal(value: bytes) -> Column:
    return F.lit(bytearray(value))


def touched(index: DataFrame, conditions: list[Encoded]) -> DataFrame:
    """segment, j, first, last, low, high, closed: the bins that condition j can match. Range bins are [low, high), the segment's
    last one is closed; an equality condition touches the one bin that holds its value."""
    parts = []
    for j, e in enumerate(conditions):
        rows = index.where(F.col("attr") == e.attr)
        if e.interval is not None:
            i = e.interval
            reaches = F.col("high") > _literal(i.low)
            if not i.low_open:
                reaches = reaches | (F.col("last") & (F.col("high") == _literal(i.low)))
            begins = F.lit(True) if i.high is None else F.col("low") < _literal(i.high) if i.high_open else F.col("low") <= _literal(i.high)
            rows = rows.where((F.col("kind") == "bins") & reaches & begins)
        else:
            rows = rows.where((F.col("kind") == "values") & (F.col("low") == _literal(e.key)))
        parts.append(rows.select("segment", F.lit(j).alias("j"), "bin", "low", "high", "last"))
    return reduce(DataFrame.unionByName, parts).groupBy("segment", "j").agg(
        F.min("bin").alias("first"), F.max("bin").alias("last"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or("last").alias("closed")
    )


def typed(attr: Attr, key: bytes) -> object:
    """A value that a row of the attribute's Spark type can hold."""
    value = from_order_key(attr, key)
    return bytearray(value) if attr.is_bytes else Decimal(value) if attr.physical == "uint" and attr.width == 8 else value


def candidates(rows: DataFrame, index: DataFrame, query: EncodedQuery, schema: Schema) -> DataFrame:
    """Data versions (rows with a column _segment) whose bins the query can match: a superset of the matches.

    Ranges are widened to the edges of their bins in the row's segment; an equality condition takes all values of its bin.
    """
    conditions = [e for clause in query.clauses for e in clause]
    rows = rows.where("_op = 0")
    if not conditions:
        return rows
    names, spark = rows.columns, rows.sparkSession
    plan: dict[str, list] = {}
    for r in touched(index, conditions).collect():  # a row for each segment and condition
        plan.setdefault(r.segment, [None] * (3 * len(conditions)))
        attr = schema.attr(conditions[r.j].attr)
        is_range = conditions[r.j].interval is not None
        plan[r.segment][3 * r.j : 3 * r.j + 3] = [typed(attr, bytes(r.low)), typed(attr, bytes(r.high)), r.closed] if is_range else [r.first, None, None]
    fields = [T.StructField("_segment", T.StringType())]
    for j, e in enumerate(conditions):
        kind = schema.attr(e.attr).spark_type if e.interval is not None else T.IntegerType()
        if kind == T.FloatType():
            kind = T.DoubleType()
        fields += [T.StructField(f"_lo{j}", kind), T.StructField(f"_hi{j}", kind), T.StructField(f"_top{j}", T.BooleanType())]
    edges = spark.createDataFrame([(s, *v) for s, v in plan.items()], T.StructType(fields))
    rows = rows.join(F.broadcast(edges), "_segment")  # a row for each segment
    holds = {}
    for j, e in enumerate(conditions):
        attr = schema.attr(e.attr)
        lo, hi, top = F.col(f"_lo{j}"), F.col(f"_hi{j}"), F.col(f"_top{j}")
        if e.interval is not None:
            value = F.col(attr.name)
            holds[j] = (value >= lo) & ((value < hi) | (top & (value <= hi)))
        else:
            wanted = edges.select(F.col("_segment").alias(f"_s{j}"), lo.alias("_bin")).where("_bin IS NOT NULL")
            values = index.where((F.col("kind") == "values") & (F.col("attr") == attr.name)).join(F.broadcast(wanted), (F.col("segment") == F.col(f"_s{j}")) & (F.col("bin") == F.col("_bin")))
            values = values.select(F.col("segment").alias(f"_s{j}"), F.col("text").alias(f"_t{j}"))
            rows = rows.join(values, (F.col("_segment") == F.col(f"_s{j}")) & (value_text(attr) == F.col(f"_t{j}")), "left")
            holds[j] = F.col(f"_t{j}").isNotNull()
    at, clauses = 0, []
    for clause in query.clauses:
        clauses.append(reduce(or_, [F.coalesce(holds[j], F.lit(False)) for j in range(at, at + len(clause))]))
        at += len(clause)
    return rows.where(reduce(and_, clauses)).select(names)


def _cuts_up_to(cuts: Column, value: Column) -> Column:
    """How many of the ascending cuts are not above the value, by bisection."""
    halves = F.sequence(F.lit(0), F.ceil(F.log2(F.size(cuts) + 1)).cast("int"))
    begin = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))

    def halve(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        up = (at["lo"] < at["hi"]) & (F.get(cuts, mid) <= value)
        return F.struct(F.when(up, mid + 1).otherwise(at["lo"]).alias("lo"), F.when((at["lo"] < at["hi"]) & ~up, mid).otherwise(at["hi"]).alias("hi"))

    return F.aggregate(halves, begin, halve, lambda at: at["lo"])


def row_bins(rows: DataFrame, index: DataFrame, attrs: list[Attr]) -> DataFrame:
    """Versions with a column _bin_<attribute> for each of the attributes: a range value's bin is the number of boundaries up to it less
    one, at most the last. Nulls and tombstones are in no bin."""
    names = rows.columns
    data = F.col("_op") == 0
    for a in attrs:
        if a.index == RANGE:
            lows: dict[str, list] = {}
            for r in index.where((F.col("kind") == "bins") & (F.col("attr") == a.name)).orderBy("segment", "bin").select("segment", "low").collect():
                lows.setdefault(r.segment, []).append(typed(a, bytes(r.low)))
            kind = T.DoubleType() if a.spark_type == T.FloatType() else a.spark_type
            cuts = rows.sparkSession.createDataFrame(list(lows.items()), T.StructType([T.StructField("_segment", T.StringType()), T.StructField("_cuts", T.ArrayType(kind))]))
            below = _cuts_up_to(F.col("_cuts"), F.col(a.name)) - 1
            # Boundaries that repeat the largest value count up to the last bin, where its rows stand.
            rows = rows.join(F.broadcast(cuts), "_segment", "left").withColumn(f"_bin_{a.name}", F.when(data & F.col(a.name).isNotNull(), below).cast("int"))
        else:
            values = index.where((F.col("kind") == "values") & (F.col("attr") == a.name)).select(F.col("segment").alias("_s"), F.col("text").alias("_t"), F.col("bin").alias(f"_bin_{a.name}"))
            rows = rows.join(values, (F.col("_segment") == F.col("_s")) & (value_text(a) == F.col("_t")) & data, "left")
        names = [*names, f"_bin_{a.name}"]
        rows = rows.select(names)
    return rows


def bitmaps(binned: DataFrame, attrs: list[Attr]) -> DataFrame:
    """segment, attr, bin, bucket, bm, card: bitmaps of row numbers for each bin, and for tombstones (attr '').

    binned: rows of row_bins with _segment and _row (a row's number in its segment, from 0).
    """
    each = [F.struct(F.lit(a.name).alias("attr"), F.col(f"_bin_{a.name}").alias("bin")) for a in attrs]
    each.append(F.struct(F.lit("").alias("attr"), F.when(F.col("_op") == 1, 0).alias("bin")))
    rows = binned.select(F.col("_segment").alias("segment"), (F.col("_row") + 1).alias("i"), F.explode(F.array(*each)).alias("v")).where("v.bin IS NOT NULL")
    return rows.groupBy("segment", "v.attr", "v.bin", F.bitmap_bucket_number("i").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("i")).alias("bm")).withColumn("card", F.bitmap_count("bm"))


def select_bitmaps(bits: DataFrame, index: DataFrame, query: EncodedQuery) -> DataFrame:
    """segment, bucket, bm, card: OR over the bins of a condition and over the conditions of a clause, AND over the clauses. A bucket
    that a clause lacks is empty. The query has a clause at least; tombstones are in no bin, so they need not be taken away."""
    conditions = [(c, e) for c, clause in enumerate(query.clauses) for e in clause]
    spark = bits.sparkSession
    which = spark.createDataFrame([(j, c, e.attr) for j, (c, e) in enumerate(conditions)], "j int, clause int, attr string")
    wanted = touched(index, [e for _, e in conditions]).join(F.broadcast(which), "j").select("segment", "attr", "clause", "first", F.col("last").alias("upto"))
    chosen = bits.join(wanted, ["segment", "attr"]).where(F.col("bin").between(F.col("first"), F.col("upto")))
    each = chosen.groupBy("segment", "clause", "bucket").agg(F.bitmap_or_agg("bm").alias("bm"))
    both = each.groupBy("segment", "bucket").agg(F.bitmap_and_agg("bm").alias("bm"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(query.clauses))
    return both.select("segment", "bucket", "bm", F.bitmap_count("bm").alias("card")).where("card > 0")


def at_bits(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows (with _segment and _row) whose bit is set in chosen (segment, bucket, bm)."""
    bit = F.bitmap_bit_position(F.col("_row") + 1)
    joined = rows.join(chosen.select("segment", "bucket", "bm"), (F.col("_segment") == F.col("segment")) & (F.bitmap_bucket_number(F.col("_row") + 1) == F.col("bucket")))
    byte = F.conv(F.hex(F.expr("substring(bm, cast(bitmap_bit_position(_row + 1) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return joined.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(rows.columns)
