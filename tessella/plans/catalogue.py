"""Queries of the engine over the driver's tables, and the SQL that says the same.

The rows of each query come out of a stored table: its segments, indexes, snapshots and levels. Tables are written once for each
session and folder, into the shared checkpoint folder.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.query import Query
from tessella.functions.schema import EQUALITY, FLOAT, INT, VARBINARY, Attr, Schema
from tessella.sources.database import Database
from tessella.sources.table import Snapshot, Table
from tessella.streaming import ingest


def _text(name: str, index: str = EQUALITY, nullable: bool = False) -> Attr:
    return Attr(name, index, VARBINARY, 0, nullable)


def _number(name: str, width: int = 8, nullable: bool = False) -> Attr:
    return Attr(name, physical=FLOAT, width=width, nullable=nullable)


LINEITEM = Schema((_number("l_quantity"), _number("l_extendedprice"), _number("l_discount"), _number("l_tax"), _text("l_returnflag"), _text("l_linestatus"), _number("x", 4)), estimator=True)
NULLABLE = Schema((_text("f", nullable=True), _number("q", nullable=True)))
ORDERS = Schema(
    (Attr("o_custkey", physical=INT), Attr("customer", EQUALITY, INT), _text("o_orderpriority", "range"), _text("priority"), _number("o_totalprice"), Attr("o_orderdate", physical=INT)), estimator=True
)
BY_CUSTOMER = Schema((Attr("o_custkey", physical=INT), _text("priority")))
BY_PRICE = Schema((_number("o_totalprice"),))
EVENTS = Schema((_number("value"), _text("event_type")), 0.05)
FLAT = Schema((_number("v"), _text("event_type")), estimator=True)
ACCOUNTS = Schema((_number("bal"), Attr("nation", physical=INT, width=4)))


@dataclass
class Stored:
    """A database with what its making left: snapshots, and the number of the ingest that each job was."""

    db: Database
    snapshots: dict[str, Snapshot] = field(default_factory=dict)

    @property
    def table(self) -> Table:
        return self.db.table()

    def ingests(self) -> DataFrame:
        """segment, ingest: in the order of the ingests, from 0."""
        jobs = sorted({(s.least_seq, s.job) for s in self.table.segments})
        order: dict[str, int] = {}
        for _, job in jobs:
            order.setdefault(job, len(order))
        return F.broadcast(self.db.spark.createDataFrame([(s.name, order[s.job]) for s in self.table.segments], "segment string, ingest long"))  # a row for each segment


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _root(spark: SparkSession) -> str:
    """A new place in the shared folder; a machine's own folder only where the driver runs everything."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors of a cluster need a shared folder")
        found = tempfile.mkdtemp(prefix="tessella-")
    return f"{found}/engine-{uuid.uuid4().hex}"


_made: dict[tuple[str, str, str], Stored] = {}


def _stored(schema: Schema):
    """A maker of a table: called with its Stored and the source folder, once for each session and folder."""

    def wrap(make: Callable[[Stored, SparkSession, str], None]) -> Callable[[SparkSession, str], Stored]:
        @functools.wraps(make)
        def get(spark: SparkSession, d: str) -> Stored:
            key = (spark.sparkContext.applicationId, d, make.__name__)
            if key not in _made:
                stored = Stored(Database(spark, _root(spark), schema))
                make(stored, spark, d)
                _made[key] = stored
            return _made[key]

        return get

    return wrap


def _row_key() -> Column:
    """A row's place in its source, for tables without a key."""
    return F.concat_ws(":", "_metadata.file_name", F.lpad(F.col("_metadata.row_index").cast("string"), 12, "0"))


def _bytes(name: str) -> Column:
    return F.col(name).cast("string").cast("binary").alias(name)


def _pack(*names: str) -> Column:
    """Columns that are no attributes travel in the payload."""
    return F.concat_ws(",", *[F.col(n).cast("string") for n in names]).cast("binary").alias("payload")


def _unpacked(i: int, kind: str) -> Column:
    return F.split(F.col("payload").cast("string"), ",")[i].cast(kind)


@_stored(LINEITEM)
def lineitem(stored: Stored, spark: SparkSession, d: str) -> None:
    rows = _read(spark, d, "lineitem").select(
        _row_key().alias("pk"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", _bytes("l_returnflag"), _bytes("l_linestatus"), (F.col("l_quantity") / 100).cast("float").alias("x"),
        _pack("l_orderkey", "l_linenumber"), F.monotonically_increasing_id().alias("ordinal"),
    )
    stored.table.put_df(rows, "ordinal")


@_stored(NULLABLE)
def nullable(stored: Stored, spark: SparkSession, d: str) -> None:
    rows = _read(spark, d, "lineitem").select(
        _row_key().alias("pk"), F.expr("nullif(l_returnflag, 'N')").cast("binary").alias("f"), F.expr("nullif(l_quantity, 50.0)").alias("q"), _pack("l_orderkey", "l_linenumber"), F.monotonically_increasing_id().alias("ordinal")
    )
    stored.table.put_df(rows, "ordinal")


def _orders(spark: SparkSession, d: str, only: Column | None = None) -> DataFrame:
    rows = _read(spark, d, "orders")
    return (rows if only is None else rows.where(only)).select(
        F.lpad(F.col("o_orderkey").cast("string"), 16, "0").alias("pk"), "o_custkey", F.col("o_custkey").alias("customer"), _bytes("o_orderpriority"), F.col("o_orderpriority").cast("binary").alias("priority"), "o_totalprice",
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("o_orderdate"), "o_orderkey", F.monotonically_increasing_id().alias("ordinal"),
    )


@_stored(ORDERS)
def orders(stored: Stored, spark: SparkSession, d: str) -> None:
    stored.table.put_df(_orders(spark, d), "ordinal")


@_stored(BY_CUSTOMER)
def orders_in_four(stored: Stored, spark: SparkSession, d: str) -> None:
    """Four ingests: orders by the rest of their key divided by four."""
    stored.table.put_dfs([_orders(spark, d, F.col("o_orderkey") % 4 == i) for i in range(4)], "ordinal")


@_stored(BY_PRICE)
def orders_by_price(stored: Stored, spark: SparkSession, d: str) -> None:
    """An ingest for each band of 50,000 in price; the ingest's number is the band's place among those that occur."""
    band = F.floor(F.col("o_totalprice") / 50000)
    bands = [r.band for r in _read(spark, d, "orders").select(band.alias("band")).distinct().orderBy("band").collect()]
    stored.table.put_dfs([_orders(spark, d, band == b) for b in bands], "ordinal")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "events").select(
        F.col("user_id").cast("string").alias("pk"), "value", _bytes("event_type"), _pack("event_id"), F.col("event_id").alias("ordinal"), (F.col("event_type") == "error").alias("gone"), "event_id"
    )


@_stored(EVENTS)
def events(stored: Stored, spark: SparkSession, d: str) -> None:
    """Events are versions of their users, error events delete them; a snapshot is taken after event 8000."""
    rows = _events(spark, d)
    stored.table.put_df(rows.where("event_id <= 8000"), "ordinal", "gone")
    stored.snapshots["8000"] = stored.table.snapshot()
    stored.table.put_df(rows.where("event_id > 8000").withColumn("ordinal", F.col("event_id") - 8001), "ordinal", "gone")


@_stored(EVENTS)
def events_compacted(stored: Stored, spark: SparkSession, d: str) -> None:
    """As events, then compacted, and the files that are not live any more deleted."""
    rows = _events(spark, d)
    stored.table.put_df(rows.where("event_id <= 8000"), "ordinal", "gone")
    stored.table.put_df(rows.where("event_id > 8000").withColumn("ordinal", F.col("event_id") - 8001), "ordinal", "gone")
    stored.table.compact()
    stored.table.vacuum(0.0)


@_stored(EVENTS)
def events_levelled(stored: Stored, spark: SparkSession, d: str) -> None:
    """Five ingests with levelled compaction after each: the last one stands above the merged ones."""
    rows = _events(spark, d)
    for i in range(5):
        part = rows.where(F.col("event_id").between(2000 * i, 2000 * i + 1999 if i < 4 else 1 << 60))
        stored.table.put_df(part.withColumn("ordinal", F.col("event_id") - 2000 * i), "ordinal", "gone")
        stored.table.maintain()


@_stored(EVENTS)
def events_pending(stored: Stored, spark: SparkSession, d: str) -> None:
    """The last hundred events are pending writes, the others a segment."""
    rows = _events(spark, d)
    last = rows.agg(F.max("event_id")).first()[0] or 0
    stored.table.put_df(rows.where(F.col("event_id") <= last - 100), "ordinal", "gone")
    for r in rows.where(F.col("event_id") > last - 100).orderBy("event_id").collect():  # a hundred rows
        stored.table.delete(r.pk) if r.gone else stored.table.put(r.pk, [r.value, bytes(r.event_type)], bytes(r.payload))


@_stored(EVENTS)
def events_streamed(stored: Stored, spark: SparkSession, d: str) -> None:
    """The events table as a stream."""
    source = _read(spark, d, "events")
    place = f"{_root(spark)}/stream"
    source.repartitionByRange(2, "event_id").write.parquet(f"{place}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 8).parquet(f"{place}/in").select(
        F.col("user_id").cast("string").alias("pk"), "value", F.col("event_type").cast("binary").alias("event_type"), F.col("event_id").cast("string").cast("binary").alias("payload"), F.col("event_id").alias("ordinal"), (F.col("event_type") == "error").alias("gone")
    )
    ingest(stream, stored.table, "ordinal", "gone").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()


@_stored(FLAT)
def events_flat(stored: Stored, spark: SparkSession, d: str) -> None:
    """A row for each event; the value of error events is NaN."""
    value = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    rows = _read(spark, d, "events").select(F.lpad(F.col("event_id").cast("string"), 16, "0").alias("pk"), value.alias("v"), _bytes("event_type"), _pack("event_id"), F.col("event_id").alias("ordinal"))
    stored.table.put_df(rows, "ordinal")


@_stored(Schema(FLAT.attrs, 0.05))
def events_in_four(stored: Stored, spark: SparkSession, d: str) -> None:
    """Four ingests by the rest of the event's number; error events delete their key."""
    rows = _read(spark, d, "events").select(F.col("event_id").cast("string").alias("pk"), F.col("value").alias("v"), _bytes("event_type"), F.col("event_id").alias("ordinal"), (F.col("event_type") == "error").alias("gone"))
    stored.table.put_dfs([rows.where(F.col("ordinal") % 4 == i) for i in range(4)], "ordinal", "gone")


@_stored(ACCOUNTS)
def accounts(stored: Stored, spark: SparkSession, d: str) -> None:
    """Two families of one schema that share keys."""
    for family, name, p in (("customer", "customer", "c"), ("supplier", "supplier", "s")):
        key = F.col(f"{p}_custkey" if p == "c" else "s_suppkey").cast("string")
        rows = _read(spark, d, name).select(key.alias("pk"), F.col(f"{p}_acctbal").alias("bal"), F.col(f"{p}_nationkey").alias("nation"), F.monotonically_increasing_id().alias("ordinal"))
        stored.db.create(family, ACCOUNTS).put_df(rows, "ordinal")


_L = "l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag"
_O = "o_orderkey, o_custkey, o_orderpriority"


def _line_rows(rows: DataFrame) -> DataFrame:
    return rows.select(_unpacked(0, "long").alias("l_orderkey"), _unpacked(1, "int").alias("l_linenumber"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.col("l_returnflag").cast("string").alias("l_returnflag"))


def _order_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("pk").cast("string").cast("long").alias("o_orderkey"), "o_custkey", F.col("o_orderpriority").cast("string").alias("o_orderpriority"))


def _event_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("pk").cast("string").cast("long").alias("user_id"), F.col("event_type").cast("string").alias("event_type"), "value", _unpacked(0, "long").alias("event_id"))


def _lines(query: Query):
    return lambda spark, d: _line_rows(lineitem(spark, d).table.find(query))


def _order(query: Query):
    return lambda spark, d: _order_rows(orders(spark, d).table.find(query))


def _live(maker, query: Query | None = None, snapshot: str | None = None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        stored = maker(spark, d)
        return _event_rows(stored.table.find(query or Query(), stored.snapshots[snapshot] if snapshot else None))

    return run


_LIVE_SQL = "SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events {where}) WHERE rn = 1 AND event_type <> 'error'"
_MATCH = Query.of(("value", ">=", 50.0), [("event_type", "=", "click"), ("event_type", "=", "view")])
_MATCH_SQL = " AND value >= 50 AND event_type IN ('click', 'view')"


def _null_3vl(spark: SparkSession, d: str) -> DataFrame:
    rows = nullable(spark, d).table.find(Query.of([("f", "=", "A"), ("q", ">", 45.0)]))
    return rows.select(_unpacked(0, "long").alias("l_orderkey"), _unpacked(1, "int").alias("l_linenumber"), F.col("f").cast("string").alias("f"), "q")


def _nan_guard(spark: SparkSession, d: str) -> DataFrame:
    return events_flat(spark, d).table.find(Query.of(("v", ">=", 60.0))).select(_unpacked(0, "long").alias("event_id"), "v")


def _float32(literal: float):
    return lambda spark, d: _line_rows(lineitem(spark, d).table.find(Query.of(("x", "=", literal))).withColumn("l_returnflag", F.lit(""))).select("l_orderkey", "l_linenumber")


def _ts_range(spark: SparkSession, d: str) -> DataFrame:
    low, high = spark.range(1).select(*[F.unix_micros(F.lit(t).cast("timestamp")) for t in ("1995-03-01", "1995-04-01")]).first()
    return _order_rows(orders(spark, d).table.find(Query.of(("o_orderdate", ">=", low), ("o_orderdate", "<", high)))).select("o_orderkey", "o_custkey")


def _two_cf(spark: SparkSession, d: str) -> DataFrame:
    query, db = Query.of(("bal", ">=", 8000.0), [("nation", "<", 10), ("nation", "=", 20)]), accounts(spark, d).db
    each = [db.scan(db.table(n), query).select(F.lit(n).alias("family"), F.col("pk").cast("string").cast("long").alias("id"), "bal", "nation") for n in ("customer", "supplier")]
    return each[0].unionByName(each[1])


def _zone_map(spark: SparkSession, d: str) -> DataFrame:
    stored = orders_in_four(spark, d)
    rows = stored.table.zones("o_custkey").join(stored.ingests(), "segment")
    return rows.groupBy(F.col("ingest").alias("segment")).agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("distinct").alias("ndv"), F.sum("n_rows").alias("n_rows"))


def _seg_skip(spark: SparkSession, d: str) -> DataFrame:
    """Which bands of prices a query would read: by its segments' bounds alone."""
    stored = orders_by_price(spark, d)
    good, _ = stored.table.matching(Query.between("o_totalprice", 1000.0, 60000.0))
    bands = stored.table.zones("o_totalprice").join(stored.ingests(), "segment").select(F.floor(F.col("least") / 50000).cast("long").alias("band"), F.col("segment").isin([s.name for s in good]).alias("read"))
    return bands.groupBy(F.col("band").alias("segment")).agg(F.bool_or("read").alias("read"))


def _value_counts(spark: SparkSession, d: str) -> DataFrame:
    stored = orders_in_four(spark, d)
    rows = stored.table.value_counts("priority").join(stored.ingests(), "segment")
    return rows.groupBy(F.col("ingest").alias("segment"), F.col("value").cast("string").alias("o_orderpriority")).agg(F.sum("n_rows").cast("long").alias("n_rows"))


def _range_hist(spark: SparkSession, d: str) -> DataFrame:
    rows = lineitem(spark, d).table.histogram("l_discount")
    return rows.groupBy(F.col("low").alias("least")).agg(F.sum("n_rows").alias("n_rows"))


def _ndv(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values by the index: these attributes have a bin for each value."""
    rows = lineitem(spark, d).table.index().where("low IS NOT NULL AND kind <> 'summary'")
    count = lambda attr, name: F.count_distinct(F.when(F.col("attr") == attr, F.col("low"))).alias(name)
    return rows.agg(count("l_quantity", "quantity"), count("l_discount", "discount"), count("l_returnflag", "flag"))


def _tombstones(spark: SparkSession, d: str) -> DataFrame:
    stored = events_in_four(spark, d)
    return stored.table.statistics().join(stored.ingests(), "segment").groupBy(F.col("ingest").alias("segment")).agg(F.sum("tombstones").alias("tombstones"))


_URGENT = [("priority", "=", "1-URGENT"), ("priority", "=", "2-HIGH")]


def _bitmap_and(spark: SparkSession, d: str) -> DataFrame:
    """Rows of orders that satisfy both clauses, found by bitmaps."""
    return orders(spark, d).table.bitmap_rows(Query.of(_URGENT, ("o_custkey", "<", 500))).agg(F.count(F.lit(1)).alias("n_rows"))


def _bitmap_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cardinality of each bin's bitmap; the priorities have a bin each."""
    table = orders(spark, d).table
    names = table.value_counts("priority").select("segment", "value").join(table.index().where("kind = 'values' AND attr = 'priority'").select("segment", F.unhex("text").alias("value"), "bin"), ["segment", "value"])
    rows = table.bitmaps(["priority"]).where("attr = 'priority'").join(names, ["segment", "bin"])
    return rows.groupBy(F.col("value").cast("string").alias("o_orderpriority")).agg(F.sum("card").alias("n_rows"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Keys of matching bins; the priorities have a bin each, so these are the matches."""
    table = orders(spark, d).table
    return table.candidates(Query.of(("priority", "=", "1-URGENT")), table.snapshot()).select(F.col("pk").cast("string").cast("long").alias("o_orderkey"))


def _candidates_cover(spark: SparkSession, d: str) -> DataFrame:
    """Matches that candidate bins miss: none. Stale and deleted keys may be among the candidates."""
    table, query = events(spark, d).table, Query.of(("value", ">=", 50.0), ("value", "<", 51.5))
    snapshot = table.snapshot()
    return table.find(query, snapshot).join(table.candidates(query, snapshot), "pk", "left_anti").agg(F.count(F.lit(1)).alias("n_rows"))


def _point_get(spark: SparkSession, d: str) -> DataFrame:
    return _event_rows(events(spark, d).table.get("42"))


def _raw_versions(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).table.raw()
    return rows.groupBy(F.col("pk").cast("string").cast("long").alias("user_id")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("_op").cast("long")).alias("tombstones"))


def _estimate(maker, query: Query):
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = maker(spark, d).table.estimate(query)
        return spark.createDataFrame([(round(found.selectivity, 9), found.physical_rows)], "selectivity double, n_rows long")

    return run


def _topk_values(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).table.top_values("customer", 100).withColumnRenamed("value", "o_custkey")


def _lq(where: str) -> str:
    return f"SELECT {_L} FROM lineitem WHERE {where}"


def _oq(where: str) -> str:
    return f"SELECT {_O} FROM orders WHERE {where}"


CATALOGUE: dict[str, tuple] = {
    "scan_full": (_order(Query()), f"SELECT {_O} FROM orders"),
    "pred_eq_range": (_order(Query.of(("o_custkey", "=", 370))), _oq("o_custkey = 370")),
    "pred_eq_equality": (_order(Query.of(("priority", "=", "1-URGENT"))), _oq("o_orderpriority = '1-URGENT'")),
    "pred_lt": (_lines(Query.of(("l_quantity", "<", 3.0))), _lq("l_quantity < 3")),
    "pred_le": (_lines(Query.of(("l_quantity", "<=", 3.0))), _lq("l_quantity <= 3")),
    "pred_gt": (_lines(Query.of(("l_quantity", ">", 48.0))), _lq("l_quantity > 48")),
    "pred_ge": (_lines(Query.of(("l_quantity", ">=", 48.0))), _lq("l_quantity >= 48")),
    "pred_between": (_lines(Query.of(("l_quantity", ">=", 10.0), ("l_quantity", "<", 20.0))), _lq("l_quantity >= 10 AND l_quantity < 20")),
    "pred_in": (_lines(Query.isin("l_quantity", [7.0, 42.0])), _lq("l_quantity IN (7, 42)")),
    "or_same_attr": (_lines(Query.of([("l_quantity", "<", 3.0), ("l_quantity", ">", 48.0)])), _lq("l_quantity < 3 OR l_quantity > 48")),
    "or_cross_attr": (_lines(Query.of([("l_quantity", ">=", 49.0), ("l_extendedprice", ">=", 100000.0)])), _lq("l_quantity >= 49 OR l_extendedprice >= 100000")),
    "or_mixed_type": (_lines(Query.of([("l_quantity", ">=", 50.0), ("l_returnflag", "=", "R")])), _lq("l_quantity >= 50 OR l_returnflag = 'R'")),
    "cnf_3x": (
        _lines(Query.of([("l_quantity", "=", 7.0), ("l_quantity", "=", 42.0)], ("l_discount", ">=", 0.05), [("l_returnflag", "=", "R"), ("l_tax", ">", 0.05)])),
        _lq("(l_quantity = 7 OR l_quantity = 42) AND l_discount >= 0.05 AND (l_returnflag = 'R' OR l_tax > 0.05)"),
    ),
    "unsat": (_lines(Query.of(("l_quantity", ">", 5.0), ("l_quantity", "<", 3.0))), _lq("l_quantity > 5 AND l_quantity < 3")),
    "bytes_range": (_order(Query.of(("o_orderpriority", ">=", "2"), ("o_orderpriority", "<", "4"))), _oq("o_orderpriority >= '2' AND o_orderpriority < '4'")),
    "null_3vl": (_null_3vl, "SELECT * FROM (SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') AS f, nullif(l_quantity, 50.0) AS q FROM lineitem) WHERE f = 'A' OR q > 45"),
    "nan_guard": (_nan_guard, "SELECT * FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'NaN'::DOUBLE ELSE value END AS v FROM events) WHERE v >= 60 AND NOT isnan(v)"),
    "float32": (_float32(0.1), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST(CAST(l_quantity / 100 AS FLOAT) AS DOUBLE) = CAST(0.1 AS DOUBLE)"),
    "float32_exact": (_float32(0.25), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST(CAST(l_quantity / 100 AS FLOAT) AS DOUBLE) = CAST(0.25 AS DOUBLE)"),
    "ts_range": (_ts_range, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-04-01'"),
    "live_view": (_live(events), _LIVE_SQL.format(where="")),
    "live_cnf": (_live(events, _MATCH), _LIVE_SQL.format(where="") + _MATCH_SQL),
    "snapshot_cnf": (_live(events, _MATCH, "8000"), _LIVE_SQL.format(where="WHERE event_id <= 8000") + _MATCH_SQL),
    "deleted_keys": (
        lambda s, d: events(s, d).table.deleted().select(F.col("pk").cast("string").cast("long").alias("user_id")),
        "SELECT user_id FROM (SELECT user_id, max_by(event_type, event_id) AS t FROM events GROUP BY user_id) WHERE t = 'error'",
    ),
    "two_cf": (
        _two_cf,
        "SELECT * FROM (SELECT 'customer' AS family, c_custkey AS id, c_acctbal AS bal, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, s_nationkey FROM supplier) WHERE bal >= 8000 AND (nation < 10 OR nation = 20)",
    ),
    "seg_zone_map": (_zone_map, "SELECT o_orderkey % 4 AS segment, min(o_custkey) AS least, max(o_custkey) AS most, count(DISTINCT o_custkey) AS ndv, count(*) AS n_rows FROM orders GROUP BY 1"),
    "seg_skip": (_seg_skip, "SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS segment, max(o_totalprice) >= 1000 AND min(o_totalprice) <= 60000 AS read FROM orders GROUP BY 1"),
    "value_counts": (_value_counts, "SELECT o_orderkey % 4 AS segment, o_orderpriority, count(*) AS n_rows FROM orders GROUP BY 1, 2"),
    "range_hist_exact": (_range_hist, "SELECT l_discount AS least, count(*) AS n_rows FROM lineitem GROUP BY 1"),
    "ndv": (_ndv, "SELECT count(DISTINCT l_quantity) AS quantity, count(DISTINCT l_discount) AS discount, count(DISTINCT l_returnflag) AS flag FROM lineitem"),
    "tombstones": (_tombstones, "SELECT event_id % 4 AS segment, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS tombstones FROM events GROUP BY 1"),
    "bitmap_and": (_bitmap_and, "SELECT count(*) AS n_rows FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey < 500)"),
    "bitmap_cards": (_bitmap_cards, "SELECT o_orderpriority, count(*) AS n_rows FROM orders GROUP BY 1"),
    "candidate_keys": (_candidates, "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'"),
    "candidates_cover": (_candidates_cover, "SELECT CAST(0 AS BIGINT) AS n_rows"),
    "point_get": (_point_get, _LIVE_SQL.format(where="") + " AND user_id = 42"),
    "raw_versions": (_raw_versions, "SELECT user_id, count(*) AS n_rows, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS tombstones FROM events GROUP BY 1"),
    "est_eq": (_estimate(orders, Query.of(("priority", "=", "1-URGENT"))), "SELECT round(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*), 9) AS selectivity, count(*) AS n_rows FROM orders"),
    "est_and": (
        _estimate(lineitem, Query.of(("l_returnflag", "=", "R"), ("l_linestatus", "=", "O"))),
        "SELECT round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*) * (count(*) FILTER (WHERE l_linestatus = 'O') / count(*)), 9) AS selectivity, count(*) AS n_rows FROM lineitem",
    ),
    "est_or": (
        _estimate(events_flat, Query.of([("event_type", "=", "click"), ("event_type", "=", "view")])),
        "SELECT round(least(1.0, count(*) FILTER (WHERE event_type = 'click') / count(*) + count(*) FILTER (WHERE event_type = 'view') / count(*)), 9) AS selectivity, count(*) AS n_rows FROM events",
    ),
    "est_absent": (_estimate(events_flat, Query.of(("event_type", "=", "absent"))), "SELECT round(1 / count(*), 9) AS selectivity, count(*) AS n_rows FROM events"),
    "est_range": (
        _estimate(lineitem, Query.of(("l_discount", ">=", 0.02), ("l_discount", "<", 0.05))),
        "SELECT round(count(*) FILTER (WHERE l_discount >= 0.02 AND l_discount < 0.05) / count(*), 9) AS selectivity, count(*) AS n_rows FROM lineitem",
    ),
    "topk_values": (_topk_values, "SELECT o_custkey, count(*) AS n_rows FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100"),
    "engine_live_cnf": (_live(events_pending, _MATCH), _LIVE_SQL.format(where="") + _MATCH_SQL),
    "engine_snapshot_cnf": (_live(events, Query(), "8000"), _LIVE_SQL.format(where="WHERE event_id <= 8000")),
    "engine_compacted": (_live(events_compacted), _LIVE_SQL.format(where="")),
    "engine_levelled": (_live(events_levelled, _MATCH), _LIVE_SQL.format(where="") + _MATCH_SQL),
    "stream_live": (_live(events_streamed), _LIVE_SQL.format(where="")),
}


def makers() -> dict:
    """What writes the tables, by name."""
    return {f.__name__: f for f in (lineitem, nullable, orders, orders_in_four, orders_by_price, events, events_compacted, events_levelled, events_pending, events_streamed, events_flat, events_in_four, accounts)}


def queries() -> dict:
    return {name: run for name, (run, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items()}
