"""The stored engine against a dictionary: random writes, flushes, compactions, snapshots and queries."""

import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from tessella.functions.generate import random_rows
from tessella.functions.query import Query, matches
from tessella.functions.schema import BINARY, EQUALITY, FLOAT, INT, UINT, VARBINARY, Attr, Schema
from tessella.sources.database import Database
from tessella.streaming import ingest

SCHEMA = Schema((Attr("n", physical=INT, width=4, nullable=True), Attr("f", physical=FLOAT), Attr("s", EQUALITY, VARBINARY, 0)), 0.2, True)
WIDE = Schema((Attr("u", physical=UINT, nullable=True), Attr("b", physical=BINARY, width=3), Attr("e", EQUALITY, INT, 2), Attr("g", EQUALITY, FLOAT, 4)), 0.05, False, 40)
NUMBERS = [0.0, -0.0, 1e300, 5e-324, math.nan, math.inf, -math.inf, *map(float, range(10))]


def _row(rnd, schema):
    if schema is SCHEMA:
        return {"n": rnd.choice([None, *range(-5, 6)]), "f": rnd.choice(NUMBERS), "s": b"v%d" % rnd.randrange(6)}
    return {"u": rnd.choice([None, 0, 1, 7, (1 << 64) - 1]), "b": rnd.choice([b"abc", b"abd", b"\x00\xff\x01"]), "e": rnd.choice([-300, 0, 300]), "g": rnd.choice([0.0, -0.0, 0.5, math.nan])}


def _condition(rnd, schema):
    op = rnd.choice("< <= = > >=".split())
    if schema is SCHEMA:
        return rnd.choice([("n", op, rnd.randint(-6, 6)), ("f", op, rnd.choice([0.0, -0.0, 3.0, math.nan, math.inf])), ("s", "=", "v%d" % rnd.randrange(7))])
    return rnd.choice([("u", op, rnd.choice([0, 5, 7, (1 << 64) - 1])), ("b", op, rnd.choice([b"", b"abc", b"abcd", b"z"])), ("e", "=", rnd.choice([-300, 1])), ("g", "=", rnd.choice([0.0, 0.5, math.nan]))])


@pytest.mark.parametrize("seed, schema", [(1, SCHEMA), (2, SCHEMA), (3, WIDE)])
def test_differential(spark, tmp_path, seed, schema):
    """400 writes with flushes, bulk ingests, levelled and full compactions, vacuums, reopening; reads now and at a held snapshot."""
    rnd = random.Random(seed)
    db = Database(spark, str(tmp_path / "db"), schema)
    table, rows, held = db.table(), {}, None
    state = lambda rows, query: sorted(k for k, r in rows.items() if matches(query, schema, r))
    for step in range(10):
        for _ in range(40):
            pk = b"k%02d" % rnd.randrange(60)
            if rnd.random() < 0.2:
                table.delete(pk)
                rows.pop(pk, None)
            else:
                rows[pk] = _row(rnd, schema)
                table.put(pk, rows[pk], b"p")
        if step == 1:
            held = (table.snapshot(pinned=True), dict(rows))
        if step % 3 != 2:
            table.flush()
        if step in (4, 7):
            table.maintain()
            assert len([s for s in table.segments if s.level == 0]) < 4
        if step == 5:
            table.compact()
            assert table.vacuum(0.0) > 0
        if step == 8:
            table.flush()
            table = Database(spark, str(tmp_path / "db"), schema).table()
        query = Query.of(*[[_condition(rnd, schema) for _ in range(rnd.randint(1, 2))] for _ in range(rnd.randint(0, 2))])
        assert [bytes(r.pk) for r in table.scan(query).collect()] == state(rows, query), str(query)
        if held and step % 2:
            then = sorted(bytes(r.pk) for r in table.find(query, held[0]).collect())
            assert then == state(held[1], query), str(query)
            assert set(then) <= {bytes(r.pk) for r in table.candidates(query, held[0]).collect()}
    assert sorted(bytes(r.pk) for r in table.deleted().collect()) == sorted({bytes(r.pk) for r in table.raw().select("pk").distinct().collect()} - set(rows))
    pk = sorted(rows)[0]
    assert bytes(table.get(pk).first().pk) == pk and not table.get("none").count()


def test_batches_families_and_errors(spark, tmp_path):
    root = str(tmp_path / "db")
    with Database(spark, root, {"default": SCHEMA}) as db:
        t, other = db.table(), db.create("other", SCHEMA)
        with pytest.raises(ValueError):
            t.put_batch(["a", "b"], [[1, 1.0, "x"], [1, None, "x"]], [b"", b""])
        assert not t.pending
        t.put_batch(["k1", "k2", "k2"], [[1, 1.0, "x"], [2, 2.0, "x"], [3, 3.0, "y"]], [b"", b"", b"last"])
        db.put(other, "k1", [9, 9.0, "z"])
        db.delete(other, "nothing")
        assert t.get("k2").first().payload == b"last"
        for bad in (None, Database(spark, str(tmp_path / "db2"), SCHEMA).table()):
            for call in (lambda x: db.put(x, "k", [1, 1.0, "x"]), lambda x: db.put_batch(x, [], [], []), lambda x: db.delete(x, "k"), db.flush, db.scan, lambda x: db.estimate(x, Query()), db.drop):
                with pytest.raises(ValueError):
                    call(bad)
        with pytest.raises(ValueError):
            db.create("other", SCHEMA)
        with pytest.raises(ValueError):
            db.drop(t)
        with pytest.raises(ValueError):
            t.candidates(Query(), None)
    again = Database(spark, root, {"default": SCHEMA, "other": SCHEMA})
    assert Database.list_families(spark, root) == ["default", "other"]
    assert again.table().live().count() == 2 and again.table("other").live().count() == 1 and again.table("none") is None
    gone = again.table("other")
    again.drop(gone)
    with pytest.raises(ValueError):
        gone.put("k", [1, 1.0, "x"])
    with pytest.raises(ValueError):
        Database(spark, root, {"default": Schema(SCHEMA.attrs[:1])})


def test_a_bad_row_refuses_the_whole_ingest(spark, tmp_path):
    t = Database(spark, str(tmp_path / "db"), WIDE).table()
    row = lambda i, u, b: (f"k{i}", u, b, 1, 0.5, i)
    frame = lambda *rows: spark.createDataFrame(list(rows), "pk string, u long, b string, e int, g float, o long")
    for bad in (row(1, -1, "abc"), row(1, 1, "ab"), row(1, 1, None)):
        with pytest.raises(ValueError):
            t.put_df(frame(row(0, 1, "abc"), bad), "o")
    assert not t.segments and not [n for n in t.store.children(t.name) if n.startswith("stage")]
    t.put_df(frame(row(0, 1, "abc"), row(1, None, "abd")), "o")
    assert t.live().count() == 2


def test_pruning_and_estimates(spark, tmp_path):
    schema = Schema((Attr("a", physical=INT), Attr("b", EQUALITY, VARBINARY, 0)), 0.1, True)
    t = Database(spark, str(tmp_path / "db"), schema).table()
    df = spark.range(2000).selectExpr("cast(lpad(id, 5, '0') as binary) AS pk", "id AS a", "cast('v' || (id % 100) as binary) AS b", "id AS o")
    t.put_df(df, "o")
    (segment,) = t.segments
    assert [r.n_rows for r in t.histogram("a", segment).orderBy("bin").collect()] == [200] * 10 and segment.single
    snap = t.snapshot()
    assert t.candidates(Query.of(("a", "=", 700)), snap).count() == 200
    assert t.candidates(Query.between("a", 500, 899), snap).count() == 600
    assert t.candidates(Query.of([("a", "=", 5), ("a", "=", 700), ("a", "=", 1900)]), snap).count() == 600
    assert t.candidates(Query.of(("b", "=", "v37")), snap).count() == 200  # its bin holds ten values
    assert sorted(r.n_rows for r in t.histogram("b", segment).collect()) == [200] * 10
    assert t.value_counts("b").where("n_rows = 20").count() == 100 and t.top_values("b", 3).collect()[0].n_rows == 20
    e = t.estimate(Query.between("a", 500, 899))
    assert abs(e.rows() - 400) < 10 and abs(e.fetches() - 600) < 30
    e = t.estimate(Query.of(("a", "<", 1000), ("b", "=", "v3")))
    assert abs(e.selectivity * 2000 - 10) < 2
    assert t.estimate(Query.of(("b", "=", "none"))).selectivity == 1 / 2000
    assert "Exchange" not in t.find(Query.of(("a", "=", 700)))._jdf.queryExecution().executedPlan().toString()
    t.put_df(df.where("a < 100").withColumn("a", df.a + 10_000), "o")
    assert t.find(Query.of(("a", "<", 1000))).count() == 900
    assert t.estimate(Query()).physical_rows == 2000 and t.estimator.rebuilds == 1  # 100 of 2000 rows are no reason to rebuild
    t.put("x", [1, "v1"])
    assert t.estimate(Query()).memtable_entries == 1
    t.put_df(df.where("a < 200"), "o")
    assert t.estimate(Query()).physical_rows == 2301 and t.estimator.rebuilds == 2


def test_segments_are_skipped_by_bounds_and_dictionaries(spark, tmp_path):
    schema = Schema((Attr("a", physical=INT), Attr("b", EQUALITY, VARBINARY, 0)), 0.001)
    t = Database(spark, str(tmp_path / "db"), schema).table()
    df = spark.range(900).selectExpr("cast(lpad(id, 4, '0') as binary) AS pk", "id AS a", "cast('v' || id as binary) AS b", "id AS o")
    for i in range(3):
        t.put_df(df.where(f"a % 3 = {i}").withColumn("a", df.a + 1000 * i), "o")
    read = lambda *clauses: len(t.matching(Query.of(*clauses))[0])
    assert read() == 3 and read(("a", "<", 500)) == 1 and read(("a", ">", 950)) == 2 and read([("a", "=", 3), ("a", ">", 2500)]) == 2 and read(("a", "=", -1)) == 0
    assert t.segments[0].attrs["b"].keys is None  # 300 values: the dictionary is asked
    assert read(("b", "=", "v7")) == 1 and read(("b", "=", "v1000")) == 0 and read([("b", "=", "v0"), ("b", "=", "v1")]) == 2
    assert t.find(Query.of(("b", "=", "v7"))).count() == 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_ingest_sorts_no_rows_for_its_statistics(spark, tmp_path):
    """Bounds of segments come from the files' first and last rows, and no task gathers the values of an attribute."""
    schema = Schema((Attr("a", physical=INT), Attr("b", EQUALITY, VARBINARY, 0)), 0.1, False, 400)
    t = Database(spark, str(tmp_path / "db"), schema).table()
    df = spark.range(1000).selectExpr("cast(id % 300 AS string) AS pk", "id AS a", "cast('v' || (id % 4) as binary) AS b", "id AS o", "id % 7 = 0 AS gone")
    ran = spark._jsparkSession.sharedState().statusStore()
    before = ran.executionsCount()
    t.put_df(df, "o", "gone")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [ran.executionsList(i, 1).head().physicalPlanDescription() for i in range(before, ran.executionsCount())]
    assert any("HashAggregate" in p for p in plans) and not any("SortAggregate" in p or "FlatMapGroups" in p for p in plans)
    of = {r["_segment"]: r for r in t._read(t.segments, True).groupBy("_segment").agg(F.min("pk").alias("least"), F.max("pk").alias("most")).collect()}
    assert len(t.segments) == 3 and all((s.least_pk, s.most_pk) == (bytes(of[s.name].least), bytes(of[s.name].most)) for s in t.segments)
    assert t.segments == sorted(t.segments, key=lambda s: s.least_pk) and not any(s.single for s in t.segments)


def test_filters_reach_the_files(spark, tmp_path):
    schema = Schema((Attr("x", physical=FLOAT), Attr("y", physical=FLOAT), Attr("s", EQUALITY, VARBINARY, 0)), 0.1)
    t = Database(spark, str(tmp_path / "db"), schema).table()
    df = spark.range(400).selectExpr("cast(lpad(id, 4, '0') as binary) AS pk", "if(id % 7 = 0, double('NaN'), id / 2) AS x", "double(id) AS y", "cast('v' || (id % 3) as binary) AS s", "id AS o")
    t.put_df(df, "o")
    for query in (Query.of([("x", ">=", 100.0), ("s", "=", "v1")]), Query.of([("x", ">", 150.0), ("y", "<", 10.0)])):
        plan = _plan(t.find(query))
        assert "PushedFilters: [Or(" in plan and "Exchange" not in plan
    want = sum(1 for i in range(400) if (i % 7 and i / 2 >= 100) or i % 3 == 1)
    assert t.find(Query.of([("x", ">=", 100.0), ("s", "=", "v1")])).count() == want
    t.put_df(df.where("o >= 350").withColumn("x", F.lit(-1.0)).withColumn("o", df.o - 350), "o")
    plan = _plan(t.find(Query.of(("x", "=", 100.0))))
    assert "EqualTo(x,100.0)" in plan  # overlapping segments: only matching versions are carried
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert any("ReadSchema: struct<pk:binary,_seq:bigint,_age:int>" in line for line in scans)  # the others show keys and numbers only
    assert t.find(Query.of(("x", ">", 170.0))).count() == sum(1 for i in range(341, 350) if i % 7) and t.find(Query.of(("x", "=", -1.0))).count() == 50


def test_segments_are_bounded_and_settled_ones_need_no_shuffle(spark, tmp_path):
    schema = Schema((Attr("a", physical=INT), Attr("b", EQUALITY, VARBINARY, 0)), 0.1, False, 300)
    t = Database(spark, str(tmp_path / "db"), schema).table()
    df = spark.range(1000).selectExpr("cast(lpad(id, 5, '0') as binary) AS pk", "id AS a", "cast('v' || (id % 4) as binary) AS b", "id AS o")
    t.put_df(df, "o")
    assert len(t.segments) == 4 and sum(s.rows for s in t.segments) == 1000 and all(s.single for s in t.segments) and len({s.job for s in t.segments}) == 1
    assert "Exchange" not in _plan(t.find(Query()))
    assert t.find(Query.between("a", 100, 899)).count() == 800
    assert {bytes(r.value): r.n for r in t.value_counts("b").groupBy("value").agg(F.sum("n_rows").alias("n")).collect()} == {b"v%d" % i: 250 for i in range(4)}
    t.put("00999", [-1, "v0"])
    t.delete("00000")
    assert len(t.settled()) == 2
    assert sorted(r.a for r in t.cursor()) == [-1, *range(1, 999)]
    t.flush()
    assert t.find(Query.of(("a", "<", 10))).count() == 10 and t.find(Query.of(("a", ">", 990))).count() == 8
    assert [bytes(r.pk) for r in t.deleted().collect()] == [b"00000"]
    t.compact()
    assert len(t.segments) == 4 and "Exchange" not in _plan(t.find(Query())) and t.live().count() == 999
    assert "Exchange" not in _plan(t.live().groupBy().count()).split("FileScan")[1]


def test_readers_outlive_compaction(spark, tmp_path):
    root = str(tmp_path / "db")
    t = Database(spark, root, SCHEMA).table()
    t.put_batch([f"k{i}" for i in range(20)], [[i % 6, float(i), "x"] for i in range(20)], [b""] * 20)
    t.flush()
    frame, loose, pinned = t.find(Query.of(("f", ">=", 10.0))), t.snapshot(), t.snapshot(pinned=True)
    t.put("k19", [0, -1.0, "x"])
    t.delete("k18")
    t.compact()
    assert frame.count() == 10 and t.find(Query.of(("f", ">=", 10.0))).count() == 8
    other = Database(spark, root, SCHEMA).table()  # another session: it knows the pin, and files in use by age
    assert other.vacuum(3600.0) == 0 and t.find(Query(), loose).count() == 20
    other.vacuum(0.0)
    assert t.find(Query(), pinned).count() == 20
    t.release(pinned)
    assert other.vacuum(0.0) > 0 and other.live().count() == 19
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        t.find(Query(), pinned).count()


def test_levels(spark, tmp_path):
    schema = Schema((Attr("a", physical=INT),), 0.5, False, 50)
    t = Database(spark, str(tmp_path / "db"), schema).table()
    rows, rnd = {}, random.Random(5)
    for i in range(14):
        keys = rnd.sample(range(600), 50)
        t.put_batch([f"{k:04d}" for k in keys], [[i] for _ in keys], [b""] * 50)
        rows |= dict.fromkeys(keys, i)
        for k in rnd.sample(range(600), 5):
            t.delete(f"{k:04d}")
            rows.pop(k, None)
        t.flush()
        t.maintain()
    levels = {s.level for s in t.segments}
    assert max(levels) >= 2
    for level in levels - {0}:
        mine = sorted((s for s in t.segments if s.level == level), key=lambda s: s.least_pk)
        assert all(a.most_pk < b.least_pk for a, b in zip(mine, mine[1:], strict=False))
    assert {int(bytes(r.pk)): r.a for r in t.live().collect()} == rows
    t.compact()
    assert not sum(s.tombstones for s in t.segments) and t.live().count() == len(rows)


def test_bitmaps(spark, tmp_path):
    schema = Schema((Attr("a", physical=INT, nullable=True), Attr("b", EQUALITY, VARBINARY, 0)), 0.02, False, 700)
    t = Database(spark, str(tmp_path / "db"), schema).table()
    df = spark.range(2000).selectExpr("cast(lpad(id, 5, '0') as binary) AS pk", "if(id % 9 = 0, null, id % 100) AS a", "cast('v' || (id % 7) as binary) AS b", "id AS o", "id % 50 = 3 AS gone")
    t.put_df(df, "o", "gone")
    assert len(t.segments) == 3
    per = {(r.attr, r.n) for r in t.bitmaps().groupBy("attr").agg(F.sum("card").alias("n")).collect()}
    data = [i for i in range(2000) if i % 50 != 3]
    assert per == {("", 40), ("a", sum(i % 9 != 0 for i in data)), ("b", len(data))}
    query = Query.of([("b", "=", "v1"), ("b", "=", "v2")], ("a", "<", 30))
    exact = [i for i in data if i % 7 in (1, 2) and i % 9 and i % 100 < 30]
    assert sorted(int(bytes(r.pk)) for r in t.bitmap_rows(query).collect()) == exact
    assert t.bitmap_select(query).agg(F.sum("card")).first()[0] >= len(exact)
    with pytest.raises(ValueError):
        t.bitmap_select(Query())


def test_a_repeated_micro_batch_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "db")
    t = Database(spark, root, SCHEMA).table()
    rows = spark.createDataFrame([("k%d" % i, i, float(i), "x", i, i == 3) for i in range(6)], "pk string, n int, f double, s string, o long, gone boolean")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    ingest(stream, t, "o", "gone").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.n for r in t.live().collect()) == [0, 1, 2, 4, 5]
    t.put("k1", [99, 1.0, "x"])
    t.flush()
    again = Database(spark, root, SCHEMA).table()
    again.put_df(rows, "o", "gone", ("stream", 0))
    assert sorted(r.n for r in again.live().collect()) == [0, 2, 4, 5, 99]


def test_ingests_side_by_side(spark, tmp_path):
    """put_dfs is put_df of one frame after the other, at one time; a refused frame refuses them all."""
    db = Database(spark, str(tmp_path / "db"), SCHEMA)
    one, all_ = db.create("one", SCHEMA), db.create("all", SCHEMA)
    rows = spark.range(60).selectExpr("cast(id % 20 AS string) AS pk", "cast(id AS int) AS n", "cast(id AS double) AS f", "cast(id % 3 AS string) AS s", "id AS o", "id % 7 = 3 AS gone")
    frames = [rows.where("o < 30"), rows.where("o > 90"), rows.where("o BETWEEN 25 AND 50"), rows.where("o > 40").withColumn("o", F.col("o") - 41)]
    at_a_time, most, write = set(), [0], all_._write

    def watched(*args):
        me = object()
        at_a_time.add(me)
        barrier.wait(60)
        most[0] = max(most[0], len(at_a_time))
        made = write(*args)
        at_a_time.discard(me)
        return made

    barrier = threading.Barrier(len(frames))
    for t in (one, all_):
        t.put("7", [0, 0.5, "x"])
    for f in frames:
        one.put_df(f, "o", "gone")
    all_.flush()  # no part of the ingests
    all_._write = watched
    all_.put_dfs(frames, "o", "gone")
    assert most[0] == len(frames) and all_.seq == one.seq and len(all_.segments) == len(one.segments) == 4
    for t in (one, all_):
        assert [(s.rows, s.least_seq, s.most_seq) for s in t.segments] == [(s.rows, s.least_seq, s.most_seq) for s in one.segments]
    assert all_.raw().orderBy("_seq").collect() == one.raw().orderBy("_seq").collect()
    with pytest.raises(ValueError):
        all_.put_dfs([frames[0], frames[2].withColumn("s", F.lit(None).cast("string")).withColumn("gone", F.lit(False))], "o", "gone")
    assert len(all_.segments) == 4 and not any(n.startswith("stage-") for n in all_.store.children("all"))


def test_empty_ingest(spark, tmp_path):
    t = Database(spark, str(tmp_path / "db"), SCHEMA).table()
    t.put_df(spark.createDataFrame([], "pk string, n int, f double, s string, o long"), "o")
    assert not t.segments and not t.live().count()
    assert t.estimate(Query.of(("f", "<", 1.0))).fallback_attrs == ["f"]
    t.delete("k")
    t.compact()
    assert not t.segments and not t.candidates(Query(), t.snapshot()).count()
    t.put("k", [None, math.nan, "x"])  # an attribute without values, one without numbers
    t.flush()
    assert t.live().count() == 1 and not t.find(Query.of(("n", "=", 1))).count() and not t.find(Query.of(("f", ">", 1.0))).count()


def test_generators_dumps_and_indexes_without_a_schema(spark, tmp_path):
    schema = Schema((*SCHEMA.attrs, Attr("u", physical=UINT, width=1), Attr("c", physical=BINARY, width=2)), 0.2)
    rows = random_rows(spark, schema, 500, 100, seed=4, deletes=0.1)
    assert rows.collect() == random_rows(spark, schema, 500, 100, seed=4, deletes=0.1).collect()
    t = Database(spark, str(tmp_path / "db"), schema).table()
    t.put_df(rows, "ordinal", "gone")
    newest = {r.pk: r for r in rows.orderBy("ordinal").collect()}
    assert t.live().count() == sum(not r.gone for r in newest.values()) and t.segments[0].tombstones == rows.where("gone").count()
    assert "bin 0" in t.dump(t.segments[0])
    t.put("k", [None, 1.5, "x", 3, "ab"], "p")
    assert t.dump_row(t.get("k").first()) == "k: n=NULL, f=1.5, s=x, u=3, c=ab | p"
    index = Database.read_index(spark, str(tmp_path / "db"))
    assert {r.attr for r in index.select("attr").distinct().collect()} == {a.name for a in schema.attrs}
