"""A versioned table: pending writes on the driver, immutable Parquet segments, one manifest per commit.

A segment is one file sorted by key and sequence number; a job writes many of them, with one index beside them. Reads see, for
each key, the newest version at or below the snapshot, and apply the filter to that version only: the filter is pushed down to find
versions that match, and those that have a newer version elsewhere are dropped, which needs keys and sequence numbers of the
segments that overlap only.

Segments stand in levels. Level 0 holds ingests, which may overlap; inside a deeper level key ranges are disjoint. Files are
deleted by `vacuum` only, so a frame that a read returned can be used after a compaction, by any session, until then.
"""

from __future__ import annotations

import bisect
import math
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from itertools import accumulate

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.intervals import EncodedQuery, encode
from tessella.functions.query import Query
from tessella.functions.schema import EQUALITY, RANGE, Schema
from tessella.operators import index as ix
from tessella.operators.estimator import VALUE_CAP, Bins, Estimate, Estimator, Values
from tessella.runtime import ship_package
from tessella.sources.manifest import FORMAT, Store

#: Level 0 is merged down from this many segments; a level holds this many times the rows of the one above it.
LEVEL0_SEGMENTS, LEVEL_RATIO = 4, 10
#: Ingests of put_dfs that are written at a time.
SIDE_BY_SIDE = 8
_REFUSED = "null keys, nulls in non-nullable attributes, or values that do not fit"


@dataclass(frozen=True)
class Segment:
    """One file of a job; name is the file's."""

    job: str
    name: str
    level: int
    rows: int
    tombstones: int
    least_pk: bytes
    most_pk: bytes
    least_seq: int
    most_seq: int
    single: bool  # one version for each key and no tombstone
    attrs: dict[str, ix.AttrSummary]

    @property
    def path(self) -> str:
        return f"{self.job}/data/{self.name}"

    def overlaps(self, other: Segment) -> bool:
        return self.least_pk <= other.most_pk and other.least_pk <= self.most_pk

    def to_json(self) -> dict:
        return self.__dict__ | {"least_pk": self.least_pk.hex(), "most_pk": self.most_pk.hex(), "attrs": {n: a.to_json() for n, a in self.attrs.items()}}

    @classmethod
    def from_json(cls, d: dict) -> Segment:
        attrs = {n: ix.AttrSummary.from_json(a) for n, a in d["attrs"].items()}
        return cls(**d | {"least_pk": bytes.fromhex(d["least_pk"]), "most_pk": bytes.fromhex(d["most_pk"]), "attrs": attrs})


@dataclass(frozen=True)
class Snapshot:
    """The segments, the pending rows and the sequence number of a moment. pin names a file that keeps its segments from vacuum."""

    version: int
    seq: int
    segments: tuple[Segment, ...]
    pending: tuple[tuple, ...]
    pin: str = ""


class Table:
    """One column family."""

    def __init__(self, spark: SparkSession, store: Store, name: str, schema: Schema, create: bool = False):
        self.spark, self.store, self.name, self.schema = spark, store, name, schema
        self.pending: list[tuple] = []
        self.estimator = Estimator(schema.attrs) if schema.estimator else None
        self.dropped = False
        if create:
            self.version, self.segments, self.seq, self.batches = 0, [], 0, {}
            self._publish()
        else:
            m = store.read(f"{name}/manifest-{self._versions()[-1]}.json")
            self.version = self._versions()[-1]
            if m["format"] != FORMAT:
                raise ValueError(f"{name}: format {m['format']}")
            if m["schema"] != schema.to_json():
                raise ValueError(f"{name}: the stored schema differs")
            self.segments, self.seq, self.batches = [Segment.from_json(s) for s in m["segments"]], m["seq"], m["batches"]

    def _versions(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self.store.children(self.name) if n.startswith("manifest-") and n.endswith(".json"))

    def _publish(self) -> None:
        content = {"format": FORMAT, "schema": self.schema.to_json(), "seq": self.seq, "batches": self.batches, "segments": [s.to_json() for s in self.segments]}
        self.store.commit(f"{self.name}/manifest-{self.version + 1}.json", content)
        self.version += 1

    def _alive(self) -> None:
        if self.dropped:
            raise ValueError(f"{self.name} was dropped")

    def _at(self, path: str) -> str:
        return f"{self.store.root}/{self.name}/{path}"

    # writes

    def put(self, pk, attrs, payload=b"") -> None:
        self.put_batch([pk], [attrs], [payload])

    def put_batch(self, pks: list, attrs: list, payloads: list) -> None:
        """All rows or none; of equal keys the later one wins. Attributes by position, or by name in a dict."""
        self._alive()
        if not len(pks) == len(attrs) == len(payloads):
            raise ValueError("keys, attributes and payloads differ in number")
        rows = []
        for pk, values, payload in zip(pks, attrs, payloads, strict=True):
            if isinstance(values, dict):
                values = [values[a.name] for a in self.schema.attrs]
            if len(values) != len(self.schema.attrs):
                raise ValueError(f"{len(values)} attributes, not {len(self.schema.attrs)}")
            rows.append((_bytes(pk), *[a.check_value(v) for a, v in zip(self.schema.attrs, values, strict=True)], _bytes(payload)))
        for r in rows:
            self.seq += 1
            self.pending.append((*r, self.seq, 0))

    def delete(self, pk) -> None:
        """A tombstone, whether the key exists or not."""
        self._alive()
        self.seq += 1
        self.pending.append((_bytes(pk), *[None] * len(self.schema.attrs), None, self.seq, 1))

    def put_df(self, df: DataFrame, order: str, deletes: str | None = None, batch: tuple[str, int] | None = None) -> None:
        """Bulk ingest: columns pk, the attributes, payload (optional); `order` numbers the versions (a long from 0, later wins,
        unique); rows whose boolean column `deletes` is true are tombstones. Becomes segments of its own. `batch` is a source's
        name and a growing number, committed with the rows: a number not above the last one changes nothing."""
        self._alive()
        if batch and batch[1] <= self.batches.get(batch[0], -1):
            return
        self._ingest([df], order, deletes, batch)

    def put_dfs(self, dfs: list[DataFrame], order: str, deletes: str | None = None) -> None:
        """put_df of one frame after the other, but they are staged and written side by side. If one is refused, none is taken."""
        self._alive()
        self._ingest(dfs, order, deletes)

    def _ingest(self, dfs: list[DataFrame], order: str, deletes: str | None, batch: tuple[str, int] | None = None) -> None:
        self.flush()
        stages = [f"stage-{uuid.uuid4().hex}" for _ in dfs]
        try:
            sizes = self._side_by_side(self._stage, [(df, order, deletes, stage) for df, stage in zip(dfs, stages, strict=True)])
        except PySparkException as e:
            for stage in stages:
                self.store.delete(f"{self.name}/{stage}")
            if _REFUSED in str(e):
                raise ValueError(_REFUSED) from e
            raise
        # Each frame's numbers begin above the last one's.
        above = list(accumulate([max(0, last) for _, last in sizes], initial=self.seq))
        staged = [self.spark.read.schema(self.schema.versions).parquet(self._at(stage)).withColumn("_seq", F.col("_seq") + begin) for stage, begin in zip(stages, above, strict=False)]
        for made in self._side_by_side(self._write, [(rows, n, 0) for rows, (n, _) in zip(staged, sizes, strict=True)]):
            self._commit(made, [], batch)
        for stage in stages:
            self.store.delete(f"{self.name}/{stage}")

    def _side_by_side(self, do: Callable, calls: list[tuple]) -> list:
        """Results of the calls, whose jobs share the executors; a single one stays in its thread."""
        if len(calls) == 1:
            return [do(*calls[0])]
        ship_package(self.spark)
        with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
            return list(pool.map(lambda call: do(*call), calls))

    def _stage(self, df: DataFrame, order: str, deletes: str | None, stage: str) -> tuple[int, int]:
        """Writes versions numbered from 1; returns how many they are and the last number. Rows are checked while they are staged: the sort
        by key range needs two looks at them."""
        op = F.coalesce(F.col(deletes), F.lit(False)).cast("int").cast("byte") if deletes else F.lit(0).cast("byte")
        payload = F.col("payload").cast("binary") if "payload" in df.columns else F.lit(None).cast("binary")
        # A tombstone has no attributes.
        value = lambda a: F.when(op == 0, F.col(a.name).cast(a.spark_type))
        rows = df.select(F.col("pk").cast("binary").alias("pk"), *[value(a).alias(a.name) for a in self.schema.attrs], payload.alias("payload"), (F.col(order).cast("long") + 1).alias("_seq"), op.alias("_op"))
        wrong = F.col("pk").isNull() | F.col("_seq").isNull()
        for a in self.schema.attrs:
            if not a.nullable:
                wrong = wrong | ((F.col("_op") == 0) & F.col(a.name).isNull())
            if a.physical == "binary":
                wrong = wrong | (F.octet_length(a.name) != a.width)
            if a.physical == "uint":
                wrong = wrong | ~F.col(a.name).between(*[F.lit(str(x)).cast("decimal(20,0)") for x in a.limits()])
        checked = F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.lit(_REFUSED)).cast("binary")).otherwise(F.col("pk"))
        rows.withColumn("pk", checked).write.parquet(self._at(stage))
        r = self.spark.read.schema(self.schema.versions).parquet(self._at(stage)).agg(F.count(F.lit(1)), F.max("_seq")).first()
        return r[0], r[1] or 0

    def flush(self) -> None:
        """Pending writes become a segment; if that fails they stay pending."""
        self._alive()
        if self.pending:
            rows = self.spark.createDataFrame(self._spark_rows(self.pending), self.schema.versions)
            made = self._write(rows, len(self.pending), 0)
            self.pending = []
            self._commit(made, [])

    def _spark_rows(self, rows: list[tuple]) -> list[tuple]:
        wide = [i + 1 for i, a in enumerate(self.schema.attrs) if a.physical == "uint" and a.width == 8]
        fix = lambda r: tuple(Decimal(v) if i in wide and v is not None else bytearray(v) if isinstance(v, bytes) else v for i, v in enumerate(r))
        return [fix(r) for r in rows]

    def _write(self, rows: DataFrame, n_rows: int, level: int, newest: bool = False, tombstones: bool = True) -> list[Segment]:
        """Segments of about schema.segment_rows rows, dealt by key range: all versions of a key stand in one of them.

        One sort by key range serves the dealing, the order of the files and the ages of versions. newest: older versions of a
        key go, and without tombstones those too.
        """
        if not n_rows:
            return []
        job, parts = f"job-{uuid.uuid4().hex}", math.ceil(n_rows / self.schema.segment_rows)
        rows = rows.select(self.schema.versions.names).repartitionByRange(parts, "pk")
        rows = rows.withColumn("_age", F.row_number().over(Window.partitionBy("pk").orderBy(F.desc("_seq"))))
        if newest:
            rows = rows.where("_age = 1" if tombstones else "_age = 1 AND _op = 0")
        rows.write.parquet(self._at(f"{job}/data"))
        written = self._files([f"{job}/data"])
        stats = written.groupBy("_segment").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("_op").cast("long")).alias("gone"), F.min("_seq").alias("least_seq"), F.max("_seq").alias("most_seq"), F.max("_age").alias("age")
        ).collect()  # a row for each segment
        ends = self._ends(written, {s["_segment"]: s["n"] for s in stats})
        none = {a.name: ix.AttrSummary() for a in self.schema.attrs}
        known = ix.build(written, self.schema, self._at(f"{job}/index")) if self.schema.attrs and stats else {}
        self.store.delete(f"{self.name}/{job}/index-runs")
        return [
            Segment(job, s["_segment"], level, s.n, s.gone, *ends[s["_segment"]], s.least_seq, s.most_seq, s.age == 1 and not s.gone, none | known.get(s["_segment"], {}))
            for s in sorted(stats, key=lambda s: ends[s["_segment"]])
        ]

    def _ends(self, written: DataFrame, sizes: dict[str, int]) -> dict[str, tuple[bytes, bytes]]:
        """The least and the largest key of each file: files are in key order, so these are their first and last rows. A minimum of byte
        strings would sort all rows."""
        if not sizes:
            return {}
        last = self.spark.createDataFrame([(name, n - 1) for name, n in sizes.items()], "_segment string, _last long")
        rows = written.select("_segment", "_row", "pk").join(F.broadcast(last), "_segment").where("_row = 0 OR _row = _last")
        found: dict[str, list[tuple[int, bytes]]] = {}
        for r in rows.collect():  # two rows for each segment
            found.setdefault(r["_segment"], []).append((r["_row"], bytes(r.pk)))
        return {name: (min(at)[1], max(at)[1]) for name, at in found.items()}

    def _commit(self, made: list[Segment], gone: list[Segment], batch: tuple[str, int] | None = None) -> None:
        if made or gone or batch:
            names = {s.name for s in gone}
            self.segments = [*[s for s in self.segments if s.name not in names], *made]
            self.seq = max([self.seq, *[s.most_seq for s in made]])
            if batch:
                self.batches = self.batches | {batch[0]: batch[1]}
            self._publish()

    # compaction

    def compact(self) -> None:
        """Everything into the last level: disjoint segments of one version a key, without tombstones."""
        self._alive()
        self.flush()
        if self.segments:
            self._merge(list(self.segments), max(1, *[s.level for s in self.segments]))

    def maintain(self) -> int:
        """Levelled compaction: merges down what is over its level's size, with the segments of the next level that it overlaps.
        Returns the number of merges."""
        self._alive()
        merges = 0
        while (found := self._due()) is not None:
            self._merge(*found)
            merges += 1
        return merges

    def _due(self) -> tuple[list[Segment], int] | None:
        levels: dict[int, list[Segment]] = {}
        for s in self.segments:
            levels.setdefault(s.level, []).append(s)
        if len(top := levels.get(0, [])) >= LEVEL0_SEGMENTS:
            return top + [s for s in levels.get(1, []) if any(s.overlaps(t) for t in top)], 1
        room = LEVEL0_SEGMENTS * self.schema.segment_rows
        for level in range(1, max(levels, default=0) + 1):
            mine, below = levels.get(level, []), levels.get(level + 1, [])
            if sum(s.rows for s in mine) > room:
                # The segment that meets the fewest rows below it moves down.
                least = min(mine, key=lambda s: (sum(t.rows for t in below if s.overlaps(t)), s.name))
                return [least, *[t for t in below if least.overlaps(t)]], level + 1
            room *= LEVEL_RATIO
        return None

    def _merge(self, old: list[Segment], level: int) -> None:
        """The newest versions of these segments as segments of a level. Tombstones stay while anything else may hold their keys."""
        names = {s.name for s in old}
        hidden = any(s.overlaps(t) for s in old for t in self.segments if t.name not in names)
        self._commit(self._write(self._read(old), sum(s.rows for s in old), level, True, hidden), old)

    def vacuum(self, older_than: float = 7 * 24 * 3600.0) -> int:
        """Delete files that no manifest younger than older_than seconds and no pinned snapshot knows; returns how many went.

        Frames that were made before then must not be read any more.
        """
        self._alive()
        keep = {self.version}
        for n in self.store.children(self.name):
            if n.startswith("pin-"):
                keep.add(self.store.read(f"{self.name}/{n}")["version"])
        versions = self._versions()
        keep |= {v for v in versions if self.store.age(f"{self.name}/manifest-{v}.json") < older_than}
        used = {(s["job"], s["name"]) for v in keep & set(versions) for s in self.store.read(f"{self.name}/manifest-{v}.json")["segments"]}
        jobs, gone = {j for j, _ in used}, 0
        for v in set(versions) - keep:
            self.store.delete(f"{self.name}/manifest-{v}.json")
        for child in self.store.children(self.name):
            if child.startswith(("job-", "stage-")) and child not in jobs:
                if child in {s.job for s in self.segments} or self.store.age(f"{self.name}/{child}") < older_than:
                    continue
                gone += len(self.store.children(f"{self.name}/{child}/data")) or 1
                self.store.delete(f"{self.name}/{child}")
            elif child in jobs:
                for f in self.store.children(f"{self.name}/{child}/data"):
                    if f.endswith(".parquet") and (child, f) not in used:
                        self.store.delete(f"{self.name}/{child}/data/{f}")
                        gone += 1
        return gone

    # snapshots and reads

    def snapshot(self, pinned: bool = False) -> Snapshot:
        """The present state. A pinned one is kept from every session's vacuum until it is released; others for older_than."""
        self._alive()
        pin = f"pin-{uuid.uuid4().hex}.json" if pinned else ""
        if pin:
            self.store.commit(f"{self.name}/{pin}", {"version": self.version})
        return Snapshot(self.version, self.seq, tuple(self.segments), tuple(self.pending), pin)

    def release(self, snapshot: Snapshot) -> None:
        if snapshot.pin:
            self.store.delete(f"{self.name}/{snapshot.pin}")

    def _now(self) -> Snapshot:
        self._alive()
        return Snapshot(self.version, self.seq, tuple(self.segments), tuple(self.pending))

    def _files(self, paths: list[str]) -> DataFrame:
        """Stored versions with _segment, the name of their file, and _row, their number in it."""
        rows = self.spark.read.schema(self.schema.stored).parquet(*[self._at(p) for p in paths])
        return rows.select(*self.schema.stored.names, F.col("_metadata.file_name").alias("_segment"), F.col("_metadata.row_index").alias("_row"))

    def _read(self, segments: list[Segment] | tuple[Segment, ...], extra: bool = False) -> DataFrame:
        """A missing file fails the read."""
        if not segments:
            empty = self.spark.createDataFrame([], self.schema.stored)
            return empty.withColumns({"_segment": F.lit(""), "_row": F.lit(0).cast("long")}) if extra else empty
        if extra:
            return self._files([s.path for s in segments])
        return self.spark.read.schema(self.schema.stored).parquet(*[self._at(s.path) for s in segments])

    def _memtable(self, snapshot: Snapshot) -> DataFrame:
        """The newest pending version of each key."""
        newest = {r[0]: r for r in snapshot.pending}
        rows = self.spark.createDataFrame(self._spark_rows(list(newest.values())), self.schema.versions)
        return rows.withColumn("_age", F.lit(1)).select(self.schema.stored.names)

    def raw(self, snapshot: Snapshot | None = None) -> DataFrame:
        """Every stored and pending version up to the snapshot."""
        at = snapshot or self._now()
        memory = self.spark.createDataFrame(self._spark_rows(list(at.pending)), self.schema.versions)
        return self._read(at.segments).select(self.schema.versions.names).unionByName(memory)

    def live(self, snapshot: Snapshot | None = None) -> DataFrame:
        return self.find(Query(), snapshot)

    def index(self, segments: list[Segment] | tuple[Segment, ...] | None = None) -> DataFrame:
        """The index rows of segments (all live ones): bins, values and summaries."""
        segments = self.segments if segments is None else segments
        rows = ix.read(self.spark, sorted({self._at(f"{s.job}/index") for s in segments})) if self.schema.attrs else ix.read(self.spark, [])
        names = self.spark.createDataFrame([(s.name,) for s in segments], "segment string")
        return rows.join(F.broadcast(names), "segment", "left_semi")  # a row for each segment

    def matching(self, query: Query, snapshot: Snapshot | None = None) -> tuple[list[Segment], EncodedQuery]:
        """Segments that can hold a match, by their summaries, and by their dictionaries where a summary has none."""
        at, coded = snapshot or self._now(), encode(query, self.schema)
        good = [s for s in at.segments if ix.can_match(s.attrs, coded)]
        asked = [e for clause in coded.clauses for e in clause if e.key is not None]
        if not good or not asked or all(s.attrs[e.attr].keys is not None for s in good for e in asked):
            return good, coded
        has = {(r.segment, r.j) for r in ix.touched(self.index(good), asked).select("segment", "j").collect()}
        may = lambda s, e: s.attrs[e.attr].possible(e) if e.key is None else (s.name, asked.index(e)) in has
        return [s for s in good if all(any(may(s, e) for e in clause) for clause in coded.clauses)], coded

    def settled(self, snapshot: Snapshot | None = None) -> list[Segment]:
        """Segments whose rows are final: one version a key, no tombstone, and no other segment or pending row in their key range."""
        at = snapshot or self._now()
        by, pending = sorted(at.segments, key=lambda s: (s.least_pk, s.most_pk)), sorted(r[0] for r in at.pending)
        out, reach = [], None
        for s, after in zip(by, [*by[1:], None], strict=False):
            alone = (reach is None or reach < s.least_pk) and (after is None or after.least_pk > s.most_pk)
            if alone and s.single and bisect.bisect_left(pending, s.least_pk) == bisect.bisect_right(pending, s.most_pk):
                out.append(s)
            reach = s.most_pk if reach is None else max(reach, s.most_pk)
        return out

    def find(self, query: Query, snapshot: Snapshot | None = None) -> DataFrame:
        """Live rows that match, unordered. The filter is pushed to all segments that can match; settled ones need no shuffle, and
        of the others' matching versions those go that have a newer version in an overlapping segment or in memory."""
        at, where = snapshot or self._now(), query.to_column(self.schema)
        good, coded = self.matching(query, at)
        if coded.unsat:
            return self.spark.createDataFrame([], self.schema.rows)
        done, names = {s.name for s in self.settled(at)}, self.schema.rows.names
        plain, mixed = [s for s in good if s.name in done], [s for s in good if s.name not in done]
        found = self._read(plain).where(where).select(names)
        if not mixed and not at.pending:
            return found
        shadows = [t for t in at.segments if t.name not in done and any(t.name != s.name and t.most_seq > s.least_seq and t.overlaps(s) for s in mixed)]
        parts = [found] if plain else []
        if mixed:
            some = self._read(mixed).where("_age = 1").where((F.col("_op") == 0) & where).select(self.schema.versions.names)
            parts.append(self._unshadowed(some, shadows, at).select(names))
        if at.pending:  # nothing is newer than these
            parts.append(self._memtable(at).where((F.col("_op") == 0) & where).select(names))
        return reduce(DataFrame.unionByName, parts)

    def _unshadowed(self, versions: DataFrame, shadows: list[Segment], at: Snapshot) -> DataFrame:
        """Versions without those that have a newer one in the segments or in memory."""
        newer = [self._read(shadows).where("_age = 1")] if shadows else []
        if at.pending:
            newer.append(self._memtable(at))
        if not newer:
            return versions
        other = reduce(DataFrame.unionByName, newer).select(F.col("pk").alias("_pk"), F.col("_seq").alias("_newer"))
        return versions.join(other, (F.col("pk") == F.col("_pk")) & (F.col("_newer") > F.col("_seq")), "left_anti")

    def deleted(self, snapshot: Snapshot | None = None) -> DataFrame:
        """Keys whose newest version is a tombstone, as far as compaction has left them."""
        at = snapshot or self._now()
        held = [s for s in at.segments if s.tombstones]
        gone = self._unshadowed(self._read(held).where("_age = 1 AND _op = 1").select(self.schema.versions.names), list(at.segments), at)
        return gone.select("pk").unionByName(self._memtable(at).where("_op = 1").select("pk"))

    def scan(self, query: Query | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """find in ascending key order."""
        return self.find(query or Query(), snapshot).orderBy("pk")

    def cursor(self, query: Query | None = None, snapshot: Snapshot | None = None) -> Iterator[Row]:
        """scan row by row; the driver holds one partition at a time."""
        return self.scan(query, snapshot).toLocalIterator()

    def candidates(self, query: Query, snapshot: Snapshot) -> DataFrame:
        """Keys whose bins match at the snapshot: a superset of the matches that may hold stale and deleted keys."""
        if snapshot is None:
            raise ValueError("candidates need a snapshot")
        good, coded = self.matching(query, snapshot)
        keys = self._memtable(snapshot).select("pk")
        if coded.unsat:
            return keys.where(F.lit(False))
        return ix.candidates(self._read(good, True), self.index(good), coded, self.schema).select("pk").unionByName(keys).distinct()

    def get(self, pk, snapshot: Snapshot | None = None) -> DataFrame:
        """The live row of a key; only segments whose key range holds it are read."""
        at, key = snapshot or self._now(), _bytes(pk)
        held = [s for s in at.segments if s.least_pk <= key <= s.most_pk]
        rows = self._read(held).unionByName(self._memtable(at)).where(F.col("pk") == F.lit(bytearray(key)))
        return rows.orderBy(F.desc("_seq")).limit(1).where("_op = 0").select(self.schema.rows.names)

    # bitmaps

    def bitmaps(self, attrs: list[str] | None = None, segments: list[Segment] | None = None) -> DataFrame:
        """segment, attr, bin, bucket, bm, card: bitmaps of row numbers for each bin of the attributes, and for tombstones (attr '')."""
        segments = self.segments if segments is None else segments
        which = [self.schema.attr(a) for a in attrs] if attrs is not None else list(self.schema.attrs)
        return ix.bitmaps(ix.row_bins(self._read(segments, True), self.index(segments), which), which)

    def bitmap_select(self, query: Query) -> DataFrame:
        """segment, bucket, bm, card of the stored rows whose bins satisfy the query."""
        good, coded = self.matching(query)
        if coded.unsat or not coded.clauses:
            raise ValueError("a query without clauses or matches selects no bitmaps")
        asked = sorted({e.attr for clause in coded.clauses for e in clause})
        return ix.select_bitmaps(self.bitmaps(asked, good), self.index(good), coded)

    def bitmap_rows(self, query: Query) -> DataFrame:
        """Stored versions at the selected bits, verified against the query; shadowed ones stay."""
        good, _ = self.matching(query)
        rows = ix.at_bits(self._read(good, True), self.bitmap_select(query))
        return rows.where(query.to_column(self.schema)).select(self.schema.versions.names)

    # statistics

    def _refresh(self) -> None:
        rows = {s.name: s.rows for s in self.segments}
        if not self.estimator.stale(rows):
            return
        ranges: dict[str, list[Bins]] = {}
        index = self.index()
        per = index.where("kind = 'bins' AND low IS NOT NULL").groupBy("segment", "attr").agg(F.array_sort(F.collect_list(F.struct("bin", "low", "high", "n"))).alias("b"))  # as many as the budget
        by = {s.name: s for s in self.segments}
        for r in per.toLocalIterator():
            ranges.setdefault(r.attr, []).append(Bins([*[bytes(b.low) for b in r.b], bytes(r.b[-1].high)], [b.n for b in r.b], by[r.segment].attrs[r.attr].distinct))
        values = {}
        for a in self.schema.attrs:
            if a.index == EQUALITY and any(s.attrs[a.name].rows for s in self.segments):
                top = self._shared(index, a.name).groupBy("low").agg(F.sum("n_rows").alias("n")).orderBy(F.desc("n"), "low").limit(VALUE_CAP + 1).collect()
                bin_rows = sum(s.attrs[a.name].rows / s.attrs[a.name].bins for s in self.segments)
                values[a.name] = Values({bytes(r.low): r.n for r in top[:VALUE_CAP]}, len(top) > VALUE_CAP, bin_rows)
        self.estimator.rebuild(rows, sum(s.rows - s.tombstones for s in self.segments), ranges, values)

    def _shared(self, index: DataFrame, attr: str) -> DataFrame:
        """segment, low (the value's key), text, n_rows as the bins know them: values of one bin share its rows evenly."""
        values = index.where((F.col("kind") == "values") & (F.col("attr") == attr)).select("segment", "bin", "low", "text", "n")
        bins = values.groupBy("segment", "bin").agg((F.sum("n") / F.count(F.lit(1))).alias("n_rows"))
        return values.join(bins, ["segment", "bin"]).select("segment", "low", "text", "n_rows")

    def estimate(self, query: Query) -> Estimate:
        """Statistics are brought up to date first if enough has changed."""
        self._alive()
        if self.estimator is None:
            raise ValueError(f"{self.name} keeps no statistics")
        self._refresh()
        return self.estimator.estimate(encode(query, self.schema), len(self.pending))

    def statistics(self) -> DataFrame:
        """One row for each segment."""
        rows = [(s.name, s.level, s.rows, s.tombstones, bytearray(s.least_pk), bytearray(s.most_pk), s.least_seq, s.most_seq, sum(a.bins for a in s.attrs.values())) for s in self.segments]
        return self.spark.createDataFrame(rows, "segment string, level int, n_rows long, tombstones long, least_pk binary, most_pk binary, least_seq long, most_seq long, bins long")

    def zones(self, attr: str) -> DataFrame:
        """segment, least, most, distinct, n_rows of an attribute, from the summaries."""
        a = self.schema.attr(attr)
        rows = [(s.name, *[ix.typed(a, k) for k in (x.least, x.most)], x.distinct, x.rows) for s in self.segments if (x := s.attrs[a.name]).rows]
        kind = "double" if a.physical == "float" else a.spark_type.simpleString()
        return self.spark.createDataFrame(rows, f"segment string, least {kind}, most {kind}, distinct long, n_rows long")

    def histogram(self, attr: str, segment: Segment | None = None) -> DataFrame:
        """segment, bin, low, high, n_rows of an attribute's bins, from the index; low and high are values of range attributes."""
        a = self.schema.attr(attr)
        rows = self.index([segment] if segment else None).where((F.col("kind") == "bins") & (F.col("attr") == a.name))
        if a.index != RANGE:
            return rows.select("segment", "bin", F.col("n").alias("n_rows"))
        kind = "double" if a.physical == "float" else a.spark_type.simpleString()
        found = [(r.segment, r.bin, ix.typed(a, bytes(r.low)), ix.typed(a, bytes(r.high)), r.n) for r in rows.toLocalIterator()]
        return self.spark.createDataFrame(found, f"segment string, bin int, low {kind}, high {kind}, n_rows long")

    def value_counts(self, attr: str) -> DataFrame:
        """segment, value, n_rows of an equality attribute as its bins know them: values of one bin share its rows evenly."""
        a = self.schema.attr(attr)
        if a.index != EQUALITY:
            raise ValueError(f"{attr} has range bins")
        value = F.unhex("text") if a.is_bytes else F.col("text").cast(a.spark_type)
        return self._shared(self.index(), a.name).select("segment", value.alias("value"), "n_rows")

    def top_values(self, attr: str, k: int) -> DataFrame:
        """value, n_rows of the k most frequent values of an equality attribute, exactly; ties to the smaller value."""
        a = self.schema.attr(attr)
        if a.index != EQUALITY:
            raise ValueError(f"{attr} has range bins")
        value = F.unhex("text") if a.is_bytes else F.col("text").cast(a.spark_type)
        rows = self.index().where((F.col("kind") == "values") & (F.col("attr") == a.name)).groupBy("low", "text").agg(F.sum("n").alias("n_rows"))
        return rows.orderBy(F.desc("n_rows"), "low").limit(k).select(value.alias("value"), "n_rows")

    def dump(self, segment: Segment) -> str:
        """The index of a segment as text, for people."""
        lines = [f"{segment.name}: {segment.rows} rows, {segment.tombstones} tombstones"]
        for r in self.index([segment]).where("kind = 'bins'").orderBy("attr", "bin").toLocalIterator():
            edge = "" if r.low is None else f" [{bytes(r.low).hex()}, {bytes(r.high).hex()}{']' if r.last else ')'}"
            lines.append(f"  {r.attr} bin {r.bin}{edge}: {r.n}")
        return "\n".join(lines)

    def dump_row(self, row: Row) -> str:
        """A row as text, for people."""
        shown = lambda v: bytes(v).decode("utf-8", "backslashreplace") if isinstance(v, (bytes, bytearray)) else "NULL" if v is None else str(v)
        return f"{shown(row.pk)}: " + ", ".join(f"{a.name}={shown(row[a.name])}" for a in self.schema.attrs) + f" | {shown(row.payload)}"


def _bytes(value) -> bytes:
    return value.encode() if isinstance(value, str) else bytes(value or b"")
