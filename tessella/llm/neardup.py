"""Operator 10: MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes the set of its 64-bit word-shingle hashes, a 128-bit fingerprint of that set and a MinHash
   signature. Equal sets are one class, represented by its smallest id; from here on only representatives take part.
2. Signatures are banded. In each bucket all representatives are compared with one pivot. Buckets that still hold more
   than one component after that make families; the members outside a family's largest component are compared with all
   its members, in cells of bounded size. Members of one component are never compared again and a cell returns a forest,
   so a group of near copies costs a few rows for each member and no pairs.
3. A candidate pair is verified sequentially: signature batches are compared until the posterior probability of a
   similarity at the threshold or above (uniform prior, so a Beta posterior) falls below `miss`; then it is dropped.
4. Survivors are confirmed on their full shingle sets, and confirmed links make components.

With 32 bands of 4 rows a pair at similarity 0.75 shares no bucket with probability 5e-6; `miss` is 1e-6 a check.

Edge cases: a text of fewer words than a shingle is one shingle of all its words; null, empty and blank texts have no
shingles and link with nothing; rows that share an id are one document: its texts' links are all its own; rows with a null
id take no part, have no component and are kept; repeated rows are in one class; an empty table gives an empty
result; extra columns take no part; words are bytes, so texts need be no valid UTF-8.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import checked_broadcast, raw_texts, write_table
from tessella.llm.components import components
from tessella.runtime import ship_package

SHINGLE, BANDS, ROWS, BATCH = 5, 32, 4, 16
THRESHOLD_PERCENT, MISS = 75, 1e-6
#: A comparison cell holds up to X_BLOCK by M_BLOCK documents of a family and CELL_BYTES of shingles on the long side.
X_BLOCK, M_BLOCK, CELL_BYTES, GROUP_DOCS = 512, 2048, 32 << 20, 20_000
_MUL = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > 200_000:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = out * _MUL + h[j : len(h) - k + 1 + j]
        out ^= out >> np.uint64(31)
    return np.unique(out)


@functools.lru_cache(1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rnd = np.random.default_rng(20240229)
    n = BANDS * ROWS
    return rnd.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rnd.integers(0, 1 << 63, n, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima, 32 bits each."""
    a, b = _permutations()
    mixed = (shingles ^ (shingles >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(29)
    best = np.full(len(a), np.iinfo(np.uint64).max)
    for i in range(0, len(mixed), 1024):
        np.minimum(best, (mixed[i : i + 1024, None] * a + b).min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


@functools.lru_cache(8)
def fewest_matches(threshold: float, miss: float, hashes: int, batch: int) -> tuple[int, ...]:
    """For each batch end n: the fewest of n equal hashes for which P(similarity >= threshold | matches) >= miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose tail is P(Bin(n + 1, threshold) <= m).
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def bayes_survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row numbers of the signature pairs that pass every batch."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), int)
    for i, least in enumerate(fewest_matches(THRESHOLD_PERCENT / 100, MISS, BANDS * ROWS, BATCH)):
        at = slice(i * BATCH, (i + 1) * BATCH)
        matches = matches + (a[alive, at] == b[alive, at]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    return alive


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * |intersection| >= THRESHOLD_PERCENT * |union| for sorted sets."""
    if 100 * min(len(a), len(b)) < THRESHOLD_PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= THRESHOLD_PERCENT * (len(a) + len(b) - both)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind)


def sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per document row: doc_id, n_shingles, fp, sig (both null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp, sig = [], [], []
            for t in raw_texts(batch.column(1)):
                s = shingle_set(t)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), _column(n, pa.int64()), _column(fp, pa.binary()), _column(sig, pa.binary())], names=["doc_id", "n_shingles", "fp", "sig"])

    base = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, n_shingles long, fp binary, sig binary")


def buckets(reps: DataFrame) -> DataFrame:
    """(bucket, id) for each band of each representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), 1))
            for r in range(ROWS):
                key = (key ^ sig[:, :, r]) * _MUL
                key ^= key >> np.uint64(32)
            ids = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(ids, pa.int64())], names=["bucket", "id"])

    return reps.select("id", "sig").mapInArrow(run, "bucket long, id long")


def _signed(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) that survive the sequential comparison of their signatures."""
    with_sigs = pairs.join(reps.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a").join(reps.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
                yield batch.select(["a", "b"]).take(pa.array(bayes_survivors(a, b)))

    return with_sigs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _full_sets(ids: DataFrame, docs: DataFrame, fps: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, shingles) of the representatives in ids: their texts are cut again."""
    needed = ids.join(fps, "id").select(F.col("id").alias("need"), F.col("fp").alias("need_fp"))
    needed = checked_broadcast(needed, 100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = [], []
            for i, t, fp in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                s = shingle_set(t).tobytes()
                if xxhash.xxh3_128_digest(s) == fp:  # rows that share the id may have other texts
                    ids.append(i)
                    sets.append(s)
            yield pa.RecordBatch.from_arrays([_column(ids, pa.int64()), _column(sets, pa.binary())], names=["id", "shingles"])

    texts = docs.select(docs[doc_id].cast("long").alias("id"), docs[text].cast("string").alias("text"))
    found = texts.join(needed, texts["id"] == needed["need"]).select("id", "text", "need_fp").mapInArrow(run, "id long, shingles binary")
    return write_table(found.distinct(), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full shingle sets are similar enough."""
    both = pairs.join(sets.withColumnsRenamed({"id": "a", "shingles": "set_a"}), "a").join(sets.withColumnsRenamed({"id": "b", "shingles": "set_b"}), "b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(confirm, "a long, b long").distinct()


def _compare(ids: np.ndarray, comp: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], xs: np.ndarray, ms: np.ndarray) -> list[tuple[int, int]]:
    """Confirmed links of xs with ms that join components, as a forest: pairs that are joined already are not compared."""
    parent = {int(c): int(c) for c in np.unique(comp)}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    out = []
    group = comp.copy()
    for i in xs.tolist():
        others = ms[group[ms] != group[i]]
        others = others[bayes_survivors(np.broadcast_to(sig[i], (len(others), sig.shape[1])), sig[others])]
        for j in others.tolist():
            a, b = root(int(group[i])), root(int(group[j]))
            if a != b and similar(sets[i], sets[j]):
                parent[max(a, b)] = min(a, b)
                group[group == max(a, b)] = min(a, b)
                out.append((int(ids[i]), int(ids[j])))
    return out


def _family_links(members: DataFrame, reps: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Links between the components that still meet in a bucket. members: bucket, id, comp.

    Documents that meet, directly or over others, are a family. The members outside its largest component are compared
    with all its members, in cells of bounded size; a cell returns at most one link for each component that it joins.
    """
    # A table of its own: a small one is broadcast, and next to a large one the join can split a bucket of very many.
    least = checked_broadcast(members.groupBy("bucket").agg(F.min("id").alias("v")), 100_000)
    family = components(members.join(least, "bucket").select(F.col("id").alias("u"), "v"), "families")
    rows = write_table(members.select("id", "comp").distinct().join(family, "id").withColumnRenamed("component", "family"), "family")
    sets = _full_sets(rows.select("id").distinct(), docs, reps.select("id", "fp"), doc_id, text)
    rows = write_table(rows.join(reps.select("id", "sig"), "id").join(sets, "id"), "family_sets")
    counts = rows.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum(F.octet_length("shingles")).alias("bytes"))
    sizes = counts.groupBy("family").agg(F.sum("k").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("k", "comp")).alias("m"))
    m_blocks = F.greatest(F.ceil(F.col("n") / M_BLOCK), F.ceil(F.col("bytes") / CELL_BYTES)).cast("int")
    x_blocks = F.ceil((F.col("n") - F.col("m.k")) / X_BLOCK).cast("int")
    sizes = sizes.select("family", F.col("m.comp").alias("main"), m_blocks.alias("m_blocks"), x_blocks.alias("x_blocks")).where("x_blocks > 0")
    rows = rows.join(sizes, "family")
    h = F.xxhash64("id", F.lit(3))
    whole = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    columns = ["family", "x", "m", "left", "id", "comp", "sig", "shingles"]
    left = rows.where(F.col("comp") != F.col("main")).withColumn("left", F.lit(True)).withColumn("x", F.pmod(h, F.col("x_blocks")).cast("int")).withColumn("m", F.explode(whole("m_blocks")))
    right = rows.withColumn("left", F.lit(False)).withColumn("m", F.pmod(h, F.col("m_blocks")).cast("int")).withColumn("x", F.explode(whole("x_blocks")))
    cells = left.select(columns).unionByName(right.select(columns))
    # Many cells are tiny, so a task group holds the cells of one hash value; the number of values follows the input.
    n_groups = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), reps.count() // GROUP_DOCS)
    cells = cells.withColumn("g", F.pmod(F.xxhash64("family", "x", "m"), F.lit(n_groups)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("family", "ascending"), ("x", "ascending"), ("m", "ascending")])
        place = [table.column(c).to_numpy() for c in ("family", "x", "m")]
        cuts = np.flatnonzero(np.any([p[1:] != p[:-1] for p in place], axis=0)) + 1
        found: list[tuple[int, int]] = []
        for lo, hi in zip([0, *cuts], [*cuts, len(table)], strict=True):
            part = table.slice(lo, hi - lo)
            left = np.array(part.column("left").to_pylist(), bool)
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(len(left), -1)
            sets = [np.frombuffer(s, np.uint64) for s in part.column("shingles").to_pylist()]
            found += _compare(part.column("id").to_numpy(), part.column("comp").to_numpy(), sig, sets, np.flatnonzero(left), np.flatnonzero(~left))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return cells.groupBy("g").applyInArrow(run, "a long, b long")


def links(docs: DataFrame, reps: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Confirmed links (a, b) between representatives that make the components of the similarity graph."""
    members = write_table(buckets(reps), "buckets")
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("pivot")).where("n > 1").select("bucket", "pivot")
    shared = checked_broadcast(shared, 100_000)
    members = write_table(members.join(shared, "bucket"), "shared")
    pairs = members.where("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    pairs = write_table(_signed(pairs, reps), "survivors")
    sets = _full_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), docs, reps.select("id", "fp"), doc_id, text)
    stars = write_table(_confirmed(pairs, sets), "confirmed")
    comp = write_table(components(stars.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")
    members = members.select("bucket", "id").join(comp, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("comp"))
    # A bucket of one component is done.
    unsettled = members.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("bucket")
    members = write_table(members.join(checked_broadcast(unsettled, 100_000), "bucket"), "unsettled")
    return stars.unionByName(write_table(_family_links(members, reps, docs, doc_id, text), "family_links"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept."""
    ship_package(docs.sparkSession)
    rows = write_table(sketches(docs, doc_id, text), "sketches")
    known = rows.where(F.col("fp").isNotNull() & F.col("doc_id").isNotNull())
    # The graph's nodes are ids: classes that share their smallest id are one node, as the id is one document.
    reps = write_table(known.groupBy("fp").agg(F.min("doc_id").alias("id"), F.min("sig").alias("sig")), "classes")
    several = known.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low != high").select("doc_id")
    own = known.select("doc_id", "fp").join(several, "doc_id").join(reps.select("fp", "id"), "fp").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    edges = links(docs, reps, doc_id, text).select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(own)
    of_class = reps.join(components(edges), "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    out = rows.join(of_class, "fp", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents whose component has a smaller id; columns as they were."""
    gone = near_duplicates(docs, doc_id, text).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    gone = checked_broadcast(gone, 100_000)
    return docs.join(gone, docs[f"`{doc_id}`"] == gone["gone_id"], "left_anti")
