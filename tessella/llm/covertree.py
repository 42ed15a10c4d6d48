"""Operator 6: exact top-k inner products by dual-tree search over cover trees.

Vectors become integer vectors floor(scale * x). The top of the index is a covering net of pivots, fitted on a bounded
sample, whose number follows the number of rows; every vector is routed to its nearest pivot, so a cell is a ball around its
pivot whose radius and largest norm are measured over all its vectors. Cells are dealt into data blocks of bounded size,
queries into query blocks that may span cells, and each pair of a query block and a data block is one task unit: both sides
are indexed by a cover tree, and pairs of nodes are pruned when the best score that their centres and covering radii allow
is below the worst k-th score of the query node.

The first round searches each query's own cell. Its k-th scores are exact lower bounds; with them each query tests every
other cell's bound, and the distributed plan of the second round holds the cells that some query of a block still needs.
Scores are integers, so a pruned candidate is strictly worse than k others, and ties resolve to the smaller id whatever the
order of work.

Scores are exact: a block whose products fit 53 bits is computed in doubles, one that fits 62 bits in 64-bit integers, others
in integers of any length. A score beyond 64 bits counts as the nearest 64-bit integer, and a component whose product with
the scale is no finite double as the largest double of its sign.

Edge cases: vectors that are null, empty or hold null, NaN or infinite components take no part, nor do rows with a null
id; shorter vectors are padded with zeros; a query row with fewer than k candidates returns all of them; repeated rows are
candidates one by one, except for rows with the query's own id; query rows that repeat an id and a vector are one query;
an empty table gives an empty result; extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import checked_broadcast, write_table
from tessella.runtime import ship_package

#: Rows that the covering net is fitted on, the most pivots it has (else one for each data block of rows), and the rows of blocks.
SAMPLE_ROWS, MAX_PIVOTS, DATA_BLOCK, QUERY_BLOCK = 4096, 1024, 8192, 16384
LEAF, QUERY_LEAF = 128, 64
LONG = (1 << 63) - 1


class CoverTree:
    """Batch-built cover tree over the rows of an integer matrix.

    A node's child centres are members of the node that stand further than the child radius from one another, and a
    child holds the members within that radius of its centre; radius[i] is the measured covering radius of node i. In
    many dimensions most members end up alone: when `patience` centres in a row gather next to nothing, the rest is
    pooled into leaf-sized children around their nearest centre found so far, whose measured radii keep every bound
    valid. Members of a node are a range of `order`.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF, base: float = 1.5, patience: int = 8):
        self.points = points.astype(np.float64)
        self.order = np.arange(len(points))
        self.lo, self.hi, self.center, self.radius, self.children = [], [], [], [], []
        self.leaf, self.base, self.patience = leaf, base, patience
        if len(points):
            mean = self.points.mean(axis=0)
            self._build(int(np.argmin(((self.points - mean) ** 2).sum(axis=1))), 0, len(points))

    def _build(self, top: int, begin: int, end: int) -> None:
        pending = [(top, begin, end, -1)]
        while pending:
            center, lo, hi, parent = pending.pop()
            members = self.order[lo:hi]
            d = np.sqrt(((self.points[members] - self.points[center]) ** 2).sum(axis=1))
            node = len(self.lo)
            self.lo.append(lo)
            self.hi.append(hi)
            self.center.append(center)
            self.radius.append(float(d.max()))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if hi - lo <= self.leaf or self.radius[node] == 0.0:
                continue
            within = self.radius[node] / self.base
            label, left = np.full(hi - lo, -1), np.ones(hi - lo, bool)
            at, dist, centers, poor = center, d, [], 0
            nearest, near_dist = np.zeros(hi - lo, int), d.copy()
            while True:
                take = left & (dist <= within)
                label[take] = len(centers)
                left &= ~take
                nearer = dist < near_dist
                nearest[nearer], near_dist[nearer] = len(centers), dist[nearer]
                poor = poor + 1 if 8 * take.sum() < self.leaf else 0
                centers.append(at)
                if not left.any() or poor >= self.patience:
                    break
                at = int(members[int(np.argmax(np.where(left, dist, -1.0)))])
                dist = np.sqrt(((self.points[members] - self.points[at]) ** 2).sum(axis=1))
            rest = np.flatnonzero(left)
            rest = rest[np.lexsort((near_dist[rest], nearest[rest]))]
            for i in range(0, len(rest), self.leaf):
                label[rest[i : i + self.leaf]] = len(centers)
                centers.append(centers[nearest[rest[i]]])
            by = np.argsort(label, kind="stable")
            self.order[lo:hi] = members[by]
            cuts = lo + np.searchsorted(label[by], np.arange(len(centers) + 1))
            pending += [(c, int(cuts[i]), int(cuts[i + 1]), node) for i, c in enumerate(centers) if cuts[i] < cuts[i + 1]]


def best_score(q: np.ndarray, q_radius: float, c: np.ndarray, c_radius: np.ndarray) -> np.ndarray:
    """Upper bound of <a, b> over a within q_radius of q and b within c_radius of each row of c, rounding included."""
    with np.errstate(over="ignore", invalid="ignore"):
        nq, nc = np.sqrt(q @ q), np.sqrt((c * c).sum(axis=1))
        return c @ q + c_radius * nq + q_radius * nc + q_radius * c_radius + 1e-6 + 1e-13 * len(q) * (nq + q_radius) * (nc + c_radius)


def _exact(queries: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices in the narrowest kind of number in which their products are exact."""
    peak = float(np.abs(queries).max(initial=0.0)) * float(np.abs(data).max(initial=0.0)) * max(1, queries.shape[1])
    if peak < 1 << 53:
        return queries, data
    kind = np.int64 if peak < 1 << 62 else object
    whole = lambda m: m.astype(np.int64) if kind is np.int64 else np.array([int(x) for x in m.ravel()] or [0], object)[: m.size].reshape(m.shape)
    return whole(queries), whole(data)


def _products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    scores = q @ d.T
    return np.clip(scores, -LONG - 1, LONG).astype(np.int64) if scores.dtype == object else scores


def _lower(score: float) -> float:
    """A double that is not above the integer it was rounded from."""
    return score if abs(score) < 1 << 53 else float(np.nextafter(score, -np.inf))


def search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query its k best (ids, scores), score descending and id ascending, without data rows of its own id.

    queries and data are doubles with integer values. floor: for each query a score that k candidates elsewhere reach; what is
    below it may be left out.
    """
    n = len(queries)
    best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * n
    worst = np.full(n, -np.inf) if floor is None else np.array([_lower(f) for f in floor.tolist()])
    if not n or not len(data):
        return best
    qt, dt = CoverTree(queries, QUERY_LEAF), CoverTree(data)
    dc, dr = dt.points[dt.center], np.array(dt.radius)
    exact_q, exact_d = _exact(qt.points, dt.points)

    def base_case(qs: np.ndarray, ds: np.ndarray) -> None:
        scores = _products(exact_q[qs], exact_d[ds])
        good = (scores >= worst[qs, None]) & (data_ids[ds][None, :] != query_ids[qs, None])
        for row in np.flatnonzero(good.any(axis=1)).tolist():
            q, at = qs[row], np.flatnonzero(good[row])
            sc, ids = scores[row, at].astype(np.int64), data_ids[ds[at]]
            if len(at) > 4 * k:  # what is below the k-th of these alone can't be among the best
                least = np.partition(sc, -k)[-k]
                sc, ids = sc[sc >= least], ids[sc >= least]
            ids, sc = np.concatenate([best[q][0], ids]), np.concatenate([best[q][1], sc])
            keep = np.lexsort((ids, ~sc))[:k]  # ~ turns the order without overflow
            best[q] = (ids[keep], sc[keep])
            if len(keep) == k:
                worst[q] = max(worst[q], _lower(float(sc[keep[-1]])))

    stack = [(0, 0, np.inf)]
    while stack:
        a, b, bound = stack.pop()
        qs = qt.order[qt.lo[a] : qt.hi[a]]
        least = worst[qs].min()
        if bound < least:
            continue
        if qt.children[a] and (qt.radius[a] >= dt.radius[b] or not dt.children[b]):
            for child in qt.children[a]:
                up = float(best_score(qt.points[qt.center[child]], qt.radius[child], dc[b : b + 1], dr[b : b + 1])[0])
                stack.append((child, b, up))
        elif dt.children[b]:
            kids = np.array(dt.children[b])
            up = best_score(qt.points[qt.center[a]], qt.radius[a], dc[kids], dr[kids])
            for i in np.argsort(up):  # the best is on top of the stack
                if not up[i] < least:  # a bound that is no number prunes nothing
                    stack.append((a, int(kids[i]), float(up[i])))
        else:
            base_case(qs, dt.order[dt.lo[b] : dt.hi[b]])
    return best


def covering_net(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Farthest-first centres: each new one is the sample row that the earlier ones cover worst."""
    chosen = [0]
    with np.errstate(over="ignore", invalid="ignore"):
        far = ((sample - sample[0]) ** 2).sum(axis=1)
        while len(chosen) < min(pivots, len(sample)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _pack(v: np.ndarray) -> bytes:
    """A vector of integer values in the narrowest of four formats; equal vectors are equal bytes."""
    top = np.abs(v).max(initial=0.0)
    kind = "<i1" if top < 1 << 7 else "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
    return kind[-1].encode() + (v + 0.0).astype(kind).tobytes()


def _matrix(packed: list[bytes], width: int = 0) -> np.ndarray:
    """Packed vectors as rows of doubles, padded with zeros to the longest or to width."""
    rows = [np.frombuffer(b, f"<{'f' if b[:1] == b'8' else 'i'}{b[:1].decode()}", offset=1) for b in packed]
    out = np.zeros((len(rows), max([width, *map(len, rows)])))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    v = F.col(embedding).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    largest = F.lit(1.7976931348623157e308)
    whole = lambda y: F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(F.greatest(-largest, F.least(largest, y)))
    return rows.where(~F.coalesce(bad, F.lit(True))).select("vec_id", F.transform("v", lambda x: whole(x * float(scale))).alias("v"))


def _routed(rows: DataFrame, net: np.ndarray) -> DataFrame:
    """vec_id, v (packed), cell (the nearest pivot), dist to it, norm."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [_pack(np.array(v)) for v in batch.column(1).to_pylist()]
            x = _matrix(packed, net.shape[1])
            pivots = np.pad(net, ((0, 0), (0, x.shape[1] - net.shape[1])))
            with np.errstate(over="ignore", invalid="ignore"):
                cell = np.argmin((pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T), axis=1) if len(x) else np.empty(0, int)
                dist, norm = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
            columns = [batch.column(0), pa.array(packed, pa.binary()), pa.array(cell, pa.int32()), pa.array(np.nan_to_num(dist, nan=np.inf)), pa.array(norm)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "cell", "dist", "norm"])

    return rows.mapInArrow(route, "vec_id long, v binary, cell int, dist double, norm double")


def _search_pairs(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """query_id, v, vec_id, score over (pair, vec_id, v, floor) rows of queries and (pair, vec_id, v) rows of data."""

    def run(table: pa.Table) -> pa.Table:
        is_query = np.array(table.column("query").to_pylist(), bool)
        ids, packed = table.column("vec_id").to_numpy(), table.column("v").to_pylist()
        matrix = _matrix(packed)
        floor = np.array([-np.inf if f is None else float(f) for f in table.column("floor").to_pylist()])
        qi, di = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        found = search(matrix[qi], ids[qi], matrix[di], ids[di], k, floor[qi])
        n = [len(f[0]) for f in found]
        join = lambda i: np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64)
        return pa.table({"query_id": pa.array(np.repeat(ids[qi], n), pa.int64()), "v": pa.array([packed[i] for i in np.repeat(qi, n)], pa.binary()), "vec_id": pa.array(join(0), pa.int64()), "score": pa.array(join(1), pa.int64())})

    both = queries.select("pair", F.lit(True).alias("query"), "vec_id", "v", "floor").unionByName(data.select("pair", F.lit(False).alias("query"), "vec_id", "v", F.lit(None).cast("long").alias("floor")))
    return both.groupBy("pair").applyInArrow(run, "query_id long, v binary, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "v").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _plan(asked: DataFrame, net: np.ndarray, cells: list[tuple[int, float, float]]) -> DataFrame:
    """q_block, d_cell: the cells other than its own that some query of the block can still find a score in."""
    numbers, radii, norms = (np.array([c[i] for c in cells], float) for i in range(3))
    numbers = numbers.astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: set[tuple[int, int]] = set()
        for batch in batches:
            x = _matrix(batch.column(0).to_pylist(), net.shape[1])
            pivots = np.pad(net[numbers], ((0, 0), (0, x.shape[1] - net.shape[1])))
            own, block = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            floor = np.array([-np.inf if f is None else _lower(float(f)) for f in batch.column(2).to_pylist()])
            with np.errstate(over="ignore", invalid="ignore"):
                size = np.sqrt((x * x).sum(axis=1))[:, None]
                slack = 1e-6 + 1e-13 * x.shape[1] * size * (np.sqrt((pivots * pivots).sum(axis=1)) + radii)
                up = np.fmin(x @ pivots.T + size * radii, size * norms) + slack
                open_ = ~(up < floor[:, None]) & (numbers[None, :] != own[:, None])
            for b in np.unique(block):
                wanted |= {(int(b), int(c)) for c in numbers[open_[block == b].any(axis=0)]}
        pairs = sorted(wanted)
        yield pa.RecordBatch.from_pydict({"q_block": pa.array([b for b, _ in pairs], pa.int32()), "d_cell": pa.array([c for _, c in pairs], pa.int32())})

    return asked.select("v", "cell", "floor", "q_block").mapInArrow(run, "q_block int, d_cell int").distinct()


def top_k(vectors: DataFrame, k: int = 20, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by 20 against all rows."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = _quantised(vectors, vec_id, embedding, scale)
    pivots = min(MAX_PIVOTS, max(8, -(-rows.count() // DATA_BLOCK)))
    sample = rows.orderBy(F.xxhash64("vec_id", "v")).limit(min(SAMPLE_ROWS, 64 * pivots)).select("v").collect()  # the documented bound of the fit
    net = covering_net(_matrix([_pack(np.array(r.v)) for r in sample]), pivots) if sample else np.zeros((1, 0))
    routed = write_table(_routed(rows, net), "routed")
    is_query = F.col("vec_id") % 20 == 0
    queries = routed.where(is_query).dropDuplicates(["vec_id", "v"])
    stats = routed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("dist").alias("radius"), F.max("norm").alias("norm")).collect()  # a row for each pivot
    asked = {r.cell: r["count"] for r in queries.groupBy("cell").count().collect()}
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Cells one after the other fill query blocks; a cell with more queries than a block has several of its own.
    layout, block, filled = [], 0, 0
    for r in sorted(stats, key=lambda r: r.cell):
        n = asked.get(r.cell, 0)
        own = -(-n // QUERY_BLOCK)
        if filled and (filled + n > QUERY_BLOCK):
            block, filled = block + 1, 0
        layout.append((r.cell, -(-r.rows // DATA_BLOCK), block, max(1, own)))
        block, filled = (block + own, 0) if own > 1 else (block, filled + n)
    layout = F.broadcast(spark.createDataFrame(layout, "cell int, d_blocks int, first int, q_blocks int"))  # a row for each pivot
    h = F.xxhash64("vec_id", "v", F.lit(5))
    data = routed.join(layout, "cell").select("vec_id", "v", "cell", F.pmod(h, F.col("d_blocks")).cast("int").alias("d_block"))
    blocks = F.broadcast(layout.select(F.col("cell").alias("d_cell"), F.explode(F.sequence(F.lit(0), F.col("d_blocks") - 1)).alias("d_block")))
    queries = queries.join(layout, "cell").select("vec_id", "v", "cell", (F.col("first") + F.pmod(h, F.col("q_blocks")).cast("int")).alias("q_block"))
    pair = lambda *c: F.concat_ws(".", *c).alias("pair")
    each = layout.select("cell", "first", "q_blocks", "d_blocks")
    mine = queries.join(each.select("cell", F.explode(F.sequence(F.lit(0), F.col("d_blocks") - 1)).alias("d_block")), "cell").select(pair("cell", "q_block", "d_block"), "vec_id", "v", F.lit(None).cast("long").alias("floor"))
    theirs = data.join(each.select("cell", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("q_blocks") - 1)).alias("q_block")), "cell").select(pair("cell", "q_block", "d_block"), "vec_id", "v")
    own = write_table(_ranked(_search_pairs(mine, theirs, k), k), "own_cell")
    floors = own.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "v", F.col("score").alias("floor"))
    floored = write_table(queries.join(floors, ["vec_id", "v"], "left"), "asked")
    plan = checked_broadcast(_plan(floored, net, [(r.cell, r.radius, r.norm) for r in stats]), 100_000)
    plan = plan.join(blocks, "d_cell")
    mine = floored.join(plan, "q_block").where("cell <> d_cell").select(pair("q_block", "d_cell", "d_block"), "vec_id", "v", "floor")
    theirs = data.withColumnRenamed("cell", "d_cell").join(plan, ["d_cell", "d_block"]).select(pair("q_block", "d_cell", "d_block"), "vec_id", "v")
    found = own.drop("rank").unionByName(_search_pairs(mine, theirs, k))
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
