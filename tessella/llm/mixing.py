"""Operator 2: mixing sources to target weights along a time-varying curriculum.

A source's target is its share of all words; its weight schedule says when in training these words are wanted. The
schedule is piecewise linear over training time t in [0, 1]; its integral, scaled to the target, is the source's
cumulative demand D(t). Documents of a source are laid end to end in a fixed pseudo-random order, pass after pass; a
document whose first word stands at offset x of that sequence is due at D^-1(x), its training position. Sorting by
position by range gives the training order; equal positions are ordered by the documents' hashes, then by copy. The offsets
are prefix sums in two steps (hash buckets of a source, then documents inside a bucket), so no task ever holds a source. The
hash covers id, source and text, so rows that share an id, null ones included, fall into different buckets.

Everything is DataFrame functions.

Edge cases: a null or blank text has size 0 and is never taken; a null source is a source of its own, last in order;
ties and repeated rows are all laid out one after the other (rows equal in id, source and text are interchangeable); an empty
table gives an empty mix; extra columns pass through `training_order` untouched and take no part elsewhere. The windows
over all sources hold one row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import checked_broadcast, fresh_name, words, write_table

#: Demand over time of the weight classes, as knots (t, height); only the shape counts, the target sets the scale.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),  # high early
    ((0.0, 1.0), (1.0, 1.0)),  # even
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),  # high late
)
#: Hex digits of the hash that make a bucket: 4096 buckets for each source.
BUCKET_DIGITS = 3


def _hash(doc_id: Column, source: Column, text: Column, seed: int) -> Column:
    """A pseudo-random key that SQL engines share, so that the mix can be checked elsewhere."""
    tag = lambda c: F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("n"))
    whole = F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))
    return F.md5(F.concat_ws("-", tag(doc_id), F.lit(str(seed)), tag(source), whole).cast("binary"))


def _bucket(h: Column) -> Column:
    return F.conv(F.substring(h, 1, BUCKET_DIGITS), 16, 10).cast("int")


def invert_demand(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """t at which the integral of the knots' polyline reaches `share` (0 to 1) of its whole."""
    areas = [(t1 - t0) * (h0 + h1) / 2 for (t0, h0), (t1, h1) in zip(knots, knots[1:], strict=False)]
    whole, before, out = sum(areas), 0.0, None
    for ((t0, h0), (t1, h1)), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
        y = F.greatest(share * whole - before, F.lit(0.0))
        slope = (h1 - h0) / (t1 - t0)
        t = F.lit(t0) + 2 * y / (F.sqrt(F.greatest(F.lit(h0 * h0) + 2 * slope * y, F.lit(0.0))) + h0)
        before += area
        out = F.when(share * whole <= before, t) if out is None else out.when(share * whole <= before, t)
    return F.least(out.otherwise(F.lit(knots[-1][0])), F.lit(knots[-1][0]))


def source_targets(sizes: DataFrame, weights=(5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target, schedule): water-filling in closed form.

    Sources in code-point order take the weights in turn. Capped sources are those whose cap per weight lies below the
    level that the words not yet given out make over the weights not yet served, in ascending order of cap per weight;
    all others share the rest by weight. One row per source, so the windows over all sources are small.
    """
    n = len(weights)
    ranked = sizes.withColumn("schedule", ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % n).cast("int"))
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("schedule") + 1)).withColumn("cap", most * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    up_to = by_cap.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - (F.sum("cap").over(up_to) - F.col("cap"))) / (F.sum("w").over(everything) - (F.sum("w").over(up_to) - F.col("w")))
    ranked = ranked.withColumn("level", level).withColumn("capped", F.col("cap") / F.col("w") < F.col("level"))
    water = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(everything)["level"]
    return ranked.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(water * F.col("w")).alias("target"), "schedule")


def mix(docs: DataFrame, weights=(5, 2, 1), most: float = 3.0, schedules=SCHEDULES, seed: int = 7, doc_id="doc_id", source="source", text="text") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies array<struct<taken, position>>, h.

    A source's copies together take round(target) words exactly: the last copy drawn is cut where the target ends.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.size(words(F.col(text).cast("string"))).cast("long").alias("size"), _hash(F.col(doc_id), F.col(source), F.col(text), seed).alias("h"))
    sized = write_table(sized.withColumn("bucket", _bucket(F.col("h"))), "sizes")
    buckets = write_table(sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "buckets")
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, most)
    targets = targets.withColumn("schedule", F.col("schedule") % len(schedules))
    start = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size")
    starts = buckets.withColumn("start", start).alias("b").join(targets.alias("t"), F.expr("b.source <=> t.source")).select(
        F.col("b.source").alias("at_source"), F.col("bucket").alias("at_bucket"), "start", "source_size", "target", "schedule"
    )
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = sized.withColumn("x", F.sum("size").over(inside) - F.col("size"))
    laid = laid.join(starts, F.col("source").eqNullSafe(F.col("at_source")) & (F.col("bucket") == F.col("at_bucket")))
    laid = laid.withColumn("x", F.col("x") + F.col("start"))
    goal = F.round("target").cast("long")

    def copy(j: Column) -> Column:
        at = j * F.col("source_size") + F.col("x")
        share = F.when(F.col("target") > 0, at / F.col("target")).otherwise(F.lit(0.0))
        position = F.coalesce(*[F.when(F.col("schedule") == i, invert_demand(share, k)) for i, k in enumerate(schedules)])
        return F.struct(F.greatest(F.lit(0), F.least(F.col("size"), goal - at)).cast("long").alias("taken"), position.alias("position"))

    passes = int(-(-most // 1))
    copies = F.filter(F.array(*[copy(F.lit(j).cast("long")) for j in range(passes)]), lambda c: c["taken"] > 0)
    laid = laid.withColumn("copies", copies)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["taken"])
    return laid.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "copies", "h")


def training_order(docs: DataFrame, seed: int = 7, doc_id="doc_id", source="source", text="text", **options) -> DataFrame:
    """docs with each row as often as the mix takes it, in training order; columns as they were.

    Whole copies only: the one copy of a source that its target cuts stays if at least half of it is taken. Rows are matched
    to their copies by their hash.
    """
    mixed = mix(docs, seed=seed, doc_id=doc_id, source=source, text=text, **options)
    key = fresh_name(docs.columns, "mix")
    h, n, at, copy = f"{key}_h", f"{key}_n", f"{key}_at", f"{key}_copy"
    # The hash is the key of the join and of the numbering of equal rows, so docs are dealt once for both.
    due = mixed.select(F.col("h").alias(f"{h}_due"), F.transform(F.filter("copies", lambda c: 2 * c["taken"] >= F.col("size")), lambda c: c["position"]).alias(at))
    due = due.groupBy(f"{h}_due").agg(F.array_sort(F.collect_list(at)).alias(at))
    rows = docs.withColumn(h, _hash(F.col(doc_id), F.col(source), F.col(text), seed))
    joined = rows.join(due.where(F.exists(at, lambda x: F.size(x) > 0)).hint("shuffle_hash"), rows[h] == due[f"{h}_due"])
    joined = joined.withColumn(n, F.row_number().over(Window.partitionBy(h).orderBy(F.lit(0))))
    joined = joined.select(*[F.col(f"`{c}`") for c in docs.columns], h, F.posexplode(F.get(F.col(at), F.col(n) - 1)).alias(copy, key))
    return joined.repartitionByRange(key, h).sortWithinPartitions(key, h, copy).drop(key, h, copy)


def file_position() -> Column:
    """A number that grows along a table written in order, whichever way its files are dealt when it is read.

    Spark numbers the parts of a range-sorted table in range order, and a part's further files too: the part is above
    bit 43, the file above bit 32, the row in the file below.
    """
    number = lambda pattern: F.regexp_extract("_metadata.file_name", pattern, 1).cast("bigint")
    return F.shiftleft(number(r"^part-(\d+)"), 43) + F.shiftleft(number(r"-c(\d+)\."), 32) + F.col("_metadata.row_index")


def ranked(mixed: DataFrame) -> DataFrame:
    """mixed plus first_position and first_rank: the place of a document's first copy among all first copies, from 1.

    Documents are range-sorted by position and written; a row's rank is its place in its file after the rows of all files
    before it, so no task holds more than a range. Documents that the mix doesn't take have neither.
    """
    first = mixed.withColumn("first_position", F.array_min(F.transform("copies", lambda c: c["position"])))
    ordered = first.where(F.col("first_position").isNotNull()).repartitionByRange("first_position", "h").sortWithinPartitions("first_position", "h")
    ordered = write_table(ordered, "ordered").withColumn("place", file_position())
    files = ordered.groupBy(F.shiftright("place", 32).alias("file")).agg(F.count(F.lit(1)).alias("n"))
    starts = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("start"))  # a row for each file
    placed = ordered.withColumn("file", F.shiftright("place", 32)).join(checked_broadcast(starts), "file")
    placed = placed.withColumn("first_rank", F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 32) - 1)) + 1).drop("place", "file", "start")
    return placed.unionByName(first.where(F.col("first_position").isNull()).withColumn("first_rank", F.lit(None).cast("long")))
