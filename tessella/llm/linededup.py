"""Operator 4: line dedup over levelled sorted runs of line hashes.

A key is a line without its outer white space, A-Z lower-cased; keys of fewer code points than `min_chars` never count.
Documents come in batches (by a hash of the id). A run is a table of key hashes, bucketed and sorted by hash, in which
each key stands once with the number of its documents and the largest id among them; no key stands in two runs. A new
batch is bucketed and sorted alike and merges with every run without a shuffle, in one left join each: keys that no run has (the
anti-join) become its own run, the others go to a log of repeats. When `fanout` runs of a level exist they are compacted into one run of the next level, so a batch meets few
runs. At the end a key's documents are its run's count plus its repeats; a key in at least `min_docs` documents loses its
lines everywhere but in the largest id that holds it.

Only hashes (128 bits), ids and line numbers are shuffled before the last join brings each document its dropped lines.
Everything is DataFrame functions.

Edge cases: a null or empty text is one empty line; rows that share an id are one document when documents are counted,
and each row is cut by itself; a null id is one document, smaller than all others; repeated lines inside the kept
document all stay; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import WS, ascii_lower, bucketed, checked_broadcast, fresh_name, write_table


def line_key(line: Column) -> Column:
    return F.btrim(ascii_lower(line), F.lit(WS))


class Runs:
    """The levelled runs and the log of repeats: columns h, n_docs, top_doc."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.repeats: list[DataFrame] = []

    def _write(self, rows: DataFrame) -> DataFrame:
        return bucketed(rows, "line_run", "h", self.buckets)

    def all(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> None:
        """batch: h, n_docs, top_doc with each h once."""
        met, runs = self._write(batch.repartition(self.buckets, "h")), self.all()
        for i, run in enumerate(runs):  # a key stands in one run at most
            met = met.join(run.select("h", F.lit(True).alias(f"in_{i}")).hint("merge"), "h", "left")
        known = reduce(or_, [F.col(f"in_{i}").isNotNull() for i in range(len(runs))], F.lit(False))
        if runs:
            self.repeats.append(write_table(met.where(known).select("h", "n_docs", "top_doc"), "repeats"))
        level, run = 0, self._write(met.where(~known).select("h", "n_docs", "top_doc"))
        while True:
            if len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            merged, rest = self.levels[level][0], self.levels[level][1:]
            for r in rest:
                merged = merged.unionByName(r)
            self.levels[level], run, level = [], self._write(merged.repartition(self.buckets, "h")), level + 1

    def totals(self, min_docs: int) -> DataFrame:
        """h, top_doc of the keys in at least min_docs documents."""
        parts = self.all() + self.repeats
        union = parts[0]
        for p in parts[1:]:
            union = union.unionByName(p)
        return union.groupBy("h").agg(F.sum("n_docs").alias("n_docs"), F.max("top_doc").alias("top_doc")).where(F.col("n_docs") >= min_docs).select("h", "top_doc")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with three more columns; the dict gives the names of n_lines, n_dropped and kept (the text that stays)."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # The key of a row: its id and a hash of its text, so that rows that share an id are told apart.
    lines = docs.select(F.col(doc_id).alias("d"), F.xxhash64(whole).alias("x"), F.posexplode(F.split(ascii_lower(whole), "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(WS))).where(F.char_length("line") >= min_chars)
    lines = write_table(lines.select("d", "x", "pos", F.unhex(F.md5("line")).alias("h")), "lines")
    runs = Runs(spark, fanout)
    for b in range(batches):
        part = lines.where(F.pmod(F.xxhash64("d"), F.lit(batches)) == b)
        holders = part.select("h", "d").distinct()
        runs.add(holders.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("d").alias("top_doc")))
    # A table of its own: a small one is broadcast, and next to a large one the join can split a line that is everywhere.
    hot = checked_broadcast(runs.totals(min_docs), 100_000)
    drops = lines.join(hot, "h").where(~F.col("d").eqNullSafe(F.col("top_doc"))).groupBy("d", "x").agg(F.sort_array(F.collect_set("pos")).alias("drop"))
    names = docs.columns
    free = {n: fresh_name(names, n) for n in ("n_lines", "n_dropped", "kept")}
    d, x, drop, arr = (fresh_name(names, f"line_{c}") for c in ("d", "x", "drop", "arr"))
    drops = drops.select(F.col("d").alias(d), F.col("x").alias(x), F.col("drop").alias(drop))
    key = fresh_name(names, "line_key")
    joined = docs.withColumn(key, F.xxhash64(whole)).join(drops.hint("shuffle_hash"), F.col(doc_id).eqNullSafe(F.col(d)) & (F.col(key) == F.col(x)), "left")
    joined = joined.withColumn(arr, F.split(whole, "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size(arr) - 1), drop)
    kept = F.when(F.col(drop).isNull(), whole).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(arr), i)), "\n"))
    out = joined.withColumns({free["n_lines"]: F.size(arr).cast("long"), free["n_dropped"]: F.coalesce(F.size(drop), F.lit(0)).cast("long"), free["kept"]: kept})
    return out.drop(d, x, drop, arr, key), free


def dedup_line_texts(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with the lines dropped from their texts; a document that loses all its lines goes."""
    out, names = dedup_lines(docs, text=text, **options)
    gone = (F.col(names["n_dropped"]) > 0) & (F.col(names["n_dropped"]) == F.col(names["n_lines"]))
    changed = F.when(F.col(names["n_dropped"]) > 0, F.col(names["kept"])).otherwise(F.col(text))
    return out.where(~gone).withColumn(text, changed).select(*[F.col(f"`{c}`") for c in docs.columns])
