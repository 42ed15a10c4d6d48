"""Pieces that several operators share: white space, shared storage, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: blank and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
WS_RE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set on a local master (tests, local runs)."""
    found = spark.sparkContext.getCheckpointDir()
    if not found and (configured := spark.conf.get("spark.checkpoint.dir", None)):
        spark.sparkContext.setCheckpointDir(configured)
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors of a cluster need a shared folder")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    _made.append(f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def drop_scratch(spark: SparkSession) -> int:
    """Delete every table that operators of this process have written; frames they returned can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    gone = [path(p) for p in _made]
    _made.clear()
    return sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True) for p in gone)


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freeing_shuffles(spark: SparkSession):
    """Executions inside give back their shuffle files when they end: what they made is in a table."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so that a lost executor costs a reread only."""
    path = scratch(df.sparkSession, name)
    with freeing_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int, codec: str = "zstd", ordered: bool = True) -> DataFrame:
    """df as a table of buckets by key, sorted by it: joins and groups by key read it without a shuffle.

    The catalogue needs a name for it while it is made only; frames keep the layout they were resolved with.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    out = df.write.bucketBy(buckets, key)
    with freeing_shuffles(spark):
        (out.sortBy(key) if ordered else out).option("compression", codec).option("path", scratch(spark, name)).saveAsTable(table)
    found = spark.table(table)
    found.schema  # resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {table}")
    return found


def checked_broadcast(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Hint a broadcast only if the table has at most max_rows rows; beyond that the join shuffles (AQE splits hot keys)."""
    table = write_table(df, "side")
    return F.broadcast(table) if len(table.limit(max_rows + 1).select(F.lit(1)).collect()) <= max_rows else table


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """The bytes of a column of texts, whether they are valid UTF-8 or not."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def texts(column: pa.Array) -> list[str | None]:
    """The texts of a column; bytes that are no UTF-8 become U+FFFD."""
    return [None if b is None else b.decode("utf-8", "replace") for b in raw_texts(column)]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character; all-ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """The runs of characters that are not ASCII white space; an empty array for null or blank text."""
    stripped = F.btrim(text, F.lit(WS))
    return F.when(F.coalesce(F.length(stripped), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(stripped, WS_RE))


def fresh_name(taken: list[str], stem: str) -> str:
    """A column name that no column in taken has (names are compared without case, as Spark does)."""
    have, name = {c.lower() for c in taken}, stem
    while name.lower() in have:
        name += "_"
    return name
