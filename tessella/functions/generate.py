"""Random rows for trying out a table: made by Spark, the same for a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.schema import FLOAT, UINT, Attr, Schema


def _value(attr: Attr, seed: int, values: int) -> Column:
    """One of about `values` values that fit the attribute; a tenth is null where it may be."""
    n = F.floor(F.rand(seed) * values)
    if attr.is_bytes:
        text = F.lpad(n.cast("string"), attr.width or 8, "0")
        out = (F.substring(text, -attr.width, attr.width) if attr.width else F.concat(F.lit("v"), text)).cast("binary")
    elif attr.physical == FLOAT:
        out = (n / 8).cast(attr.spark_type)
    else:
        low, high = attr.limits()
        span = min(values, high - low + 1)
        out = (n % span - (0 if attr.physical == UINT else span // 2)).cast(attr.spark_type)
    return F.when(F.rand(seed + 7919) >= 0.1, out) if attr.nullable else out


def random_rows(spark: SparkSession, schema: Schema, rows: int, keys: int, seed: int = 1, values: int = 100, deletes: float = 0.0) -> DataFrame:
    """Rows for Table.put_df(order="ordinal", deletes="gone"): keys k0 to k<keys - 1> at random, so that some are written again."""
    out = spark.range(rows).select(
        F.concat(F.lit("k"), F.floor(F.rand(seed) * keys).cast("string")).cast("binary").alias("pk"),
        *[_value(a, seed + 31 * (i + 1), values).alias(a.name) for i, a in enumerate(schema.attrs)],
        F.concat(F.lit("p"), F.col("id").cast("string")).cast("binary").alias("payload"), F.col("id").alias("ordinal"), (F.rand(seed + 104729) < deletes).alias("gone"),
    )
    return out
