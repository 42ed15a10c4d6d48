"""A training corpus from documents: quality rules, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame that is written as
Parquet and reread for the next stage. All but the last return the columns of documents.

Empty tables, nulls, repeated rows and extra columns are handled as the operators' docstrings say. A document that loses
all its lines to line dedup goes. Mixing repeats rows as often as the mix takes them and leaves out those it doesn't take.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, linededup, mixing, neardup, quality
from tessella.llm.common import scratch
from tessella.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup_line_texts(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.training_order(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, position, n_tokens, ids; position gives the training order, the rows come in any.

    docs is the mixing stage's table as read from its files: their names and row numbers hold the order.
    """
    tokens = bpe.encode(docs.select("doc_id", "lang", "source", "text", mixing.file_position().alias("position")), tokenizer_path())
    return tokens.selectExpr("doc_id", "lang", "source", "position", "cast(size(ids) as bigint) as n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: SQL has no byte-pair merging; the pipeline is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage before it is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = scratch(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
