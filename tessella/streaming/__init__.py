"""Ingest from Structured Streaming: each micro-batch becomes segments, once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tessella.sources.table import Table


def ingest(stream: DataFrame, table: Table, order: str, deletes: str | None = None, name: str = "stream") -> DataStreamWriter:
    """A writer whose batches go to put_df; `order` numbers the versions inside a batch. A batch that Spark repeats after a
    failure is committed already and changes nothing; streams into one table need different names."""
    return stream.writeStream.foreachBatch(lambda batch, number: table.put_df(batch, order, deletes, (name, number)))
