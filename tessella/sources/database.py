"""Several independent tables (column families) in one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.functions.query import Query
from tessella.functions.schema import Schema
from tessella.operators.estimator import Estimate
from tessella.operators.index import read
from tessella.sources.manifest import Store
from tessella.sources.table import Snapshot, Table

DEFAULT = "default"


class Database:
    """Opens every family there is; `families` names each with its schema, the default one included.

    The methods that take a table refuse None, dropped tables and tables of another database.
    """

    def __init__(self, spark: SparkSession, root: str, families: dict[str, Schema] | Schema):
        families = {DEFAULT: families} if isinstance(families, Schema) else dict(families)
        if DEFAULT not in families:
            raise ValueError("the default family is missing")
        self.spark, self.store = spark, Store(spark, root)
        there = self.store.children() if self.store.exists("") else []
        if missing := set(there) - set(families):
            raise ValueError(f"families not named: {sorted(missing)}")
        self._tables = {name: Table(spark, self.store, name, schema, create=name not in there) for name, schema in families.items()}

    @staticmethod
    def list_families(spark: SparkSession, root: str) -> list[str]:
        return Store(spark, root).children()

    @staticmethod
    def read_index(spark: SparkSession, root: str, family: str = DEFAULT) -> DataFrame:
        """The index rows of all jobs of a family, without its schema: they describe themselves."""
        jobs = [n for n in Store(spark, root).children(family) if n.startswith("job-")]
        return read(spark, [f"{root.rstrip('/')}/{family}/{j}/index" for j in jobs])

    def create(self, name: str, schema: Schema) -> Table:
        if name in self._tables:
            raise ValueError(f"{name} exists")
        self._tables[name] = Table(self.spark, self.store, name, schema, create=True)
        return self._tables[name]

    def drop(self, table: Table | None) -> None:
        table = self._own(table)
        if table.name == DEFAULT:
            raise ValueError("the default family stays")
        table.dropped = True
        del self._tables[table.name]
        self.store.delete(table.name)

    def table(self, name: str = DEFAULT) -> Table | None:
        return self._tables.get(name)

    def _own(self, table: Table | None) -> Table:
        if table is None or self._tables.get(table.name) is not table:
            raise ValueError("no table of this database")
        return table

    def put(self, table: Table | None, pk, attrs, payload=b"") -> None:
        self._own(table).put(pk, attrs, payload)

    def put_batch(self, table: Table | None, pks: list, attrs: list, payloads: list) -> None:
        self._own(table).put_batch(pks, attrs, payloads)

    def delete(self, table: Table | None, pk) -> None:
        self._own(table).delete(pk)

    def flush(self, table: Table | None) -> None:
        self._own(table).flush()

    def scan(self, table: Table | None, query: Query | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        return self._own(table).scan(query, snapshot)

    def estimate(self, table: Table | None, query: Query) -> Estimate:
        return self._own(table).estimate(query)

    def close(self) -> None:
        """Pending writes become segments."""
        for t in self._tables.values():
            t.flush()

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_) -> None:
        self.close()
