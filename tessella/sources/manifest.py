"""Small JSON files published by one rename, on any file system that Hadoop knows."""

from __future__ import annotations

import json
import time

from pyspark.sql import SparkSession

FORMAT = 3


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def children(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def age(self, name: str) -> float:
        """Seconds since the file or folder was changed."""
        return time.time() - self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def commit(self, name: str, content: dict) -> None:
        """All or nothing: written beside, then renamed; a name is never written twice."""
        aside = self._path(f"{name}.tmp")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if not self._fs.rename(aside, self._path(name)):
            raise OSError(f"{name} is there already")
