"""Named tables below a root.

Every write is a new version; then the table's own pointer file is replaced by a rename, so that readers see whole tables
and writers of different tables don't undo each other's work. The version before stays until the next write, for those
who hold it.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from siftstone.operators.merge import upsert


class Catalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def read_json(self, name: str) -> dict:
        path = self._path(name)
        if not self._fs.exists(path):
            return {}
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write_json(self, name: str, value: dict) -> None:
        """Write a new file and rename it over the old one."""
        new = self._path(f"{name}.{uuid.uuid4().hex}")
        stream = self._fs.create(new, True)
        stream.write(bytearray(json.dumps(value, indent=1, sort_keys=True).encode()))
        stream.close()
        hadoop, conf = self.spark._jvm.org.apache.hadoop, self.spark._jsc.hadoopConfiguration()
        files = hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        overwrite = self.spark.sparkContext._gateway.new_array(getattr(hadoop.fs, "Options$Rename"), 1)
        overwrite[0] = getattr(hadoop.fs, "Options$Rename").OVERWRITE
        files.rename(self._fs.makeQualified(new), self._fs.makeQualified(self._path(name)), overwrite)

    @staticmethod
    def checked(name: str) -> str:
        if not re.fullmatch(r"[a-z][a-z0-9_]*", name):
            raise ValueError(f"not a table name: {name!r}")
        return name

    def _pointer(self, name: str) -> str:
        return f"_tables/{self.checked(name)}.json"

    def tables(self) -> dict[str, str]:
        """The folder of each table's version."""
        where = self._path("_tables")
        names = [f.getPath().getName() for f in self._fs.listStatus(where)] if self._fs.exists(where) else []
        found = {n.removesuffix(".json"): self.read_json(f"_tables/{n}") for n in names if re.fullmatch(r"[a-z][a-z0-9_]*\.json", n)}
        return {n: v["now"] for n, v in found.items() if v}

    def has(self, name: str) -> bool:
        return bool(self.read_json(self._pointer(name)))

    def read(self, name: str) -> DataFrame:
        where = self.read_json(self._pointer(name)).get("now")
        if where is None:
            raise KeyError(f"no table {name}")
        return self.spark.read.parquet(f"{self.root}/{where}")

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """Replace a table. Of the older versions the last stays; those before it go after the pointer has moved."""
        where = f"{self.checked(name)}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{where}")
        pointer = self.read_json(self._pointer(name))
        self.write_json(self._pointer(name), {"now": where, "before": pointer.get("now")})
        if pointer.get("before"):
            self._fs.delete(self._path(pointer["before"]), True)
        return self.read(name)

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        return self.write(name, upsert(self.read(name), rows, keys) if self.has(name) else rows.dropDuplicates(keys))

    def remove(self, name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        return self.write(name, self.read(name).join(rows.select(*keys).distinct(), keys, "left_anti"))

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(self._pointer(name)), True)
        self._fs.delete(self._path(name), True)
