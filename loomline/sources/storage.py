"""Where tables live: {root}/data/{module}/{version}/{table}.parquet, on any file system that Spark reaches.

A table is written to a staging folder and renamed into place, and the table before it is kept beside it until then, so a
plan may read what it replaces and a failed write leaves the old table whole. Where a run ends between the two renames, the
next one to look for the table moves the old one back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..plans.contracts import Description, Relation
from ..plans.version import Version


class Storage:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, str(root).rstrip("/")

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def names(self, path: str) -> list[str]:
        """Sorted names in a folder; none, if it is absent."""
        return sorted(s.getPath().getName() for s in self._fs(path).listStatus(self._path(path))) if self.exists(path) else []

    def table_path(self, module: str, version: str, table: str, *, area: str = "data") -> str:
        """The versioned layout, or the older name@version one where only that exists."""
        new = f"{self.root}/{area}/{module}/{version}/{table}.parquet"
        old = f"{self.root}/{area}/{module}@{version}/{table}.parquet"
        return old if not self.has(new) and self.exists(old) else new

    def _before(self, path: str) -> str:
        folder, _, name = path.rpartition("/")
        return f"{folder}/.{name}.before"

    def has(self, path: str) -> bool:
        """Whether there is a table at path; one that a broken-off write moved away is moved back."""
        if not self.exists(path) and self.exists(self._before(path)):
            self._fs(path).rename(self._path(self._before(path)), self._path(path))
        return self.exists(path)

    def read(self, path: str, schema: StructType | None = None) -> DataFrame:
        if not self.has(path):
            raise FileNotFoundError(path)
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(path)

    def write(self, df: DataFrame, path: str, relation: Relation | None = None) -> None:
        """Replace the table at path: write aside, move the old one away, move the new one in, delete the old one.

        By its relation the new table holds the stored rows too (append), or those whose keys no new row has (merge), and
        its files are ranged and sorted by columns.
        """
        had = self.has(path)
        if relation is not None:
            if had and relation.mode != "replace":
                old = self.read(path)
                if relation.mode == "merge":
                    old = old.join(df.select(*relation.keys).distinct(), list(relation.keys), "left_anti")
                df = old.unionByName(df, allowMissingColumns=True)
            if relation.order:
                df = df.repartitionByRange(*relation.order).sortWithinPartitions(*relation.order)
        staging, before = f"{self.root}/_staging/{uuid.uuid4().hex}", self._before(path)
        df.write.parquet(staging)
        fs = self._fs(path)
        fs.mkdirs(self._path(path).getParent())
        fs.delete(self._path(before), True)  # left by a write that ended after its second rename
        if had and not fs.rename(self._path(path), self._path(before)):
            raise OSError(f"can't move {path} away")
        if not fs.rename(self._path(staging), self._path(path)):
            self.has(path)
            raise OSError(f"can't move the new table to {path}")
        if had:
            fs.delete(self._path(before), True)

    def newest(self, module: str) -> Version | None:
        """The newest version of a module that has stored tables."""
        found = []
        for n in self.names(f"{self.root}/data/{module}"):
            try:
                found.append(Version.parse(n))
            except ValueError:
                continue
        return max(found, default=None)

    def publish_all(self, offers: list[Description]) -> None:
        """The views of these modules' stored public tables, as after their runs; a new session starts without."""
        for d in offers:
            for table in d.names(True):
                path = self.table_path(d.module, d.version, table)
                if self.has(path):
                    self.publish(d.module, d.version, table, path, Version.parse(d.version) >= (self.newest(d.module) or Version.parse(d.version)))

    def publish(self, module: str, version: str, table: str, path: str, newest: bool = True) -> None:
        """Views {module}__v{major}.{table} and, for the newest major, {module}.{table}."""
        for schema in [f"{module}__v{Version.parse(version).major}", *[module] * newest]:
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{schema}`")
            self.spark.sql(f"CREATE OR REPLACE VIEW `{schema}`.`{table}` AS SELECT * FROM parquet.`{path}`")

    def discover(self, module: str, version: str, *, area: str = "data") -> Description:
        """The contract of what is stored: one table for each *.parquet, with the schema in its footer."""
        for folder in (f"{self.root}/{area}/{module}/{version}", f"{self.root}/{area}/{module}@{version}"):
            names = [n.removesuffix(".parquet") for n in self.names(folder) if n.endswith(".parquet")]
            if names:
                return Description(module, version, {n: Relation(self.read(f"{folder}/{n}.parquet").schema) for n in names})
        raise FileNotFoundError(f"no tables of {module}@{version} under {self.root}/{area}")
