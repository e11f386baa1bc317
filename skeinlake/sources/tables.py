"""Stage tables in a warehouse folder: written whole, read back, listed and dropped."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F


class Warehouse:
    """Parquet tables by name in one folder. A stage replaces its table; rows are never changed in place."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.path(name)))

    def write(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> DataFrame:
        """Replace (or ``append`` to) a table and return it as read from its files.

        The new files are complete before the old ones go, so a table may be rewritten from itself.
        """
        if mode == "append":
            df.write.mode("append").partitionBy(*partition_by).parquet(self.path(name))
            return self.read(name)
        fresh = self.path(f"__new_{name}")
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(fresh)
        self.drop(name)
        self._fs.rename(self._path(fresh), self._path(self.path(name)))
        return self.read(name)

    def duplicates(self, df: DataFrame, key: tuple[str, ...]) -> DataFrame:
        """(key, n) of keys that several rows have."""
        return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")

    def upsert(self, name: str, rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
        """Replace the rows that have a key of ``rows`` and add the others. Keys of ``rows`` must be unique and not null;
        columns that one side lacks are null there."""
        bad = rows.where(F.expr(" OR ".join(f"`{c}` IS NULL" for c in key))).select(*key).unionByName(self.duplicates(rows, key).select(*key))
        if not bad.isEmpty():
            raise ValueError(f"keys ({', '.join(key)}) must be unique and not null")
        if not self.exists(name):
            return self.write(name, rows)
        others = self.read(name).join(rows.select(*key), list(key), "left_anti")
        return self.write(name, others.unionByName(rows, allowMissingColumns=True))

    def update(self, name: str, changes: DataFrame, key: tuple[str, ...]) -> DataFrame:
        """Set the columns of ``changes`` in rows of its keys; nulls in it change nothing, and unknown keys add nothing."""
        if not self.duplicates(changes, key).isEmpty():
            raise ValueError(f"keys ({', '.join(key)}) must be unique")
        old = self.read(name)
        fields = [c for c in changes.columns if c not in key]
        new = changes.select(*key, *(F.col(c).alias(f"__new_{c}") for c in fields))
        both = old.join(new, list(key), "left")
        return self.write(name, both.select(*(F.coalesce(f"__new_{c}", c).alias(c) if c in fields else F.col(c) for c in old.columns)))

    def create_if_missing(self, name: str, schema: str) -> DataFrame:
        if not self.exists(name):
            self.spark.createDataFrame([], schema).write.parquet(self.path(name))
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def drop(self, name: str) -> bool:
        return self._fs.delete(self._path(self.path(name)), True)

    def names(self) -> list[str]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)) if not s.getPath().getName().startswith("__"))

    def count(self, *names: str) -> int:
        """Rows of several tables together, from file metadata."""
        return sum(self.read(n).count() for n in names)

    def query(self, sql: str, **params: Any) -> DataFrame:
        """A SELECT over the tables with named parameters (``:name``); values are never pasted into the text."""
        for n in self.names():
            self.read(n).createOrReplaceTempView(n)
        return self.spark.sql(sql, args=params)


def union_all(*tables: DataFrame) -> DataFrame:
    """Rows of all tables, columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def structured_schema(nodes: DataFrame, hide: str = "Searchable") -> DataFrame:
    """(label, property, n) of a property graph (id, labels, props), hidden words left out."""
    rows = nodes.select(F.explode("labels").alias("label"), F.explode_outer(F.map_keys("props")).alias("property"))
    shown = rows.where(~F.contains("label", F.lit(hide)) & ~F.contains(F.coalesce("property", F.lit("")), F.lit(hide)))
    return shown.groupBy("label", "property").agg(F.count("*").alias("n"))


def unseen(listing: DataFrame, manifest: DataFrame, on: tuple[str, ...] = ("path", "modificationTime")) -> DataFrame:
    """Files of a listing that no manifest row knows."""
    return listing.join(manifest.select(*on), list(on), "left_anti")
