"""Versioned key-value tables.

A table is a folder of change rows (row_key, col, value, seq). Writing appends; reading
takes the last write of each cell, which aggregates partially before the shuffle.
Filters on row_key reach the Parquet scan, so point reads and range scans skip row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "row_key string, col string, value string, seq long"
NEW, DONE, OLD = ".writing", ".compacted", ".replaced"  # versions of a table while it is compacted


def latest(changes: DataFrame) -> DataFrame:
    """row_key, col, value, seq of the last write of each cell."""
    last = F.max(F.struct("seq", "value"))
    return changes.groupBy("row_key", "col").agg(last.alias("x")).select("row_key", "col", "x.value", "x.seq")


def get(changes: DataFrame, row_key: str, col: str) -> DataFrame:
    return latest(changes.where((F.col("row_key") == row_key) & (F.col("col") == col)))


def get_row(changes: DataFrame, row_key: str) -> DataFrame:
    return rows(changes.where(F.col("row_key") == row_key))


def exists(changes: DataFrame, row_key: str) -> DataFrame:
    """One row, ``found``."""
    return changes.where(F.col("row_key") == row_key).limit(1).agg((F.count("*") > 0).alias("found"))


def rows(changes: DataFrame) -> DataFrame:
    """row_key and a map of its columns; new columns join old ones, the last write wins."""
    return latest(changes).groupBy("row_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "value")))).alias("columns"))


def scan(changes: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Cells with start <= row_key < end, strings compared by bytes; either end may be open."""
    if start is not None:
        changes = changes.where(F.col("row_key") >= start)
    if end is not None:
        changes = changes.where(F.col("row_key") < end)
    return latest(changes)


def count_rows(changes: DataFrame) -> DataFrame:
    return changes.agg(F.countDistinct("row_key").alias("n"))


def page(changes: DataFrame, start: str = "", size: int = 10) -> DataFrame:
    """The ``size`` rows from ``start`` on by key, and the key that the next page starts at."""
    keys = changes.where(F.col("row_key") >= start).select("row_key").distinct().orderBy("row_key").limit(size + 1)
    return rows(changes.where(F.col("row_key") >= start).join(F.broadcast(keys), "row_key", "left_semi")).orderBy("row_key")


def route(changes: DataFrame, workers: list[str]) -> DataFrame:
    """The changes with ``worker``: the greatest worker id that is not above the row key;
    keys below all ids go to the greatest id, whose range wraps around."""
    ids = F.array(*map(F.lit, sorted(workers)))
    below = F.array_max(F.filter(ids, lambda w: w <= F.col("row_key")))
    return changes.withColumn("worker", F.coalesce(below, F.lit(max(workers))))


class Store:
    """Named tables below one folder of a store that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def persist(self, name: str) -> None:
        """Create a table; it must not be there."""
        if self.fs.exists(self._path(name)):
            raise ValueError(f"table {name} exists")
        self.spark.createDataFrame([], SCHEMA).write.parquet(f"{self.folder}/{name}")

    def put(self, name: str, changes: DataFrame) -> None:
        """Append change rows, sorted by key within ranges so that scans can skip files."""
        changes.select("row_key", "col", "value", "seq").repartitionByRange("row_key").sortWithinPartitions("row_key").write.mode("append").parquet(f"{self.folder}/{name}")

    def changes(self, name: str) -> DataFrame:
        self._mend(name)
        if not self.fs.exists(self._path(name)):
            raise KeyError(name)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/{name}")

    def rename(self, name: str, to: str) -> None:
        if not self.fs.exists(self._path(name)):
            raise KeyError(name)
        if self.fs.exists(self._path(to)):
            raise ValueError(f"table {to} exists")
        if not self.fs.rename(self._path(name), self._path(to)):
            raise OSError(f"table {name} could not be renamed to {to}")

    def path(self, name: str) -> str:
        """Where a table is stored."""
        return f"{self.folder}/{name}"

    def delete(self, name: str) -> None:
        if not self.fs.delete(self._path(name), True):
            raise KeyError(name)

    def tables(self) -> list[str]:
        """Names of tables."""
        found = [x.getPath().getName() for x in self.fs.listStatus(self._path(""))] if self.fs.exists(self._path("")) else []
        return sorted({x.removesuffix(DONE) for x in found if not x.endswith((OLD, NEW))})

    def _mend(self, name: str) -> None:
        """Give a table its name back that a crash took between the renames of ``compact``."""
        if not self.fs.exists(self._path(name)) and self.fs.exists(self._path(name + DONE)):
            self.rename(name + DONE, name)

    def compact(self, name: str) -> None:
        """Keep the last write of each cell only. The new version is whole, and named so,
        before the old one is moved, and the old one goes last: a crash leaves one of them,
        and the next reader mends its name."""
        self._mend(name)
        for leftover in (NEW, DONE, OLD):
            if self.fs.exists(self._path(name + leftover)):
                self.delete(name + leftover)
        latest(self.changes(name)).repartitionByRange("row_key").sortWithinPartitions("row_key").write.parquet(self.path(name + NEW))
        self.rename(name + NEW, name + DONE)
        self.rename(name, name + OLD)
        self.rename(name + DONE, name)
        self.delete(name + OLD)
