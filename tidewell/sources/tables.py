"""Bags and pairs from tables, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_table(df: DataFrame, value: Column | str) -> DataFrame:
    """A bag of one expression over a table's rows, without nulls."""
    return df.select((F.expr(value) if isinstance(value, str) else value).alias("value")).where("value is not null")


def save_bag(df: DataFrame, path: str, mode: str = "error") -> None:
    df.select("value").write.mode(mode).parquet(path)


def save_pairs(df: DataFrame, path: str, mode: str = "error") -> None:
    """Pairs in long form, one row a pair: no column per value, so keys may be hot."""
    df.select("key", "value").write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def take(df: DataFrame, n: int) -> list:
    """Up to n elements, any."""
    return df.take(n)


def count(df: DataFrame) -> DataFrame:
    """The number of elements, duplicates included, as one row."""
    return df.agg(F.count("*").alias("n"))


def output(df: DataFrame, column: str = "value") -> str:
    """A small result's strings, concatenated on the driver."""
    return "".join(r[0] for r in df.select(column).toLocalIterator())


def with_parallelism(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)
