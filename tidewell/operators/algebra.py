"""The algebra of bags (one column ``value``) and pairs (``key``, ``value``).

Where an operator takes a function, give a Column or SQL expression: Catalyst then
sees through it. A Python callable is the slow path; it runs over Arrow batches.
Bags keep duplicates and have no order. A null result emits nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.session import prepare

Function = Column | str | Callable
PAIR = "key string, value string"


def _column(f: Column | str) -> Column:
    return F.expr(f) if isinstance(f, str) else f


def _by_rows(df: DataFrame, f: Callable, schema: str, many: bool) -> DataFrame:
    """Apply a Python function to each row's columns; ``many``: it gives an iterable."""
    width = schema.count(",") + 1
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = f(*row)
                for x in (got or ()) if many else (got,):
                    if x is not None:
                        out.append((x,) if width == 1 else tuple(x))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=names)

    prepare(df.sparkSession)
    return df.mapInArrow(run, schema)


# --- projection -------------------------------------------------------------------


def flat_map(df: DataFrame, f: Function) -> DataFrame:
    """0..n values per element or pair; ``f`` gives an array."""
    if callable(f) and not isinstance(f, Column):
        return _by_rows(df, f, "value string", True)
    return df.select(F.explode(_column(f)).alias("value")).where("value is not null")


def map_to_pair(df: DataFrame, key: Function, value: Column | str | None = None) -> DataFrame:
    """0..1 pair per element; a pair with a null key is dropped. A callable gives the pair."""
    if value is None:
        return _by_rows(df, key, PAIR, False)
    return df.select(_column(key).alias("key"), _column(value).alias("value")).where("key is not null")


def flat_map_to_pair(df: DataFrame, f: Function) -> DataFrame:
    """0..n pairs per element or pair; ``f`` gives an array of (key, value) structs."""
    if callable(f) and not isinstance(f, Column):
        return _by_rows(df, f, PAIR, True)
    return df.select(F.inline(_column(f)).alias("key", "value")).where("key is not null")


def map_partitions(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """A function from the batches of a partition to batches."""
    prepare(df.sparkSession)
    return df.mapInPandas(f, schema)


def to_long(df: DataFrame, key: str, entries: str) -> DataFrame:
    """``key -> [(name, value)]`` to one row per entry (key, name, value)."""
    return df.select(key, F.inline(F.expr(entries)))


def to_wide(df: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """One row per key with a map from name to its greatest value."""
    one = df.groupBy(key, name).agg(F.max(value).alias(value))
    return one.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias("columns"))


# --- filters ------------------------------------------------------------------------


def keep(df: DataFrame, f: Function) -> DataFrame:
    """Elements for which ``f`` is true."""
    if callable(f) and not isinstance(f, Column):
        return map_partitions(df, lambda it: (x[[bool(f(*r)) for r in x.itertuples(index=False)]] for x in it), df.schema)
    return df.where(_column(f))


def sample(df: DataFrame, fraction: float, seed: int | None = None) -> DataFrame:
    """Each element by itself with the probability ``fraction``."""
    return df.sample(False, fraction, seed)


def sample_by_hash(df: DataFrame, column: str, fraction: float) -> DataFrame:
    """A sample that any engine can repeat: the first byte of the key's MD5 is below the fraction."""
    return df.where(F.substring(F.md5(F.col(column).cast("string")), 1, 2) < f"{round(fraction * 256):02x}")


# --- joins --------------------------------------------------------------------------


def join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join of pairs on the key, n times m rows: key, left_value, right_value."""
    return a.select("key", F.col("value").alias("left_value")).join(b.select("key", F.col("value").alias("right_value")), "key")


def join_text(a: DataFrame, b: DataFrame) -> DataFrame:
    """The join with both values in one string, separated by a comma."""
    return join(a, b).select("key", F.concat_ws(",", "left_value", "right_value").alias("value"))


def cogroup(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, left_values, right_values (sorted; empty where a side lacks the key)."""
    side = lambda df, name: df.groupBy("key").agg(F.array_sort(F.collect_list("value")).alias(name))
    both = side(a, "left_values").join(side(b, "right_values"), "key", "full")
    return both.select("key", *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("left_values", "right_values")))


def cogroup_text(a: DataFrame, b: DataFrame) -> DataFrame:
    """The cogroup as ``[x,..],[y,..]``."""
    text = lambda c: F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))
    return cogroup(a, b).select("key", F.concat_ws(",", text("left_values"), text("right_values")).alias("value"))


def semi_join(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    return a.join(b.select(on), on, "left_semi")


def anti_join(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    return a.join(b.select(on), on, "left_anti")


def lookup(a: DataFrame, b: DataFrame, on: str, **defaults) -> DataFrame:
    """Left outer join with defaults for what ``b`` lacks."""
    joined = a.join(b.select(on, *defaults), on, "left")
    return joined.select(*a.columns, *(F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()))


# --- folds --------------------------------------------------------------------------

#: Folds that Spark can sum partially before the shuffle.
ALGEBRA: dict[str, Callable[[str], Column]] = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "count": lambda c: F.count(F.lit(1)),
    "concat": lambda c: F.array_join(F.array_sort(F.collect_list(c)), ","),
    "concat_distinct": lambda c: F.array_join(F.array_sort(F.collect_set(c)), ","),
}
#: What a fold makes of its zero element and of the fold of the values.
WITH_ZERO: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda zero, x: zero + F.coalesce(x, zero - zero),
    "max": lambda zero, x: F.greatest(zero, x),
    "min": lambda zero, x: F.least(zero, x),
    "count": lambda zero, x: zero + x,
    "concat": lambda zero, x: F.concat_ws(",", F.when(zero != "", zero), F.when(x != "", x)),
    "concat_distinct": lambda zero, x: F.concat_ws(",", F.when(zero != "", zero), F.when(x != "", x)),
}


def _fold(value: str, f: str | Callable[[Column, Column], Column], zero) -> Column:
    start = zero if isinstance(zero, Column) else F.lit(zero)
    if isinstance(f, str):
        folded = ALGEBRA[f](value)
        return folded if zero is None else WITH_ZERO[f](start, folded)
    return F.aggregate(F.array_sort(F.collect_list(value)), start, f)


def fold_by_key(pairs: DataFrame, f: str | Callable[[Column, Column], Column], zero=None, value: str = "value") -> DataFrame:
    """One row per key: ``zero`` folded with the key's values, once. ``f`` names an algebra
    of ALGEBRA (``zero`` may then be left out), or is (accumulator, value) -> accumulator,
    applied in ascending order of the values; the latter gathers a key's values, so use it
    for keys of bounded size. A zero that is not empty comes first in a concatenation."""
    return pairs.groupBy("key").agg(_fold(value, f, zero).alias("value"))


def fold(df: DataFrame, f: str | Callable[[Column, Column], Column], zero, value: str = "value") -> DataFrame:
    """A single row: ``zero`` folded with all values, once; ``zero`` for an empty bag."""
    return df.agg(F.coalesce(_fold(value, f, zero), F.lit(zero)).alias("value"))


def group_by(df: DataFrame, key: Column | str) -> DataFrame:
    """key, and its members in one string, sorted, separated by commas."""
    return df.select(_column(key).alias("key"), "value").groupBy("key").agg(ALGEBRA["concat"]("value").alias("value"))


def blocked(df: DataFrame, key: str, member: str, size: int = 10_000) -> DataFrame:
    """key, block, members: the distinct members of each key in sorted blocks of about
    ``size``. Members are dealt to blocks by hash, as many as the key needs, so a key that
    a third of all rows have is many rows, made by many tasks."""
    pairs = df.select(key, member).distinct()
    sizes = pairs.groupBy(F.col(key).alias("__key")).agg(F.ceil(F.count("*") / size).alias("__blocks"))
    dealt = pairs.join(sizes, F.col(key) == F.col("__key")).withColumn("block", F.pmod(F.xxhash64(member), "__blocks").cast("int"))
    return dealt.groupBy(key, "block").agg(F.array_sort(F.collect_list(member)).alias("members"))


def postings_by_count(df: DataFrame, key: str, doc: str, n: str) -> DataFrame:
    """key -> documents by falling count, then document."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(n)).alias("n"), F.col(doc).alias("doc"))))
    return df.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["doc"].cast("string")), ",").alias("docs"))


# --- sets, order ----------------------------------------------------------------------


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Elements of both, each once."""
    return a.intersect(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Elements of either, duplicates kept; columns are matched by name."""
    return a.unionByName(b)


def subtract(a: DataFrame, b: DataFrame, distinct: bool = False) -> DataFrame:
    """Elements of ``a`` less those of ``b``: each copy in ``b`` takes one away or, with
    ``distinct``, all of them, and what is left stands once."""
    return a.subtract(b) if distinct else a.exceptAll(b)


def top(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows of an order, which must be total for one result."""
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, order: list, number: int, size: int = 10) -> DataFrame:
    """A page (from 0) of an order: rows ``number * size`` onwards."""
    return df.orderBy(*order).limit((number + 1) * size).offset(number * size)


def sorted_by(df: DataFrame, *order) -> DataFrame:
    return df.orderBy(*order)


def parallelize(spark, values: Iterable[str]) -> DataFrame:
    """A bag from a local list."""
    return spark.createDataFrame([(x,) for x in values], "value string")
