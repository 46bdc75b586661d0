"""Operators on literal and random cases, with values computed here."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewell.operators import algebra as A
from tidewell.operators import kv
from tidewell.plans import graph
from tidewell.session import new_path
from tidewell.sources import rowlog, tables


def values(df):
    return sorted(r[0] for r in df.collect())


def pairs(spark, rows):
    return spark.createDataFrame(rows, "key string, value string")


def test_filter(spark):
    bag = A.parallelize(spark, ["abc", "def", "fgh", "fdakhl", "iFu"])
    for f in ("contains(value, 'f')", F.col("value").contains("f"), lambda v: "f" in v):
        assert values(A.keep(bag, f)) == ["def", "fdakhl", "fgh"]


def test_cogroup(spark):
    a = pairs(spark, [("a", "1"), ("a", "2"), ("b", "3"), ("c", "4")])
    b = pairs(spark, [("a", "3"), ("c", "5"), ("c", "6"), ("d", "7")])
    got = sorted((r.key, r.left_values, r.right_values) for r in A.cogroup(a, b).collect())
    assert got == [("a", ["1", "2"], ["3"]), ("b", ["3"], []), ("c", ["4"], ["5", "6"]), ("d", [], ["7"])]


def test_join_is_a_bag(spark):
    r = random.Random(1)
    a = [(f"k{r.randrange(5)}", f"a{i}") for i in range(12)]
    b = [(f"k{r.randrange(6)}", f"b{i}") for i in range(12)]
    want = sorted((k, f"{v},{w}") for k, v in a for x, w in b if x == k)
    assert sorted(map(tuple, A.join_text(pairs(spark, a), pairs(spark, b)).collect())) == want


def test_folds(spark):
    r = random.Random(2)
    rows = [(r.choice("ABC"), r.randrange(20)) for _ in range(24)]
    df = spark.createDataFrame(rows, "key string, value long")
    want = Counter()
    for k, v in rows:
        want[k] += v
    assert {x.key: x.value for x in A.fold_by_key(df, "sum").collect()} == dict(want)
    assert {x.key: x.value for x in A.fold_by_key(df, lambda a, v: a + v, F.lit(0).cast("long")).collect()} == dict(want)
    assert A.fold(df, "sum", 0).first()[0] == sum(v for _, v in rows)
    assert A.fold(df.limit(0), "sum", 0).first()[0] == 0
    assert A.fold(df, "max", 0).first()[0] == max(v for _, v in rows)


def test_python_functions_are_the_same(spark):
    bag = A.parallelize(spark, ["a b", "", "c d e", None])
    assert values(A.flat_map(bag, lambda x: x.split() if x else None)) == list("abcde")
    assert values(A.flat_map(bag, "split(value, ' ')")) == ["", *"abcde"]
    got = A.map_to_pair(bag, lambda x: (x, str(len(x))) if x else None)
    assert sorted(map(tuple, got.collect())) == [("a b", "3"), ("c d e", "5")]
    got = A.flat_map_to_pair(bag, lambda x: [(w, x) for w in (x or "").split()])
    assert got.count() == 5


def test_sets_and_order(spark):
    a, b = A.parallelize(spark, ["x", "x", "y", "z"]), A.parallelize(spark, ["x", "z", "z", "w"])
    assert values(A.intersection(a, b)) == ["x", "z"] and values(A.distinct(a)) == ["x", "y", "z"]
    assert len(tables.take(a, 30)) == 4 and len(tables.take(a, 2)) == 2
    assert [r[0] for r in A.page(a.distinct(), ["value"], 1, 2).collect()] == ["z"]
    assert tables.output(A.sorted_by(a, "value")) == "xxyz" and tables.count(a).first()[0] == 4
    assert A.group_by(a, "'k'").first()["value"] == "x,x,y,z"
    n = A.sample(spark.range(10_000), 0.75, 3).count()
    assert 7200 < n < 7800


def test_wide_and_long(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "y", 5), ("b", "x", 3)], "k string, n string, v long")
    wide = A.to_wide(df, "k", "n", "v")
    assert {r.k: r["columns"] for r in wide.collect()} == {"a": {"x": 1, "y": 5}, "b": {"x": 3}}


def test_key_value_tables(spark):
    rows = [("a", "x", "1", 1), ("a", "y", "2", 2), ("a", "x", "3", 3), ("b", "x", "4", 4), ("c", "x", "5", 5), ("ab", "x", "6", 6)]
    df = spark.createDataFrame(rows, kv.SCHEMA)
    assert kv.get(df, "a", "x").first()["value"] == "3" and kv.get(df, "z", "x").count() == 0
    assert kv.get_row(df, "a").first()["columns"] == {"x": "3", "y": "2"}
    assert kv.exists(df, "b").first()[0] and not kv.exists(df, "z").first()[0]
    assert values(kv.scan(df, "a", "b").select("row_key").distinct()) == ["a", "ab"]
    assert values(kv.scan(df, end="b").select("row_key").distinct()) == ["a", "ab"]
    assert kv.count_rows(df).first()[0] == 4
    assert [r.row_key for r in kv.page(df, "ab", 2).collect()] == ["ab", "b", "c"]


def test_store(spark):
    store = kv.Store(spark, new_path(spark, "store"))
    df = spark.createDataFrame([("a", "x", "1", 1), ("a", "x", "2", 2)], kv.SCHEMA)
    store.persist("t")
    store.put("t", df)
    with pytest.raises(ValueError):
        store.persist("t")
    with pytest.raises(KeyError):
        store.changes("none")
    store.rename("t", "u")
    store.persist("t")
    with pytest.raises(ValueError):
        store.rename("u", "t")
    store.compact("u")
    assert store.tables() == ["t", "u"] and store.changes("u").count() == 1
    store.delete("t")
    assert store.tables() == ["u"]
    plan = kv.scan(store.changes("u"), "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(row_key,a)" in plan and "LessThan(row_key,b)" in plan


def test_row_log(spark, tmp_path):
    rows = [("k1", {"c": b"one\ntwo", "d": b""}), ("k2", {"c": "é x".encode()}), ("k1", {"c": b"late"}), ("k3", {})]
    data = rowlog.encode(rows)
    assert data.startswith(b"k1 c 7 one\ntwo d 0  \n")
    assert list(rowlog.decode(data)) == [(k, c, v) for k, cells in rows for c, v in cells.items()]
    (tmp_path / "x.table").write_bytes(data)
    got = kv.rows(rowlog.read(spark, str(tmp_path / "x.table")))
    assert {r.row_key: r["columns"] for r in got.collect()} == {"k1": {"c": "late", "d": ""}, "k2": {"c": "é x"}}
    with pytest.raises(ValueError):
        rowlog.encode([("a b", {})])


def test_streamed_changes(spark, tmp_path):
    from tidewell.streaming import append_changes

    src = str(tmp_path / "src")
    spark.createDataFrame([("a", "x", "1", 1), ("a", "x", "2", 2)], kv.SCHEMA).write.parquet(src)
    store = kv.Store(spark, new_path(spark, "store"))
    append_changes(spark.readStream.schema(kv.SCHEMA).parquet(src), store, "s", str(tmp_path / "cp")).awaitTermination()
    assert kv.get(store.changes("s"), "a", "x").first()["value"] == "2"



def test_ranks(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("c", "a"), ("d", "c"), ("d", "x"), ("a", "a")]
    nodes = ["a", "b", "c", "d", "e"]
    out = {}
    for s, d in set(edges):
        out.setdefault(s, set()).add(d)
    rank, n = dict.fromkeys(nodes, 1.0), 0
    while True:
        new = {p: 0.15 + sum(0.85 * rank[s] / len(t) for s, t in out.items() if p in t) for p in nodes}
        n += 1
        change, rank = max(abs(new[p] - rank[p]) for p in nodes), new
        if change < 0.01:
            break
    got, rounds = graph.converge(spark.createDataFrame([(x,) for x in nodes], "id string"), spark.createDataFrame(edges, "src string, dst string"))
    assert rounds == n and {r.id: round(r["rank"], 9) for r in got.collect()} == {k: round(v, 9) for k, v in rank.items()}
    five = graph.rounds(spark.createDataFrame([(x,) for x in nodes], "id string"), spark.createDataFrame(edges, "src string, dst string"), 5)
    assert five.count() == 5


# The links of a nine-page site, and its ranks when no rank changes by 0.01.
SITE = {
    "/": ["/", "/ItU5tEu.html", "/LE4.html", "/ND3.html", "/SL7sCi.html", "/UJ2p.html", "/xr6yf.html"],
    "/CN9CmwX.html": ["/ND3.html"],
    "/Cv1epgGc.html": ["/CN9CmwX.html", "/ND3.html"],
    "/ItU5tEu.html": ["/LE4.html", "/SL7sCi.html"],
    "/LE4.html": ["/LE4.html", "/SL7sCi.html", "/xr6yf.html"],
    "/ND3.html": ["/UJ2p.html"],
    "/SL7sCi.html": ["/CN9CmwX.html", "/LE4.html", "/ND3.html", "/SL7sCi.html"],
    "/UJ2p.html": ["/Cv1epgGc.html"],
    "/xr6yf.html": [],
}
RANKS = {
    "/": 0.17073170731719883, "/ItU5tEu.html": 0.17073170731719883, "/xr6yf.html": 0.30751177010942815,
    "/SL7sCi.html": 0.482657792813796, "/LE4.html": 0.482657792813796, "/CN9CmwX.html": 0.890940650951408,
    "/Cv1epgGc.html": 1.5045544412921787, "/UJ2p.html": 1.5840614770952648, "/ND3.html": 1.6640183069267136,
}


def test_ranks_of_a_site(spark):
    pages = spark.createDataFrame([(p,) for p in SITE], "id string")
    edges = spark.createDataFrame([(p, x) for p, to in SITE.items() for x in to], "src string, dst string")
    got, rounds = graph.converge(pages, edges, 0.01)
    assert rounds == 14
    assert all(abs(r["rank"] - RANKS[r.id]) < 1e-12 for r in got.collect())


def test_spread_and_release(spark):
    from tidewell import session

    few, many = spark.range(100).coalesce(1), spark.range(100).repartition(9)
    assert session.spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert session.spread(many).rdd.getNumPartitions() == 9 and session.spread(few).count() == 100
    kept = session.materialise(few, "x")
    assert kept.count() == 100
    session.release(spark)
    assert session._WRITTEN == []


@pytest.mark.parametrize(("f", "zero", "want"), [("sum", 10, 13), ("max", 10, 10), ("max", 0, 2), ("min", 0, 0), ("min", 9, 1), ("count", 5, 7)])
def test_folds_start_at_their_zero(spark, f, zero, want):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "key string, value long")
    assert A.fold_by_key(df, f, zero).first().value == want
    assert A.fold(df, f, zero).first()[0] == want
    assert A.fold(df.limit(0), f, zero).first()[0] == zero


def test_concatenations_start_at_their_zero(spark):
    df = pairs(spark, [("a", "y"), ("a", "x"), ("a", "x")])
    assert A.fold_by_key(df, "concat", "z").first().value == "z,x,x,y"
    assert A.fold_by_key(df, "concat_distinct", "").first().value == A.fold_by_key(df, "concat_distinct").first().value == "x,y"
    assert A.fold(df, "concat", "z").first()[0] == "z,x,x,y" and A.fold(df.limit(0), "concat", "z").first()[0] == "z"


def test_union_and_difference_of_bags(spark):
    a, b = A.parallelize(spark, list("aabbc")), A.parallelize(spark, list("abd"))
    assert values(A.union(a, b)) == sorted("aabbcabd")
    assert values(A.subtract(a, b)) == ["a", "b", "c"] and values(A.subtract(a, b, distinct=True)) == ["c"]


def test_blocks_of_hot_keys(spark):
    rows = [("hot", f"v{i % 900}") for i in range(1800)] + [("cold", "x")]
    got = A.blocked(pairs(spark, rows), "key", "value", 100).collect()
    assert sorted(v for r in got for v in r.members if r.key == "hot") == sorted({v for k, v in rows if k == "hot"})
    assert sum(r.key == "hot" for r in got) == 9 and max(len(r.members) for r in got) < 200
    assert [(r.block, r.members) for r in got if r.key == "cold"] == [(0, ["x"])]


def test_routes_wrap_around(spark):
    keys = spark.createDataFrame([(k,) for k in ("a", "d", "dz", "m", "z")], "row_key string")
    assert {r.row_key: r.worker for r in kv.route(keys, ["m", "d"]).collect()} == {"a": "m", "d": "d", "dz": "d", "m": "m", "z": "m"}


def test_compaction_survives_a_crash_at_each_step(spark):
    changes = spark.createDataFrame([("r", "c", "old", 1), ("r", "c", "new", 2)], kv.SCHEMA)
    for step in range(4):
        store = kv.Store(spark, new_path(spark, "kv"))
        store.put("t", changes)
        real, calls = store.fs, []

        class Crashing:
            def __getattr__(self, name, real=real, calls=calls, step=step):
                def run(*args):
                    if name in ("rename", "delete"):
                        if len(calls) == step:
                            raise OSError("crash")
                        calls.append(name)
                    return getattr(real, name)(*args)

                return run

        store.fs = Crashing()
        with pytest.raises(OSError, match="crash"):
            store.compact("t")
        store.fs = real
        assert store.tables() == ["t"]
        assert [(r.value, r.seq) for r in kv.latest(store.changes("t")).collect()] == [("new", 2)]
        store.compact("t")
        assert store.tables() == ["t"] and store.changes("t").count() == 1


def test_a_rename_that_fails_is_told(spark):
    store = kv.Store(spark, new_path(spark, "kv"))
    store.persist("t")

    class Refusing:
        def __init__(self, real):
            self.real = real

        def __getattr__(self, name):
            return (lambda *_: False) if name == "rename" else getattr(self.real, name)

    store.fs = Refusing(store.fs)
    with pytest.raises(OSError, match="could not be renamed"):
        store.rename("t", "u")
