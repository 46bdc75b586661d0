import hashlib
import random

import numpy as np
import pytest

from tests.llm.conftest import hard_rows
from tidewell.llm import line_dedup as L

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    held = {}
    for n, (i, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            key = line.strip(WHITE).translate(LOWER)
            if len(key) >= 20:
                held.setdefault(key, set()).add((n, i))
    keeper = {k: max(-(1 << 63) if i is None else i for _, i in v) for k, v in held.items() if len(v) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        own = -(1 << 63) if i is None else i
        kept = [x for x in lines if keeper.get(x.strip(WHITE).translate(LOWER), own) == own]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return out


def many_lines():
    r = random.Random(2)
    pool = [f"Pool line number {k} with some é text" for k in range(40)]
    return [(i, t) for i, t, _ in hard_rows()] + [(1000 + k, "\n".join(r.choice(pool) + r.choice(["", " ", "\t"]) for _ in range(r.randint(0, 6)))) for k in range(200)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_equals_brute_force(spark, broadcast):
    rows = many_lines()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as n_lines", "1 as shard").repartition(5)
    how = {} if broadcast else {"broadcast_bytes": 0, "keys_per_shard": 5, "rows_per_salt": 20}
    want = brute(rows)
    got = L.dedup_lines(docs, **how).collect()
    key = lambda x: str(tuple(x))
    assert sorted(map(tuple, got), key=key) == sorted((x[:4] for x in want), key=key)
    texts = L.dedup_lines(docs, texts=True, **how)
    assert texts.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in texts.collect()), key=key) == sorted(((x[0], x[4]) for x in want), key=key)
    assert L.dedup_lines(docs.limit(0), **how).count() == 0 == L.dedup_lines(docs.limit(0), texts=True, **how).count()


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 1000, 20_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        seeds = L.build_mph(keys)
        assert sorted(L.slot_of(keys, seeds, len(keys)).tolist()) == list(range(len(keys)))


def test_shard_numbers_equal_spark(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    h = rng.integers(-(1 << 63), 1 << 63, 100)
    got = [r[0] for r in spark.createDataFrame([(int(x),) for x in h], "b long").select(F.pmod(F.hash("b"), F.lit(7))).collect()]
    assert L.shard_numbers(np.column_stack((h, h)).view(np.uint64), 7).tolist() == got


def test_shards_tell_counts():
    rng = np.random.default_rng(3)
    hashes = np.unique(rng.integers(0, 1 << 63, (5000, 2), dtype=np.uint64), axis=0)
    count, doc = rng.integers(2, 1 << 40, len(hashes)), rng.integers(-5, 1 << 40, len(hashes))
    shard = L.Shard(*L.build_shard(hashes, count, doc))
    got, docs = shard.probe(hashes)
    assert (got == np.minimum(count, (1 << 32) - 1)).all() and (docs == doc).all()
    assert (shard.probe(hashes + np.uint64(1))[0] == 0).all()


def test_hashes_that_blend_alike_get_another_salt():
    a = np.array([5, 9], np.uint64)
    b = L.mix(a, 0) ^ np.uint64(77)  # both blend to 77 under salt 0
    hashes = np.column_stack((a, b))
    assert L.distinct_salt(hashes) == 1
    got, docs = L.Shard(*L.build_shard(hashes, np.array([3, 4]), np.array([1, 2]))).probe(hashes)
    assert got.tolist() == [3, 4] and docs.tolist() == [1, 2]


@pytest.mark.parametrize("least_docs", [2, 4])
def test_other_thresholds(spark, least_docs):
    rows = [(i, "\n".join(f"one line of twenty characters {k}" for k in range(6) if i <= k)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in L.dedup_lines(docs, least_docs=least_docs).collect()}
    # line k is in documents 0..k, of which k keeps it
    assert got == {i: sum(k + 1 >= least_docs and i < k for k in range(i, 6)) for i in range(6)}
