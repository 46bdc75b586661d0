import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import quality_classifier as C


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 5)), min_size=1, max_size=12))
def test_isotonic_is_nearest(points):
    y, w = (np.array(x, float) for x in zip(*points, strict=True))
    fit = C.pool_adjacent_violators(y, w)
    assert (np.diff(fit) >= -1e-12).all()
    # the min-max formula of isotonic regression
    n = len(y)
    mean = lambda a, b: (y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
    want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    assert np.allclose(fit, want)


def test_normal_equations_equal_one_pass(spark):
    rng = np.random.default_rng(0)
    model = C.Model(np.zeros(C.N_STATS), np.ones(C.N_STATS), rng.normal(size=(C.N_STATS, 8)), rng.uniform(0, 6, 8), np.zeros(9), np.zeros(1), np.zeros(1))
    x, y = rng.normal(size=(300, C.N_STATS)).astype(np.float32), rng.integers(0, 2, 300)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<float>, y double").repartition(7)
    from functools import partial

    got = C.summed(df.mapInArrow(partial(C._normal_equations, model=model), "sums binary")).reshape(9, 10)
    z = model.features(x.astype(float))
    assert np.allclose(got[:, :9], z.T @ z) and np.allclose(got[:, 9], z.T @ y)


def test_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(1)
    d = 20_000
    model = C.Model(np.zeros(C.N_STATS), np.ones(C.N_STATS), rng.normal(size=(C.N_STATS, d)) / 4, rng.uniform(0, 2 * np.pi, d), None, None, None)
    a, b = rng.normal(size=(2, C.N_STATS))
    za, zb = model.features(np.stack((a, b)))[:, :-1]
    assert abs(za @ zb - np.exp(-((a - b) ** 2).sum() / 32)) < 0.03


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = C.train(docs, labels)
    out = C.classify(docs, model).where("held_out").join(labels, "doc_id").toPandas()
    assert (out.predicted == out.quality).mean() > 0.97
    ranks = out.score.rank()
    good = out.quality == 1
    auc = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.98 and out.score.between(0, 1).all()
    assert out[good].predicted.mean() > 0.99
    kept = C.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == C.classify(docs, model).where("predicted = 1").count()


def test_hard_rows(spark, hard, labels):
    model = C.train(hard, labels)
    rows = C.classify(hard, model).collect()
    assert len(rows) == hard.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id: r.held_out for r in rows if r.doc_id in (1, 2)} == {1: C.held_out(1), 2: C.held_out(2)}
    blank = C.train(hard, labels.limit(0))
    assert {r.score for r in C.classify(hard, blank).collect()} == {0.5}
    assert C.classify(hard.limit(0), model).count() == 0 == C.keep_good(hard.limit(0), model).count()


def test_title_case_share_is_of_all_words():
    for n in (100, 511, 512, 970, 5000):
        words = ["Title" if i % 4 == 1 else "plain" for i in range(n)]
        assert abs(C.statistics(" ".join(words))[-1] - sum(w == "Title" for w in words) / n) < 1e-6
    assert C.statistics(" \n")[-1] == 0


def in_one_pass(docs, labels, n_features=256, width=4.0, ridge=1e-2, folds=4, seed=7):
    """The scores of all rows by numpy alone, as the docstrings say them."""
    rng = np.random.default_rng(seed)
    directions, phases = rng.normal(size=(C.N_STATS, n_features)) / width, rng.uniform(0, 2 * np.pi, n_features)
    x = np.stack([C.statistics(t) for t in docs.text]).astype(np.float64)
    own = docs[["doc_id", "fold"]].assign(at=range(len(docs))).merge(labels[labels.quality.isin([0, 1])], on="doc_id")
    own = own[[zlib.crc32(str(i).encode()) % 3 != 1 for i in own.doc_id]]
    fit, rest = own[own.fold != 0], own[own.fold == 0]
    mean, scale = x[fit["at"]].mean(axis=0), x[fit["at"]].std(axis=0)
    scale[scale <= 1e-9] = 1
    z = np.cos((x - mean) / scale @ directions + phases) * np.sqrt(2 / n_features)
    z = np.column_stack((z, np.ones(len(z))))
    a = z[fit["at"]]
    raw = z @ np.linalg.solve(a.T @ a + ridge * np.eye(n_features + 1), a.T @ fit.quality.to_numpy(float))
    at = np.clip((raw[rest["at"]] - C.LOW) / (C.HIGH - C.LOW) * C.BINS, 0, C.BINS - 1).astype(int)
    bins = np.unique(at)
    y, n = rest.quality.to_numpy(float), np.array([(at == b).sum() for b in bins], float)
    fit_values = C.pool_adjacent_violators(np.array([y[at == b].mean() for b in bins]), n)
    return np.clip(np.interp(raw, C.LOW + (bins + 0.5) * (C.HIGH - C.LOW) / C.BINS, fit_values), 0, 1)


def test_scores_of_all_rows_equal_one_pass(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("fold")).toPandas()
    want = dict(zip(rows.doc_id, in_one_pass(rows, labels.toPandas()), strict=True))
    got = C.classify(docs, C.train(docs.repartition(7), labels)).collect()
    assert len(got) == len(want)
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 1e-3 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_sums_run_in_every_partition(spark):
    from functools import partial

    model = C.train(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int"))
    rows = spark.createDataFrame([([0.0] * C.N_STATS, 1.0)] * 40, "x array<float>, y double").repartition(8)
    tracker, group = spark.sparkContext.statusTracker(), "sums"
    spark.sparkContext.setJobGroup(group, group)
    try:
        C.summed(rows.mapInArrow(partial(C._normal_equations, model=model), "sums binary"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert sum(s.numTasks == 8 for s in stages if s) >= 1


def test_clashing_columns_and_repeats(spark, hard, labels):
    docs = hard.selectExpr("*", "1 as __id", "2 as y", "'z' as x", "3 as calibrates", "4 as quality")
    model = C.train(docs, labels.unionByName(labels))
    assert C.classify(docs, model).count() == docs.count()
    kept = C.keep_good(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == docs.count()
