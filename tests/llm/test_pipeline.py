from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import minhash
from tidewell.session import materialise

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    """Each stage on what the one before kept, against facts that brute force can see."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes, texts = docs.columns, [docs.count()], {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash", "suffix_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns
        sizes.append(docs.count())
        texts[name] = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in docs.collect()) or name in ("quality_classifier",)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = texts["quality_classifier"]
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) > 0.98 * len(good) and sum(i in kept for i in bad) < 0.5 * len(bad)
    assert texts["line_dedup"].keys() == kept.keys()
    assert sizes[1] == sizes[2] > sizes[3] == sizes[4]
    # brute force: what goes is what occurs twice in the stage's own input
    raws = {i: t.encode() for i, t in texts["minhash"].items()}
    count = Counter(r[k : k + 200] for r in raws.values() for k in range(len(r) - 199))
    for i, r in raws.items():
        gone = bytearray(len(r))
        for k in range(len(r) - 199):
            if count[r[k : k + 200]] > 1:
                gone[k : k + 200] = b"x" * 200
        left = len(r) - gone.count(b"x")
        assert left <= len(texts["suffix_dedup"][i].encode()) <= left + 6 * (1 + len(bytes(gone).split(b"\0")))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == sizes[4]


def test_near_copies_go(spark):
    """No two documents that stay are near copies, and every one that goes has a group that stays."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: set(minhash.shingles(r.text, 5).tolist()) for r in minhash.keep_one(docs).collect()}
    held = {}
    for i, s in kept.items():
        for x in s:
            held.setdefault(x, []).append(i)
    for i, s in kept.items():
        for j, n in Counter(j for x in s for j in held[x] if j < i).items():
            assert 100 * n < 80 * len(s | kept[j])


@pytest.fixture(scope="module")
def hard_sf(spark, hard, labels, tmp_path_factory):
    """A folder whose documents are the hard rows, and one whose tables are empty."""
    folders = []
    for name, rows, own in (("hard", hard, labels), ("none", hard.limit(0), labels.limit(0))):
        folder = tmp_path_factory.mktemp(name)
        rows.coalesce(1).write.parquet(str(folder / "documents.parquet"))
        own.coalesce(1).write.parquet(str(folder / "labels.parquet"))
        folders.append(str(folder))
    return folders


def test_stages_on_hard_rows(spark, hard, hard_sf):
    """Every stage by itself on nulls, empty and long texts, repeats and clashing columns."""
    sf, none = hard_sf
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n, key = docs.count(), lambda r: (str(r.doc_id), r.component)
    before = {key(r): r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        rows = {key(r): r for r in out.collect()}
        assert len(rows) == out.count() and rows.keys() <= before.keys()
        if name in ("line_dedup", "suffix_dedup"):
            assert len(rows) == n and all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows.values())
            assert all(before[k].text in (None, "") for k, r in rows.items() if r.text is None)
        if name == "minhash":
            assert all(rows[k] == before[k] for k in rows)
            assert {k for k in before if before[k].doc_id is None or not (before[k].text or "").strip()} <= rows.keys()
        assert stage(spark, spark.read.parquet(f"{none}/documents.parquet"), none).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    tokens = {r.doc_id: r.n for r in packed.where("start = 0").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert tokens == {r.doc_id: r.n for r in docs.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0


def test_the_whole_run_on_hard_and_empty_tables(spark, hard_sf):
    sf, none = hard_sf
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert corpus_pipeline.run(spark, none).count() == 0


def test_a_text_under_a_shared_id_stays(spark):
    """Stage minhash: another text under the doc_id of a copy is not taken along."""
    from tests.llm.conftest import prose

    a, b = prose(1, 80), prose(2, 80)
    docs = spark.createDataFrame([(1, a), (2, a), (2, b)], "doc_id long, text string")
    out = dict(corpus_pipeline.STAGES)["minhash"](spark, docs, SF)
    assert {(r.doc_id, r.text) for r in out.collect()} == {(1, a), (2, b)}
