from collections import Counter

from pyspark.sql import functions as F

from tidewell.llm import token_counts as T
from tidewell.llm.tokenizers import byte_bpe, default_path, encode
from tidewell.session import new_path

PATH = default_path("byte_bpe_50k.tiktoken")


def want(docs, version="v1"):
    total = {}
    for r in docs.collect():
        x = total.setdefault((r.source, r.lang, version), Counter())
        x.update(n_docs=1, n_tokens=len(encode(byte_bpe(PATH), r.text)), n_chars=len(r.text or ""))
    return {(*k, v["n_docs"], v["n_tokens"], v["n_chars"]) for k, v in total.items()}


def rows(df):
    return {tuple(r[c] for c in (*T.GROUP, *T.MEASURES)) for r in df.collect()}


def test_batches_are_added_once(spark, hard):
    rollup = T.Rollup(spark, new_path(spark, "rollup"))
    assert rollup.totals().count() == 0
    counted = T.counts(hard, PATH, "v1")
    assert rollup.commit("a", T.inserted(counted)) and not rollup.commit("a", T.inserted(counted))
    assert rows(rollup.totals()) == want(hard)
    assert rollup.batches() == ["a"]


def test_deletes_and_revisions(spark, hard):
    rollup = T.Rollup(spark, new_path(spark, "rollup"))
    rollup.commit("a", T.inserted(T.counts(hard, PATH, "v1")))
    gone = hard.where("doc_id in (1, 5, 15)")
    rollup.commit("b", T.deleted(T.counts(gone, PATH, "v1")))
    left = hard.where("doc_id is null or doc_id not in (1, 5, 15)")
    assert rows(rollup.totals()) == want(left)
    old = left.where("doc_id in (9, 12)")
    new = old.withColumn("text", F.concat("text", F.lit(" more words"))).withColumn("lang", F.lit("xx"))
    rollup.commit("c", T.revised(T.counts(old, PATH, "v1"), T.counts(new, PATH, "v1")))
    after = left.where("doc_id is null or doc_id not in (9, 12)").unionByName(new)
    assert rows(rollup.totals()) == want(after)
    rollup.commit("d", T.deleted(T.counts(after, PATH, "v1")))
    assert rollup.totals().count() == 0


def test_two_versions_and_empty_batches(spark, hard):
    rollup = T.Rollup(spark, new_path(spark, "rollup"))
    rollup.commit("a", T.inserted(T.counts(hard, PATH, "v1")), T.inserted(T.counts(hard, PATH, "v2")))
    rollup.commit("none", T.inserted(T.counts(hard.limit(0), PATH, "v1")))
    assert rows(rollup.totals()) == want(hard, "v1") | want(hard, "v2")


def test_snapshots_keep_totals_and_batches(spark, hard):
    rollup = T.Rollup(spark, new_path(spark, "rollup"))
    counted = T.counts(hard, PATH, "v1")
    assert rollup.compact() and rollup.totals().count() == 0
    rollup.commit("a", T.inserted(counted))
    assert rollup.compact() and rows(rollup.totals()) == want(hard) and rollup._names("batch-") == []
    assert not rollup.commit("a", T.inserted(counted)) and rollup.batches() == ["a"]
    gone = hard.where("doc_id in (1, 5, 15)")
    rollup.commit("b", T.deleted(T.counts(gone, PATH, "v1")))
    left = want(hard.where("doc_id is null or doc_id not in (1, 5, 15)"))
    assert rows(rollup.totals()) == left
    assert rollup.compact() and rollup._names("snapshot-") == [f"{2:012d}"] and rollup.batches() == ["a", "b"]
    assert rows(rollup.totals()) == left


def test_a_crash_after_a_snapshot_loses_and_doubles_nothing(spark, hard):
    """Folders of batches that a snapshot holds are still there."""
    rollup = T.Rollup(spark, new_path(spark, "rollup"))
    rollup.commit("a", T.inserted(T.counts(hard, PATH, "v1")))
    real = rollup.fs

    class NoDelete:
        def __getattr__(self, name):
            return (lambda *_: True) if name == "delete" else getattr(real, name)

    rollup.fs = NoDelete()
    assert rollup.compact() and rollup._names("batch-") == ["a"]
    rollup.fs = real
    assert rows(rollup.totals()) == want(hard) and rollup.batches() == ["a"]
    rollup.commit("b", T.inserted(T.counts(hard, PATH, "v2")))
    assert rollup.compact() and rollup._names("batch-") == [] and rows(rollup.totals()) == want(hard, "v1") | want(hard, "v2")


def test_the_query_nets_one_count_of_each(spark):
    from tidewell.llm.queries import op9_token_counts

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = rows(op9_token_counts(spark, sf))
    assert {x for x in got if x[2] == "byte_bpe_50k"} == want(docs, "byte_bpe_50k")
    assert {x[:2] for x in got if x[2] == "byte_bpe_multi_50k"} == {x[:2] for x in want(docs)} and len(got) == 2 * len(want(docs))
