import random
import re
from collections import Counter
from math import comb, exp

from pyspark.sql import functions as F

from tests.llm.conftest import hard_rows
from tidewell.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_counts(spark, hard, labels):
    extra = "a b c d e f a b c d e x # | <> \n\nl\nl\nl\n \n \n" + "p q r s t " * 3
    docs = hard.select("doc_id", "text", "lang", "kept").unionByName(spark.createDataFrame([(50, extra, "en", "z")], "doc_id long, text string, lang string, kept string"))
    got = sorted(tuple(r) for r in Q.judge(docs, labels).select(F.coalesce("doc_id", F.lit(-1)), *Q.COUNTS).collect())
    assert got == sorted((-1 if i is None else i, *brute(t)) for i, t, _ in [*hard_rows(), (50, extra, "en")])


def test_verdicts(spark, hard, labels):
    rows = Q.judge(hard, labels).collect()
    assert len(rows) == hard.count()
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed)  # too few labels to certify any cutoff
    assert Q.judge(hard.limit(0), labels).count() == 0
    assert Q.judge(hard, labels.limit(0)).where("kept").count() == sum(r.kept for r in rows)


def test_binomial_tail(spark):
    cases = [(0, 100), (1, 100), (3, 400), (0, 5), (4, 500), (9, 1000)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", Q.log_binomial_cdf(F.col("k"), F.col("n"), 0.01).alias("p"))
    for r in df.collect():
        want = 1.0 if r.k >= 0.01 * r.n else sum(comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1))
        assert abs(exp(r.p) - want) < 1e-9


def test_certified_cutoffs_reject_junk_and_few_good(spark):
    rows, labels = [], []
    for i in range(4000):
        junk = i % 4 == 0
        text = " ".join(f"w{(i * 7 + k * k) % 977}{'###' if junk else ''}" for k in range(30))
        rows.append((i, text, "en" if i % 3 else None))
        labels.append((i, 0 if junk else 1))
    docs, held = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    out = Q.judge(docs, held).join(held, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    assert {r.quality: r.kept for r in out} == {0: 0.0, 1: 1.0}


def test_small_strata_are_certified(spark):
    """600 good labels are enough alone; strata of 300 are tested together; one without labels is left alone."""
    rows, labels = [], []
    for lang, good, junk in [("a", 600, 60), ("b", 300, 30), (None, 300, 30), ("none", 0, 30)]:
        for i in range(good + junk):
            bad = i >= good
            rows.append((len(rows), " ".join(f"w{(i * 7 + k * k) % 977}{'###' if bad else ''}" for k in range(30)), lang))
            if lang != "none":
                labels.append((rows[-1][0], 0 if bad else 1))
    docs, held = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    out = Q.judge(docs, held).join(docs.select("doc_id", "lang"), "doc_id").join(held, "doc_id", "left")
    got = {(r.lang, r.quality): r.kept for r in out.groupBy("lang", "quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    want = {(lang, q): float(q) for lang in ("a", "b", None) for q in (0, 1)}
    assert got == {**want, ("none", None): 1.0}


def test_pool_is_chosen_by_label_counts_and_bounded(spark):
    def tally(*sizes):
        return spark.createDataFrame([(str(i), 0, n) for i, n in enumerate(sizes)], "stratum string, step int, n long")

    # levels: 299 good labels for one tested stratum, 368 for two, 408 for three, 437 for four
    assert Q.tested_alone(tally(2076, 507, 505, 321), 0.01, 0.05) == (507, 3)  # so that the pool has enough, too
    assert Q.tested_alone(tally(2076, 437, 437, 437), 0.01, 0.05) == (437, 4)
    assert Q.tested_alone(tally(2076, 436, 436, 436), 0.01, 0.05) == (2076, 2)
    assert Q.tested_alone(tally(600, 10), 0.01, 0.05) == (600, 2)
    assert Q.tested_alone(tally(200, 200), 0.01, 0.05)[1] == 1 and Q.tested_alone(tally(200, 200), 0.01, 0.05)[0] > 400


def labelled(spark):
    """Documents in four languages, of which good ones break a rule now and then."""
    r = random.Random(5)
    rows, labels = [], []
    for lang, good in (("en", 1500), ("de", 450), ("fr", 250), (None, 200), ("es", 40)):
        for i in range(good + good // 4):
            bad = i >= good
            mark = "###" if r.random() < (0.9 if bad else 0.001) else "!" * 9 if r.random() < 0.001 else ""
            words = [f"w{r.randrange(5000)}" + (mark if k % 3 else "") for k in range(r.randrange(12, 60))]
            if r.random() < (0.3 if bad else 0.001):
                words = [w.upper() for w in words]
            rows.append((len(rows), " ".join(words), lang))
            labels.append((rows[-1][0], 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_verdicts_equal_the_sql_where_rules_reject(spark):
    """The oracle's SQL, exactly, on enough labels for rules to be certified."""
    import duckdb

    from tidewell.llm.queries import ORACLE_SQL

    docs, labels = labelled(spark)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("labels", labels.toArrow())
    res = con.execute(ORACLE_SQL["op3_quality_rules"])
    names = [d[0] for d in res.description]
    want = sorted(res.fetchall())
    got = sorted(tuple(r[c] for c in names) for r in Q.judge(docs, labels).collect())
    assert got == want
    kept, base, failed = names.index("kept"), names.index("base_failed"), names.index("failed_rules")
    assert sum(not r[kept] and not r[base] for r in got) > 300 and {x for r in got for x in r[failed].split(",")} >= {"symbols", "capitals"}


def test_a_stratum_rejects_few_good_documents(spark):
    """The bound holds for all rules together, in each stratum tested and in the pool."""
    docs, labels = labelled(spark)
    good = Q.judge(docs, labels).join(labels.where("quality = 1"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    for r in good.where("not base_failed").groupBy(F.when(F.col("lang").isin("en", "de"), F.col("lang")).alias("unit")).agg(F.avg((F.col("failed_rules") != "").cast("int")).alias("rate")).collect():
        assert r.rate <= 0.01
