import random

import pytest

from tests.llm.conftest import hard_rows, prose
from tidewell.llm import minhash as M
from tidewell.llm.components import components


def brute(rows, size, num, den):
    """(doc_id, number of shingles, component) of each row, by comparing all pairs of rows."""
    sets = [set(M.shingles(t, size).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b in range(a):
            s, t = sets[a], sets[b]
            if i is not None and rows[b][0] is not None and s and t and den * len(s & t) >= num * len(s | t):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return sorted(((i, len(s), None if i is None else least[root(a)]) for a, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def told(df):
    return sorted(((g.doc_id, g.n_shingles, g.component_id) for g in df.collect()), key=str)


@pytest.mark.parametrize(("size", "num"), [(3, 85), (5, 80)])
def test_components_equal_all_pairs(spark, hard, size, num):
    r = random.Random(size)
    base = prose(40, 150).split()
    rows = [(i, t) for i, t, _ in hard_rows()]
    for k in range(60):  # near copies on both sides of the threshold, chains included
        words = list(base)
        for _ in range(r.randint(0, 6)):
            words[r.randrange(150)] = f"z{r.randrange(99)}"
        rows.append((100 + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as kept")
    got = M.near_duplicates(docs, size, num, 100).collect()
    assert len(got) == len(rows)
    assert sorted(((g.doc_id, g.n_shingles, g.component_id) for g in got), key=str) == brute(rows, size, num, 100)
    assert all(g.kept == (g.doc_id is None or g.doc_id == g.component_id) for g in got)


@pytest.mark.parametrize(("block", "levels"), [(2, 1), (2, 3), (5, 2), (1024, 3)])
def test_pairs_past_the_pivot_are_found(spark, monkeypatch, block, levels):
    """A chain whose ends are no link, and texts that share half of their words; small
    blocks force further pivots, splits by later bands and many groups."""
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "LEVELS", levels)
    r = random.Random(block)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(12):
        words = list(base)
        for x in range(4):
            words[(k * 4 + x) * 3 % 200] = f"c{k}{x}"
        rows.append((k, " ".join(words)))
    for k in range(40):  # boilerplate with own words; some are near copies of others
        own = [f"q{k // 2}-{x}" for x in range(60)]
        own[r.randrange(60)] = f"y{k}"
        rows.append((100 + k, " ".join(base[:140] + own)))
    for k in range(40):  # near copies of which about half the pairs are links
        words = [f"v{x}" for x in range(200)]
        for _ in range(r.randrange(1, 9)):
            words[r.randrange(200)] = f"u{k}-{r.randrange(999)}"
        rows.append((200 + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(M.near_duplicates(docs, 3, 85, 100)) == brute(rows, 3, 85, 100)


def shared_ids():
    a, b = prose(70, 200), prose(71, 200)
    return [(1, a), (2, a), (2, b), (3, b + " more"), (4, b + " more words"), (4, prose(72, 50)), (5, prose(72, 50)), (7, a + " x"), (7, prose(73, 90)), (None, b), (None, b)]


def test_texts_under_one_id_stay_apart(spark):
    rows = shared_ids()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert told(M.near_duplicates(docs, 3, 85, 100)) == brute(rows, 3, 85, 100)
    got = {(r.doc_id, r.text) for r in M.keep_one(docs, 3, 85, 100).collect()}
    assert got == {rows[0], rows[2], rows[5], rows[8], (None, rows[2][1])}


@pytest.mark.parametrize("seed", range(3))
def test_random_tables_with_shared_ids(spark, seed):
    r = random.Random(seed)
    bases = [prose(200 + k, 60).split() for k in range(4)]
    rows = []
    for _ in range(70):
        words = list(r.choice(bases))
        for _ in range(r.randint(0, 4)):
            words[r.randrange(60)] = f"z{r.randrange(50)}"
        rows.append((r.choice([None, *range(12)]), r.choice([None, "", "one", *[" ".join(words)] * 20])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 3, 85, 100)
    assert told(M.near_duplicates(docs, 3, 85, 100)) == want
    # the texts that stay: one of each id and component, and what is linked with nothing
    kept = M.keep_one(docs, 3, 85, 100).collect()
    assert len(kept) == sum(i is None or i == c for i, _, c in want)


def test_keep_one_returns_whole_rows(spark, hard):
    out = M.keep_one(hard)
    assert out.columns == hard.columns
    rows = hard.collect()
    kept = {i for i, _, c in brute([(r.doc_id, r.text) for r in rows], 5, 80, 100) if i == c}
    assert sorted(map(str, out.collect())) == sorted(str(r) for r in rows if r.doc_id in kept)
    assert 1 in kept and 2 not in kept and 3 not in kept
    assert M.keep_one(hard.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(80)] + [(5, 5), (500, 499), (500, 499)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {(g.node, g.component) for g in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(x, root(x)) for x in list(parent)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
