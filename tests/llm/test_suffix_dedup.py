import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import hard_rows, prose
from tidewell.llm import suffix_dedup as S


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    n = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - 199):
            if n[r[i : i + 200]] > 1:
                gone[i : i + 200] = True
        flat = np.diff(np.concatenate(([False], gone)).astype(int))
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((len(r), int(gone.sum()), int((flat == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def cases():
    r = random.Random(4)
    rows = [(i, t) for i, t, _ in hard_rows()]
    passage = prose(77, 80)
    k = 100
    for n in (198, 199, 200, 201, 230, 400):
        for _ in range(2):
            rows.append((k := k + 1, prose(k, 30) + "|" + passage[:n] + "|" + prose(k + 900, 30)))
            rows.append((k := k + 1, prose(k, 10) + "#" + passage[r.randrange(100) :][:n]))
    rows += [(k + 1, "a" * 900), (k + 2, "a" * 650), (k + 3, "ab" * 300 + prose(3, 50)), (k + 4, passage[:260]), (k + 5, "é" * 150 + passage[50:300] + "é" * 99)]
    return rows


@pytest.mark.parametrize(("hot", "broadcast"), [(100_000, 64 << 20), (2, 64 << 20), (5, 0), (100_000, 0)])
def test_equals_brute_force(spark, monkeypatch, hot, broadcast):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(S, "ROWS_PER_SALT", 3 if hot == 5 else 4096)
    rows = cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as doc", "'x' as spans", "2 as text_hash").repartition(3)
    want = [(i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows]), strict=True)]
    got = [tuple(x) for x in S.dedup_passages(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_groups_are_repeats_with_all_occurrences(spark):
    """Each group is one string, at all the places where its anchor's gram stands; groups
    cover what is removed, and no repeat could be longer within the window."""
    rows = [(i, t) for i, t in cases() if i is not None and i != 2]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    raws = {i: (t or "").encode() for i, t in rows}
    groups, covered = {}, {i: bytearray(len(r)) for i, r in raws.items()}
    for r in S.repeat_groups(docs).collect():
        groups.setdefault((r.gram, r.number), set()).add((r.doc_id, r.low, r.high))
        covered[r.doc_id][r.low : r.high] = b"\1" * (r.high - r.low)
    assert len(groups) > 20
    for members in groups.values():
        strings = {raws[i][low:high] for i, low, high in members}
        assert len(members) > 1 and len(strings) == 1 and len(next(iter(strings))) >= 200
    want = {i: x[1] for (i, _), x in zip(rows, brute([t for _, t in rows]), strict=True)}
    assert {i: c.count(1) for i, c in covered.items()} == want
    # a passage that two texts share is one group of both, whole where its anchor sees all of it
    passage = prose(77, 80)[:230]
    n = len(passage.encode())
    short = spark.createDataFrame([(1, prose(1, 30) + "|" + passage + "|" + prose(2, 30)), (2, prose(3, 30) + "#" + passage + "#" + prose(4, 30))], "doc_id long, text string")
    found = {}
    for r in S.repeat_groups(short).collect():
        found.setdefault((r.gram, r.number), []).append((r.doc_id, r.high - r.low))
    sizes = {tuple(sorted(x)) for x in found.values()}
    assert ((1, n), (2, n)) in sizes and all([i for i, _ in x] == [1, 2] and x[0][1] == x[1][1] <= n for x in sizes)
    assert S.repeat_groups(docs.limit(0)).count() == 0


def test_texts_keep_whole_characters(spark):
    rows = cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans")
    out = S.dedup_passages(docs, texts=True)
    assert out.columns == docs.columns and out.count() == len(rows)
    sizes = {r.doc_id: r.n_bytes - r.n_removed for r in S.dedup_passages(docs).collect() if r.doc_id}
    for r in out.collect():
        if r.doc_id and r.text is not None:
            assert sizes[r.doc_id] <= len(r.text.encode()) <= sizes[r.doc_id] + 6 * len(rows)
    assert S.dedup_passages(docs.limit(0)).count() == 0 == S.dedup_passages(docs.limit(0), texts=True).count()


def test_anchors_do_not_hang_on_chunks(monkeypatch):
    r = random.Random(5)
    for t in range(12):
        raw = bytes(r.choice(b"abcdefgh") for _ in range(r.randint(200, 2500)))
        if t % 3 == 0:
            raw = raw[:300] + b"ab" * 200 + raw[:400] + b"a" * 300
        whole = [x.tolist() for x in S.anchors(raw)]
        with monkeypatch.context() as m:
            m.setattr(S, "CHUNK", 333)
            assert [x.tolist() for x in S.anchors(raw)] == whole


def test_intervals_are_the_tree():
    r = random.Random(6)
    for _ in range(100):
        lcp = [0] + [r.randrange(5) for _ in range(r.randrange(1, 9))]
        got = set(S.prefix_intervals(lcp))
        want = set()
        for a in range(len(lcp)):
            for b in range(a + 1, len(lcp)):
                depth = min(lcp[a + 1 : b + 1])
                if (a == 0 or lcp[a] < depth) and (b == len(lcp) - 1 or lcp[b + 1] < depth):
                    want.add((depth, a, b))
        assert got == want
