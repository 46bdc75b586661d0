import random

import pytest

WORDS = "the of and to in lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor été über niño".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", "s", "ing", ".", ","]) for _ in range(n))


def hard_rows():
    """Ids, texts: nulls, empties, ties, repeats, copies, near copies, one long text."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "CHANGED"
    passage = prose(99, 90)
    rows = [
        (1, base, "en"), (2, base, "en"), (2, base, "en"), (3, " ".join(near), "en"), (4, base.upper(), None),
        (5, None, "en"), (6, "", "fr"), (7, " \n\t \r\x0b", "fr"), (8, "word", None), (9, "two words", "en"),
        (None, prose(5, 40), "en"), (None, None, None), (10, "é" * 300, "fr"), (11, "ab " * 400, "en"),
        (12, prose(6, 30) + " " + passage + " " + prose(7, 30), "en"), (13, prose(8, 20) + passage + prose(9, 25), "en"),
        (14, passage, "en"), (15, prose(10, 6000), "en"), (16, "a line that many documents share\nx\n\n" + prose(11, 5), "en"),
        (17, "  A LINE that many documents share \t\r\ny", "en"), (18, "q\na line that many documents share", "de"),
        (19, "same line twice in one text here\nsame line twice in one text here", "de"), (20, "日本語 テキスト 🎉 ▁ x y", "ja"),
    ]
    return rows


@pytest.fixture(scope="session")
def hard(spark):
    """The hard rows with extra columns that clash with names the operators give."""
    rows = [(i, t, la, None if k % 5 == 0 else f"s{k % 3}", len(t or ""), "x", 1.5, k) for k, (i, t, la) in enumerate(hard_rows())]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, component long"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 1, 0), (11, 0, 0), (None, 1, 0), (12, None, None), (15, 1, 1), (10, 0, 0)], "doc_id long, quality int, toxic int")
