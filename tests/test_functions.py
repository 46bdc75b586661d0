"""Scalar functions on single cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidewell.functions import hashing, pages, stemmer, urls
from tidewell.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()[0]


def test_letter_hash(spark):
    texts = [f"text {k}" for k in range(200)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "u string").select(hashing.letter_hash(F.col("u"))).collect()]
    for t, h in zip(texts, got, strict=True):
        n = [255 if b == 0 else b - 1 if b >= 128 else b for b in hashlib.sha1(t.encode()).digest()]
        assert h == "".join(chr(97 + i % 26) + chr(97 + 2 * (i // 26)) for i in n)


@pytest.mark.parametrize(("url", "want"), [
    ("http://h.org/a/b", ("http", "h.org", None, "/a/b")), ("https://h.org:8443", ("https", "h.org", "8443", "/")),
    ("/a/b", (None, None, None, "/a/b")), ("x.html", (None, None, None, "x.html")), ("", (None, None, None, "")),
])
def test_parse(spark, url, want):
    assert tuple(one(spark, urls.parse(F.col("u")), u=url)) == want


BASE = "https://h.org:443/a/b/c.html"


@pytest.mark.parametrize(("link", "want"), [
    ("x.html", "https://h.org:443/a/b/x.html"), ("../x.html#f", "https://h.org:443/a/x.html"), ("../../../x", None),
    ("/r/s", "https://h.org:443/r/s"), ("#f", BASE), ("", BASE), ("http://o.com", "http://o.com:80/"),
    ("http://o.com:8/p", "http://o.com:8/p"), ("mailto://z/", None), ("ftp://o.com/f", None), ("pic.png", None), ("a.txt#q", None),
])
def test_resolve(spark, link, want):
    assert one(spark, urls.resolve(F.col("l"), F.col("b")), l=link, b=BASE) == want


@pytest.mark.parametrize(("source", "target", "want"), [
    ("/a/b.html", "c.html", "/a/c.html"), ("/a/b.html", "./c", "/a/c"), ("/a/b/c.html", "../d", "/a/d"),
    ("/a/", "../../d/e", "/d/e"), ("/a/b", "/z", "/z"), ("/a/b", "#x", "/a/b"), ("/a/b/", "./", "/a/b/"),
])
def test_join_path(spark, source, target, want):
    assert one(spark, urls.join_path(F.col("s"), F.col("t")), s=source, t=target) == want


def test_normalize_and_protocols(spark):
    assert one(spark, urls.normalize(F.col("u")), u="https://h.org/x") == "https://h.org:443/x"
    assert one(spark, urls.normalize(F.col("u")), u="http://h.org:81") == "http://h.org:81/"
    for u, want in (("ftp://x/", True), ("http://x/", False), ("/x", False)):
        assert one(spark, urls.ignored_protocol(F.col("u")), u=u) is want


def test_robots(spark):
    text = "User-agent: A\nDisallow: /\n\nUser-Agent: own\nCrawl-delay: 1.5\nAllow: /p/q\nDisallow: /p\nDisallow:\nUser-agent: *\nDisallow: /z"
    for path, want in (("/p/q1", (True, 1.5)), ("/p/x", (False, 1.5)), ("/z", (False, 1.5)), ("/free", (True, 1.5))):
        assert tuple(one(spark, urls.robots_verdict(F.col("r"), F.col("p"), "own"), r=text, p=path)) == want
    assert tuple(one(spark, urls.robots_verdict(F.col("r"), F.col("p"), "own"), r="", p="/x")) == (True, 0.01)


def test_text(spark):
    assert one(spark, F.array_join(T.words(F.col("t")), "|"), t=" <b>One</b>,two! THREE<br>four ") == "one|two|three|four"
    assert one(spark, T.text_window(F.col("t")), t="x" * 1388) == "x" * 1388
    assert one(spark, F.length(T.text_window(F.col("t"))), t="x" * 1390) == 2
    assert one(spark, F.length(T.text_window(F.col("t"))), t="x" * 9000) == 3612
    assert one(spark, T.from_base64(T.to_base64(F.col("t"))), t="é\n🎉") == "é\n🎉"
    assert one(spark, T.escape_json_urls(F.array("t")), t='a"b') == '[{"url":"a\\"b"}]'


def test_pages(spark):
    html = "<html><head><title> A\n b </title><meta name=\"description\" content=\"said\"></head><body><script>no</script><p>Body <b>text</b></p></body></html>"
    assert one(spark, pages.head_text(F.col("h")), h=html) == "A b"
    assert one(spark, pages.body_text(F.col("h")), h=html) == "Body text"
    assert one(spark, pages.description(F.col("h")), h=html) == "said"
    assert one(spark, pages.description(F.col("h")), h="<p>short</p>") is None
    assert one(spark, pages.is_plain_head(F.col("h")), h=html) and not one(spark, pages.is_plain_head(F.col("h")), h="<title>日本</title>")
    assert one(spark, F.array_join(urls.links(F.col("h")), "|"), h='<a href="x?a=1">1</a><A class="c" href="/y">2</A><b href="no">') == "x?a=1|/y"


# Words and stems from the published description.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl",
    "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration",
    "valenci": "valenc", "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
    "formaliti": "formal", "triplicate": "triplic", "formative": "form", "formalize": "formal", "electrical": "electr", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "replacement": "replac",
    "adoption": "adopt", "communism": "commun", "activate": "activ", "effective": "effect", "probate": "probat", "rate": "rate",
    "cease": "ceas", "controll": "control", "roll": "roll", "is": "is", "generalizations": "gener", "oscillators": "oscil",
}


def test_stemmer():
    assert {w: stemmer.stem(w) for w in STEMS} == STEMS


def test_plain_heads_character_by_character(spark):
    allowed = {chr(c) for c in range(0x21, 0x7F)} - {"\\", "`"} | {"–"}
    probes = [chr(c) for c in [*range(0x21, 0x180), 0x2010, 0x2013, 0x2014, 0x65E5]]
    rows = spark.createDataFrame([(c, f"<title>a{c}</title>") for c in probes if c not in "<>"], "c string, h string")
    got = {r.c for r in rows.where(pages.is_plain_head(F.col("h"))).collect()}
    assert got == {c for c in probes if c in allowed and c not in "<>"}
    assert not one(spark, pages.is_plain_head(F.col("h")), h="<title></title>")


def test_pages_are_refused_by_their_headers(spark):
    verdict = lambda encoding, language: one(spark, pages.accepted(F.col("e"), F.col("l")), e=encoding, l=language)
    assert verdict("identity", "en-GB") and verdict("br", "en") and not verdict("gzip", "en") and not verdict("br", "fr")
    rows = spark.createDataFrame([(None, None), ("gzip", None), (None, "de")], "e string, l string")
    assert [r[0] for r in rows.select(pages.accepted(F.col("e"), F.col("l"))).collect()] == [True, False, False]


def test_words_are_counted(spark):
    from tidewell.plans import search

    texts = [None, "", "the of a", "word", "zeta alpha zeta <b>beta</b> alpha zeta x1y", "same " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in search.frequencies(search.terms(docs)).collect():
        got.setdefault(r.doc_id, {})[r.word] = r.f
    assert got == {3: {"word": 1}, 4: {"zeta": 3, "alpha": 2, "beta": 1}, 5: {"same": 50}}
