"""One query per operator, by name, with SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import hashing, pages, stemmer, urls
from tidewell.functions import text as T
from tidewell.operators import algebra as A
from tidewell.operators import kv
from tidewell.plans import frontier, graph, search
from tidewell.session import materialise, new_path, prepare, spread, table
from tidewell.sources import rowlog, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _pairs(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))


# SQL of the words of a text, as T.words
WORDS = r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(text, '<.*?>', ' ', 'g'), '[[:punct:]]', ' ', 'g')), '\s+'), lambda w: w <> '')"
TOKENS = f"SELECT doc_id, unnest({WORDS}) AS word FROM documents"
STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
TERMS = rf"""SELECT doc_id, word FROM (
  SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(text, '<.*?>', ' ', 'g'), '[^a-zA-Z]', ' ', 'g')), '\s+'), lambda w: w <> '')) AS word FROM documents)
  WHERE length(word) BETWEEN 3 AND 17 AND word NOT IN ({STOPS})"""


def _stem_steps() -> str:
    """The published stemming steps as SQL: CTEs s0 (word, w) to s5 (word, w = the stem)
    over a table ``stem_words`` (word) of lower-case letters."""
    cut = lambda w, n: f"left({w}, length({w}) - {n})"

    def shape(w: str) -> str:
        marked = f"regexp_replace(regexp_replace(translate({w}, 'aeiou', 'VVVVV'), '[^Vy]', 'C', 'g'), '^y', 'C')"
        for _ in range(4):  # y after a consonant is a vowel, after a vowel a consonant
            marked = f"replace(replace({marked}, 'Cy', 'CV'), 'Vy', 'VC')"
        return marked

    measure = lambda w: f"len(regexp_extract_all({shape(w)}, 'V+C'))"
    cvc = lambda w: f"({shape(w)} LIKE '%CVC' AND right({w}, 1) NOT IN ('w', 'x', 'y'))"

    def rules(pairs: list[tuple[str, str]], least: int, extra: str = "TRUE") -> str:
        ordered = sorted(pairs, key=lambda x: -len(x[0]))
        cases = " ".join(f"WHEN w LIKE '%{a}' THEN {len(a)}" for a, _ in ordered)
        ends = " ".join(f"WHEN w LIKE '%{a}' THEN '{b}'" for a, b in ordered)
        return f"SELECT word, CASE WHEN n > 0 AND {measure('left(w, length(w) - n)')} > {least} AND {extra} THEN left(w, length(w) - n) || e ELSE w END AS w FROM (SELECT word, w, CASE {cases} ELSE 0 END AS n, CASE {ends} ELSE '' END AS e FROM {{}})"

    fixed = f"CASE WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN regexp_matches({shape('w')}, 'C$') AND length(w) > 1 AND right(w, 1) = substring(w, length(w) - 1, 1) AND right(w, 1) NOT IN ('l', 's', 'z') THEN {cut('w', 1)} WHEN {measure('w')} = 1 AND {cvc('w')} THEN w || 'e' ELSE w END"
    fours = " AND ".join(["(n <> 3 OR w NOT LIKE '%ion' OR regexp_matches(left(w, length(w) - n), '[st]$'))"])
    parts = [
        f"s0 AS (SELECT word, CASE WHEN regexp_matches(word, '(sses|ies)$') THEN {cut('word', 2)} WHEN word LIKE '%s' AND word NOT LIKE '%ss' THEN {cut('word', 1)} ELSE word END AS w FROM stem_words WHERE length(word) > 2)",
        f"s1 AS (SELECT word, CASE WHEN w LIKE '%eed' THEN CASE WHEN {measure(cut('w', 3))} > 0 THEN {cut('w', 1)} ELSE w END WHEN w LIKE '%ed' AND {shape(cut('w', 2))} LIKE '%V%' THEN '<' || {cut('w', 2)} WHEN w LIKE '%ing' AND {shape(cut('w', 3))} LIKE '%V%' THEN '<' || {cut('w', 3)} ELSE w END AS w FROM s0)",
        f"s2 AS (SELECT word, {fixed} AS w FROM (SELECT word, w[2:] AS w FROM s1 WHERE w LIKE '<%') UNION ALL SELECT word, w FROM s1 WHERE w NOT LIKE '<%')",
        f"s3 AS (SELECT word, CASE WHEN w LIKE '%y' AND {shape(cut('w', 1))} LIKE '%V%' THEN {cut('w', 1)} || 'i' ELSE w END AS w FROM s2)",
        f"s4 AS ({rules(list(stemmer.STEP_2.items()), 0).format('s3')})",
        f"s5 AS ({rules(list(stemmer.STEP_3.items()), 0).format('s4')})",
        f"s6 AS ({rules([(a, '') for a in stemmer.STEP_4], 1, fours).format('s5')})",
        f"s7 AS (SELECT word, CASE WHEN w LIKE '%e' AND ({measure(cut('w', 1))} > 1 OR {measure(cut('w', 1))} = 1 AND NOT {cvc(cut('w', 1))}) THEN {cut('w', 1)} ELSE w END AS w FROM s6)",
        f"stems AS (SELECT word, CASE WHEN w LIKE '%ll' AND {measure('w')} > 1 THEN {cut('w', 1)} ELSE w END AS stem FROM s7 UNION ALL SELECT word, word FROM stem_words WHERE length(word) <= 2)",
    ]
    return ", ".join(parts)


SQL_STEMS = _stem_steps()


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents")).select("doc_id", F.explode(T.words(F.col("text"))).alias("word"))


def _doc_words(spark: SparkSession, sf: str) -> DataFrame:
    """Each word of a text once: repeats go within the row, before anything is shuffled."""
    return spread(table(spark, sf, "documents")).select("doc_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))


# --- words ------------------------------------------------------------------------


@query(f"SELECT word, count(*) AS n FROM ({TOKENS}) GROUP BY word")
def word_count(spark, sf):
    return _tokens(spark, sf).groupBy("word").agg(F.count("*").alias("n"))


@query(f"SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM ({TOKENS}) GROUP BY word")
def term_count(spark, sf):
    per_doc = _tokens(spark, sf).groupBy("word", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


@query(f"SELECT word, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR)) AS docs FROM (SELECT DISTINCT doc_id, word FROM ({TOKENS})) GROUP BY word")
def inverted_index(spark, sf):
    pairs = _doc_words(spark, sf).select(F.col("word").alias("key"), F.col("doc_id").cast("string").alias("value"))
    return A.fold_by_key(pairs, "concat_distinct").select(F.col("key").alias("word"), F.col("value").alias("docs"))


@query(f"SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, word FROM ({TOKENS})) GROUP BY word")
def doc_freq(spark, sf):
    return _doc_words(spark, sf).distinct().groupBy("word").agg(F.count("*").alias("df"))


@query(f"SELECT word, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY n DESC, doc_id) AS docs FROM (SELECT word, doc_id, count(*) AS n FROM ({TOKENS}) GROUP BY word, doc_id) GROUP BY word")
def posting_sort(spark, sf):
    return A.postings_by_count(_tokens(spark, sf).groupBy("word", "doc_id").agg(F.count("*").alias("n")), "word", "doc_id", "n")


# --- weights and search -------------------------------------------------------------

N_DOCS = "(SELECT count(*) FROM documents)"
SQL_F = f"f AS (SELECT doc_id, word, count(*) AS f FROM ({TERMS}) GROUP BY doc_id, word)"
SQL_TF = f"{SQL_F}, tf AS (SELECT doc_id, word, 0.4::DOUBLE + 0.6::DOUBLE * f / max(f) OVER (PARTITION BY doc_id) AS tf FROM f)"
SQL_IDF = f"idf AS (SELECT word, count(*) AS df, ln({N_DOCS}::DOUBLE / count(*)) AS idf FROM f GROUP BY word)"
SQL_W = f"{SQL_TF}, {SQL_IDF}, w AS (SELECT doc_id, word, tf * idf AS w FROM tf JOIN idf USING (word))"
SQL_NORM = f"{SQL_W}, norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)"
SAID = "que thethe pour oder que"


def _counts(spark, sf) -> DataFrame:
    return search.frequencies(search.terms(table(spark, sf, "documents")))


def _index(spark, sf) -> search.Index:
    return search.Index(_counts(spark, sf), table(spark, sf, "documents").count())


def _idf(spark, sf) -> DataFrame:
    return search.inverse(_counts(spark, sf), table(spark, sf, "documents").count())


@query(f"WITH {SQL_F}, {SQL_IDF} SELECT word, df, round(idf, 6) AS idf FROM idf")
def idf(spark, sf):
    return _idf(spark, sf).select("word", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {SQL_TF} SELECT doc_id, word, round(tf, 6) AS tf FROM tf")
def augmented_tf(spark, sf):
    return search.augmented(_counts(spark, sf)).select("doc_id", "word", F.round("tf", 6).alias("tf"))


@query(f"WITH {SQL_TF} SELECT word, string_agg(doc_id || ' ' || CAST(round(tf, 4) AS DECIMAL(6, 4)), ',' ORDER BY doc_id) AS postings FROM tf GROUP BY word")
def tf_postings(spark, sf):
    tf = search.augmented(_counts(spark, sf))
    entries = F.array_sort(F.collect_list(F.struct("doc_id", F.concat_ws(" ", "doc_id", F.round("tf", 4).cast("decimal(6,4)")).alias("x"))))
    return tf.groupBy("word").agg(F.array_join(F.transform(entries, lambda e: e["x"]), ",").alias("postings"))


def _weights(spark, sf) -> DataFrame:
    counts = _counts(spark, sf)
    return search.weights(search.augmented(counts), search.inverse(counts, table(spark, sf, "documents").count()))


@query(f"WITH {SQL_W} SELECT doc_id, word, round(w, 6) AS w FROM w")
def tfidf_weights(spark, sf):
    return _weights(spark, sf).select("doc_id", "word", F.round("w", 6).alias("w"))


@query(f"WITH {SQL_NORM} SELECT doc_id, round(norm, 6) AS norm FROM norms")
def tfidf_norm(spark, sf):
    return search.norms(_weights(spark, sf)).select("doc_id", F.round("norm", 6).alias("norm"))


def _search_sql(before: str, said: str = "said", ranked: str = "") -> str:
    """The search over CTEs w, idf and norms, for the words of ``said`` (word)."""
    return f"""WITH {before},
q AS (SELECT word, times, (0.4::DOUBLE + 0.6::DOUBLE * times / (SELECT max(c) FROM (SELECT count(*) AS c FROM {said} GROUP BY word))) * idf AS q
      FROM (SELECT word, count(*) AS times FROM {said} GROUP BY word) JOIN idf USING (word)),
scores AS (SELECT doc_id, sum(w * q * times) / (any_value(norm) * (SELECT sqrt(sum(times * q * q)) FROM q)) AS score FROM w JOIN q USING (word) JOIN norms USING (doc_id) {ranked} GROUP BY doc_id),
best AS (SELECT doc_id, round(score, 6) AS score FROM scores WHERE score <> 0 ORDER BY scores.score DESC, doc_id LIMIT 21)"""


SQL_SEARCH = _search_sql(f"{SQL_NORM}, said AS (SELECT unnest(string_split('{SAID}', ' ')) AS word)")


def _search(spark, sf):
    return _index(spark, sf).search(search.query_terms(spark, SAID))


@query(f"{SQL_SEARCH} SELECT doc_id, score FROM best")
def cosine_top21(spark, sf):
    return _search(spark, sf).select("doc_id", F.round("score", 6).alias("score"))


@query(f"{SQL_SEARCH} SELECT to_json(list({{'url': CAST(doc_id AS VARCHAR)}} ORDER BY score DESC, doc_id)) AS json FROM best")
def search_json(spark, sf):
    best = cosine_top21(spark, sf).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id"))).alias("hits"))
    return best.select(T.escape_json_urls(F.transform("hits", lambda h: h["doc_id"].cast("string"))).alias("json"))


@query(f"{SQL_SEARCH} SELECT doc_id, d.lang, d.source, left(d.text, 100) AS description FROM best JOIN documents d USING (doc_id)")
def result_lookup(spark, sf):
    hits = _search(spark, sf).select("doc_id")
    return table(spark, sf, "documents").join(F.broadcast(hits), "doc_id").select("doc_id", "lang", "source", F.substring("text", 1, 100).alias("description"))


@query(f"WITH {SQL_F}, vocabulary AS (SELECT word FROM f GROUP BY word HAVING count(*) >= 5) SELECT doc_id, word, f FROM f WHERE word IN (SELECT word FROM vocabulary)")
def vocabulary_filter(spark, sf):
    counts = _counts(spark, sf)
    return T.in_vocabulary(counts, counts.groupBy("word").count().where("count >= 5")).select("doc_id", "word", "f")


# stems of the windowed texts: doc_id, word (the stem), f
SQL_WINDOW_TERMS = TERMS.replace("FROM documents)", "FROM (SELECT doc_id, CASE WHEN length(text) <= 1388 THEN left(text, 5000) ELSE substring(text, 1389, 3612) END AS text FROM documents))")
SQL_STEM_F = f"""window_words AS MATERIALIZED (SELECT doc_id, word, count(*) AS f FROM ({SQL_WINDOW_TERMS}) GROUP BY doc_id, word),
stem_words AS (SELECT DISTINCT word FROM window_words), {SQL_STEMS},
all_stems AS MATERIALIZED (SELECT doc_id, stem AS word, sum(f)::BIGINT AS f FROM window_words JOIN stems USING (word) WHERE stem NOT IN ({STOPS}) GROUP BY doc_id, stem),
vocabulary AS (SELECT word FROM all_stems GROUP BY word HAVING count(*) >= 5),
f AS (SELECT * FROM all_stems WHERE word IN (SELECT word FROM vocabulary))"""
SQL_STEM_TF = f"{SQL_STEM_F}, tf AS (SELECT doc_id, word, 0.4::DOUBLE + 0.6::DOUBLE * f / max(f) OVER (PARTITION BY doc_id) AS tf FROM f)"


@query(f"WITH words AS (SELECT word, count(*) AS n FROM ({TERMS}) GROUP BY word), stem_words AS (SELECT word FROM words), {SQL_STEMS} SELECT stem, sum(n)::BIGINT AS n FROM words JOIN stems USING (word) GROUP BY stem")
def stem_counts(spark, sf):
    counts = _counts(spark, sf).groupBy("word").agg(F.sum("f").alias("n"))
    return stemmer.with_stems(counts).groupBy("stem").agg(F.sum("n").alias("n"))


def _stems(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Counts of the windowed texts' stems that are in the corpus vocabulary, and this."""
    stems = materialise(search.stem_frequencies(table(spark, sf, "documents")), "stems")
    vocabulary = materialise(stems.groupBy("word").count().where("count >= 5").select("word"), "vocabulary")
    return T.in_vocabulary(stems, vocabulary), vocabulary


@query(f"WITH {SQL_STEM_TF} SELECT doc_id, word, round(tf, 6) AS tf FROM tf")
def stemmed_tf_index(spark, sf):
    """The text window's stems that are in the corpus vocabulary, with augmented frequency."""
    return search.augmented(_stems(spark, sf)[0]).select("doc_id", "word", F.round("tf", 6).alias("tf"))


STEM_SAID = "Tioning, the bleing onones eriner threing thties, nowhereinworld ersting tioned thouing"
SQL_STEM_SAID = "stem_words AS (SELECT DISTINCT word FROM window_words UNION SELECT unnest({words}))".format(words=[w.lower() for w in STEM_SAID.replace(",", "").split()])
SQL_STEM_SEARCH = _search_sql(
    SQL_STEM_TF.replace("stem_words AS (SELECT DISTINCT word FROM window_words)", SQL_STEM_SAID)
    + f", {SQL_IDF}, w AS (SELECT doc_id, word, tf * idf AS w FROM tf JOIN idf USING (word)), norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)"
    + f", said AS (SELECT stem AS word FROM (SELECT unnest({[w.lower() for w in STEM_SAID.replace(',', '').split()]}) AS word) JOIN stems USING (word) WHERE stem NOT IN ({STOPS}) AND stem IN (SELECT word FROM vocabulary))",
    ranked="JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id)",
)


@query(f"{SQL_STEM_SEARCH} SELECT doc_id, score FROM best")
def search_stemmed(spark, sf):
    """Search on stems of the vocabulary, on both sides, among documents that have a rank
    (here: a label)."""
    counts, vocabulary = _stems(spark, sf)
    index = search.Index(counts, table(spark, sf, "documents").count())
    said = materialise(search.query_terms(spark, STEM_SAID, stemmed=True, vocabulary=vocabulary), "said")
    return index.search(said, ranked=table(spark, sf, "labels")).select("doc_id", F.round("score", 6).alias("score"))


# --- text functions -----------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN length(text) <= 1388 THEN left(text, 5000) ELSE substring(text, 1389, 3612) END AS text FROM documents")
def text_window(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.text_window(F.col("text")).alias("text"))


@query("SELECT page_id, regexp_replace(html, '<.*?>', ' ', 'g') AS text FROM pages")
def tag_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query("SELECT doc_id, regexp_replace(text, '[[:punct:]]', ' ', 'g') AS text FROM documents")
def punct_strip(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.strip_punct(F.col("text")).alias("text"))


@query("SELECT doc_id, regexp_replace(text, '[^a-zA-Z]', ' ', 'g') AS text FROM documents")
def letters_only(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.letters_only(F.col("text")).alias("text"))


@query(f"SELECT doc_id, array_to_string({WORDS}, ' ') AS words FROM documents")
def tokenize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.words(F.col("text")), " ").alias("words"))


@query(f"SELECT word, count(*) AS n FROM ({TOKENS}) WHERE word NOT IN ({STOPS}) GROUP BY word")
def stop_words(spark, sf):
    return A.keep(_tokens(spark, sf), ~T.is_stop_word(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


@query(f"SELECT word, count(*) AS n FROM ({TOKENS}) WHERE length(word) BETWEEN 3 AND 17 GROUP BY word")
def length_filter(spark, sf):
    return A.keep(_tokens(spark, sf), T.is_index_length(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT doc_id, base64(encode(text)) AS code FROM documents")
def base64_encode(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.to_base64(F.col("text")).alias("code"))


@query("SELECT doc_id, decode(from_base64(base64(encode(text)))) AS text FROM documents")
def base64_decode(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.from_base64(T.to_base64(F.col("text"))).alias("text"))


SQL_LETTERS = """array_to_string(list_transform(range(0, 20), lambda i: (
  CASE WHEN b[i + 1] = 0 THEN chr((97 + 255 % 26)::INT) || chr((97 + 2 * (255 // 26))::INT)
       WHEN b[i + 1] >= 128 THEN chr((97 + (b[i + 1] - 1) % 26)::INT) || chr((97 + 2 * ((b[i + 1] - 1) // 26))::INT)
       ELSE chr((97 + b[i + 1] % 26)::INT) || chr((97 + 2 * (b[i + 1] // 26))::INT) END)), '')"""


@query(f"SELECT page_id, {SQL_LETTERS} AS hash FROM (SELECT page_id, list_transform(range(0, 20), lambda i: CAST('0x' || substring(sha1(url), (2 * i + 1)::INT, 2) AS INT)) AS b FROM pages)")
def letter_hash(spark, sf):
    return table(spark, sf, "pages").select("page_id", hashing.letter_hash(F.col("url")).alias("hash"))


# --- URLs and pages -------------------------------------------------------------------

SQL_PARTS = r"""SELECT page_id, url, regexp_extract(url, '^([^/]+?):?//([^/:]*)(?::([^/]*))?(/.*)?$', 1) AS protocol,
  regexp_extract(url, '^([^/]+?):?//([^/:]*)(?::([^/]*))?(/.*)?$', 2) AS host,
  nullif(regexp_extract(url, '^([^/]+?):?//([^/:]*)(?::([^/]*))?(/.*)?$', 3), '') AS port,
  coalesce(nullif(regexp_extract(url, '^([^/]+?):?//([^/:]*)(?::([^/]*))?(/.*)?$', 4), ''), '/') AS path FROM pages"""
SQL_NORMAL = "protocol || '://' || host || ':' || coalesce(port, CASE WHEN protocol = 'https' THEN '443' ELSE '80' END) || path"
SQL_LINKS = """SELECT page_id, url, unnest(regexp_extract_all(html, '<[aA]\\s[^>]*?href="([^"]*)"', 1)) AS raw FROM pages"""


@query(f"SELECT page_id, protocol, host, port, path FROM ({SQL_PARTS})")
def url_parse(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.parse(F.col("url")).alias("p")).select("page_id", "p.*")


@query(f"SELECT page_id, {SQL_NORMAL} AS url FROM ({SQL_PARTS})")
def url_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.normalize(F.col("url")).alias("url"))


@query("SELECT page_id, split_part(url, '//', 1) NOT IN ('http:', 'https:') AS ignored FROM pages")
def ignored_protocol(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.ignored_protocol(F.col("url")).alias("ignored"))


@query(SQL_LINKS.replace("page_id, url, unnest", "page_id, unnest").replace("AS raw", "AS link"))
def link_extract(spark, sf):
    return A.flat_map_to_pair(table(spark, sf, "pages"), F.transform(urls.links(F.col("html")), lambda x: F.struct(F.col("page_id"), x))).select(F.col("key").alias("page_id"), F.col("value").alias("link"))


SQL_RESOLVED = f"""SELECT page_id, url, raw, CASE
  WHEN regexp_matches(bare, '\\.(jpg|jpeg|gif|png|txt)$') THEN NULL WHEN bare = '' THEN url
  WHEN starts_with(bare, '/') THEN protocol || '://' || host || ':' || CASE WHEN protocol = 'https' THEN '443' ELSE '80' END || bare
  ELSE 'relative' END AS link
  FROM (SELECT l.page_id, l.url, l.raw, regexp_replace(l.raw, '#.*$', '') AS bare, p.protocol, p.host FROM ({SQL_LINKS}) l JOIN ({SQL_PARTS}) p ON l.page_id = p.page_id)"""


@query(f"SELECT page_id, raw, link FROM ({SQL_RESOLVED}) WHERE link <> 'relative'")
def url_resolve(spark, sf):
    out = table(spark, sf, "pages").select("page_id", "url", F.explode(urls.links(F.col("html"))).alias("raw"))
    return out.select("page_id", "raw", urls.resolve(F.col("raw"), F.col("url")).alias("link")).where("link is not null")


@query(f"SELECT page_id, '/' || regexp_replace(path, '^/|[^/]*$', '', 'g') || 'x/y.html' AS joined FROM ({SQL_PARTS})")
def join_path(spark, sf):
    bare = F.regexp_replace(urls.parse(F.col("url"))["path"], "//+", "/")
    return table(spark, sf, "pages").select("page_id", urls.join_path(bare, F.lit("./x/y.html#z")).alias("joined"))


@query(f"SELECT page_id, link FROM ({SQL_RESOLVED}) WHERE link <> '' AND link <> url AND link <> 'relative' AND regexp_matches(link, 'blog|www')")
def link_filter(spark, sf):
    found = table(spark, sf, "pages").select("page_id", "url", F.explode(urls.links(F.col("html"))).alias("raw"))
    found = found.select("page_id", "url", urls.resolve(F.col("raw"), F.col("url")).alias("link")).where("link is not null and link <> '' and link <> url")
    return frontier.allowed(found, "blog|www").select("page_id", "link")


@query("SELECT doc_id, lang FROM documents WHERE starts_with(lang, 'en')")
def language_filter(spark, sf):
    return A.keep(table(spark, sf, "documents"), pages.is_english(F.col("lang"))).select("doc_id", "lang")


ROBOTS = "User-agent: other\nDisallow: /\nUser-agent: *\nCrawl-delay: 2\nAllow: /en/1\nDisallow: /en\nDisallow: /fr"


@query(f"SELECT page_id, CASE WHEN starts_with(path, '/en/1') THEN TRUE WHEN starts_with(path, '/en') THEN FALSE WHEN starts_with(path, '/fr') THEN FALSE ELSE TRUE END AS allowed, 2.0::DOUBLE AS delay_s FROM ({SQL_PARTS})")
def robots_rules(spark, sf):
    path = urls.parse(F.col("url"))["path"]
    return table(spark, sf, "pages").select("page_id", urls.robots_verdict(F.lit(ROBOTS), path, "own-crawler").alias("v")).select("page_id", "v.*")


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS head FROM pages")
def page_head(spark, sf):
    return table(spark, sf, "pages").select("page_id", pages.head_text(F.col("html")).alias("head"))


SQL_TITLE = r"trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'))"
SQL_BODY = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<!--.*?-->', ' ', 'g'), '\n', ' ', 'g'), '<.*?>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""SELECT page_id, regexp_matches({SQL_TITLE}, '^[!-\[\]-_a-~\s–]+\z') AS plain_head,
  CASE WHEN meta <> '' THEN meta WHEN length(body) >= 100 THEN left(body, 100) END AS description
FROM (SELECT page_id, html, {SQL_BODY} AS body, regexp_extract(html, '(?is)<meta\s[^>]*name="[^"]*description"[^>]*content="([^"]*)"', 1) AS meta FROM pages)""")
def page_description(spark, sf):
    return table(spark, sf, "pages").select("page_id", pages.description(F.col("html")).alias("description"), pages.is_plain_head(F.col("html")).alias("plain_head"))


@query("SELECT doc_id, NOT (source = 'forum') AND (lang IS NULL OR starts_with(lang, 'en')) AS accepted FROM documents")
def header_filter(spark, sf):
    """Which pages are read, by their headers: documents of one source stand for those
    sent as gzip."""
    encoding = F.when(F.col("source") == "forum", "gzip")
    return table(spark, sf, "documents").select("doc_id", pages.accepted(encoding, F.col("lang")).alias("accepted"))


@query(f"SELECT DISTINCT link AS url FROM ({SQL_RESOLVED}) WHERE link <> '' AND link <> url AND link <> 'relative' EXCEPT SELECT {SQL_NORMAL} FROM ({SQL_PARTS})")
def frontier_step(spark, sf):
    web = table(spark, sf, "pages")
    return frontier.step(web, web.select(urls.normalize(F.col("url")).alias("url")))


@query("""WITH RECURSIVE reached(id, round) AS (SELECT page_id, 0 FROM pages WHERE page_id = 0
  UNION SELECT p.page_id, r.round + 1 FROM reached r JOIN pages p ON p.page_id IN (2 * r.id + 1, 2 * r.id + 2))
SELECT 'http://site.example:80/a/' || id || '/index.html' AS url, round FROM reached""")
def frontier_loop(spark, sf):
    """All pages as one site: page n has, beside its own links, relative links up and down
    to the pages 2n+1 and 2n+2; round by round from page 0."""
    link = lambda k: F.format_string('<a href="../%d/x/../index.html#top">more</a>', F.col("page_id") * 2 + k)
    web = table(spark, sf, "pages").select(F.format_string("http://site.example:80/a/%d/index.html", "page_id").alias("url"), F.concat(F.coalesce("html", F.lit("")), link(1), link(2)).alias("html"))
    return frontier.crawl(web, web.where("url like '%/a/0/index.html'"))


SQL_FOLDERS = f"SELECT page_id, protocol || '://' || host || ':' || coalesce(port, CASE WHEN protocol = 'https' THEN '443' ELSE '80' END) AS front, list_filter(string_split(regexp_extract(path, '^(.*/)', 1), '/'), lambda x: x <> '') AS folders FROM ({SQL_PARTS})"


@query(f"""SELECT page_id, raw, front || '/' || array_to_string(folders[:len(folders) - up] || [leaf], '/') AS link
FROM ({SQL_FOLDERS}), (VALUES ('../up.html', 1, 'up.html'), ('same.html#x', 0, 'same.html'), ('a/../../b.html', 1, 'b.html'), ('../../far.html', 2, 'far.html')) AS r(raw, up, leaf)
WHERE up <= len(folders)""")
def url_resolve_relative(spark, sf):
    """Relative links of every page, dots resolved; those that lead above the root are none."""
    raws = F.array(*map(F.lit, ["../up.html", "same.html#x", "a/../../b.html", "../../far.html"]))
    out = table(spark, sf, "pages").select("page_id", "url", F.explode(raws).alias("raw"))
    return out.select("page_id", "raw", urls.resolve(F.col("raw"), F.col("url")).alias("link")).where("link is not null")


@query(f"SELECT page_id, {SQL_BODY} AS text FROM pages")
def page_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", pages.body_text(F.col("html")).alias("text"))


@query(f"SELECT {SQL_NORMAL} AS url FROM ({SQL_PARTS}) WHERE page_id NOT IN (SELECT page_id FROM pages WHERE page_id % 3 = 0)")
def unseen_filter(spark, sf):
    """Pages that are not among those crawled."""
    web = table(spark, sf, "pages").select("page_id", urls.normalize(F.col("url")).alias("url"))
    return A.anti_join(web, web.where("page_id % 3 = 0"), "page_id").select("url")


# --- links and ranks ------------------------------------------------------------------

SQL_EDGES = """edges AS (SELECT DISTINCT src, dst FROM (
  SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem)
  WHERE dst IS NOT NULL AND src <> dst),
deg AS (SELECT src, count(*) AS d FROM edges GROUP BY src), nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), r0 AS (SELECT id, 1.0::DOUBLE AS rank FROM nodes)"""


def _rounds_sql(n: int) -> str:
    steps = [f"r{k} AS (SELECT n.id, 0.15 + coalesce(s.sum, 0) AS rank FROM nodes n LEFT JOIN (SELECT e.dst AS id, sum(r.rank * 0.85::DOUBLE / d.d) AS sum FROM edges e JOIN deg d USING (src) JOIN r{k - 1} r ON r.id = e.src GROUP BY e.dst) s USING (id))" for k in range(1, n + 1)]
    return f"WITH {', '.join([SQL_EDGES, *steps])}"


def co_ordered(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Parts that follow each other in an order: pages (id) and edges."""
    within = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(within).alias("dst")).where("dst is not null and src <> dst").distinct()
    edges = materialise(edges, "co-ordered")
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), edges


@query(f"{_rounds_sql(5)} SELECT id, round(rank, 6) AS rank FROM r5")
def pagerank_5(spark, sf):
    nodes, edges = co_ordered(spark, sf)
    return graph.rounds(nodes, edges, 5).select("id", F.round("rank", 6).alias("rank"))


@query(f"{_rounds_sql(4)} SELECT id, round(rank, 6) AS rank FROM r4")
def pagerank_resumed(spark, sf):
    """Two rounds, a saved state, two more."""
    nodes, edges = co_ordered(spark, sf)
    path = new_path(spark, "rank-state")
    graph.rounds(nodes, edges, 2).write.parquet(path)
    return graph.rounds(nodes, edges, 2, state=spark.read.parquet(path)).select("id", F.round("rank", 6).alias("rank"))


def _converged_sql(most: int = 40) -> str:
    """Rounds up to the first in which no rank changes by 0.01 or more."""
    steps = [f"r{k} AS MATERIALIZED (SELECT n.id, 0.15 + coalesce(s.sum, 0) AS rank FROM nodes n LEFT JOIN (SELECT e.dst AS id, sum(r.rank * 0.85::DOUBLE / d.d) AS sum FROM edges e JOIN deg d USING (src) JOIN r{k - 1} r ON r.id = e.src GROUP BY e.dst) s USING (id))" for k in range(1, most + 1)]
    changes = " UNION ALL ".join(f"SELECT {k} AS k, max(abs(a.rank - b.rank)) AS change FROM r{k} a JOIN r{k - 1} b USING (id)" for k in range(1, most + 1))
    ranks = " UNION ALL ".join(f"SELECT {k} AS k, id, rank FROM r{k}" for k in range(1, most + 1))
    edges = SQL_EDGES.replace(" AS (SELECT", " AS MATERIALIZED (SELECT")
    return f"WITH {', '.join([edges, *steps])}, done AS (SELECT min(k) AS k FROM ({changes}) WHERE change < 0.01) SELECT id, round(rank, 6) AS rank FROM ({ranks}) WHERE k = (SELECT k FROM done)"


@query(_converged_sql())
def pagerank_converged(spark, sf):
    return graph.converge(*co_ordered(spark, sf))[0].select("id", F.round("rank", 6).alias("rank"))


@query(f"{_rounds_sql(2)} SELECT id, round(rank, 6) AS rank FROM r2 ORDER BY 2 DESC, 1")
def rank_sort(spark, sf):
    nodes, edges = co_ordered(spark, sf)
    return A.sorted_by(graph.rounds(nodes, edges, 2).select("id", F.round("rank", 6).alias("rank")), F.desc("rank"), "id")


# --- bags and pairs -------------------------------------------------------------------


@query("SELECT unnest(['abc', 'def', 'fgh', 'fdakhl', 'iFu']) AS value")
def parallelize(spark, sf):
    return A.parallelize(spark, ["abc", "def", "fgh", "fdakhl", "iFu"])


@query("SELECT c_name || ':' || c_mktsegment AS value FROM customer WHERE c_acctbal > 0")
def from_table(spark, sf):
    return tables.from_table(table(spark, sf, "customer"), "CASE WHEN c_acctbal > 0 THEN concat(c_name, ':', c_mktsegment) END")


@query("SELECT n_name AS value FROM nation")
def save_bag(spark, sf):
    path = new_path(spark, "bag")
    tables.save_bag(table(spark, sf, "nation").select(F.col("n_name").alias("value")), path)
    return tables.load(spark, path)


@query("SELECT CAST(n_regionkey AS VARCHAR) AS key, n_name AS value FROM nation")
def save_pairs(spark, sf):
    path = new_path(spark, "pairs")
    tables.save_pairs(_pairs(table(spark, sf, "nation"), "n_regionkey", "n_name"), path)
    return tables.load(spark, path)


@query("SELECT user_id, event_id, value FROM events ORDER BY value DESC, event_id LIMIT 30")
def take_ordered(spark, sf):
    return A.top(table(spark, sf, "events").select("user_id", "event_id", "value"), [F.desc("value"), "event_id"], 30)


@query("SELECT event_id, value FROM events ORDER BY event_id LIMIT 10 OFFSET 20")
def result_page(spark, sf):
    return A.page(table(spark, sf, "events").select("event_id", "value"), ["event_id"], 2)


@query("SELECT n_name AS value FROM nation")
def take_all(spark, sf):
    """At most as many elements as asked for: all of a bag that has fewer."""
    return spark.createDataFrame(tables.take(table(spark, sf, "nation").select(F.col("n_name").alias("value")), 100), "value string")


@query("SELECT string_agg(n_name || ';', '' ORDER BY n_name) AS value FROM nation")
def output_text(spark, sf):
    """The strings of a result, in its order, as one."""
    lines = table(spark, sf, "nation").orderBy("n_name").select(F.concat("n_name", F.lit(";")).alias("value"))
    return spark.createDataFrame([(tables.output(lines),)], "value string")


@query("SELECT 6 AS n_partitions, count(*) AS n FROM events")
def concurrency_level(spark, sf):
    dealt = tables.with_parallelism(table(spark, sf, "events").select("event_id"), 6)
    return dealt.groupBy(F.spark_partition_id().alias("p")).count().agg(F.count("*").cast("int").alias("n_partitions"), F.sum("count").alias("n"))


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_bags(spark, sf):
    return A.union(table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_bags(spark, sf):
    return A.subtract(table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '2%'")
def except_distinct(spark, sf):
    of = lambda p: table(spark, sf, "orders").where(f"o_orderpriority like '{p}%'").select(F.col("o_custkey").alias("k"))
    return A.subtract(of(1), of(2), distinct=True)


@query("SELECT count(*) AS n FROM events")
def count_elements(spark, sf):
    return tables.count(table(spark, sf, "events"))


@query("SELECT unnest(string_split(p_name, ' ')) AS value FROM part")
def flat_map(spark, sf):
    return A.flat_map(table(spark, sf, "part"), F.split("p_name", " "))


@query("SELECT unnest(string_split(p_name, ' ')) AS value FROM part")
def flat_map_python(spark, sf):
    return A.flat_map(table(spark, sf, "part").select("p_name"), lambda name: name.split(" "))


@query("SELECT o_orderpriority AS key, CAST(o_orderkey AS VARCHAR) AS value FROM orders WHERE o_orderstatus = 'O'")
def map_to_pair(spark, sf):
    return A.map_to_pair(table(spark, sf, "orders"), "CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END", "cast(o_orderkey as string)")


@query("SELECT CAST(s_nationkey AS VARCHAR) AS key, unnest([s_name, 'k' || s_suppkey]) AS value FROM supplier")
def flat_map_to_pair(spark, sf):
    return A.flat_map_to_pair(table(spark, sf, "supplier"), "array(named_struct('key', cast(s_nationkey as string), 'value', s_name), named_struct('key', cast(s_nationkey as string), 'value', concat('k', s_suppkey)))")


@query("SELECT unnest([key, value]) AS value FROM (SELECT CAST(n_regionkey AS VARCHAR) AS key, n_name AS value FROM nation)")
def pair_flat_map(spark, sf):
    return A.flat_map(_pairs(table(spark, sf, "nation"), "n_regionkey", "n_name"), "array(key, value)")


@query("SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS value FROM nation")
def pair_flat_map_to_pair(spark, sf):
    return A.flat_map_to_pair(_pairs(table(spark, sf, "nation"), "n_regionkey", "n_name"), "array(struct(value, key))")


@query("SELECT conv_id, turn, length(text) AS n FROM conversations")
def map_partitions(spark, sf):
    def lengths(batches):
        for x in batches:
            yield x.assign(n=x.text.str.len().astype("int64"))[["conv_id", "turn", "n"]]

    return A.map_partitions(table(spark, sf, "conversations").select("conv_id", "turn", "text"), lengths, "conv_id long, turn long, n long")


@query("SELECT user_id, event_type AS name, max(value) AS value FROM events GROUP BY ALL")
def wide_long(spark, sf):
    wide = A.to_wide(table(spark, sf, "events"), "user_id", "event_type", "value")
    return A.to_long(wide, "user_id", "map_entries(columns)").select("user_id", F.col("key").alias("name"), "value")


@query("SELECT event_id FROM events WHERE value > 50 AND event_type LIKE '%c%'")
def filter_rows(spark, sf):
    return A.keep(table(spark, sf, "events"), "value > 50 and event_type like '%c%'").select("event_id")


@query("SELECT event_id FROM events WHERE substring(md5(CAST(event_id AS VARCHAR)), 1, 2) < '40'")
def sample_hash(spark, sf):
    return A.sample_by_hash(table(spark, sf, "events"), "event_id", 0.25).select("event_id")


@query()
def sample_bernoulli(spark, sf):
    return A.sample(table(spark, sf, "events"), 0.25, seed=7).select("event_id")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def pair_join(spark, sf):
    orders, customers = _pairs(table(spark, sf, "orders"), "o_custkey", "o_orderkey"), _pairs(table(spark, sf, "customer"), "c_custkey", "c_name")
    return A.join(orders, customers).select(F.col("left_value").cast("long").alias("o_orderkey"), F.col("right_value").alias("c_name"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name || ',' || s_name AS value FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def pair_join_text(spark, sf):
    return A.join_text(_pairs(table(spark, sf, "nation"), "n_nationkey", "n_name"), _pairs(table(spark, sf, "supplier"), "s_nationkey", "s_name"))


@query("""WITH a AS (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 15), b AS (SELECT s_nationkey AS k, s_name AS v FROM supplier WHERE s_nationkey > 5)
SELECT CAST(k AS VARCHAR) AS key, '[' || coalesce((SELECT string_agg(v, ',' ORDER BY v) FROM a WHERE a.k = u.k), '') || '],[' || coalesce((SELECT string_agg(v, ',' ORDER BY v) FROM b WHERE b.k = u.k), '') || ']' AS value
FROM (SELECT k FROM a UNION SELECT k FROM b) u""")
def cogroup(spark, sf):
    return A.cogroup_text(_pairs(table(spark, sf, "nation").where("n_nationkey < 15"), "n_nationkey", "n_name"), _pairs(table(spark, sf, "supplier").where("s_nationkey > 5"), "s_nationkey", "s_name"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def left_semi(spark, sf):
    return A.semi_join(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def left_anti(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return A.anti_join(table(spark, sf, "customer").select("c_custkey"), urgent, "c_custkey")


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1) ON o_custkey = c_custkey")
def lookup_default(spark, sf):
    n = table(spark, sf, "orders").where("o_orderpriority like '1%'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return A.lookup(table(spark, sf, "customer").select("c_custkey"), n, "c_custkey", n=0)


@query("SELECT l_returnflag AS key, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY 1")
def fold_by_key_sum(spark, sf):
    pairs = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_quantity").alias("value"))
    return A.fold_by_key(pairs, "sum").select("key", F.round("value", 2).alias("value"))


@query("SELECT l_returnflag AS key, round(10 + sum(l_quantity), 2) AS value FROM lineitem GROUP BY 1")
def fold_by_key_sum_zero(spark, sf):
    """A fold that starts at ten."""
    pairs = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_quantity").alias("value"))
    return A.fold_by_key(pairs, "sum", 10.0).select("key", F.round("value", 2).alias("value"))


@query("SELECT event_type AS key, greatest(max(value), 50) AS value FROM events GROUP BY 1")
def fold_by_key_max_zero(spark, sf):
    return A.fold_by_key(table(spark, sf, "events").select(F.col("event_type").alias("key"), "value"), "max", 50.0)


@query("SELECT greatest(max(value), 1e9::DOUBLE) AS value FROM events")
def fold_max_zero(spark, sf):
    return A.fold(table(spark, sf, "events"), "max", 1e9)


@query("SELECT event_type AS key, max(value) AS value FROM events GROUP BY 1")
def fold_by_key_max(spark, sf):
    return A.fold_by_key(table(spark, sf, "events").select(F.col("event_type").alias("key"), "value"), "max")


@query("SELECT event_type AS key, count(*) AS value FROM events GROUP BY 1")
def fold_by_key_count(spark, sf):
    return A.fold_by_key(table(spark, sf, "events").select(F.col("event_type").alias("key"), "value"), "count")


@query("SELECT CAST(n_regionkey AS VARCHAR) AS key, string_agg(n_name, ',' ORDER BY n_name) AS value FROM nation GROUP BY 1")
def fold_by_key_concat(spark, sf):
    return A.fold_by_key(_pairs(table(spark, sf, "nation"), "n_regionkey", "n_name"), "concat_distinct")


@query("SELECT round(coalesce(sum(l_extendedprice), 0), 2) AS value FROM lineitem")
def fold_sum(spark, sf):
    return A.fold(table(spark, sf, "lineitem"), "sum", 0.0, "l_extendedprice").select(F.round("value", 2).alias("value"))


@query("SELECT max(value) AS value FROM events")
def fold_max(spark, sf):
    return A.fold(table(spark, sf, "events"), "max", float("-inf"))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS key, list_reduce(list_prepend(0::BIGINT, list(n_nationkey::BIGINT ORDER BY n_nationkey)), lambda a, x: (a * 3 + x) % 1000) AS value FROM nation GROUP BY n_regionkey")
def fold_lambda(spark, sf):
    pairs = table(spark, sf, "nation").select(F.col("n_regionkey").cast("string").alias("key"), F.col("n_nationkey").cast("long").alias("value"))
    return A.fold_by_key(pairs, lambda a, x: (a * 3 + x) % 1000, F.lit(0).cast("long"))


@query("SELECT left(n_name, 1) AS key, string_agg(n_name, ',' ORDER BY n_name) AS value FROM nation GROUP BY 1")
def group_by_concat(spark, sf):
    return A.group_by(table(spark, sf, "nation").select(F.col("n_name").alias("value")), F.substring("value", 1, 1))


@query("SELECT event_type AS key, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def posting_blocks(spark, sf):
    """Members of hot keys in blocks of a bounded size, counted back together."""
    return A.blocked(table(spark, sf, "events"), "event_type", "user_id", 50).groupBy(F.col("event_type").alias("key")).agg(F.sum(F.size("members")).alias("n"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct(spark, sf):
    return A.distinct(table(spark, sf, "events").select("user_id", "event_type"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersection(spark, sf):
    return A.intersection(table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


# --- key-value tables -------------------------------------------------------------------

SQL_CELLS = "SELECT CAST(user_id AS VARCHAR) AS row_key, event_type AS col, arg_max(CAST(event_id AS VARCHAR), event_id) AS value, max(event_id) AS seq FROM events GROUP BY ALL"


def _changes(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("row_key"), F.col("event_type").alias("col"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("seq"))


@query(SQL_CELLS)
def kv_last_write(spark, sf):
    return kv.latest(_changes(spark, sf))


@query(f"SELECT row_key, string_agg(col || '=' || value, ';' ORDER BY col) AS cells FROM ({SQL_CELLS}) GROUP BY row_key")
def kv_rows(spark, sf):
    cells = F.transform(F.map_entries("columns"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return kv.rows(_changes(spark, sf)).select("row_key", F.array_join(cells, ";").alias("cells"))


@query(f"SELECT * FROM ({SQL_CELLS}) WHERE row_key = '7' AND col = 'click'")
def kv_get_cell(spark, sf):
    return kv.get(_changes(spark, sf), "7", "click")


@query(f"SELECT col, value FROM ({SQL_CELLS}) WHERE row_key = '7'")
def kv_get_row(spark, sf):
    return kv.get_row(_changes(spark, sf), "7").select(F.inline(F.map_entries("columns")).alias("col", "value"))


@query("SELECT count(*) > 0 AS found FROM events WHERE user_id = 7")
def kv_exists(spark, sf):
    return kv.exists(_changes(spark, sf), "7")


@query(f"SELECT * FROM ({SQL_CELLS}) WHERE row_key >= '12' AND row_key < '15'")
def kv_range_scan(spark, sf):
    return kv.scan(_changes(spark, sf), "12", "15")


@query("SELECT count(DISTINCT user_id) AS n FROM events")
def kv_count(spark, sf):
    return kv.count_rows(_changes(spark, sf))


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS row_key FROM events WHERE CAST(user_id AS VARCHAR) >= '3' ORDER BY 1 LIMIT 11")
def kv_page(spark, sf):
    return kv.page(_changes(spark, sf), "3").select("row_key")


@query(SQL_CELLS)
def kv_store(spark, sf):
    """Create, put in two batches, rename and compact a table."""
    store = kv.Store(spark, new_path(spark, "kv"))
    store.persist("first")
    for half in (0, 1):
        store.put("first", _changes(spark, sf).where(F.col("seq") % 2 == half))
    store.rename("first", "second")
    store.compact("second")
    return store.changes("second")


@query("SELECT name, (SELECT count(DISTINCT user_id) FROM events) AS n FROM (SELECT unnest(['crawl', 'index']) AS name)")
def kv_list_tables(spark, sf):
    """Names of tables and their numbers of rows."""
    store = kv.Store(spark, new_path(spark, "kv"))
    for name in ("crawl", "index"):
        store.put(name, _changes(spark, sf))
    counted = [kv.count_rows(store.changes(name)).select(F.lit(name).alias("name"), "n") for name in store.tables()]
    return counted[0].union(counted[1])


@query("SELECT 'index' AS name, count(DISTINCT user_id) AS n FROM events")
def kv_delete(spark, sf):
    """Of two tables one is deleted; the other is there, under its physical path."""
    store = kv.Store(spark, new_path(spark, "kv"))
    for name in ("crawl", "index"):
        store.put(name, _changes(spark, sf))
    store.delete("crawl")
    (left,) = store.tables()
    return kv.count_rows(spark.read.parquet(store.path(left))).select(F.lit(left).alias("name"), "n")


@query("SELECT row_key, CASE WHEN row_key >= '7' THEN '7' WHEN row_key >= '4' THEN '4' WHEN row_key >= '2' THEN '2' ELSE '7' END AS worker FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS row_key FROM events)")
def kv_route(spark, sf):
    """The worker that owns each key: ranges of keys, the last of which wraps around."""
    return kv.route(_changes(spark, sf).select("row_key").distinct(), ["4", "2", "7"]).select("row_key", "worker")


@query("SELECT CAST(n_regionkey AS VARCHAR) AS row_key, n_name AS col, CAST(n_nationkey AS VARCHAR) AS value FROM nation")
def row_log(spark, sf):
    """Rows written in the row-log format by executors, read again as change rows."""
    prepare(spark)
    cells = table(spark, sf, "nation").groupBy(F.col("n_regionkey").cast("string").alias("key")).agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_nationkey").cast("string")))).alias("cells"))

    def written(batches):
        import pyarrow as pa

        for x in batches:
            rows = [[(r["key"], c.decode() if isinstance(c, bytes) else c, v.decode()) for _, c, v in rowlog.decode(rowlog.encode([(r["key"], {k: w.encode() for k, w in r["cells"]})]))] for r in x.to_pylist()]
            flat = [c for row in rows for c in row]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*flat, strict=True)], names=["row_key", "col", "value"])

    return cells.mapInArrow(written, "row_key string, col string, value string")

