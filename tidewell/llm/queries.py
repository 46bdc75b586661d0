"""The queries of this subpackage, by name, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import html_extract, line_dedup, media, minhash, packing, quality_classifier, quality_rules, sentencepiece, suffix_dedup, token_counts
from tidewell.llm.tokenizers import default_path
from tidewell.session import materialise, new_path, prepare, spread, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(documents(spark, sf_dir), digest=True)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), size=3, num=85, den=100)


def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.audio(documents(spark, sf_dir), digest=True)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_classifier.classify(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_passages(documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of every document under two tokenizer versions, kept up to date through the
    life of a store: a load whose languages are not known yet, its retry, a revision of all
    rows by their languages, a withdrawal of all rows of one version, their return, and a
    compaction between. The net result is one count of each document and version."""
    versions = {v: default_path(f"{v}.tiktoken") for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    rows = materialise(token_counts.counts_by(documents(spark, sf_dir), versions), "token-counts-rows")
    unknown = rows.withColumn("lang", F.lit("und"))
    second = rows.where(F.col("tokenizer") == "byte_bpe_multi_50k")
    rollup = token_counts.Rollup(prepare(spark), new_path(spark, "token-counts"))
    for batch, changes in (
        ("load", token_counts.inserted(unknown)),
        ("load", token_counts.inserted(unknown)),
        ("languages", token_counts.revised(unknown, rows)),
        ("withdrawal", token_counts.deleted(second)),
    ):
        rollup.commit(batch, changes)
    rollup.compact()
    rollup.commit("languages", token_counts.revised(unknown, rows))
    rollup.commit("return", token_counts.inserted(second))
    return rollup.totals()


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spread(table(spark, sf_dir, "pages")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_packing, op3_quality_rules, op4_minhash, op5_audio, op6_quality_classifier, op7_suffix_array, op8_line_dedup, op9_token_counts, op10_html)
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op8_line_dedup"] = r"""
WITH docs AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, i, lines[i] AS line,
         translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM docs, unnest(range(1, len(lines) + 1)) AS r(i)
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.i, l.line, f.key IS NOT NULL AND l.doc_id <> f.keeper AS dropped
  FROM lines l LEFT JOIN frequent f ON l.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: For each rule its rate and grid, as in ``quality_rules.RULES``.
_RULE_ROWS = ", ".join(f"('{r}', {at}, {x!r})" for r, (_, grid) in quality_rules.RULES.items() for at, x in enumerate(grid))
_RATES = " UNION ALL ".join(f"SELECT doc_id, lang, '{r}' AS rule, coalesce({rule.replace(' / ', '::DOUBLE / nullif(')}, 0), 0) AS rate FROM counted" for r, (rule, _) in quality_rules.RULES.items())

ORACLE_SQL["op3_quality_rules"] = rf"""
WITH docs AS (
  SELECT doc_id, lang, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM docs
), placed AS (
  SELECT doc_id, i, words[i : i + 4] AS gram FROM worded, unnest(range(1, greatest(len(words) - 3, 1))) AS r(i)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM placed) WHERE n > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 5)) AS r(k) GROUP BY doc_id
), lined AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs
), counted AS (
  SELECT d.doc_id, d.lang, len(w.words)::BIGINT AS n_words,
         length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l.lines) - len(list_distinct(l.lines)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(d.text, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(d.text, '[^!]', '', 'g')) AS n_exclamations
  FROM docs d JOIN worded w USING (doc_id) JOIN lined l USING (doc_id) LEFT JOIN repeated r USING (doc_id)
), rates AS ({_RATES}), grids(rule, pos, cutoff) AS (VALUES {_RULE_ROWS}
), above AS (
  SELECT x.doc_id, x.lang, x.rule, count(g.cutoff) AS step
  FROM rates x LEFT JOIN grids g ON g.rule = x.rule AND x.rate > g.cutoff GROUP BY ALL
), good AS (
  SELECT doc_id, lang, max(step) AS step FROM above
  WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY doc_id, lang
), sizes AS (SELECT lang, count(*) AS n FROM good GROUP BY lang
), choices AS (
  SELECT n, tested, rest > 0 AND rest * ln(0.99) > ln(0.05 / tested) AS pool_fails FROM (
    SELECT n, rest, alone + CASE WHEN rest > 0 THEN 1 ELSE 0 END AS tested FROM (
      SELECT n, (SELECT count(*) FROM sizes b WHERE b.n >= a.n) AS alone, (SELECT coalesce(sum(b.n), 0) FROM sizes b WHERE b.n < a.n) AS rest FROM sizes a))
  WHERE n * ln(0.99) <= ln(0.05 / tested)
), chosen AS (SELECT n, tested FROM choices ORDER BY pool_fails, n LIMIT 1
), units AS (
  SELECT lang, n >= coalesce((SELECT n FROM chosen), 4611686018427387904) AS alone, CASE WHEN n >= coalesce((SELECT n FROM chosen), 4611686018427387904) THEN lang END AS unit FROM sizes
), tested AS (
  SELECT u.alone, u.unit, a.pos, count(*) AS n, count(*) FILTER (WHERE g.step > a.pos) AS k
  FROM good g JOIN units u ON g.lang IS NOT DISTINCT FROM u.lang, (SELECT DISTINCT pos FROM grids) a GROUP BY ALL
), certified AS (
  SELECT alone, unit, min(pos) AS pos FROM (SELECT * FROM tested WHERE k < n * 0.01) t
  WHERE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)))
         FROM unnest(range(0, k + 1)) AS r(i)) <= 0.05 / coalesce((SELECT tested FROM chosen), 1)
  GROUP BY ALL
), broken AS (
  SELECT x.doc_id, string_agg(x.rule, ',' ORDER BY list_position(['symbols', 'capitals', 'exclamations', 'repeats'], x.rule)) AS failed_rules
  FROM above x JOIN units u ON x.lang IS NOT DISTINCT FROM u.lang
  JOIN certified c ON c.alone = u.alone AND c.unit IS NOT DISTINCT FROM u.unit WHERE x.step > c.pos GROUP BY x.doc_id
), based AS (
  SELECT c.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(b.failed_rules, '') AS failed_rules
  FROM counted c LEFT JOIN broken b USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM based
"""

ORACLE_SQL["op4_minhash"] = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 2], ' ') AS s
  FROM docs, unnest(range(1, greatest(len(words) - 1, 2))) AS r(i) WHERE len(words) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON r.other = e.x
)
SELECT r.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""

ORACLE_SQL["op7_suffix_array"] = r"""
WITH raw AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), starts AS (
  SELECT doc_id, i, md5(array_slice(b, i + 1, i + 200)) AS window_md5 FROM raw, unnest(range(0, octet_length(b) - 199)) AS r(i)
), twice AS (
  SELECT window_md5 FROM starts GROUP BY window_md5 HAVING count(*) > 1
), repeated AS (
  SELECT doc_id, i FROM starts WHERE window_md5 IN (SELECT window_md5 FROM twice)
), marked AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM repeated
), runs AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked
), spans AS (
  SELECT doc_id, min(i) AS low, max(i) + 200 AS high FROM runs GROUP BY doc_id, run
), edges AS (
  SELECT doc_id, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS low, low AS high FROM spans
  UNION ALL SELECT doc_id, max(high), NULL FROM spans GROUP BY doc_id
), kept AS (
  SELECT e.doc_id, unhex(string_agg(hex(array_slice(b, e.low + 1, coalesce(e.high, octet_length(b)))), '' ORDER BY e.low)) AS left_over
  FROM edges e JOIN raw USING (doc_id) GROUP BY e.doc_id
), removed AS (
  SELECT doc_id, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT r.doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(coalesce(left_over, b)) AS kept_sha256
FROM raw r LEFT JOIN removed m USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

ORACLE_SQL["op10_html"] = r"""
WITH articles AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)(?:</article>|\z)', 1) AS article FROM pages
), blocks AS (
  SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(article, '</?(?:p|h1)>'),
    lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))),
    lambda x: x <> '') AS blocks
  FROM articles
), texts AS (SELECT page_id, url, array_to_string(blocks, chr(10) || chr(10)) AS text FROM blocks)
SELECT page_id, url, text, length(text) AS n_chars FROM texts
"""
