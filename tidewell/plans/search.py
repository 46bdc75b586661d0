"""Term weights and search (G. Salton and C. Buckley, 1988)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions.stemmer import stem_udf, with_stems
from tidewell.session import materialise

ALPHA = 0.4
RESULTS = 21


def terms(docs: DataFrame, window: bool = False) -> DataFrame:
    """doc_id, word, one row per occurrence of an index word: lower-case letters, 3 to 17
    of them, no stop word. ``window`` takes the text window only.

    The texts are dealt out by document once, and counts by (document, word), maxima and
    norms by document need no shuffle of their own. (Counting inside the row with array
    functions shuffles no text, but was measured to take three times as long: these
    functions are interpreted, and a text has as many bytes as its words.)"""
    docs = docs.select("doc_id", "text").repartition("doc_id")
    text = T.text_window(F.col("text")) if window else F.col("text")
    words = docs.select("doc_id", F.explode(T.split_words(F.lower(T.letters_only(T.strip_tags(text))))).alias("word"))
    return words.where(T.is_index_length(F.col("word")) & ~T.is_stop_word(F.col("word")))


def frequencies(found: DataFrame) -> DataFrame:
    """doc_id, word, f."""
    return found.groupBy("doc_id", "word").agg(F.count("*").alias("f"))


def augmented(counts: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """doc_id, word, tf: ``alpha`` plus the rest in proportion to the document's commonest word."""
    most = counts.groupBy(F.col("doc_id").alias("d")).agg(F.max("f").alias("most"))
    return counts.join(most, F.col("doc_id") == F.col("d")).select("doc_id", "word", (alpha + (1 - alpha) * F.col("f") / F.col("most")).alias("tf"))


def inverse(counts: DataFrame, n: int) -> DataFrame:
    """word, df, idf = ln(n / df)."""
    return counts.groupBy("word").agg(F.count("*").alias("df")).select("word", "df", F.log(F.lit(float(n)) / F.col("df")).alias("idf"))


def weights(tf: DataFrame, idf: DataFrame) -> DataFrame:
    """doc_id, word, w."""
    return tf.join(idf, "word").select("doc_id", "word", (F.col("tf") * F.col("idf")).alias("w"))


def norms(w: DataFrame) -> DataFrame:
    """doc_id, norm."""
    return w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def query_terms(spark: SparkSession, query: str, stemmed: bool = False, vocabulary: DataFrame | None = None) -> DataFrame:
    """word, times for the words of a query: letters only, lower case, stems if
    ``stemmed``; stop words and words outside a vocabulary (``word``) go."""
    said = spark.createDataFrame([(query,)], "text string").select(F.explode(T.split_words(F.lower(T.letters_only(F.col("text"))))).alias("word"))
    if stemmed:
        said = said.select(stem_udf("word").alias("word"))
    said = said.where(~T.is_stop_word(F.col("word"))).groupBy("word").agg(F.count("*").alias("times"))
    return said if vocabulary is None else T.in_vocabulary(said, vocabulary)


def query_weights(said: DataFrame, idf: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """word, times, q for a query's words; words that no document has weigh nothing."""
    said = said.withColumn("most", F.max("times").over(Window.partitionBy(F.lit(0))))  # a query's words: a few rows
    return F.broadcast(said).join(idf, "word").select("word", "times", ((alpha + (1 - alpha) * F.col("times") / F.col("most")) * F.col("idf")).alias("q"))


def stem_frequencies(docs: DataFrame, window: bool = True) -> DataFrame:
    """doc_id, word (a stem), f: counts of stems, of the text window by default, without
    stop words."""
    stems = with_stems(frequencies(terms(docs, window))).groupBy("doc_id", F.col("stem").alias("word")).agg(F.sum("f").alias("f"))
    return stems.where(~T.is_stop_word(F.col("word")))


class Index:
    """Weights and norms of a corpus, written once; a search reads the postings of its
    words, and the norms of the documents that have one."""

    def __init__(self, counts: DataFrame, n: int):
        tf = materialise(augmented(counts), "index-tf")
        self.idf = materialise(inverse(tf, n), "index-idf")
        # sorted by word within its files, so that a query's words skip row groups
        self.w = materialise(weights(tf, self.idf).sortWithinPartitions("word"), "index-weights")
        self.norms = materialise(norms(self.w), "index-norms")

    def search(self, said: DataFrame, n: int = RESULTS, norm_power: float = 1.0, ranked: DataFrame | None = None) -> DataFrame:
        """doc_id, score of the best n documents for a query's terms; ``ranked`` (doc_id)
        restricts them to those that have a rank."""
        words = [r["word"] for r in said.select("word").collect()]  # a query's words: a few
        return search(self.w.where(F.col("word").isin(words)), self.norms, query_weights(said, self.idf.where(F.col("word").isin(words))), n, norm_power, ranked)


def search(w: DataFrame, lengths: DataFrame, q: DataFrame, n: int = RESULTS, norm_power: float = 1.0, ranked: DataFrame | None = None) -> DataFrame:
    """doc_id, score of the best n documents from weights, norms and query weights; the
    query side, a few words, is broadcast. A word said twice counts twice.
    ``norm_power=0.5`` divides by the root of the document's norm."""
    said = Window.partitionBy(F.lit(0))
    q = q.withColumn("said", F.sqrt(F.sum(F.col("times") * F.col("q") * F.col("q")).over(said)))
    lists = w.join(F.broadcast(q), "word").groupBy("doc_id").agg(F.sum(F.col("w") * F.col("q") * F.col("times")).alias("dot"), F.max("said").alias("said"))
    lists = lists if ranked is None else lists.join(ranked.select("doc_id"), "doc_id", "left_semi")
    scored = lists.join(lengths, "doc_id").select("doc_id", (F.col("dot") / (F.pow("norm", F.lit(norm_power)) * F.col("said"))).alias("score"))
    return scored.where(~F.isnan("score") & (F.col("score") != 0)).orderBy(F.desc("score"), "doc_id").limit(n)
