"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written as Parquet and read again as the next stage's docs. All but the last return
the columns of documents; where a stage rewrites ``text``, ``n_chars`` follows it.

In every stage null and empty texts are rows like others, rows with a null doc_id are
kept apart from all others, repeated rows meet one fate, columns of any other name pass
through (the last stage returns its own), and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import line_dedup, minhash, packing, quality_classifier, suffix_dedup
from tidewell.session import materialise, table


def recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half go.

    The labels of sf_dir train the model, save those of the held-out third. Null and empty
    texts are scored by their statistics, which are zeros; rows with a null doc_id by their
    text. Repeated rows have one score. Without labelled rows all score one half and stay.
    """
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more in three documents or more stay in that of the largest doc_id.

    A null text becomes an empty one. A null doc_id is the smallest; rows that share the
    largest keep the line each. A document may lose all its lines; it stays, empty.
    """
    return recounted(line_dedup.dedup_lines(docs, texts=True))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, 0.8): the least doc_id.

    Texts without a word, and rows with a null doc_id, have no copies and stay. Rows that
    share a doc_id go or stay by their own text; repeated rows go or stay together.
    """
    return minhash.keep_one(docs)


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur again go, in whole characters, at every occurrence.

    A null text stays null, an empty one empty. Repeated rows are occurrences of each
    other, so texts of 200 bytes that stand twice go in both.
    """
    return recounted(suffix_dedup.dedup_passages(docs, texts=True))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens, a row for each piece of a document.

    A null or empty text is its closing token alone. Rows that share a doc_id, or a null
    one, are documents of their own.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("line_dedup", dedup_lines),
    ("minhash", dedup_documents),
    ("suffix_dedup", dedup_passages),
    ("packing", pack),
]

#: A trained model decides the first stage, which SQL cannot express; tests/llm holds
#: every stage against a brute-force version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
