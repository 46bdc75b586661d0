"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stop words of the search index.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not",
    "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was",
    "will", "with",
]


def strip_tags(text: Column) -> Column:
    """Tags become one space."""
    return F.regexp_replace(text, "<.*?>", " ")


def strip_punct(text: Column) -> Column:
    """ASCII punctuation becomes one space."""
    return F.regexp_replace(text, r"\p{Punct}", " ")


def letters_only(text: Column) -> Column:
    """Whatever is not A-Z or a-z becomes one space."""
    return F.regexp_replace(text, "[^a-zA-Z]", " ")


def split_words(text: Column) -> Column:
    """Words between runs of white space, none empty."""
    return F.array_remove(F.split(text, r"\s+"), "")


def words(text: Column) -> Column:
    """Tags and punctuation out, lower case, split."""
    return split_words(F.lower(strip_punct(strip_tags(text))))


def text_window(text: Column, start: int = 1388, stop: int = 5000) -> Column:
    """Characters ``start`` to ``stop`` of a longer text, the beginning of a shorter one."""
    return F.when(F.length(text) <= start, F.substring(text, 1, stop)).otherwise(F.substring(text, start + 1, stop - start))


def is_stop_word(word: Column) -> Column:
    return word.isin(STOP_WORDS)


def is_index_length(word: Column, least: int = 3, most: int = 17) -> Column:
    return F.length(word).between(least, most)


def in_vocabulary(terms: DataFrame, vocabulary: DataFrame, column: str = "word") -> DataFrame:
    """Terms whose word is in a vocabulary table; small ones are broadcast by Catalyst's own size check."""
    return terms.join(vocabulary.select(column).distinct(), column, "left_semi")


def escape_json_urls(urls: Column) -> Column:
    """A JSON array of objects ``{"url": ...}``."""
    return F.to_json(F.transform(urls, lambda u: F.struct(u.alias("url"))))


def to_base64(text: Column) -> Column:
    """Base64 of the UTF-8 bytes, in one line."""
    return F.translate(F.base64(F.encode(text, "UTF-8")), "\r\n", "")


def from_base64(text: Column) -> Column:
    return F.decode(F.unbase64(text), "UTF-8")
