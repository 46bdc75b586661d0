"""Head, description and text of a page by regular expressions (an approximation of a parser)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import strip_tags

#: Printable ASCII but for the backslash and the backtick, white space, and the en dash.
PLAIN_HEAD = r"^[!-\[\]-_a-~\s–]+\z"
#: Subtrees without text.
NO_TEXT = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<!--.*?-->"


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def head_text(html: Column) -> Column:
    """The title's text."""
    return collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def body_text(html: Column) -> Column:
    """What is left without scripts, styles, comments, the head and tags."""
    bare = F.regexp_replace(html, NO_TEXT, " ")
    return collapse(strip_tags(F.regexp_replace(bare, r"\n", " ")))


def description(html: Column) -> Column:
    """The meta description, or the first 100 characters of the text; null if that is shorter."""
    meta = F.regexp_extract(html, r'(?is)<meta\s[^>]*name="[^"]*description"[^>]*content="([^"]*)"', 1)
    text = body_text(html)
    return F.when(meta != "", meta).when(F.length(text) >= 100, F.substring(text, 1, 100))


def is_plain_head(html: Column) -> Column:
    """Whether the title has characters of PLAIN_HEAD only, and at least one."""
    return head_text(html).rlike(PLAIN_HEAD)


def is_english(content_language: Column) -> Column:
    return F.lower(content_language).startswith("en")


def accepted(content_encoding: Column, content_language: Column) -> Column:
    """Whether a page is read: not one sent as gzip, nor one in a stated language other
    than English. Headers that are missing exclude nothing."""
    return ~F.coalesce(content_encoding == "gzip", F.lit(False)) & F.coalesce(content_language.startswith("en"), F.lit(True))
