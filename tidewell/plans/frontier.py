"""The crawl frontier: links found, made absolute, minus what has been seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import urls as U
from tidewell.session import materialise


def found_links(pages: DataFrame) -> DataFrame:
    """url, link: followed links of each page, not to itself."""
    out = pages.select("url", F.explode(U.links(F.col("html"))).alias("raw"))
    return out.select("url", U.resolve(F.col("raw"), F.col("url")).alias("link")).where("link is not null and link <> '' and link <> url")


def allowed(links: DataFrame, pattern: str | None = None) -> DataFrame:
    """Links that match a pattern."""
    return links.where(F.col("link").rlike(pattern)) if pattern else links


def step(pages: DataFrame, seen: DataFrame, pattern: str | None = None) -> DataFrame:
    """url: distinct new links."""
    new = allowed(found_links(pages), pattern).select(F.col("link").alias("url")).distinct()
    return new.join(seen.select("url"), "url", "left_anti")


def crawl(web: DataFrame, seeds: DataFrame, rounds: int = 100, url: Column | None = None) -> DataFrame:
    """url, round at which each page of ``web`` (url, html) is reached from the seeds.

    ``web`` stands for the network. The frontier and the seen pages of each round are
    written to the shared folder, so that a run can be taken up again.
    """
    spell = U.normalize(F.col("url")) if url is None else url
    web = web.select(spell.alias("url"), "html").where("url is not null").dropDuplicates(["url"])
    frontier = materialise(seeds.select(spell.alias("url")).distinct(), "frontier")
    seen = None
    for n in range(rounds):
        now = web.join(frontier, "url", "left_semi")
        reached = frontier.join(web.select("url"), "url", "left_semi").select("url", F.lit(n).alias("round"))
        seen = materialise(reached if seen is None else seen.unionByName(reached), "seen")
        links = found_links(now).select(F.col("link").alias("url")).distinct().join(web.select("url"), "url", "left_semi")
        frontier = materialise(links.join(seen, "url", "left_anti"), "frontier")
        if not frontier.head(1):
            break
    return seen
