"""Chains of pages that name their successor: next-url and cursor paging, followed in a number of steps that grows with the
logarithm of the longest chain.

Pointer doubling: in each round every page's jump becomes twice as long, by one join of the jumps with themselves, and the
pages reached so far reach as many again. Places only ever shrink, so a page that a cycle reaches once more keeps its first place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.settle import settled

KEY = ["source_key", "page"]


def places(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """source_key, page, place (from 0) of all pages that are reached from their source's start.

    pages: source_key, page, next (null at the end), one row a page (of several the one with the smallest next counts);
    starts: source_key, page. A start that isn't landed reaches nothing. The next page is one of the same source.
    """
    c = F.col
    links = settled(pages.filter("page is not null").groupBy(*KEY).agg(F.min("next").alias("next")))
    landed = links.select(*KEY)
    reached = settled(starts.select(*KEY).dropDuplicates(["source_key"]).join(landed, KEY, "left_semi").withColumn("place", F.lit(0).cast("long")))
    jump = links.filter("next is not null").join(landed.withColumnRenamed("page", "next"), ["source_key", "next"], "left_semi").select(*KEY, "next")
    step, count = 1, reached.count()
    while True:
        more = reached.join(jump, KEY).select("source_key", c("next").alias("page"), (c("place") + step).alias("place"))
        reached = settled(reached.union(more).groupBy(*KEY).agg(F.min("place").alias("place")))
        now = reached.count()
        if now == count:
            return reached
        count, step = now, 2 * step
        after = jump.select("source_key", c("page").alias("next"), c("next").alias("then"))
        jump = settled(jump.join(after, ["source_key", "next"]).select(*KEY, c("then").alias("next")))


def chains(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """source_key, n_pages, last_page, points_to, status: complete (no next), gap (next isn't landed), cycle (next was read
    before) or missing (the start isn't landed: no pages)."""
    c = F.col
    at = places(pages, starts)
    one = pages.filter("page is not null").groupBy(*KEY).agg(F.min("next").alias("next"))
    ends = at.groupBy("source_key").agg(F.count(F.lit(1)).alias("n_pages"), F.max_by("page", "place").alias("page")).join(one, KEY)
    back = at.select("source_key", c("page").alias("next"), F.lit(True).alias("read"))
    told = ends.join(back, ["source_key", "next"], "left")
    status = F.when(c("next").isNull(), "complete").when(c("read"), "cycle").otherwise("gap")
    told = told.select("source_key", "n_pages", c("page").alias("last_page"), c("next").alias("points_to"), status.alias("status"))
    all_ = starts.select("source_key").distinct().join(told, "source_key", "left")
    return all_.withColumns({"n_pages": F.coalesce("n_pages", F.lit(0)), "status": F.coalesce("status", F.lit("missing"))})
