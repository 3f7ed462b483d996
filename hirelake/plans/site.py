"""Site crawls over landed pages: from each root the pages within some links, breadth first, up to a number of pages.

A step is one join of the frontier with the link table. A page's first 2 * ``most`` distinct internal links decide every
crawl: at most ``most`` of them can have been met before, and no more than ``most`` are ever taken. So a root's frontier is
bounded whatever its pages link to, and no root meets all links of a large site.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import absolute, internal_links
from ..sources.settle import settled

DEPTH, MOST = 2, 12


def link_table(pages: DataFrame, most: int | None = None) -> DataFrame:
    """src, at, dst: internal links of pages (url, html), in order from 0, or the first ``most`` of each page."""
    found = internal_links(F.col("html"), F.col("url"))
    found = found if most is None else F.slice(found, 1, most)
    return pages.select(absolute(F.col("url"), F.lit("")).alias("src"), F.posexplode(found).alias("at", "dst"))


def crawl(pages: DataFrame, roots: DataFrame, depth: int = DEPTH, most: int = MOST) -> DataFrame:
    """root, url, depth, place, landed: at most ``most`` pages of each root within ``depth`` internal links, the root first.

    pages: url, html, one row a url; roots: url. Pages come breadth first, those of one depth by the place of the page that
    links to them first, then by the place of the link. A linked page that isn't landed counts, and leads nowhere. Roots
    that aren't http(s) urls are left out; a root given twice counts once.
    """
    c = F.col
    links = settled(link_table(pages, 2 * most))
    found = roots.select(absolute(c("url"), F.lit("")).alias("root")).filter("root is not null").distinct()
    found = front = settled(found.select("root", c("root").alias("url"), F.lit(0).alias("depth"), F.lit(1).alias("place")))
    for step in range(1, depth + 1):
        ahead = front.join(links, front.url == links.src).groupBy("root", c("dst").alias("url")).agg(F.min(F.struct("place", "at")).alias("by"))
        new = ahead.join(found.select("root", "url"), ["root", "url"], "left_anti")
        before = found.groupBy("root").agg(F.max("place").alias("n"))
        ranked = new.withColumn("r", F.row_number().over(Window.partitionBy("root").orderBy("by"))).join(before, "root")
        front = settled(ranked.filter(c("r") + c("n") <= most).select("root", "url", F.lit(step).alias("depth"), (c("r") + c("n")).alias("place")))
        found = found.unionByName(front)
    landed = pages.select(absolute(c("url"), F.lit("")).alias("url")).distinct().withColumn("there", F.lit(True))
    return found.join(landed, "url", "left").select("root", "url", "depth", "place", F.coalesce("there", F.lit(False)).alias("landed"))
