"""Crawls of sites whose pages are landed.

The pages of the tables lie two folders deep, while their links name words at the top of a host. So the first word of a page's
title stands for its address at its site, the last two labels of its host; of several pages at one address the first counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import site as S
from ..sources.tables import table

SITE, TITLE, WORD = r"^[A-Za-z]+://[^/?#]*?([^./?#]+[.][^./?#]+)(?:[/?#]|$)", "(?is)<title[^>]*>(.*?)</title>", '^[^ ?#&%<>"]+'


def site_pages(spark: SparkSession, d: str) -> DataFrame:
    word = F.regexp_extract(F.trim(F.regexp_extract("html", TITLE, 1)), WORD, 0)
    url = F.concat(F.lit("http://"), F.lower(F.regexp_extract("url", SITE, 1)), F.lit("/"), word)
    return table(spark, d, "pages").groupBy(url.alias("url")).agg(F.min_by("html", "page_id").alias("html"))


def site_crawl(spark: SparkSession, d: str) -> DataFrame:
    """From every page as root, the first 12 pages within two links."""
    pages = site_pages(spark, d)
    return S.crawl(pages, pages)


QUERIES = {"site_crawl": site_crawl}
ORACLE = {
    "site_crawl": f"""WITH a AS (SELECT 'http://' || lower(regexp_extract(url, '{SITE}', 1)) || '/' || regexp_extract(trim(regexp_extract(html, '{TITLE}', 1)), '{WORD}') AS url, page_id, html FROM pages),
      p AS (SELECT url, arg_min(html, page_id) AS html FROM a GROUP BY url),
      l AS (SELECT url AS src, regexp_extract(url, '^http://[^/]+') AS own, regexp_extract_all(html, '<a href="([^"#]*)', 1) AS h FROM p),
      e AS (SELECT src, own || h[i] AS dst, min(i) AS link FROM (SELECT src, own, h, unnest(range(1, len(h) + 1)) AS i FROM l) WHERE starts_with(h[i], '/') GROUP BY 1, 2),
      f1 AS (SELECT src AS root, dst AS url, 1 AS depth, 1 + row_number() OVER (PARTITION BY src ORDER BY link) AS place FROM e WHERE dst <> src QUALIFY place <= {S.MOST}),
      n AS (SELECT root, max(place) AS n FROM f1 GROUP BY root),
      w AS (SELECT f.root, e.dst AS url, min(place * 1000000 + link) AS way FROM f1 f JOIN e ON e.src = f.url WHERE e.dst <> f.root AND (f.root, e.dst) NOT IN (SELECT (root, url) FROM f1) GROUP BY 1, 2),
      f2 AS (SELECT w.root, w.url, 2 AS depth, n + row_number() OVER (PARTITION BY w.root ORDER BY way) AS place FROM w JOIN n ON n.root = w.root QUALIFY place <= {S.MOST}),
      u AS (SELECT url AS root, url, 0 AS depth, 1 AS place FROM p UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2)
      SELECT root, url, depth, place, url IN (SELECT url FROM p) AS landed FROM u""",
}
