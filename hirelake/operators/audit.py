"""HTML audit over pages: presence and quality of metadata, headings, landmarks, links, duplicate titles, and contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.tables import table


def html_checks(spark: SparkSession, d: str) -> DataFrame:
    h = F.lower("html")
    title = F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1))
    return table(spark, d, "pages").select(
        "page_id",
        (title != "").alias("has_title"),
        h.rlike('<meta[^>]+name="description"').alias("has_description"),
        h.rlike('<link[^>]+rel="canonical"').alias("has_canonical"),
        h.rlike("<html[^>]+lang=").alias("has_lang"),
        F.length(title).between(15, 70).alias("title_fits"),
        F.regexp_count("html", F.lit("(?i)<h1[ >]")).cast("long").alias("h1"),
        (h.rlike("<nav[ >]") & h.rlike("<(main|article)[ >]")).alias("landmarks"),
    )


def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    """Pages that pass each check."""
    names = ["has_title", "has_description", "has_canonical", "has_lang", "title_fits", "landmarks"]
    checks = html_checks(spark, d).select("page_id", *names).unpivot(["page_id"], names, "check", "passed")
    return checks.groupBy("check").agg(F.count(F.lit(1)).alias("pages"), F.count(F.when(F.col("passed"), 1)).alias("passed"))


def internal_links(spark: SparkSession, d: str) -> DataFrame:
    """Distinct links of each page that stay on its scheme, host and port, as absolute urls without their fragment."""
    found = table(spark, d, "pages").select("page_id", F.size(urls.internal_links(F.col("html"), F.col("url"))).cast("long").alias("links"))
    return found.filter("links > 0")


def duplicate_titles(spark: SparkSession, d: str) -> DataFrame:
    title = F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1))
    return table(spark, d, "pages").groupBy(title.alias("title")).agg(F.count(F.lit(1)).alias("pages")).filter("pages > 1")


def contacts(spark: SparkSession, d: str) -> DataFrame:
    """First e-mail address and number of addresses in each document that has one."""
    found = F.regexp_extract_all("text", F.lit("([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,})"), 1)
    return table(spark, d, "documents").select("doc_id", found.alias("m")).filter(F.size("m") > 0).select(
        "doc_id", F.col("m")[0].alias("email"), F.size("m").cast("long").alias("n")
    )


QUERIES = {
    "html_checks": html_checks, "audit_summary": audit_summary, "internal_links": internal_links,
    "duplicate_titles": duplicate_titles, "contacts": contacts,
}
_T = "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"
_CHECKS = f"""SELECT page_id, {_T} <> '' AS has_title, regexp_matches(lower(html), '<meta[^>]+name="description"') AS has_description,
  regexp_matches(lower(html), '<link[^>]+rel="canonical"') AS has_canonical, regexp_matches(lower(html), '<html[^>]+lang=') AS has_lang,
  length({_T}) BETWEEN 15 AND 70 AS title_fits, len(regexp_extract_all(html, '(?i)<h1[ >]')) AS h1,
  regexp_matches(lower(html), '<nav[ >]') AND regexp_matches(lower(html), '<(main|article)[ >]') AS landmarks FROM pages"""
_NAMES = ("has_title", "has_description", "has_canonical", "has_lang", "title_fits", "landmarks")
ORACLE = {
    "html_checks": _CHECKS,
    "audit_summary": f"WITH c AS ({_CHECKS}) " + " UNION ALL ".join(f"SELECT '{n}' AS \"check\", count(*) AS pages, count(*) FILTER ({n}) AS passed FROM c" for n in _NAMES),
    "internal_links": """WITH l AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a href="([^"#]*)', 1))) AS href FROM pages)
      SELECT page_id, count(*) AS links FROM l WHERE starts_with(href, '/') GROUP BY page_id""",
    "duplicate_titles": f"SELECT {_T} AS title, count(*) AS pages FROM pages GROUP BY 1 HAVING count(*) > 1",
    "contacts": r"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,})', 1) AS m FROM documents)
      SELECT doc_id, m[1] AS email, len(m) AS n FROM m WHERE len(m) > 0""",
}
