"""Catalogue operators: filters, facets, paging, statistics, company directory, hashes and classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import jobs, table

INCLUDE, EXCLUDE, PREFIXES = ("the ", "de ", "der "), ("stupid", "idiot"), ("of", "is")
#: Parts of a location that shut a job out.
ABROAD = ("es",)
#: Ordered category and industry rules over lower-cased text.
CATEGORIES = (("ation|tion", "Backend"), ("und|ung", "Data"), ("eau|eux", "Frontend"), ("ción|mente", "QA"))
INDUSTRIES = (("src0$", "Aggregator"), ("src[1-9]$", "Product"), ("src1", "Agency"))
TECHNOLOGIES = (("thon", "(^|[^a-z])thon"), ("tion", "tion([^a-z]|$)"), ("eaux", "eaux"), ("ung", "ung([^a-z]|$)"), ("mente", "mente"))


def source_stats(spark: SparkSession, d: str) -> DataFrame:
    live = F.col("active") & ~F.col("stale")
    count = lambda c: F.count(F.when(c, 1))
    return jobs(spark, d).groupBy("company").agg(
        F.count(F.lit(1)).alias("total"),
        count(F.col("active")).alias("active"),
        count(F.col("active") & F.col("stale")).alias("stale"),
        count(live).alias("live"),
        count(~F.col("active")).alias("closed"),
    )


def include_exclude(spark: SparkSession, d: str) -> DataFrame:
    """Titles with a wanted word, no unwanted word, no unwanted prefix word, outside the excluded locations."""
    j = jobs(spark, d)
    prefixed = F.lit(False)
    for p in PREFIXES:
        prefixed = prefixed | (F.lower("title") == p) | F.lower("title").startswith(p + " (")
    kept = X.any_contains(F.col("title"), INCLUDE) & ~X.any_contains(F.col("title"), EXCLUDE) & ~prefixed
    abroad = F.exists(F.array(*map(F.lit, ABROAD)), lambda p: F.contains(F.lower("location"), p))
    return j.filter(kept & ~abroad).select("external_id", "company", "location")


def classified(spark: SparkSession, d: str) -> DataFrame:
    """Each job with its category, industry, technologies and tags."""
    j = jobs(spark, d)
    found = F.filter(
        F.array(*[F.when(F.lower("description").rlike(p), F.lit(n)) for n, p in TECHNOLOGIES]), lambda t: t.isNotNull()
    )
    return j.withColumns(
        {
            "category": X.first_match(F.col("title"), CATEGORIES, "Other"),
            "industry": X.first_match(F.col("company"), INDUSTRIES, "Other"),
            "technologies": found,
        }
    )


def job_classes(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).select(
        "external_id", "category", "industry", F.array_join("technologies", ",").alias("technologies")
    )


def facet_page(spark: SparkSession, d: str) -> DataFrame:
    """Second page of 15 live jobs of one category that name all wanted technologies, longest description first."""
    c = classified(spark, d).filter(F.col("active") & ~F.col("stale") & (F.col("category") == "Backend"))
    c = c.filter(F.forall(F.array(F.lit("tion")), lambda t: F.array_contains("technologies", t)))
    c = c.select("external_id", "company", F.length("description").alias("score"))
    return c.orderBy(F.desc("score"), "external_id").offset(15).limit(15)


def facet_domain(spark: SparkSession, d: str) -> DataFrame:
    return (
        classified(spark, d).select(F.explode("technologies").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("jobs"))
    )


def company_directory(spark: SparkSession, d: str) -> DataFrame:
    """Companies with their live jobs, industry, initials and distinct technologies."""
    c = classified(spark, d).filter(F.col("active") & ~F.col("stale"))
    return c.groupBy("company", "industry").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("technologies")))), ",").alias("stack"),
    ).withColumn("initials", X.initials(F.col("company")))


def job_hashes(spark: SparkSession, d: str) -> DataFrame:
    j = jobs(spark, d)
    key = F.concat_ws(":", "source_key", F.col("external_id").cast("string"))
    return j.select(
        "external_id",
        X.content_hash(F.col("title"), F.col("description")).alias("content_hash"),
        X.site_job_id(key).alias("site_id"),
        X.stable_job_id(key).alias("stable_id"),
        X.slug(key).alias("slug"),
    )


def related_jobs(spark: SparkSession, d: str) -> DataFrame:
    """For each customer's order the next three orders of that customer, -1 where there is none."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    following = [F.lead("o_orderkey", k, -1).over(w).alias(f"next{k}") for k in (1, 2, 3)]
    return o.select("o_orderkey", *following)


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Source and language pairs of all documents against those of closed ones: added and removed pairs."""
    now = table(spark, d, "documents").select("source", "lang").distinct()
    j = jobs(spark, d).filter("not active").select(F.col("company").alias("source"), F.col("location").alias("lang")).distinct()
    added, removed = now.subtract(j), j.subtract(now)
    return added.withColumn("change", F.lit("added")).unionByName(removed.withColumn("change", F.lit("removed")))


QUERIES = {
    "catalog_source_stats": source_stats, "catalog_filter": include_exclude, "catalog_job_classes": job_classes,
    "catalog_facet_page": facet_page, "catalog_facet_domain": facet_domain, "company_directory": company_directory,
    "job_hashes": job_hashes, "related_jobs": related_jobs, "snapshot_diff": snapshot_diff,
}

JOBS = """jobs AS (SELECT source AS source_key, d.doc_id AS external_id, source AS company,
  split_part(text, chr(10), 1) AS title, lang AS location, text AS description,
  coalesce(quality, 1) = 1 AS active, coalesce(toxic, 0) = 1 AS stale
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def _case(expr, rules, default):
    return "CASE " + " ".join(f"WHEN regexp_matches({expr}, '{p}') THEN '{v}'" for p, v in rules) + f" ELSE '{default}' END"


_TECH = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(description), '{p}') THEN '{n}' END" for n, p in TECHNOLOGIES) + "], lambda x: x IS NOT NULL)"
CLASSED = f"""{JOBS}, classed AS (SELECT *, {_case('lower(title)', CATEGORIES, 'Other')} AS category,
  {_case('lower(company)', INDUSTRIES, 'Other')} AS industry, {_TECH} AS technologies FROM jobs)"""
_NORM = lambda c: f"lower(trim(regexp_replace(translate(coalesce({c}, ''), 'ёЁ–—−   ', 'еЕ---   '), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')))"
_KEY = "concat_ws(':', source_key, external_id::VARCHAR)"
_H = f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split({_KEY}, ''), lambda c: ord(c)::BIGINT)), lambda a, b: (a * 31 + b) & 4294967295)"
ORACLE = {
    "catalog_source_stats": f"""WITH {JOBS} SELECT company, count(*) AS total, count(*) FILTER (active) AS active,
      count(*) FILTER (active AND stale) AS stale, count(*) FILTER (active AND NOT stale) AS live,
      count(*) FILTER (NOT active) AS closed FROM jobs GROUP BY company""",
    "catalog_filter": f"""WITH {JOBS} SELECT external_id, company, location FROM jobs WHERE ("""
    + " OR ".join(f"contains(lower(title), '{w}')" for w in INCLUDE)
    + ") AND NOT ("
    + " OR ".join(f"contains(lower(title), '{w}')" for w in EXCLUDE)
    + ") AND NOT ("
    + " OR ".join(f"lower(title) = '{p}' OR starts_with(lower(title), '{p} (')" for p in PREFIXES)
    + ") AND NOT (" + " OR ".join(f"contains(lower(location), '{p}')" for p in ABROAD) + ")",
    "catalog_job_classes": f"WITH {CLASSED} SELECT external_id, category, industry, array_to_string(technologies, ',') AS technologies FROM classed",
    "catalog_facet_page": f"""WITH {CLASSED} SELECT external_id, company, length(description)::INTEGER AS score FROM classed
      WHERE active AND NOT stale AND category = 'Backend' AND list_contains(technologies, 'tion')
      ORDER BY score DESC, external_id LIMIT 15 OFFSET 15""",
    "catalog_facet_domain": f"WITH {CLASSED}, t AS (SELECT unnest(technologies) AS tag FROM classed) SELECT tag, count(*) AS jobs FROM t GROUP BY tag",
    "company_directory": f"""WITH {CLASSED}, live AS (SELECT * FROM classed WHERE active AND NOT stale),
      t AS (SELECT company, string_agg(DISTINCT u.tech, ',' ORDER BY u.tech) AS stack FROM live, unnest(technologies) AS u(tech) GROUP BY company)
      SELECT live.company, industry, count(*) AS jobs, coalesce(any_value(stack), '') AS stack, upper(left(live.company, 1)) AS initials
      FROM live LEFT JOIN t ON live.company = t.company GROUP BY live.company, industry""",
    "job_hashes": f"""WITH {JOBS}, h AS (SELECT *, {_H} AS h, {_KEY} AS k FROM jobs), i AS (SELECT *, CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END AS sid FROM h)
      SELECT external_id, sha256({_NORM('title')} || chr(10) || {_NORM('description')}) AS content_hash, sid AS site_id,
      CASE WHEN (h & 2147483647) = 0 THEN 1 ELSE h & 2147483647 END AS stable_id,
      regexp_replace(regexp_replace(regexp_replace(lower(k), '[^a-zа-яё0-9]+', '-', 'g'), '^-', ''), '-$', '') || '-' || lower(to_base(sid, 36)) AS slug FROM i""",
    "related_jobs": """SELECT o_orderkey, lead(o_orderkey, 1, -1) OVER w AS next1, lead(o_orderkey, 2, -1) OVER w AS next2, lead(o_orderkey, 3, -1) OVER w AS next3
      FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""",
    "snapshot_diff": f"""WITH {JOBS}, a AS (SELECT DISTINCT source, lang FROM documents), b AS (SELECT DISTINCT company AS source, location AS lang FROM jobs WHERE NOT active)
      SELECT source, lang, 'added' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT source, lang, 'removed' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
}
