"""Facets and selections of the catalogue: company pages, directory, recommendations, payload and url guards, exports.

Each function takes tables and settings; the queries below apply them to the test tables, whose labels stand for closed
and stale jobs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.hosts import LOCAL_NAMES, public_host, ranges
from ..functions.text import content_hash
from ..plans.placed import placed
from ..sources.tables import jobs, table
from .catalogue import _NORM, CLASSED, JOBS, classified
from .scoring import ORACLE as SCORING
from .scoring import scored

#: Hosts that the query of public urls puts in: some global, some not.
ADDRESSES = ("://100.64.0.1", "://8.8.8.8:80", "://224.0.0.1", "://192.0.2.1", "://0x7f.0.0.1", "://2130706433", "://1.2.3.4", "://172.32.0.9", "://203.0.113.7")
PAYLOAD, TITLE, DESCRIPTION = 4000, 300, 20000


def live(j: DataFrame) -> DataFrame:
    return j.filter("active and not stale")


def has_all(values: Column, wanted: tuple[str, ...]) -> Column:
    return reduce(lambda a, w: a & F.array_contains(values, w), wanted, F.lit(True))


def company_page(j: DataFrame, company: str, query: str = "", category: str | None = None, techs: tuple[str, ...] = (), remote: bool = False) -> DataFrame:
    """Live jobs of one company whose title or tags hold the query, of a category, with all technologies, perhaps remote."""
    q = query.lower()
    named = F.contains(F.lower("title"), F.lit(q)) | F.exists("technologies", lambda t: F.contains(F.lower(t), F.lit(q)))
    out = live(j).filter(F.col("company") == company).filter(named & has_all(F.col("technologies"), techs))
    if category:
        out = out.filter(F.col("category") == category)
    if remote:
        out = out.filter(F.lower(F.concat_ws(" ", "location", "type")).rlike(R.REMOTE))
    return out


def by_category(j: DataFrame) -> DataFrame:
    """Every job under its category, with the number of the category's jobs: rows, so that no list grows with a category."""
    sizes = j.groupBy(F.col("category").alias("_of")).agg(F.count(F.lit(1)).alias("jobs"))
    return j.join(sizes, F.col("category").eqNullSafe(F.col("_of"))).select("category", "jobs", "external_id")


def directory(companies: DataFrame, search: str = "", industry: str | None = None, stack: tuple[str, ...] = (), order: str = "jobs") -> DataFrame:
    """Companies whose name, about or technologies hold the search, of an industry, with all of a stack; most jobs first or
    by name."""
    q = search.lower()
    found = F.contains(F.lower(F.concat_ws(" ", "company", "about", F.array_join("stack", " "))), F.lit(q))
    out = companies.filter(found & has_all(F.col("stack"), stack))
    if industry:
        out = out.filter(F.col("industry") == industry)
    return out.orderBy(*([F.desc("jobs"), "company"] if order == "jobs" else [F.lower("company"), "company"]))


def recommended(scores: DataFrame, applied: DataFrame, key: str = "external_id") -> DataFrame:
    """Scored jobs that are not ineligible and not applied for."""
    return scores.filter("score is not null and band <> 'poor'").join(applied.select(key).distinct(), key, "left_anti")


def score_payload(j: DataFrame, limit: int = PAYLOAD) -> DataFrame:
    """What a scoring request takes: the first jobs with a title, titles and descriptions of bounded length."""
    titled = j.filter(F.trim(F.coalesce("title", F.lit(""))) != "").orderBy("external_id").limit(limit)
    return titled.select("external_id", F.substring("title", 1, TITLE).alias("title"), F.substring(F.coalesce("description", F.lit("")), 1, DESCRIPTION).alias("description"))


def public_url(url: Column) -> Column:
    """Whether a url is http or https, without credentials, and of no local or private host."""
    at = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), "^https?://([^/?#]+)", 1)
    host = F.regexp_replace(at, ":[0-9]*$", "")
    return (at != "") & ~at.contains("@") & public_host(host)


def complete(j: DataFrame) -> DataFrame:
    """Rows with a title and a description."""
    full = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return j.filter(full("title") & full("description"))


def outside(j: DataFrame, cities: Column, foreign: tuple[str, ...]) -> DataFrame:
    """Rows without those whose cities are all foreign; rows without cities stay."""
    return j.filter((F.size(cities) == 0) | ~F.forall(cities, lambda c: c.isin(*foreign)))


def merged_filters(defaults: DataFrame, sources: DataFrame) -> DataFrame:
    """Filters of each enabled source: its own includes, else the default ones; excludes of both."""
    one = defaults.select(F.col("include").alias("_i"), F.col("exclude").alias("_e"))
    none = F.array().cast("array<string>")
    joined = sources.filter("enabled").crossJoin(F.broadcast(one.limit(1)))
    include = F.when(F.size(F.coalesce("include", none)) > 0, F.col("include")).otherwise(F.coalesce("_i", none))
    return joined.select("source_key", include.alias("include"), F.concat(F.coalesce("_e", none), F.coalesce("exclude", none)).alias("exclude"))


def eligible(subscribers: DataFrame) -> DataFrame:
    """Subscribers who asked for notices and have a chat; ``any`` among formats says nothing; scores lie in 0 to 100."""
    formats = F.filter(F.coalesce("formats", F.array().cast("array<string>")), lambda f: F.lower(f) != "any")
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce("min_score", F.lit(0.0))))
    asked = subscribers.filter("enabled and new_jobs and coalesce(chat_id, '') <> ''")
    return asked.withColumns({"formats": formats, "min_score": score})


def with_features(j: DataFrame, index: DataFrame) -> DataFrame:
    """Live jobs joined with the feature index by both keys, newest first, then by company and title."""
    return live(j).join(index, ["source_key", "external_id"]).orderBy(F.desc("first_seen"), "company", "title")


def export_order(j: DataFrame) -> DataFrame:
    """Active jobs first, then by company and title."""
    return j.orderBy(F.desc("active"), "company", "title")


def archive_order(j: DataFrame) -> DataFrame:
    """Closed and stale jobs, the last to leave first, then by company and title."""
    gone = j.filter("not active or stale").withColumn("left_at", F.coalesce("closed_at", "stale_at"))
    return gone.orderBy(F.desc_nulls_last("left_at"), "company", "title")


def without_codes(j: DataFrame, other: DataFrame, code: str) -> DataFrame:
    """Rows whose code isn't found elsewhere."""
    return j.join(other.select(code).distinct(), code, "left_anti")


# ---- queries


def _typed(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("external_id") % 3 == 0, "Удалённо").when(F.col("external_id") % 3 == 1, "Гибрид").otherwise("Офис")
    return classified(spark, d).withColumn("type", kind)


def catalog_rules(spark: SparkSession, d: str) -> DataFrame:
    j = jobs(spark, d)
    return j.select(
        "external_id", F.array_join(R.technologies(F.col("description")), ",").alias("technologies"),
        R.first_of(F.col("title"), R.CATEGORIES, R.NO_CATEGORY).alias("category"), R.first_of(F.col("company"), R.INDUSTRIES, R.NO_INDUSTRY).alias("industry"),
    )


def q_company_page(spark: SparkSession, d: str) -> DataFrame:
    return by_category(company_page(_typed(spark, d), "src1", "t", None, ("tion",), True))


def q_directory(spark: SparkSession, d: str) -> DataFrame:
    c = live(classified(spark, d)).groupBy("company", "industry").agg(
        F.count(F.lit(1)).alias("jobs"), F.array_distinct(F.flatten(F.collect_set("technologies"))).alias("stack"), F.min("location").alias("about")
    )
    return directory(c, "src1", "Product", ("tion",)).select("company", "industry", "jobs", F.size("stack").cast("long").alias("techs"))


def q_recommended(spark: SparkSession, d: str) -> DataFrame:
    applied = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("external_id"))
    return recommended(scored(live(jobs(spark, d))), applied).select("external_id", "score", "band")


def q_score_payload(spark: SparkSession, d: str) -> DataFrame:
    p = score_payload(jobs(spark, d))
    return p.select("external_id", F.length("title").cast("long").alias("title_chars"), F.sha2("description", 256).alias("description_sha256"))


def q_public_urls(spark: SparkSession, d: str) -> DataFrame:
    """Urls of pages, some with credentials, private hosts or other schemes put in their place."""
    n, url = F.col("page_id"), F.col("url")
    put = lambda to: F.regexp_replace(url, F.lit("://[^/?#]*"), to if isinstance(to, Column) else F.lit(to))
    odd = F.when(n % 9 == 1, put("://user:pw@x.example.com")).when(n % 9 == 2, put("://10.0.0.7:8080")).when(n % 9 == 3, F.regexp_replace(url, "^[a-z]+", "ftp"))
    odd = odd.when(n % 9 == 4, put("://localhost:81")).when(n % 9 == 5, put("://172.20.1.1")).when(n % 9 == 6, put("://172.40.1.1:443")).when(n % 9 == 7, put("://printer.local"))
    odd = odd.when(n % 9 == 8, put(F.element_at(F.array(*map(F.lit, ADDRESSES)), (F.floor(n / 9) % len(ADDRESSES) + 1).cast("int")))).otherwise(url)
    return table(spark, d, "pages").select("page_id", public_url(odd).alias("is_public"))


def q_complete(spark: SparkSession, d: str) -> DataFrame:
    """Jobs with title and description, without those whose cities are all foreign."""
    cities = F.when(F.col("external_id") % 4 == 0, F.array()).when(F.col("external_id") % 4 == 1, F.array("location", F.lit("en"))).otherwise(F.array("location"))
    j = complete(jobs(spark, d)).withColumn("cities", cities)
    return outside(j, F.col("cities"), ("de", "fr")).groupBy("company").agg(F.count(F.lit(1)).alias("jobs"), F.sum("external_id").alias("ids"))


def q_source_filters(spark: SparkSession, d: str) -> DataFrame:
    """Nations as sources: every third is off, every second has includes of its own."""
    n, none = F.col("n_nationkey"), F.array().cast("array<string>")
    s = table(spark, d, "nation").select(
        F.col("n_name").alias("source_key"), (n % 3 != 0).alias("enabled"), F.when(n % 2 == 0, F.array(F.lower("n_name"))).otherwise(none).alias("include"),
        F.when(n % 5 == 0, F.array(F.lit("intern"))).alias("exclude"),
    )
    base = spark.range(1).select(F.array(F.lit("java")).alias("include"), F.array(F.lit("sales")).alias("exclude"))
    return merged_filters(base, s).select("source_key", F.array_join("include", "|").alias("include"), F.array_join("exclude", "|").alias("exclude"))


def q_eligible(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    people = table(spark, d, "customer").select(
        (k % 2 == 0).alias("enabled"), (k % 3 != 0).alias("new_jobs"), F.when(k % 5 != 0, F.concat(F.lit("c"), k.cast("string"))).alias("chat_id"),
        F.when(k % 7 != 0, F.array(F.lit("Any"), F.lower("c_mktsegment"))).alias("formats"), (F.col("c_acctbal") / 50).alias("min_score"),
    )
    return eligible(people).select("chat_id", F.array_join("formats", "|").alias("formats"), F.round("min_score", 6).alias("min_score"))


def q_with_features(spark: SparkSession, d: str) -> DataFrame:
    j = jobs(spark, d).withColumn("first_seen", F.col("external_id") % 30)
    index = jobs(spark, d).filter("external_id % 2 = 0").select("source_key", "external_id", content_hash(F.col("title"), F.col("description")).alias("content_hash"))
    return with_features(j, index).select("source_key", "external_id", "first_seen", "content_hash")


def q_export_order(spark: SparkSession, d: str) -> DataFrame:
    """All rows of an export with their places."""
    rows = jobs(spark, d).select("external_id", "active", "company")
    return placed(rows, F.desc("active"), "company", "external_id")


def q_archive(spark: SparkSession, d: str) -> DataFrame:
    j = jobs(spark, d)
    closed = F.when(~F.col("active"), F.col("external_id") % 40)
    j = j.withColumns({"closed_at": closed, "stale_at": F.when(F.col("stale"), F.col("external_id") % 50)})
    return archive_order(j).select("external_id", "company", "left_at")


def q_without_codes(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose id isn't a page's."""
    pages = table(spark, d, "pages").select((F.col("page_id") * 2).alias("external_id"))
    return without_codes(jobs(spark, d), pages, "external_id").groupBy("company").agg(F.count(F.lit(1)).alias("jobs"), F.sum("external_id").alias("ids"))


QUERIES = {
    "catalog_rules": catalog_rules, "company_page": q_company_page, "company_search": q_directory, "recommended_jobs": q_recommended,
    "score_payload": q_score_payload, "public_urls": q_public_urls, "complete_jobs": q_complete, "source_filters": q_source_filters,
    "eligible_subscribers": q_eligible, "jobs_with_features": q_with_features, "export_order": q_export_order, "archive_order": q_archive,
    "jobs_without_codes": q_without_codes,
}
_PUT = lambda to: f"regexp_replace(url, '://[^/?#]*', '{to}')"
_TITLED = "trim(coalesce(title, ''), ' ') <> ''"
ORACLE = {
    "catalog_rules": f"""WITH {JOBS} SELECT external_id, array_to_string({R.sql_technologies('description')}, ',') AS technologies,
      {R.sql_first_of('title', R.CATEGORIES, R.NO_CATEGORY)} AS category, {R.sql_first_of('company', R.INDUSTRIES, R.NO_INDUSTRY)} AS industry FROM jobs""",
    "company_page": f"""WITH {CLASSED}, p AS (SELECT * FROM classed WHERE active AND NOT stale AND company = 'src1' AND list_contains(technologies, 'tion')
      AND (contains(lower(title), 't') OR len(list_filter(technologies, lambda t: contains(t, 't'))) > 0) AND external_id % 3 <> 2)
      SELECT category, count(*) OVER (PARTITION BY category) AS jobs, external_id FROM p""",
    "company_search": f"""WITH {CLASSED}, live AS (SELECT * FROM classed WHERE active AND NOT stale), c AS (SELECT company, industry, count(*) AS jobs, min(location) AS about,
      list_distinct(flatten(list(technologies))) AS stack FROM live GROUP BY company, industry)
      SELECT company, industry, jobs, len(stack) AS techs FROM c WHERE contains(lower(company || ' ' || about || ' ' || array_to_string(stack, ' ')), 'src1') AND list_contains(stack, 'tion') AND industry = 'Product'""",
    "recommended_jobs": f"""WITH a AS ({SCORING['score_jobs']}), {JOBS} SELECT a.external_id, score, band FROM a JOIN jobs USING (external_id)
      WHERE active AND NOT stale AND band <> 'poor' AND external_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "score_payload": f"""WITH {JOBS} SELECT external_id, length(substr(title, 1, {TITLE})) AS title_chars, sha256(substr(coalesce(description, ''), 1, {DESCRIPTION})) AS description_sha256
      FROM jobs WHERE {_TITLED} ORDER BY external_id LIMIT {PAYLOAD}""",
    "public_urls": f"""WITH u AS (SELECT page_id, lower(CASE page_id % 9 WHEN 1 THEN {_PUT('://user:pw@x.example.com')} WHEN 2 THEN {_PUT('://10.0.0.7:8080')} WHEN 3 THEN regexp_replace(url, '^[a-z]+', 'ftp')
        WHEN 4 THEN {_PUT('://localhost:81')} WHEN 5 THEN {_PUT('://172.20.1.1')} WHEN 6 THEN {_PUT('://172.40.1.1:443')} WHEN 7 THEN {_PUT('://printer.local')}
        WHEN 8 THEN regexp_replace(url, '://[^/?#]*', [{', '.join(f"'{a}'" for a in ADDRESSES)}][((page_id // 9) % {len(ADDRESSES)} + 1)::INTEGER]) ELSE url END) AS url FROM pages),
      h AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS a, regexp_replace(a, ':[0-9]*$', '') AS h FROM u),
      n AS (SELECT *, CASE WHEN regexp_matches(h, '^[0-9]+$') THEN h::BIGINT WHEN regexp_matches(h, '^((0x[0-9a-f]+|[0-9]+)[.]){{3}}[0-9]+$')
        THEN list_reduce(list_transform(string_split(h, '.'), lambda p: CASE WHEN p LIKE '0x%' THEN (position(p[3] IN '0123456789abcdef') - 1) * 16 + position(p[4] IN '0123456789abcdef') - 1 ELSE p::BIGINT END), lambda x, y: x * 256 + y) END AS n FROM h)
      SELECT page_id, a <> '' AND NOT contains(a, '@') AND CASE WHEN n IS NOT NULL THEN NOT ({' OR '.join(f'n BETWEEN {x} AND {y}' for x, y in ranges())})
        ELSE contains(h, '.') AND NOT regexp_matches(h, '{LOCAL_NAMES}') END AS is_public FROM n""",
    "complete_jobs": f"""WITH {JOBS} SELECT company, count(*) AS jobs, sum(external_id)::BIGINT AS ids FROM jobs
      WHERE {_TITLED} AND trim(coalesce(description, ''), ' ') <> '' AND (external_id % 4 <= 1 OR location NOT IN ('de', 'fr')) GROUP BY company""",
    "source_filters": """SELECT n_name AS source_key, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE 'java' END AS include,
      CASE WHEN n_nationkey % 5 = 0 THEN 'sales|intern' ELSE 'sales' END AS exclude FROM nation WHERE n_nationkey % 3 <> 0""",
    "eligible_subscribers": """SELECT 'c' || c_custkey AS chat_id, CASE WHEN c_custkey % 7 <> 0 THEN lower(c_mktsegment) ELSE '' END AS formats,
      round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, c_acctbal / 50)), 6) AS min_score FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0""",
    "jobs_with_features": f"""WITH {JOBS} SELECT source_key, external_id, external_id % 30 AS first_seen, sha256({_NORM('title')} || chr(10) || {_NORM('description')}) AS content_hash
      FROM jobs WHERE active AND NOT stale AND external_id % 2 = 0""",
    "export_order": f"WITH {JOBS} SELECT external_id, active, company, row_number() OVER (ORDER BY active DESC, company, external_id) AS place FROM jobs",
    "archive_order": f"""WITH {JOBS} SELECT external_id, company, CASE WHEN NOT active THEN external_id % 40 ELSE external_id % 50 END AS left_at FROM jobs WHERE NOT active OR stale""",
    "jobs_without_codes": f"""WITH {JOBS} SELECT company, count(*) AS jobs, sum(external_id)::BIGINT AS ids FROM jobs WHERE external_id NOT IN (SELECT page_id * 2 FROM pages) GROUP BY company""",
}
