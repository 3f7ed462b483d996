"""Source shapes: landed JSON or HTML payloads to vacancy rows.

Fetching is outside: a crawl lands one payload a row (source_key, page, body). An adapter is a function of that table, found
by its type in ADAPTERS; unknown types raise. Each shape below stands for the sites that serve it; a new site is a schema
and a mapping of columns. Broken payloads give no rows; the guards report what is missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.resume import fragment_text
from .tables import epoch_millis_iso

ROW = ("external_id", "title", "location", "team", "workplace_type", "description", "url", "posted_at", "source_updated_at")


def rows_of(landed: DataFrame, schema: str, path: str = "") -> DataFrame:
    """source_key, page and r of every element of the array at ``path`` ("" where the payload itself is the array)."""
    parsed = F.from_json("body", schema)
    return landed.select("source_key", "page", F.explode(parsed[path] if path else parsed).alias("r"))


def as_jobs(rows: DataFrame, **columns: Column) -> DataFrame:
    """Vacancy rows; columns that a source doesn't give are empty texts."""
    return rows.select("source_key", *[F.coalesce(columns.get(c, F.lit("")).cast("string"), F.lit("")).alias(c) for c in ROW])


def last_by_id(jobs: DataFrame, order: str) -> DataFrame:
    """Of rows with the same id the one of the last page."""
    w = Window.partitionBy("source_key", "external_id").orderBy(F.desc(order))
    return jobs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", order)


def names(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: x["name"]), ", ")


def greenhouse(landed: DataFrame) -> DataFrame:
    schema = "struct<jobs:array<struct<id:string,title:string,location:struct<name:string>,content:string,absolute_url:string,updated_at:string,departments:array<struct<name:string>>>>>"
    rows, r = rows_of(landed, schema, "jobs"), F.col("r")
    # The content is HTML that has been escaped once more inside the JSON.
    text = fragment_text(F.replace(F.replace(r["content"], F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")))
    return as_jobs(rows, external_id=r["id"], title=r["title"], location=r["location"]["name"], team=names(r["departments"]), description=text, url=r["absolute_url"], source_updated_at=r["updated_at"])


def lever(landed: DataFrame) -> DataFrame:
    schema = "array<struct<id:string,text:string,categories:struct<location:string,team:string,commitment:string>,descriptionPlain:string,additionalPlain:string,lists:array<struct<text:string,content:string>>,hostedUrl:string,createdAt:long>>"
    rows, r = rows_of(landed, schema), F.col("r")
    parts = F.transform(F.coalesce(r["lists"], F.array().cast("array<struct<text:string,content:string>>")), lambda x: F.concat_ws(" ", x["text"], fragment_text(x["content"])))
    text = F.trim(F.concat_ws("\n", r["descriptionPlain"], F.array_join(parts, "\n"), r["additionalPlain"]))
    return as_jobs(rows, external_id=r["id"], title=r["text"], location=r["categories"]["location"], team=r["categories"]["team"], workplace_type=r["categories"]["commitment"], description=text, url=r["hostedUrl"], posted_at=epoch_millis_iso(r["createdAt"]))


def board(landed: DataFrame) -> DataFrame:
    """A searched board with ids that repeat over role groups: the last page's row stays."""
    schema = "struct<items:array<struct<id:string,name:string,area:struct<name:string>,professional_roles:array<struct<name:string>>,work_format:array<struct<name:string>>,snippet:struct<responsibility:string,requirement:string>,alternate_url:string,published_at:string>>>"
    r = F.col("r")
    rows = last_by_id(rows_of(landed, schema, "items").withColumn("external_id", r["id"]), "page")
    text = F.concat_ws("\n", *[F.nullif(fragment_text(r["snippet"][k]), F.lit("")) for k in ("responsibility", "requirement")])
    return as_jobs(rows, external_id=r["id"], title=r["name"], location=r["area"]["name"], team=names(r["professional_roles"]), workplace_type=names(r["work_format"]), description=text, url=r["alternate_url"], posted_at=r["published_at"])


def html_links(landed: DataFrame) -> DataFrame:
    """Anchors whose address ends in a number; the title is the anchor's text, 3 characters at least."""
    anchors = F.regexp_extract_all("body", F.lit('(?is)(<a[^>]+href="[^"]*/[0-9]+/?"[^>]*>.*?</a>)'), 1)
    rows = landed.select("source_key", F.explode(anchors).alias("a"))
    url = F.regexp_extract("a", 'href="([^"]*)"', 1)
    title = F.trim(F.regexp_replace(F.regexp_replace("a", "(?s)<[^>]*>", " "), r"\s+", " "))
    found = as_jobs(rows, external_id=F.regexp_extract(url, "/([0-9]+)/?$", 1), title=title, url=url)
    return found.filter(F.length("title") >= 3).dropDuplicates(["source_key", "external_id"])


def embedded_state(landed: DataFrame) -> DataFrame:
    """Vacancies inside a page's JSON state: the script tag is cut out and parsed as a list."""
    state = F.regexp_extract("body", r'(?is)<script[^>]+id="__[A-Z_]+__"[^>]*>(.*?)</script>', 1)
    rows = rows_of(landed.withColumn("body", state), "struct<vacancies:array<struct<id:string,title:string,city:string,text:string>>>", "vacancies")
    r = F.col("r")
    return as_jobs(rows, external_id=r["id"], title=r["title"], location=r["city"], description=fragment_text(r["text"]))


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "greenhouse": greenhouse, "lever": lever, "board": board, "html_links": html_links, "embedded_state": embedded_state,
}


def adapter(kind: str) -> Callable[[DataFrame], DataFrame]:
    if kind not in ADAPTERS:
        raise ValueError(f"unknown source type: {kind}")
    return ADAPTERS[kind]


def with_details(listed: DataFrame, details: DataFrame) -> DataFrame:
    """Listing rows with the columns of their detail page where it was fetched and isn't empty; the rest stays as listed."""
    key = ["source_key", "external_id"]
    extra = [c for c in details.columns if c not in key]
    one = details.dropDuplicates(key).select(*key, *[F.col(c).alias(f"_d_{c}") for c in extra])
    filled = {c: F.coalesce(F.nullif(F.col(f"_d_{c}"), F.lit("")), F.col(c)) if c in listed.columns else F.col(f"_d_{c}") for c in extra}
    return listed.join(one, key, "left").withColumns(filled).drop(*[f"_d_{c}" for c in extra])


def looked_up(listed: DataFrame, options: DataFrame, code: str, label: str, into: str) -> DataFrame:
    """Codes turned into labels by an option list; unknown codes give empty texts. Spark decides whether to broadcast."""
    one = options.select(F.col(code).alias("_code"), F.col(label).alias("_label")).dropDuplicates(["_code"])
    return listed.join(one, listed[code] == F.col("_code"), "left").withColumn(into, F.coalesce("_label", F.lit(""))).drop("_code", "_label")


def shortfall(jobs: DataFrame, expected: DataFrame) -> DataFrame:
    """Sources with fewer or other rows than they declare: source_key, found, declared, least.

    expected: source_key, declared (the total a source states, or null) and least (a configured minimum, or null). Sources
    listed here must not reach a lifecycle merge, or their vacancies would close.
    """
    found = jobs.groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))
    both = expected.join(found, "source_key", "left").select("source_key", F.coalesce("n", F.lit(0)).alias("found"), "declared", "least")
    return both.filter((F.col("found") != F.coalesce("declared", F.col("found"))) | (F.col("found") < F.coalesce("least", F.lit(0))))
