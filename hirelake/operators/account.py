"""Account operators: application rates, saved vacancies, description blocks, result pages and a company registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table

PAGE, BUTTONS = 15, 5
NOW = "1998-08-02"


def per_cent(part: Column, whole: Column) -> Column:
    """Whole per cent, half up; 0 of nothing."""
    return F.when(whole > 0, F.floor(100 * part / whole + 0.5)).otherwise(0).cast("long")


def application_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per customer with ten orders and more: answers, interviews and offers in per cent, and unanswered ones over a week old.

    Status O is sent, F an interview or, of urgent priority, an offer, P rejected.
    """
    status = F.when(F.col("o_orderstatus") == "O", "sent").when(F.col("o_orderstatus") == "P", "rejected").when(F.col("o_orderpriority").startswith("1"), "offer").otherwise("interview")
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", status.alias("status"))
    n = lambda c: F.count(F.when(c, 1))
    s, all_ = F.col("status"), F.count(F.lit(1))
    old = F.col("o_orderdate") <= F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 7 DAYS")
    return o.groupBy("o_custkey").agg(
        all_.alias("total"), per_cent(n(s != "sent"), all_).alias("answered"), per_cent(n(s.isin("interview", "offer")), all_).alias("interviews"),
        per_cent(n(s == "offer"), all_).alias("offers"), n(~s.isin("offer", "rejected") & old).alias("waiting"),
    ).filter(F.col("total") >= 10)


def saved_sets(events: DataFrame, user: str, item: str, order: str, add: Column) -> DataFrame:
    """user, saved: the items whose last event added them, greatest first. A user who removed all has an empty list."""
    last = events.groupBy(user, item).agg(F.max_by(add, order).alias("kept"))
    kept = F.collect_list(F.when(F.col("kept"), F.col(item)))
    return last.groupBy(user).agg(F.sort_array(kept, asc=False).alias("saved"))


def saved_vacancies(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type in ('click', 'error')").withColumn("item", F.get_json_object("props", "$.k").cast("long"))
    return saved_sets(e, "user_id", "item", "event_id", F.col("event_type") == "click").select("user_id", F.array_join(F.col("saved").cast("array<string>"), ",").alias("saved"))


def block_kinds(text: Column) -> Column:
    """Kind of each line that isn't blank: a list item begins with a bullet or dash, a heading of up to 96 ends in a colon."""
    rows = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(rows, lambda x: F.when(x.rlike("^[•*-] "), "list").when(x.endswith(":") & (F.length(x) <= 96), "heading").otherwise("paragraph"))


def description_blocks(spark: SparkSession, d: str) -> DataFrame:
    kinds = block_kinds(F.col("text"))
    n = lambda k: F.size(F.filter(kinds, lambda x: x == k)).cast("long").alias(k)
    return table(spark, d, "documents").select("doc_id", n("heading"), n("list"), n("paragraph"))


def page_of(rows: DataFrame, page: int, order: list[Column], size: int = PAGE) -> DataFrame:
    """One page of a listing, the last where ``page`` is beyond it, with the page's number, the pages and the first button."""
    pages = rows.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).alias("pages")).first().pages
    at = min(max(1, page), pages)
    first = max(1, min(at - BUTTONS // 2, pages - BUTTONS + 1))
    cut = rows.orderBy(*order).offset((at - 1) * size).limit(size)
    return cut.withColumns({"page": F.lit(at).cast("long"), "pages": F.lit(pages).cast("long"), "first_button": F.lit(first).cast("long")})


def last_page(spark: SparkSession, d: str) -> DataFrame:
    """A page far beyond the end of the suppliers by balance."""
    s = table(spark, d, "supplier").select("s_suppkey")
    return page_of(s, 1_000_000, [F.desc("s_suppkey")])


def company_registry(spark: SparkSession, d: str) -> DataFrame:
    """Registered companies with their vacancies, also those without any, then companies that only the vacancies name.

    Nations stand for the registry, market segments and nation names of customers for companies of vacancies.
    """
    registry = table(spark, d, "nation").select(F.col("n_name").alias("company"), "n_nationkey", F.lit(True).alias("registered"))
    c = table(spark, d, "customer").withColumn("n_nationkey", F.col("c_nationkey")).join(registry, "n_nationkey", "left")
    named = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.col("company"))
    jobs = c.groupBy(named.alias("company")).agg(F.count(F.lit(1)).alias("jobs"), F.max("c_custkey").alias("latest"))
    both = registry.select("company", "registered").join(jobs, "company", "full_outer")
    return both.select("company", F.coalesce("registered", F.lit(False)).alias("registered"), F.coalesce("jobs", F.lit(0)).alias("jobs"), "latest")


def first_technologies(spark: SparkSession, d: str) -> DataFrame:
    """Of each customer the first three part types ordered, in the order of their first order."""
    o, l = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    seen = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", F.concat("l_returnflag", "l_linestatus").alias("kind")).agg(F.min("o_orderkey").alias("at"))
    w = Window.partitionBy("o_custkey").orderBy("at", "kind")
    top = seen.withColumn("n", F.row_number().over(w)).filter("n <= 3")
    return top.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "kind"))), lambda x: x["kind"]), ",").alias("kinds"))


QUERIES = {
    "application_rates": application_rates, "saved_vacancies": saved_vacancies, "description_blocks": description_blocks,
    "last_page": last_page, "company_registry": company_registry, "first_technologies": first_technologies,
}
_RATE = "floor(100.0 * count(*) FILTER ({}) / count(*) + 0.5)::BIGINT"
_KINDS = """list_transform(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''),
  lambda x: CASE WHEN regexp_matches(x, '^[•*-] ') THEN 'list' WHEN ends_with(x, ':') AND length(x) <= 96 THEN 'heading' ELSE 'paragraph' END)"""
ORACLE = {
    "application_rates": f"""WITH o AS (SELECT o_custkey, o_orderdate, CASE WHEN o_orderstatus = 'O' THEN 'sent' WHEN o_orderstatus = 'P' THEN 'rejected' WHEN starts_with(o_orderpriority, '1') THEN 'offer' ELSE 'interview' END AS s FROM orders)
      SELECT o_custkey, count(*) AS total, {_RATE.format("s <> 'sent'")} AS answered, {_RATE.format("s IN ('interview', 'offer')")} AS interviews, {_RATE.format("s = 'offer'")} AS offers,
      count(*) FILTER (s NOT IN ('offer', 'rejected') AND o_orderdate <= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS waiting FROM o GROUP BY o_custkey HAVING count(*) >= 10""",
    "saved_vacancies": """WITH e AS (SELECT user_id, event_id, event_type, (props::JSON ->> '$.k')::BIGINT AS item FROM events WHERE event_type IN ('click', 'error')),
      l AS (SELECT user_id, item, arg_max(event_type, event_id) AS kind FROM e GROUP BY 1, 2)
      SELECT user_id, coalesce(string_agg(item::VARCHAR, ',' ORDER BY item DESC) FILTER (kind = 'click'), '') AS saved FROM l GROUP BY user_id""",
    "description_blocks": "SELECT doc_id, " + ", ".join(f"len(list_filter({_KINDS}, lambda k: k = '{k}')) AS {k}" for k in ("heading", "list", "paragraph")) + " FROM documents",
    "last_page": f"""WITH n AS (SELECT greatest(1, ceil(count(*) / {PAGE}.0))::BIGINT AS pages FROM supplier), r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey DESC) AS k FROM supplier)
      SELECT s_suppkey, pages AS page, pages, greatest(1, pages - {BUTTONS - 1}) AS first_button FROM r, n WHERE k > (pages - 1) * {PAGE}""",
    "company_registry": """WITH j AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE n_name END AS company, count(*) AS jobs, max(c_custkey) AS latest FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
      SELECT coalesce(n_name, company) AS company, n_name IS NOT NULL AS registered, coalesce(jobs, 0) AS jobs, latest FROM nation FULL OUTER JOIN j ON n_name = company""",
    "first_technologies": """WITH s AS (SELECT o_custkey, l_returnflag || l_linestatus AS kind, min(o_orderkey) AS seen FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY seen, kind) AS n FROM s) SELECT o_custkey, string_agg(kind, ',' ORDER BY n) AS kinds FROM r WHERE n <= 3 GROUP BY o_custkey""",
}
