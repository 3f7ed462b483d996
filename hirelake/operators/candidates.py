"""Resume, notification and matching operators over conversations, pages, events and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import token_set
from ..sources.tables import table

NOW = "2024-02-01 00:00:00"
MIN_OVERLAP = 0.05


def phones(spark: SparkSession, d: str) -> DataFrame:
    """First phone number of each document that has one, as digits."""
    found = F.regexp_extract("text", r"([+][0-9][0-9 ()-]{8,16}[0-9])", 1)
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(found, "[^0-9+]", "").alias("phone")).filter("phone <> ''")


def html_text(spark: SparkSession, d: str) -> DataFrame:
    """Pages as text: script, style and comments go, other tags become blanks, white space is collapsed."""
    t = F.regexp_replace("html", "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(F.regexp_replace(t, "(?s)<!--.*?-->", " "), "(?s)<[^>]*>", " ")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(plain))
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(t, "[ \\t\\n\\r]+", " ")).alias("text"))


def event_ages(spark: SparkSession, d: str) -> DataFrame:
    """Events by age band and by the days that passed until the report."""
    hours = F.floor((F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 3600)
    days = F.floor(hours / 24).cast("long")
    band = F.when(hours < 1, "now").when(hours < 24, "hours").otherwise("days")
    return table(spark, d, "events").groupBy(band.alias("band"), days.alias("days")).agg(F.count(F.lit(1)).alias("n"))


def page_matches(spark: SparkSession, d: str) -> DataFrame:
    """Best benchmark item for each page by Jaccard of token sets, found through shared tokens, ties to the smaller id."""
    title = F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)
    p = table(spark, d, "pages").select("page_id", token_set(title).alias("pt"))
    b = table(spark, d, "benchmark").select("item_id", token_set(F.col("text")).alias("bt"))
    left = p.select("page_id", F.size("pt").alias("pn"), F.explode("pt").alias("token"))
    right = b.select("item_id", F.size("bt").alias("bn"), F.explode("bt").alias("token"))
    both = left.join(right, "token").groupBy("page_id", "item_id", "pn", "bn").agg(F.count(F.lit(1)).alias("common"))
    both = both.withColumn("score", F.round(F.col("common") / (F.col("pn") + F.col("bn") - F.col("common")), 6))
    best = both.filter(F.col("score") >= MIN_OVERLAP).groupBy("page_id").agg(F.max(F.struct("score", (-F.col("item_id")).alias("m"))).alias("x"))
    return best.select("page_id", (-F.col("x.m")).alias("item_id"), F.col("x.score").alias("score"))


def skill_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Words a conversation's user and assistant share, and those only the user has."""
    c = table(spark, d, "conversations")
    t = c.select("conv_id", "role", F.explode(token_set(F.col("text"))).alias("word")).filter("role in ('user', 'assistant')")
    per = t.groupBy("conv_id", "word").agg(F.max(F.col("role") == "user").alias("u"), F.max(F.col("role") == "assistant").alias("a"))
    return per.groupBy("conv_id").agg(
        F.count(F.when(F.col("u") & F.col("a"), 1)).alias("matched"), F.count(F.when(F.col("u") & ~F.col("a"), 1)).alias("missing")
    )


def digest_slice(spark: SparkSession, d: str) -> DataFrame:
    """Purchases 11 to 30 by value: a page of a digest."""
    e = table(spark, d, "events").filter("event_type = 'purchase'")
    return e.orderBy(F.desc("value"), "event_id").offset(10).limit(20).select("event_id", "user_id", "value")


def events_after_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Events after each user's last sign-up (all where there is none), with the number before the cursor."""
    e = table(spark, d, "events")
    cursor = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.max("event_id").alias("cursor"))
    j = e.join(cursor, "user_id", "left")
    new = F.col("cursor").isNull() | (F.col("event_id") > F.col("cursor"))
    return j.groupBy("user_id").agg(F.count(F.when(new, 1)).alias("pending"), F.count(F.when(~new, 1)).alias("done"))


def settings_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Latest setting ``k`` of every user and event type, the later event over the earlier."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("user_id", "event_type").agg(F.max_by("k", "event_id").alias("k"))


def benchmark_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Customers' whole cents above the average balance of their nation, or of all where it has fewer than five."""
    cents = F.round(F.col("c_acctbal").cast("double") * 100).cast("long")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", cents.alias("bal"))
    per = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("bal").alias("s")).filter("n >= 5")
    whole = c.agg(F.count(F.lit(1)).alias("n"), F.sum("bal").alias("s")).first()
    j = c.join(per, "c_nationkey", "left")
    n, s = F.coalesce("n", F.lit(whole.n)), F.coalesce("s", F.lit(whole.s or 0))
    return j.select("c_custkey", F.floor((F.col("bal") * n - s) / n).cast("long").alias("above"))


def daily_change(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and type and the change on the day before in per cent, half up; the first day has 0."""
    per = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    before = F.lag("n").over(Window.partitionBy("event_type").orderBy("day"))
    change = F.floor((F.col("n") - before) / before * 100 + 0.5).cast("long")
    return per.select("event_type", F.col("day").cast("string").alias("day"), "n", F.coalesce(change, F.lit(0)).alias("change"))


def event_pivot(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["signup", "error", "click", "view", "purchase"]
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", kinds).count().na.fill(0)


def first_event(spark: SparkSession, d: str) -> DataFrame:
    """First event of every user and the event types in the order they were first seen."""
    per = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"))
    return per.groupBy("user_id").agg(
        F.min("at").alias("event_id"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "event_type"))), lambda x: x["event_type"]), ",").alias("kinds")
    )


QUERIES = {
    "phones": phones, "html_text": html_text, "event_ages": event_ages, "page_matches": page_matches, "skill_overlap": skill_overlap,
    "digest_slice": digest_slice, "events_after_cursor": events_after_cursor, "settings_overlay": settings_overlay,
    "benchmark_lookup": benchmark_lookup, "daily_change": daily_change, "event_pivot": event_pivot, "first_event": first_event,
}
_SET = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '([a-zа-яё0-9+#.]{{3,}})', 1))"
_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
ORACLE = {
    "phones": r"""WITH p AS (SELECT doc_id, regexp_replace(regexp_extract(text, '([+][0-9][0-9 ()-]{8,16}[0-9])', 1), '[^0-9+]', '', 'g') AS phone FROM documents)
      SELECT * FROM p WHERE phone <> ''""",
    "html_text": """WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages)
      SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM a""",
    "event_ages": f"""WITH h AS (SELECT floor((epoch(TIMESTAMP '{NOW}') - floor(epoch(ts))) / 3600) AS h FROM events)
      SELECT CASE WHEN h < 1 THEN 'now' WHEN h < 24 THEN 'hours' ELSE 'days' END AS band, floor(h / 24)::BIGINT AS days, count(*) AS n FROM h GROUP BY 1, 2""",
    "page_matches": f"""WITH p AS (SELECT page_id, {_SET.format(_TITLE)} AS pt FROM pages), b AS (SELECT item_id, {_SET.format('text')} AS bt FROM benchmark),
      j AS (SELECT page_id, item_id, len(list_intersect(pt, bt)) AS c, len(pt) AS pn, len(bt) AS bn FROM p, b),
      s AS (SELECT page_id, item_id, round(c / (pn + bn - c), 6) AS score FROM j WHERE c > 0)
      SELECT page_id, item_id, score FROM s WHERE score >= {MIN_OVERLAP} QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, item_id) = 1""",
    "skill_overlap": f"""WITH t AS (SELECT conv_id, role, unnest({_SET.format('text')}) AS word FROM conversations WHERE role IN ('user', 'assistant')),
      p AS (SELECT conv_id, word, bool_or(role = 'user') AS u, bool_or(role = 'assistant') AS a FROM t GROUP BY conv_id, word)
      SELECT conv_id, count(*) FILTER (u AND a) AS matched, count(*) FILTER (u AND NOT a) AS missing FROM p GROUP BY conv_id""",
    "digest_slice": "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' ORDER BY value DESC, event_id LIMIT 20 OFFSET 10",
    "events_after_cursor": """WITH c AS (SELECT user_id, max(event_id) AS cursor FROM events WHERE event_type = 'signup' GROUP BY user_id)
      SELECT e.user_id, count(*) FILTER (cursor IS NULL OR event_id > cursor) AS pending, count(*) FILTER (event_id <= cursor) AS done
      FROM events e LEFT JOIN c ON c.user_id = e.user_id GROUP BY e.user_id""",
    "settings_overlay": "SELECT user_id, event_type, arg_max((props::JSON ->> '$.k')::BIGINT, event_id) AS k FROM events GROUP BY user_id, event_type",
    "benchmark_lookup": """WITH c AS (SELECT c_custkey, c_nationkey, round(c_acctbal::DOUBLE * 100)::BIGINT AS bal FROM customer),
      p AS (SELECT c_nationkey, count(*) AS n, sum(bal)::BIGINT AS s FROM c GROUP BY 1 HAVING count(*) >= 5), w AS (SELECT count(*) AS n, sum(bal)::BIGINT AS s FROM c)
      SELECT c_custkey, floor((bal * coalesce(p.n, w.n) - coalesce(p.s, w.s)) / coalesce(p.n, w.n))::BIGINT AS above FROM c LEFT JOIN p ON p.c_nationkey = c.c_nationkey CROSS JOIN w""",
    "daily_change": """WITH p AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)
      SELECT event_type, day::VARCHAR AS day, n, coalesce(floor((n - lag(n) OVER w) / lag(n) OVER w * 100 + 0.5)::BIGINT, 0) AS change FROM p WINDOW w AS (PARTITION BY event_type ORDER BY day)""",
    "event_pivot": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ("signup", "error", "click", "view", "purchase")) + " FROM events GROUP BY user_id",
    "first_event": """WITH p AS (SELECT user_id, event_type, min(event_id) AS seen FROM events GROUP BY 1, 2)
      SELECT user_id, min(seen) AS event_id, string_agg(event_type, ',' ORDER BY seen) AS kinds FROM p GROUP BY user_id""",
}
