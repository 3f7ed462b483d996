"""Lifecycle operators: a snapshot merged into keyed state, staleness, link re-checks, and batch reports.

The stored state is the labelled documents; the snapshot is the feed of all documents but those in Spanish, whose
source is not authoritative. Classification is one full outer join on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table

NOW = "2024-02-01 00:00:00"


def classify(state: DataFrame, snapshot: DataFrame, key: str = "id") -> DataFrame:
    """key and event of each row: new, reopened, restored, updated, unchanged, or missing from the snapshot.

    state: key, fingerprint, active, stale; snapshot: key, fingerprint.
    """
    s = state.select(key, F.col("fingerprint").alias("old"), "active", "stale", F.lit(True).alias("known"))
    n = snapshot.select(key, F.col("fingerprint").alias("seen"), F.lit(True).alias("present"))
    event = (
        F.when(F.col("known").isNull(), "new")
        .when(F.col("present").isNull(), F.when(F.col("active"), "missing").otherwise("absent"))
        .when(~F.col("active"), "reopened")
        .when(F.col("stale"), "restored")
        .when(F.col("old") != F.col("seen"), "updated")
        .otherwise("unchanged")
    )
    return s.join(n, key, "full_outer").select(key, event.alias("event"))


def lifecycle_events(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    state = docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), F.sha2("text", 256).alias("fingerprint"), (F.col("quality") == 1).alias("active"), (F.col("toxic") == 1).alias("stale")
    )
    snapshot = docs.filter("lang <> 'es'").select(F.col("doc_id").alias("id"), F.sha2(F.trim("text"), 256).alias("fingerprint"))
    return classify(state, snapshot)


def lifecycle_counts(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle_events(spark, d).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def stale_marks(spark: SparkSession, d: str) -> DataFrame:
    """Users' event types not seen for seven days before the report."""
    seen = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last_seen"))
    return seen.filter(F.col("last_seen") < F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 7 DAYS")).select(
        "user_id", "event_type", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen")
    )


def recheck_batch(spark: SparkSession, d: str) -> DataFrame:
    """The 250 users with most errors, then longest unseen, to look at again."""
    e = table(spark, d, "events")
    per = e.groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "error", 1)).alias("misses"), F.max("event_id").alias("last_event"))
    return per.orderBy(F.desc("misses"), F.asc_nulls_first("last_event"), "user_id").limit(250)


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def last_event(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))


def registrations_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Sign-ups of the 14 days up to the last one, days without any included."""
    e = table(spark, d, "events")
    last = e.agg(F.to_date(F.max("ts")).alias("last"))
    days = last.select(F.explode(F.sequence(F.date_sub("last", 13), F.col("last"))).alias("day"))
    per = e.filter("event_type = 'signup'").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.join(per, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def rate_limit(events: DataFrame, limit: int = 3, width: str = "1 hour") -> DataFrame:
    """Calls per user and fixed window, and how many of them a limit lets through."""
    per = events.groupBy("user_id", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("calls"))
    return per.select(
        "user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "calls", F.least("calls", F.lit(limit)).alias("allowed")
    )


def rate_limit_window(spark: SparkSession, d: str) -> DataFrame:
    return rate_limit(table(spark, d, "events"))


def application_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Orders per customer as applications: counts by status, response rate, for customers with ten and more."""
    o = table(spark, d, "orders")
    n = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1))
    per = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"), n("O").alias("sent"), n("F").alias("closed"), n("P").alias("open"))
    per = per.filter("total >= 10")
    return per.withColumn("response", F.floor(100 * (F.col("total") - F.col("sent")) / F.col("total") + 0.5).cast("long"))


def refresh_report(spark: SparkSession, d: str) -> DataFrame:
    """Days as runs: rows, errors, users, seconds from first to last event; days with errors first."""
    e = table(spark, d, "events")
    per = e.groupBy(F.to_date("ts").cast("string").alias("run")).agg(
        F.count(F.lit(1)).alias("received"),
        F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"),
        F.countDistinct("user_id").alias("users"),
        (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"),
    )
    return per.orderBy(F.when(F.col("errors") > 0, 0).otherwise(1), "run")


QUERIES = {
    "lifecycle_events": lifecycle_events, "lifecycle_counts": lifecycle_counts, "stale_marks": stale_marks,
    "link_recheck_batch": recheck_batch, "last_event": last_event, "registrations_by_day": registrations_by_day,
    "rate_limit_window": rate_limit_window, "application_funnel": application_funnel, "refresh_report": refresh_report,
}
_EVENTS = """ev AS (SELECT coalesce(s.doc_id, n.doc_id) AS id, CASE WHEN s.doc_id IS NULL THEN 'new'
  WHEN n.doc_id IS NULL THEN CASE WHEN s.quality = 1 THEN 'missing' ELSE 'absent' END WHEN s.quality <> 1 THEN 'reopened'
  WHEN s.toxic = 1 THEN 'restored' WHEN s.text <> trim(n.text, ' ') THEN 'updated' ELSE 'unchanged' END AS event
  FROM (SELECT d.doc_id, d.text, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id) s
  FULL OUTER JOIN (SELECT * FROM documents WHERE lang <> 'es') n ON s.doc_id = n.doc_id)"""
ORACLE = {
    "lifecycle_events": f"WITH {_EVENTS} SELECT id, event FROM ev",
    "lifecycle_counts": f"WITH {_EVENTS} SELECT event, count(*) AS n FROM ev GROUP BY event",
    "stale_marks": f"SELECT user_id, event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY user_id, event_type HAVING max(ts) < TIMESTAMP '{NOW}' - INTERVAL 7 DAY",
    "link_recheck_batch": """SELECT user_id, count(*) FILTER (event_type = 'error') AS misses, max(event_id) AS last_event FROM events
      GROUP BY user_id ORDER BY misses DESC, last_event ASC NULLS FIRST, user_id LIMIT 250""",
    "last_event": "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id",
    "registrations_by_day": """WITH l AS (SELECT max(ts)::DATE AS last FROM events), d AS (SELECT unnest(generate_series(last - INTERVAL 13 DAY, last::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM l),
      p AS (SELECT ts::DATE AS day, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT d.day::VARCHAR AS day, coalesce(n, 0) AS n FROM d LEFT JOIN p ON d.day = p.day""",
    "rate_limit_window": """SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS calls, least(count(*), 3) AS allowed
      FROM events GROUP BY user_id, date_trunc('hour', ts)""",
    "application_funnel": """SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS sent, count(*) FILTER (o_orderstatus = 'F') AS closed,
      count(*) FILTER (o_orderstatus = 'P') AS open, floor(100.0 * (count(*) - count(*) FILTER (o_orderstatus = 'O')) / count(*) + 0.5)::BIGINT AS response
      FROM orders GROUP BY o_custkey HAVING count(*) >= 10""",
    "refresh_report": """SELECT ts::DATE::VARCHAR AS run, count(*) AS received, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) AS users,
      (epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))))::BIGINT AS seconds FROM events GROUP BY 1""",
}
