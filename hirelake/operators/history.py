"""Histories over the tables: lifecycles replayed from all snapshots, chains of pages, and look-ups of a cache that expires.

The event log stands for a crawl: an event type is a source, a day a run, a user a vacancy that the run saw, and the number of
that day's events its content. Runs of ``view`` on every third day have no authority.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import chains as C
from ..plans import replay as R
from ..sources.tables import table
from ..streaming import keyed

HOURS = 6
STAMP, SQL_STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f"


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sightings and runs."""
    e = table(spark, d, "events").select(F.col("event_type").alias("source_key"), F.col("user_id").alias("external_id"), F.to_date("ts").cast("timestamp").alias("run_at"))
    seen = e.groupBy("source_key", "external_id", "run_at").agg(F.count(F.lit(1)).cast("string").alias("fingerprint"))
    told = (F.col("source_key") == "view") & (F.day("run_at") % 3 == 0)
    return seen, e.select("source_key", "run_at", (~told).alias("authoritative")).distinct()


def history_replay(spark: SparkSession, d: str) -> DataFrame:
    got = R.replay(*snapshots(spark, d))
    return got.withColumn("happened_at", F.date_format("happened_at", "yyyy-MM-dd"))


def history_state(spark: SparkSession, d: str) -> DataFrame:
    got = R.final_state(*snapshots(spark, d))
    return got.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_seen", "last_seen")})


def paged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events as pages of their user: the next event is the next page, unless the page ends the list (a costly error), names
    one that isn't there (some purchases) or leads back (some clicks)."""
    c = F.col
    own = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").withColumns({"after": F.lead("event_id").over(own), "before": F.lag("event_id", 3).over(own), "first": F.row_number().over(own) == 1})
    ends, lost, back = (c("event_type") == "error") & (c("value") > 250), (c("event_type") == "purchase") & (c("event_id") % 17 == 0), (c("event_type") == "click") & (c("event_id") % 13 == 0)
    following = F.when(ends, None).when(lost, -c("event_id")).when(back & c("before").isNotNull(), c("before")).otherwise(c("after"))
    pages = e.select(c("user_id").alias("source_key"), c("event_id").alias("page"), following.alias("next"), "first")
    return pages.drop("first"), pages.filter("first").select("source_key", "page")


def page_chains(spark: SparkSession, d: str) -> DataFrame:
    return C.chains(*paged(spark, d))


def page_places(spark: SparkSession, d: str) -> DataFrame:
    return C.places(*paged(spark, d))


def cache_lookups(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return keyed.fresh(e, HOURS * 3600).select("key", "event_id", "hit", F.date_format("filled_at", STAMP).alias("filled_at"))


QUERIES = {
    "history_replay": history_replay, "history_state": history_state, "page_chains": page_chains, "page_places": page_places,
    "cache_lookups": cache_lookups,
}

# The SQL folds run by run and page by page, as the definitions have it.
_FOLD = """WITH RECURSIVE e AS (SELECT event_type AS s, user_id AS i, ts::DATE AS day FROM events),
  seen AS (SELECT s, i, day, count(*)::VARCHAR AS fp FROM e GROUP BY ALL),
  runs AS (SELECT s, day, NOT (s = 'view' AND day(day) % 3 = 0) AS counts, row_number() OVER (PARTITION BY s ORDER BY day) AS n FROM (SELECT DISTINCT s, day FROM e)),
  st AS (SELECT DISTINCT s, i, 0::BIGINT AS n, NULL::DATE AS first, NULL::DATE AS last, false AS active, 0 AS missing, NULL::VARCHAR AS fp, NULL::VARCHAR AS event, NULL::DATE AS day FROM e
    UNION ALL SELECT st.s, st.i, r.n, coalesce(st.first, x.day), coalesce(x.day, st.last),
      x.day IS NOT NULL OR (st.active AND NOT (r.counts AND st.missing + 1 >= 2)),
      CASE WHEN x.day IS NOT NULL THEN 0 WHEN st.active AND r.counts THEN st.missing + 1 ELSE st.missing END, coalesce(x.fp, st.fp),
      CASE WHEN x.day IS NOT NULL AND st.first IS NULL THEN 'new' WHEN x.day IS NOT NULL AND NOT st.active THEN 'reopened' WHEN x.day IS NOT NULL AND x.fp <> st.fp THEN 'updated'
        WHEN x.day IS NULL AND st.active AND r.counts AND st.missing + 1 >= 2 THEN 'closed' END, r.day
      FROM st JOIN runs r ON r.s = st.s AND r.n = st.n + 1 LEFT JOIN seen x ON x.s = st.s AND x.i = st.i AND x.day = r.day)"""
_WALK = """WITH RECURSIVE w AS (SELECT user_id AS s, event_id AS p, event_type AS k, value AS v, lead(event_id) OVER o AS after, lag(event_id, 3) OVER o AS before, row_number() OVER o AS r
    FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
  pages AS (SELECT s, p, r, CASE WHEN k = 'error' AND v > 250 THEN NULL WHEN k = 'purchase' AND p % 17 = 0 THEN -p WHEN k = 'click' AND p % 13 = 0 AND before IS NOT NULL THEN before ELSE after END AS next FROM w),
  walk AS (SELECT s, p, next, 0::BIGINT AS place, [p] AS path FROM pages WHERE r = 1
    UNION ALL SELECT walk.s, x.p, x.next, place + 1, list_append(path, x.p) FROM walk JOIN pages x ON x.s = walk.s AND x.p = walk.next WHERE NOT list_contains(path, x.p))"""
ORACLE = {
    "history_replay": f"{_FOLD} SELECT s AS source_key, i AS external_id, event, strftime(day, '%Y-%m-%d') AS happened_at FROM st WHERE event IS NOT NULL",
    "history_state": f"""{_FOLD} SELECT s AS source_key, i AS external_id, fp AS fingerprint, strftime(first, '%Y-%m-%d') AS first_seen, strftime(last, '%Y-%m-%d') AS last_seen, active, missing AS missing_runs
      FROM st QUALIFY n = max(n) OVER (PARTITION BY s)""",
    "page_places": f"{_WALK} SELECT s AS source_key, p AS page, place FROM walk",
    "page_chains": f"""{_WALK} SELECT s AS source_key, count(*) AS n_pages, arg_max(p, place) AS last_page, arg_max(struct_pack(n := next), place).n AS points_to,
      CASE WHEN arg_max(struct_pack(n := next), place).n IS NULL THEN 'complete' WHEN list_contains(list(p), arg_max(struct_pack(n := next), place).n) THEN 'cycle' ELSE 'gap' END AS status FROM walk GROUP BY s""",
    "cache_lookups": f"""WITH RECURSIVE e AS (SELECT user_id AS key, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
      f AS (SELECT key, r, ts FROM e WHERE r = 1 UNION ALL
        SELECT f.key, min(e.r), min(e.ts) FROM f JOIN e ON e.key = f.key AND e.ts >= f.ts + INTERVAL {HOURS} HOUR GROUP BY f.key)
      SELECT e.key, event_id, e.r <> f.r AS hit, strftime(f.ts, '{SQL_STAMP}') AS filled_at FROM e ASOF JOIN f ON e.key = f.key AND e.r >= f.r""",
}
