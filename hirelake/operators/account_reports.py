"""Account and run reports: sessions, active resumes, totals, refresh windows. Events, customers and orders stand for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table

NOW = "2024-01-02 00:00:00"
WINDOW_MINUTES = 15


def latest_runs(runs: DataFrame, at: str = "finished_at", minutes: int = WINDOW_MINUTES) -> DataFrame:
    """Runs that finished within some minutes of the last one."""
    last = runs.agg(F.max(at).alias("_last"))
    return runs.crossJoin(F.broadcast(last)).filter(F.col(at) >= F.col("_last") - F.make_dt_interval(mins=F.lit(minutes))).drop("_last")


def run_report(runs: DataFrame, counters: tuple[str, ...]) -> DataFrame:
    """One row: sums of the counters, first start, last end, duration in seconds (not below 0, tenths), runs that went well
    and failed."""
    micros = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    seconds = micros(F.max("finished_at")) - micros(F.min("started_at"))
    return latest_runs(runs).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters], F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"),
        F.round(F.greatest(F.lit(0.0), seconds), 1).alias("seconds"), F.count(F.when(F.col("status") == "ok", 1)).alias("ok"), F.count(F.when(F.col("status") != "ok", 1)).alias("failed"),
    )


def named_runs(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Runs with a company: their own, else the greatest of the source's jobs, else the source's key."""
    names = jobs.groupBy("source_key").agg(F.max("company").alias("_company"))
    own = F.nullif(F.col("company"), F.lit(""))
    return runs.join(names, "source_key", "left").withColumn("company", F.coalesce(own, "_company", "source_key")).drop("_company")


def sessions(events: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Sessions that have not run out, with their user; those of unknown users go."""
    return events.filter(F.col("expires_at") > now).join(users, "user_id")


def current_resume(profiles: DataFrame, resumes: DataFrame) -> DataFrame:
    """Each profile with its active resume, else its first; null without any. The least id decides between several."""
    w = Window.partitionBy("user_id").orderBy(F.col("active").desc(), "resume_id")
    first = resumes.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("user_id", "resume_id", "active")
    return profiles.join(first, "user_id", "left")


def skills_by_category(skills: DataFrame) -> DataFrame:
    """Per user and category the skills in order and how many are confirmed; of none confirmed all count."""
    per = skills.groupBy("user_id", "category").agg(F.array_join(F.sort_array(F.collect_set("skill")), ",").alias("skills"), F.count(F.when(F.col("confirmed"), 1)).alias("sure"), F.count(F.lit(1)).alias("all"))
    return per.select("user_id", "category", "skills", F.when(F.col("sure") > 0, F.col("sure")).otherwise(F.col("all")).alias("counted"))


# ---- queries


def _runs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    finished = F.col("ts") + F.make_dt_interval(secs=(F.col("value") % 60).cast("decimal(18,6)"))
    return e.select(
        F.col("event_id").alias("run_id"), F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string")).alias("source_key"),
        F.when(F.col("user_id") % 3 == 0, F.lit("")).when(F.col("user_id") % 3 == 1, F.concat(F.lit("co"), F.col("user_id").cast("string"))).alias("company"),
        F.col("ts").alias("started_at"), finished.alias("finished_at"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"),
        (F.col("event_id") % 7).alias("added"), (F.col("event_id") % 5).alias("closed"),
    )


def q_run_report(spark: SparkSession, d: str) -> DataFrame:
    return run_report(_runs(spark, d).withColumn("finished_at", F.col("started_at")), ("added", "closed")).drop("started_at", "finished_at")


def q_named_runs(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.concat(F.lit("s"), (F.col("s_suppkey") % 50).cast("string")).alias("source_key"), F.col("s_name").alias("company"))
    return named_runs(_runs(spark, d), jobs).groupBy("source_key", "company").agg(F.count(F.lit(1)).alias("runs"), F.sum("added").alias("added"))


def q_sessions(spark: SparkSession, d: str) -> DataFrame:
    life = F.make_dt_interval(hours=(F.col("event_id") % 24).cast("int"))
    e = table(spark, d, "events").select("event_id", "user_id", (F.col("ts") + life).alias("expires_at"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return sessions(e, users, F.lit(NOW).cast("timestamp")).groupBy("user_id", "c_name").agg(F.count(F.lit(1)).alias("sessions"))


def q_current_resume(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    resumes = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("resume_id"), (F.col("o_orderstatus") == "P").alias("active"))
    return current_resume(users, resumes)


def account_totals(spark: SparkSession, d: str) -> DataFrame:
    """One row: users, those with money, those first seen in the last week of events, orders, and saved items over all."""
    c, o, e = table(spark, d, "customer"), table(spark, d, "orders"), table(spark, d, "events")
    first = e.groupBy("user_id").agg(F.min("ts").alias("first"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("saved"))
    week = first.agg(F.max("first").alias("last"))
    recent = first.crossJoin(F.broadcast(week)).agg(F.count(F.when(F.col("first") >= F.col("last") - F.make_dt_interval(days=F.lit(7)), 1)).alias("recent"), F.sum("saved").alias("saved"))
    users = c.agg(F.count(F.lit(1)).alias("users"), F.count(F.when(F.col("c_acctbal") > 0, 1)).alias("active"))
    return users.crossJoin(recent).crossJoin(o.agg(F.count(F.lit(1)).alias("applications")))


def chart_scale(spark: SparkSession, d: str) -> DataFrame:
    """Events a day with the greatest day, one at least, and each day's share of it."""
    days = table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    top = days.agg(F.greatest(F.lit(1), F.max("n")).cast("long").alias("top"))
    return days.crossJoin(F.broadcast(top)).withColumn("share", F.round(F.col("n") / F.col("top"), 6))


def q_skills(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return skills_by_category(table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("category"), F.col("o_orderpriority").alias("skill"), (k % 5 == 0).alias("confirmed")))


QUERIES = {
    "run_report": q_run_report, "named_runs": q_named_runs, "valid_sessions": q_sessions, "current_resume": q_current_resume,
    "account_totals": account_totals, "chart_scale": chart_scale, "skills_by_category": q_skills,
}
ORACLE = {
    "run_report": f"""WITH m AS (SELECT max(ts) AS last FROM events), r AS (SELECT e.* FROM events e, m WHERE ts >= last - INTERVAL {WINDOW_MINUTES} MINUTE)
      SELECT coalesce(sum(event_id % 7), 0)::BIGINT AS added, coalesce(sum(event_id % 5), 0)::BIGINT AS closed, round(greatest(0.0::DOUBLE, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE), 1) AS seconds,
        count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed FROM r""",
    "named_runs": """WITH j AS (SELECT 's' || (s_suppkey % 50) AS source_key, max(s_name) AS company FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1),
      r AS (SELECT 's' || (user_id % 50) AS source_key, CASE WHEN user_id % 3 = 1 THEN 'co' || user_id END AS own, event_id FROM events)
      SELECT r.source_key, coalesce(own, j.company, r.source_key) AS company, count(*) AS runs, sum(event_id % 7)::BIGINT AS added FROM r LEFT JOIN j USING (source_key) GROUP BY 1, 2""",
    "valid_sessions": f"""SELECT user_id, c_name, count(*) AS sessions FROM events JOIN customer ON user_id = c_custkey
      WHERE ts + to_hours(event_id % 24) > TIMESTAMP '{NOW}' GROUP BY user_id, c_name""",
    "current_resume": """WITH r AS (SELECT o_custkey AS user_id, o_orderkey AS resume_id, o_orderstatus = 'P' AS active FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'P' DESC, o_orderkey) = 1)
      SELECT c_custkey AS user_id, c_mktsegment, resume_id, active FROM customer LEFT JOIN r ON c_custkey = user_id""",
    "account_totals": """WITH f AS (SELECT user_id, min(ts) AS first, count(*) FILTER (event_type = 'purchase') AS saved FROM events GROUP BY user_id),
      w AS (SELECT count(*) FILTER (first >= (SELECT max(first) FROM f) - INTERVAL 7 DAY) AS recent, sum(saved)::BIGINT AS saved FROM f)
      SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS active, recent, saved, (SELECT count(*) FROM orders) AS applications FROM w""",
    "chart_scale": """WITH d AS (SELECT ts::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1)
      SELECT day, n, greatest(1, max(n) OVER ())::BIGINT AS top, round(n / greatest(1, max(n) OVER ())::DOUBLE, 6) AS share FROM d""",
    "skills_by_category": """SELECT o_custkey AS user_id, o_orderstatus AS category, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS skills,
      CASE WHEN count(*) FILTER (o_orderkey % 5 = 0) > 0 THEN count(*) FILTER (o_orderkey % 5 = 0) ELSE count(*) END AS counted FROM orders GROUP BY 1, 2""",
}
