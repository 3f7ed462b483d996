"""Vacancy plans over the test tables: features, scores, two crawls merged, staleness, re-checks and notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..plans import features, match_score, merge, notify, score_cache
from ..plans.taxonomy import invented_words
from ..sources.settle import settled
from ..sources.tables import table
from .catalogue import _NORM, TECHNOLOGIES
from .vacancy_sql import VACANCIES, features_sql, mentions_sql, scores_sql

FIRST, SECOND, LATER = "2026-08-01 00:00:00", "2026-08-02 00:00:00", "2026-08-12 00:00:00"
CANDIDATE = match_score.Candidate("BACKEND", "SENIOR", 5.0, (("JAVA", "MUST_HAVE"), ("SPRING_BOOT", "MUST_HAVE"), ("KAFKA", "STRONG_PREFERENCE"), ("DOCKER", "BONUS")))
COMPANIES, FORMATS = ("src1", "src2", "src3"), ("en", "fr", "de")


def _at(moment: str) -> Column:
    return F.lit(moment).cast("timestamp")


def vacancies(spark: SparkSession, d: str) -> DataFrame:
    """Documents as vacancies: the source is the company, the first line the title, the language the location."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select(
        F.col("source").alias("source_key"), F.col("doc_id").cast("string").alias("external_id"), F.col("source").alias("company"),
        F.split(t, "\n")[0].alias("title"), F.col("lang").alias("location"), t.alias("description"),
    )


def vacancy_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Every mention of a concept: its place in title and text, and the weight that its surroundings give it."""
    return features.mention_rows(vacancies(spark, d), invented_words(), ("external_id",))


def vacancy_features(spark: SparkSession, d: str) -> DataFrame:
    f = features.extract(vacancies(spark, d), invented_words())
    shown = F.transform(F.map_entries("concepts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["mentions"], F.lit("@"), e["value"]["context"]))
    return f.select(
        "external_id", "content_hash", F.col("role.primary").alias("role"), F.col("seniority.level").alias("level"), "years",
        F.array_join(shown, ",").alias("concepts"), F.array_join(F.transform("negatives", lambda n: n["id"]), ",").alias("negatives"),
    )


def vacancy_scores(spark: SparkSession, d: str) -> DataFrame:
    t = invented_words()
    lists = [F.array_join(c, ",").alias(c) for c in ("matched", "partial", "missing", "wanted", "gates")]
    scored = match_score.score(features.extract(vacancies(spark, d), t), CANDIDATE, t)
    return scored.select("external_id", "score", "level", "confidence", "eligibility", "hard_match", "coverage", *lists)


def cached_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the second crawl from entries of the first, of which only unknown texts are scored."""
    t = invented_words()
    none = spark.createDataFrame([], score_cache.ENTRY)
    known = settled(score_cache.score_texts(score_cache.missing(_snapshot(spark, d, 1), none), CANDIDATE, t))
    now = _snapshot(spark, d, 2)
    fresh = score_cache.score_texts(score_cache.missing(now, known), CANDIDATE, t)
    both = known.withColumn("cached", F.lit(True)).unionByName(fresh.withColumn("cached", F.lit(False)))
    return score_cache.looked_up(now, both).select("external_id", "score", "band", "confidence", "eligibility", "cached")


def _snapshot(spark: SparkSession, d: str, number: int) -> DataFrame:
    """Crawl 1 lacks ids ending in 0; crawl 2 lacks those ending in 1 and has changed texts of ids divisible by 7."""
    v, n = vacancies(spark, d), F.col("external_id").cast("long")
    if number == 1:
        v = v.filter(n % 10 != 0)
    else:
        v = v.filter(n % 10 != 1).withColumn("description", F.when(n % 7 == 0, F.concat("description", F.lit(" !"))).otherwise(F.col("description")))
    v = v.select("source_key", "external_id", "title", F.concat(F.lit("http://x/"), "external_id").alias("url"), "location", "description")
    return v.withColumn("fingerprint", merge.fingerprint("title", "location", "description"))


def _synced(spark: SparkSession, d: str) -> DataFrame:
    """State after both crawls with the events of the second; only src1 isn't authoritative, one missing run closes."""
    one = _snapshot(spark, d, 1)
    state = merge.merge(merge.empty_state(one), one, _at(FIRST)).drop("event")
    return merge.merge(state, _snapshot(spark, d, 2), _at(SECOND), 1, F.col("source_key") != "src1")


def sync_state(spark: SparkSession, d: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return _synced(spark, d).select("source_key", "external_id", "active", "missing_runs", day("first_seen"), day("last_seen"), day("closed_at"), "event")


def sync_counts(spark: SparkSession, d: str) -> DataFrame:
    return merge.counts(_synced(spark, d))


def stale_pass(spark: SparkSession, d: str) -> DataFrame:
    """Rows of src1 that went stale ten days after the second crawl missed them."""
    state = _synced(spark, d).drop("event")
    return merge.mark_stale(state, _at(LATER), 10, F.col("source_key") == "src1").filter("event is not null").select("source_key", "external_id", "event", "stale")


def recheck_pass(spark: SparkSession, d: str) -> DataFrame:
    """The 250 oldest links to test at the later date."""
    return merge.recheck(_synced(spark, d).drop("event"), _at(LATER)).select("source_key", "external_id")


def _wanted(n: Column) -> list[Column]:
    """Deterministic filters of a subscriber by id: technologies, company, format, title word, minimal score."""
    none = F.lit(None).cast("array<string>")
    one = lambda names, k, rest: F.when(n % k == rest, F.array(F.element_at(F.array(*map(F.lit, names)), (F.pmod(n, F.lit(len(names))) + 1).cast("int"))))
    return [
        one([t for t, _ in TECHNOLOGIES], 3, 0).alias("technologies"), one(("the", "der", "la"), 5, 1).alias("title_words"), none.alias("keywords"),
        one(COMPANIES, 2, 1).alias("companies"), none.alias("locations"), none.alias("roles"), none.alias("levels"), one(FORMATS, 4, 1).alias("formats"),
        F.when(n % 7 == 0, 40.0).alias("min_score"),
    ]


def notify_matches(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as subscribers: how many vacancies meet the filters of each, and the sum of their ids."""
    v = vacancies(spark, d)
    found = F.filter(F.array(*[F.when(F.lower("description").rlike(p), F.lit(n)) for n, p in TECHNOLOGIES]), lambda t: t.isNotNull())
    events = v.select(
        F.col("external_id").cast("long").alias("event_id"), "company", "title", "location", F.lit("").alias("team"), F.lit("").alias("workplace_type"), "description",
        found.alias("technologies"), F.pmod(F.length("description"), F.lit(100)).cast("double").alias("score"),
    )
    n = F.col("s_suppkey")
    people = table(spark, d, "supplier").select(F.concat(F.lit("c"), n.cast("string")).alias("chat_id"), *_wanted(n))
    return notify.tallied(events, people)


def index_outdated(spark: SparkSession, d: str) -> DataFrame:
    """Vacancies to be indexed again when the second crawl meets an index of the first."""
    index = _snapshot(spark, d, 1).select("source_key", "external_id", F.lit("v").alias("version"), content_hash(F.col("title"), F.col("description")).alias("content_hash"))
    return features.outdated(_snapshot(spark, d, 2), index, "v").select("source_key", "external_id")


QUERIES = {
    "vacancy_mentions": vacancy_mentions, "vacancy_features": vacancy_features, "vacancy_scores": vacancy_scores, "cached_scores": cached_scores, "sync_state": sync_state, "sync_counts": sync_counts,
    "stale_pass": stale_pass, "recheck_pass": recheck_pass, "notify_matches": notify_matches, "index_outdated": index_outdated,
}
_V = "v AS (SELECT source AS source_key, doc_id, source AS company, split_part(coalesce(text, ''), chr(10), 1) AS title, lang AS location, coalesce(text, '') AS description FROM documents)"
_SYNC = f"""{_V}, a AS (SELECT * FROM v WHERE doc_id % 10 <> 0), b AS (SELECT * REPLACE (CASE WHEN doc_id % 7 = 0 THEN description || ' !' ELSE description END AS description) FROM v WHERE doc_id % 10 <> 1),
  s AS (SELECT coalesce(a.source_key, b.source_key) AS source_key, coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NOT NULL AS known, b.doc_id IS NOT NULL AS seen,
    NOT seen AND coalesce(a.source_key, b.source_key) <> 'src1' AS closes,
    CASE WHEN NOT known THEN 'new' WHEN seen AND (a.description <> b.description) THEN 'updated' WHEN closes THEN 'closed' END AS event
    FROM a FULL OUTER JOIN b ON a.source_key = b.source_key AND a.doc_id = b.doc_id)"""
_TECH = " OR ".join(f"(list_contains(technologies, '{n}') AND regexp_matches(lower(description), '{p}'))" for n, p in TECHNOLOGIES)


def _sql_one(names, k: int, rest: int) -> str:
    return f"CASE WHEN n % {k} = {rest} THEN [[{', '.join(repr(x) for x in names)}][(n % {len(names)}) + 1]] ELSE [] END"


_SECOND = f"""(SELECT doc_id, title, CASE WHEN doc_id % 7 = 0 THEN description || ' !' ELSE description END AS description FROM {VACANCIES} WHERE doc_id % 10 <> 1)"""
_HASH = f"{_NORM('title')} || chr(10) || {_NORM('description')}"
ORACLE = {
    "vacancy_mentions": f"WITH {mentions_sql(invented_words())} SELECT * FROM m",
    "vacancy_features": f"""WITH {features_sql(invented_words())}
      SELECT external_id, content_hash, role, level, years, concepts, array_to_string(negatives, ',') AS negatives FROM f""",
    "vacancy_scores": f"WITH {scores_sql(invented_words(), CANDIDATE)}",
    "cached_scores": f"""SELECT external_id, score, level AS band, confidence, eligibility, {_HASH} IN (SELECT {_HASH} FROM {VACANCIES} WHERE doc_id % 10 <> 0) AS cached
      FROM (WITH {scores_sql(invented_words(), CANDIDATE, _SECOND)}) JOIN (SELECT doc_id::VARCHAR AS external_id, title, description FROM {_SECOND}) USING (external_id)""",
    "sync_state": f"""WITH {_SYNC} SELECT source_key, doc_id::VARCHAR AS external_id, NOT closes AS active, closes::INTEGER AS missing_runs,
      CASE WHEN known THEN '2026-08-01' ELSE '2026-08-02' END AS first_seen, CASE WHEN seen THEN '2026-08-02' ELSE '2026-08-01' END AS last_seen,
      CASE WHEN closes THEN '2026-08-02' END AS closed_at, event FROM s""",
    "sync_counts": f"WITH {_SYNC} SELECT source_key, " + ", ".join(f"count(*) FILTER (event = '{e}') AS {e}" for e in ("new", "updated", "reopened", "restored", "closed"))
    + ", count(*) FILTER (NOT closes) AS live FROM s GROUP BY source_key",
    "stale_pass": f"WITH {_SYNC} SELECT source_key, doc_id::VARCHAR AS external_id, 'stale' AS event, true AS stale FROM s WHERE NOT seen AND source_key = 'src1'",
    "recheck_pass": f"WITH {_SYNC} SELECT source_key, doc_id::VARCHAR AS external_id FROM s WHERE NOT closes ORDER BY known DESC, source_key, external_id LIMIT 250",
    "notify_matches": f"""WITH {_V}, p AS (SELECT 'c' || s_suppkey AS chat_id, s_suppkey AS n FROM supplier),
      q AS (SELECT chat_id, n, {_sql_one([t for t, _ in TECHNOLOGIES], 3, 0)} AS technologies, {_sql_one(('the', 'der', 'la'), 5, 1)} AS words,
        {_sql_one(COMPANIES, 2, 1)} AS companies, {_sql_one(FORMATS, 4, 1)} AS formats FROM p)
      SELECT chat_id, count(*) AS jobs, sum(doc_id)::BIGINT AS ids FROM v, q WHERE (len(technologies) = 0 OR {_TECH})
      AND (len(words) = 0 OR contains(lower(title), words[1])) AND (len(companies) = 0 OR contains(lower(company), companies[1]))
      AND (len(formats) = 0 OR contains(lower(location), formats[1])) AND (n % 7 <> 0 OR length(description) % 100 >= 40) GROUP BY chat_id""",
    "index_outdated": f"""WITH {_SYNC} SELECT b.source_key, b.doc_id::VARCHAR AS external_id FROM b LEFT JOIN a ON a.source_key = b.source_key AND a.doc_id = b.doc_id
      WHERE a.doc_id IS NULL OR {_NORM('a.title')} <> {_NORM('b.title')} OR {_NORM('a.description')} <> {_NORM('b.description')}""",
}
