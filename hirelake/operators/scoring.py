"""Concept extraction, scoring and ranking of jobs against a candidate, and subscriber matching.

A taxonomy is a short list of settings: concept, category, weight, aliases and one-hop relations. Concepts are counted in
texts with built-in expressions; the score is the importance-weighted mean per category, renormalised over the
categories present, less penalties, under gates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import score_band
from ..sources.tables import jobs, table

#: Concept, category, importance weight, alias, related concept and its share.
TAXONOMY = (
    ("core", "language", 4, "the", "base", 0.5),
    ("base", "language", 2, "of", "core", 0.3),
    ("query", "data", 3, "and", "store", 0.6),
    ("store", "data", 1, "that", "query", 0.4),
    ("cloud", "platform", 2, "ing", "core", 0.2),
)
CATEGORY_WEIGHT = {"language": 0.5, "data": 0.3, "platform": 0.2}
PENALTY = ("stupid", 15)
GATE = ("core", 60)


def mentions(j: DataFrame) -> DataFrame:
    """external_id, whether the penalty word stands in the text, and a count a concept. A text is split once: only the
    words of the taxonomy are kept before they are counted."""
    aliases = [a for _, _, _, a, _, _ in TAXONOMY]
    text = F.lower("description")
    words = F.filter(F.split(text, "[^a-z]+"), lambda w: w.isin(*aliases))
    found = j.select("external_id", words.alias("_words"), text.contains(PENALTY[0]).alias("penal"))
    count = lambda a: F.size(F.filter("_words", lambda w: w == a)).cast("long")
    return found.select("external_id", "penal", *[count(a).alias(c) for c, _, _, a, _, _ in TAXONOMY])


def concept_totals(spark: SparkSession, d: str) -> DataFrame:
    """Documents and mentions per concept."""
    m = mentions(jobs(spark, d)).drop("penal")
    long = m.unpivot(["external_id"], [c[0] for c in TAXONOMY], "concept", "n").filter("n > 0")
    return long.groupBy("concept").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("mentions"), F.max("n").alias("top"))


def scored(j: DataFrame) -> DataFrame:
    m = mentions(j)
    has = lambda c: (F.col(c) > 0).cast("double")
    effective = {c: F.greatest(has(c), has(rel) * share) for c, _, _, _, rel, share in TAXONOMY}
    total, active = F.lit(0.0), 0.0
    for category, weight in CATEGORY_WEIGHT.items():
        rows = [(c, w) for c, cat, w, *_ in TAXONOMY if cat == category]
        mean = sum((effective[c] * w for c, w in rows), F.lit(0.0)) / sum(w for _, w in rows)
        total, active = total + mean * weight, active + weight
    raw = total / active * 100 - F.when(F.col("penal"), PENALTY[1]).otherwise(0)
    gated = F.when(F.col(GATE[0]) == 0, F.least(raw, F.lit(float(GATE[1])))).otherwise(raw)
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), gated)), 2)
    missing = F.concat_ws(",", *[F.when(effective[c] == 0, c) for c, _, w, *_ in TAXONOMY if w >= 3])
    return m.select("external_id", score.alias("score"), score_band(score).alias("band"), missing.alias("missing"))


def score_jobs(spark: SparkSession, d: str) -> DataFrame:
    return scored(jobs(spark, d))


def rank_top(spark: SparkSession, d: str) -> DataFrame:
    """The hundred best live jobs, by score and then id: a report."""
    live = jobs(spark, d).filter("active and not stale")
    return scored(live).orderBy(F.desc("score"), "external_id").limit(100)


def subscriber_matches(spark: SparkSession, d: str) -> DataFrame:
    """Users subscribed to the market segment of a nation: the customers that match, without those already served."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    wanted = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    served = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return wanted.join(served, "c_custkey", "left_anti")


QUERIES = {"concept_totals": concept_totals, "score_jobs": score_jobs, "rank_top": rank_top, "subscriber_matches": subscriber_matches}

from .catalogue import JOBS  # noqa: E402


def _sql_score() -> str:
    eff = {c: f"greatest(({c} > 0)::INT::DOUBLE, ({rel} > 0)::INT::DOUBLE * {share}::DOUBLE)" for c, _, _, _, rel, share in TAXONOMY}
    parts = []
    for category, weight in CATEGORY_WEIGHT.items():
        rows = [(c, w) for c, cat, w, *_ in TAXONOMY if cat == category]
        mean = "(0.0::DOUBLE + " + " + ".join(f"{eff[c]} * {w}" for c, w in rows) + f") / {sum(w for _, w in rows)}"
        parts.append(f"({mean}) * {weight}::DOUBLE")
    raw = f"(0.0::DOUBLE + {' + '.join(parts)}) / {sum(CATEGORY_WEIGHT.values())}::DOUBLE * 100 - CASE WHEN contains(lower(description), '{PENALTY[0]}') THEN {PENALTY[1]} ELSE 0 END"
    missing = "concat_ws(',', " + ", ".join(f"CASE WHEN {eff[c]} = 0 THEN '{c}' END" for c, _, w, *_ in TAXONOMY if w >= 3) + ")"
    return f"""SELECT external_id, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, CASE WHEN {GATE[0]} = 0 THEN least({raw}, {GATE[1]}.0::DOUBLE) ELSE {raw} END)), 2) AS score, {missing} AS missing FROM m"""


_M = "m AS (SELECT external_id, active, stale, description, " + ", ".join(f"len(list_filter(string_split_regex(lower(description), '[^a-z]+'), lambda w: w = '{a}')) AS {c}" for c, _, _, a, _, _ in TAXONOMY) + " FROM jobs)"
_BAND = "CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 70 THEN 'strong' WHEN score >= 55 THEN 'fair' WHEN score >= 40 THEN 'weak' ELSE 'poor' END AS band"
ORACLE = {
    "concept_totals": f"WITH {JOBS}, {_M}, u AS (" + " UNION ALL ".join(f"SELECT '{c[0]}' AS concept, {c[0]} AS n FROM m" for c in TAXONOMY)
    + ") SELECT concept, count(*) AS docs, sum(n)::BIGINT AS mentions, max(n) AS top FROM u WHERE n > 0 GROUP BY concept",
    "score_jobs": f"WITH {JOBS}, {_M}, s AS ({_sql_score()}) SELECT external_id, score, {_BAND}, missing FROM s",
    "rank_top": f"WITH {JOBS}, {_M}, s AS ({_sql_score()} WHERE active AND NOT stale) SELECT external_id, score, {_BAND}, missing FROM s ORDER BY score DESC, external_id LIMIT 100",
    "subscriber_matches": """SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
      WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
}
