from dataclasses import replace

from pyspark.sql import functions as F

from hirelake.plans import features, match_score, score_cache
from hirelake.plans.taxonomy import java_backend

T = java_backend()
C = match_score.Candidate("BACKEND", "SENIOR", 5, (("JAVA", "MUST_HAVE"), ("KAFKA", "BONUS")))


def jobs(spark, *rows):
    return spark.createDataFrame([("s", str(k), *r) for k, r in enumerate(rows)], "source_key string, external_id string, title string, description string")


def test_only_missing_texts_are_scored(spark, tmp_path):
    store = str(tmp_path / "scores")
    j = jobs(spark, ("Java developer", "kafka"), ("Java developer", "kafka"), ("java  Developer", "Kafka"), (None, None), ("", ""), ("Backend engineer", "mysql"))
    assert score_cache.entries(spark, store, C, T).count() == 0
    assert score_cache.fill(store, j, C, T) == 3  # equal texts, and those equal when normalised, are one entry
    assert score_cache.fill(store, j, C, T) == 0
    changed = jobs(spark, ("Java developer", "kafka"), ("Backend engineer", "mysql, java"))
    assert score_cache.fill(store, changed, C, T) == 1
    assert score_cache.fill(store, changed, replace(C, years=2.0), T) == 2
    assert score_cache.fill(store, changed, C, replace(T, version="java-2")) == 2
    assert score_cache.fill(store, j.limit(0), C, T) == 0


def test_equal_to_scores(spark, tmp_path):
    j = jobs(spark, ("Senior Java developer", "kafka required"), ("Senior Java developer", "kafka required"), ("x", "java"), (None, "5 years experience"))
    got = score_cache.scores(str(tmp_path / "scores"), j, C, T).select("external_id", "score", "band", "eligibility").collect()
    plain = match_score.score(features.extract(j, T), C, T).select("external_id", "score", "level", "eligibility").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain)) and len(got) == 4


def test_written_twice(spark, tmp_path):
    store, j = str(tmp_path / "scores"), jobs(spark, ("Java developer", "kafka"))
    score_cache.fill(store, j, C, T)
    score_cache.entries(spark, store, C, T).write.mode("append").parquet(score_cache._folder(store, C, T))
    assert score_cache.scores(store, j, C, T).count() == 1


def test_digest():
    a = replace(C, excluded=frozenset({"A", "B"}))
    assert score_cache.profile_digest(a) == score_cache.profile_digest(replace(C, excluded=frozenset({"B", "A"}))) != score_cache.profile_digest(C)


def test_texts_are_normalised_once(spark):
    """What is missing comes normalised, so that scoring doesn't do it again; phrases are found at all borders."""
    j = jobs(spark, ("  Java\n Developer – Ё", "A  B"), ("java developer - е", "a b"))
    got = score_cache.missing(j, spark.createDataFrame([], score_cache.ENTRY)).collect()
    assert [(r.title, r.description) for r in got] == [("java developer - е", "a b")]
    said = ["c++", "xc++", "c++ x", "c++b", "java", "_java", "java_", "(java)", "javajava java", "яjava", "a java"]
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", features.phrase(F.col("t"), "java", "c++").alias("b")).collect()
    assert [r.t for r in rows if r.b] == ["c++", "c++ x", "java", "(java)", "javajava java", "a java"]
