"""Scores kept by candidate, taxonomy version and content, so that only new texts are scored.

A score depends on title and description alone, so copies of a vacancy share one entry, and a changed text is another key.
Entries are never rewritten: a fill that is lost midway leaves no rows, and one that runs twice writes equal rows, which readers
see once. Old versions and profiles stay until their folders are deleted.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, normalize_text
from . import features, match_score
from .match_score import Candidate
from .taxonomy import Taxonomy

ENTRY = "content_hash string, score double, level string, confidence double, eligibility string, hard_match double, coverage double"


def profile_digest(candidate: Candidate) -> str:
    """Digest of all that a candidate is; the order of requirements counts, that of exclusions doesn't."""
    told = asdict(candidate) | {"excluded": sorted(candidate.excluded)}
    return hashlib.sha256(json.dumps(told, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def _folder(store: str, candidate: Candidate, taxonomy: Taxonomy) -> str:
    return f"{store}/{profile_digest(candidate)}/{taxonomy.version}"


def entries(spark: SparkSession, store: str, candidate: Candidate, taxonomy: Taxonomy) -> DataFrame:
    """The candidate's entries; none where nothing was filled yet."""
    try:
        found = spark.read.schema(ENTRY).parquet(_folder(store, candidate, taxonomy))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], ENTRY)
    return found.dropDuplicates(["content_hash"])


def missing(jobs: DataFrame, known: DataFrame) -> DataFrame:
    """content_hash and the normalised title and description of each text that has no entry, once. Copies are one group, combined
    before the shuffle; texts of equal hash are equal when normalised, so any of them stands for all."""
    plain = jobs.select(normalize_text(F.col("title")).alias("title"), normalize_text(F.col("description")).alias("description"))
    texts = plain.select(F.sha2(F.concat("title", F.lit("\n"), "description"), 256).alias("content_hash"), "title", "description")
    new = texts.join(known.select("content_hash"), "content_hash", "left_anti")
    return new.dropDuplicates(["content_hash"])


def score_texts(texts: DataFrame, candidate: Candidate, taxonomy: Taxonomy) -> DataFrame:
    """Entries of texts (content_hash, title, description), normalised as ``missing`` gives them."""
    found = features.extract(texts.withColumnRenamed("content_hash", "text_key"), taxonomy, ("text_key",), normal=True)
    scored = match_score.score(found.drop("content_hash"), candidate, taxonomy)
    return scored.withColumnRenamed("text_key", "content_hash").select(*[c.split()[0] for c in ENTRY.split(", ")])


def looked_up(jobs: DataFrame, known: DataFrame) -> DataFrame:
    """jobs with their entry's columns, null without one."""
    other = known.withColumnRenamed("content_hash", "_hash").withColumnRenamed("level", "band")
    hashed = jobs.withColumn("_now", content_hash(F.col("title"), F.col("description")))
    return hashed.join(other, F.col("_now") == F.col("_hash"), "left").drop("_now", "_hash")


def fill(store: str, jobs: DataFrame, candidate: Candidate, taxonomy: Taxonomy) -> int:
    """Score the texts that have no entry, append them, and say how many they were."""
    spark, folder = jobs.sparkSession, _folder(store, candidate, taxonomy)
    before = entries(spark, store, candidate, taxonomy)
    n = before.count()
    score_texts(missing(jobs, before), candidate, taxonomy).write.mode("append").parquet(folder)
    return entries(spark, store, candidate, taxonomy).count() - n


def scores(store: str, jobs: DataFrame, candidate: Candidate, taxonomy: Taxonomy) -> DataFrame:
    """jobs with score, band and the rest, of which only missing texts were scored."""
    fill(store, jobs, candidate, taxonomy)
    return looked_up(jobs, entries(jobs.sparkSession, store, candidate, taxonomy))
