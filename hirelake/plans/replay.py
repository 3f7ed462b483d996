"""Lifecycles from the whole history of snapshots in one pass, instead of a merge for each snapshot.

Of every (source, id) only its sightings are kept, so the pass costs one sort of what was seen: what happened between two
sightings follows from their run numbers. Runs are those of a source; a failed run isn't one, so it makes nothing missing.
Runs without authority don't count as missing either, and a gap closes at the ``close_after``-th counting run in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source_key", "external_id"]


def numbered_runs(runs: DataFrame) -> DataFrame:
    """runs (source_key, run_at, authoritative) with n, the run's number, and c, the counting runs up to it."""
    before = Window.partitionBy("source_key").orderBy("run_at").rowsBetween(Window.unboundedPreceding, 0)
    return runs.select("source_key", "run_at", F.coalesce("authoritative", F.lit(True)).alias("counts")).withColumns(
        {"n": F.row_number().over(Window.partitionBy("source_key").orderBy("run_at")), "c": F.sum(F.col("counts").cast("int")).over(before)}
    )


def replay(sightings: DataFrame, runs: DataFrame, close_after: int = 2) -> DataFrame:
    """source_key, external_id, event, happened_at: new, updated, closed and reopened, as merging run by run gives them.

    sightings: source_key, external_id, run_at, fingerprint, one row at least for every vacancy seen in a run (of several the
    one with the greatest fingerprint counts, as in merge()); runs: source_key, run_at, authoritative (null: true), a row a
    run. Sightings of runs that aren't listed are left out. A closing is dated by its run: the counting run that is close_after
    after the last sighting, found by its number and not by a search through the gap.
    """
    c = F.col
    close_after = max(1, close_after)
    told = numbered_runs(runs)
    seen = sightings.groupBy(*KEY, "run_at").agg(F.max("fingerprint").alias("fingerprint")).join(told, ["source_key", "run_at"])
    own = Window.partitionBy(*KEY).orderBy("n")
    seen = seen.select(
        *KEY, "n", "c", "run_at", "counts", "fingerprint",
        F.lag("fingerprint").over(own).alias("before"), F.lag("c").over(own).alias("c_before"), F.row_number().over(own).alias("k"),
        F.lead("c").over(own).alias("c_next"), F.lead("counts").over(own).alias("next_counts"),
    )
    # Counting runs strictly between two sightings; the later sighting's own run doesn't count as missing.
    missed = c("c") - c("counts").cast("int") - c("c_before")
    event = F.when(c("k") == 1, "new").when(missed >= close_after, "reopened").when(c("fingerprint") != c("before"), "updated")
    own_events = seen.select(*KEY, event.alias("event"), c("run_at").alias("happened_at")).filter("event is not null")
    last = told.groupBy("source_key").agg(F.max("c").alias("c_last"))
    until = F.coalesce(c("c_next") - c("next_counts").cast("int"), c("c_last"))
    gone = seen.join(last, "source_key").filter(until - c("c") >= close_after).select(*KEY, (c("c") + close_after).alias("c"))
    closing = told.filter("counts").select("source_key", "c", c("run_at").alias("happened_at"))
    closed = gone.join(closing, ["source_key", "c"]).select(*KEY, F.lit("closed").alias("event"), "happened_at")
    return own_events.union(closed)


def final_state(sightings: DataFrame, runs: DataFrame, close_after: int = 2) -> DataFrame:
    """source_key, external_id, fingerprint, first_seen, last_seen, active, missing_runs after the last run, as merge() leaves them.

    A closed row keeps the count at which it closed.
    """
    c = F.col
    told = numbered_runs(runs)
    seen = sightings.join(told, ["source_key", "run_at"])
    kept = seen.groupBy(*KEY).agg(F.min("run_at").alias("first_seen"), F.max(F.struct("n", "fingerprint", "run_at", "c")).alias("x"))
    last = told.groupBy("source_key").agg(F.max("c").alias("c_last"))
    missing = c("c_last") - c("x.c")
    return kept.join(last, "source_key").select(
        *KEY, c("x.fingerprint").alias("fingerprint"), "first_seen", c("x.run_at").alias("last_seen"), (missing < max(1, close_after)).alias("active"),
        F.least(missing, F.lit(max(1, close_after))).cast("int").alias("missing_runs"),
    )
