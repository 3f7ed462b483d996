"""Crawl snapshots merged into the keyed vacancy state: one full outer join on the key gives state, events and counts.

State columns: source_key, external_id, the payload columns, fingerprint, first_seen, last_seen, active, stale, stale_at,
missing_runs, closed_at, link_runs, link_checked. A merge returns the whole row once with its event beside it, so state and
event log come from the same shuffle; write the result and split it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source_key", "external_id"]
MARKS = {
    "first_seen": "timestamp", "last_seen": "timestamp", "active": "boolean", "stale": "boolean", "stale_at": "timestamp",
    "missing_runs": "int", "closed_at": "timestamp", "link_runs": "int", "link_checked": "timestamp",
}


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the named columns as sorted-key JSON, nulls as empty texts."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(columns)])), 256)


def empty_state(batch: DataFrame) -> DataFrame:
    return batch.limit(0).withColumns({c: F.lit(None).cast(t) for c, t in MARKS.items()})


def merge(state: DataFrame, batch: DataFrame, now: Column, close_after: int = 2, authoritative: Column | None = None) -> DataFrame:
    """The state after a sync, with ``event``: new, reopened, restored, updated, closed or null.

    batch: key, payload and fingerprint, one or more rows a key (the row that sorts last by fingerprint stays, since a
    table has no arrival order; use last_wins() before where there is one). A seen row becomes active with its counters
    at zero. An active row of an authoritative source that is missing counts a run and closes at ``close_after``. Sources
    absent from the batch altogether (a failed crawl) are left as they were only if filtered out of state beforehand.
    """
    payload = [c for c in batch.columns if c not in KEY]
    latest = batch.groupBy(*KEY).agg(F.max(F.struct("fingerprint", *[c for c in payload if c != "fingerprint"])).alias("n"))
    j = state.withColumn("_known", F.lit(True)).join(latest.withColumn("_seen", F.lit(True)), KEY, "full_outer")
    seen, known = F.col("_seen").isNotNull(), F.col("_known").isNotNull()
    counts = (F.lit(True) if authoritative is None else authoritative) & ~seen & F.col("active")
    runs = F.col("missing_runs") + counts.cast("int")
    closes = counts & (runs >= close_after)
    event = (
        F.when(~known, "new").when(seen & ~F.col("active"), "reopened").when(seen & F.col("stale"), "restored")
        .when(seen & (F.col("fingerprint") != F.col("n.fingerprint")), "updated").when(closes, "closed")
    )
    none = F.lit(None).cast("timestamp")
    marks = {
        "first_seen": F.when(known, F.col("first_seen")).otherwise(now),
        "last_seen": F.when(seen, now).otherwise(F.col("last_seen")),
        "active": seen | (F.col("active") & ~closes),
        "stale": ~seen & F.col("stale") & ~closes,
        "stale_at": F.when(seen | closes, none).otherwise(F.col("stale_at")),
        "missing_runs": F.when(seen, 0).otherwise(runs),
        "closed_at": F.when(seen, none).when(closes, now).otherwise(F.col("closed_at")),
        "link_runs": F.when(seen, 0).otherwise(F.col("link_runs")),
        "link_checked": F.when(seen, none).otherwise(F.col("link_checked")),
    }
    return j.select(*KEY, *[F.when(seen, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in payload], *[v.cast(MARKS[k]).alias(k) for k, v in marks.items()], event.alias("event"))


def mark_stale(state: DataFrame, now: Column, days: int = 7, loose: Column | None = None) -> DataFrame:
    """Active rows of sources that aren't authoritative (``loose``), unseen for so many days, become stale."""
    old = F.col("active") & ~F.col("stale") & (F.col("last_seen") < now - F.make_dt_interval(F.lit(days)))
    old = old & loose if loose is not None else old
    return state.withColumns({"event": F.when(old, "stale"), "stale_at": F.when(old, now).otherwise(F.col("stale_at")), "stale": F.col("stale") | old})


def prune(state: DataFrame, now: Column, wanted: Column) -> DataFrame:
    """Active rows that the filters no longer admit are closed with the event ``filtered``."""
    out = F.col("active") & ~wanted
    return state.withColumns({"event": F.when(out, "filtered"), "closed_at": F.when(out, now).otherwise(F.col("closed_at")), "active": F.col("active") & wanted})


def recheck(state: DataFrame, now: Column, batch: int = 250, interval: int = 7, age: int = 7) -> DataFrame:
    """Links to test next: old enough, untested for the interval or awaiting confirmation; a report of bounded size."""
    day = lambda n: F.make_dt_interval(F.lit(n))
    due = F.col("link_checked").isNull() | (F.col("link_checked") <= now - day(interval)) | (F.col("link_runs") > 0)
    picked = state.filter(F.col("active") & (F.col("url") != "") & (F.col("first_seen") <= now - day(age)) & due)
    return picked.orderBy(F.desc("link_runs"), F.asc_nulls_first("link_checked"), "first_seen", *KEY).limit(batch)


def apply_links(state: DataFrame, outcomes: DataFrame, now: Column, confirm: int = 2) -> DataFrame:
    """Outcomes (key, outcome: active, closed or inconclusive) put into the state; a link closes when confirmed."""
    j = state.join(outcomes.select(*KEY, "outcome").dropDuplicates(KEY), KEY, "left")
    up, down = F.coalesce(F.col("outcome") == "active", F.lit(False)), F.coalesce(F.col("outcome") == "closed", F.lit(False))
    runs = F.when(up, 0).otherwise(F.col("link_runs") + down.cast("int"))
    closes = down & F.col("active") & (F.col("link_runs") + 1 >= max(1, confirm))
    none = F.lit(None).cast("timestamp")
    return j.withColumns(
        {
            "event": F.when(up & F.col("stale"), "restored").when(closes, "closed"),
            "link_checked": F.when(F.col("outcome").isNotNull(), now).otherwise(F.col("link_checked")),
            "link_runs": runs.cast("int"),
            "stale": F.col("stale") & ~up & ~closes,
            "stale_at": F.when(up | closes, none).otherwise(F.col("stale_at")),
            "active": F.col("active") & ~closes,
            "missing_runs": F.when(closes, 0).otherwise(F.col("missing_runs")),
            "closed_at": F.when(closes, now).otherwise(F.col("closed_at")),
        }
    ).drop("outcome")


def events(merged: DataFrame, now: Column, after: int = 0, buckets: int = 1024) -> DataFrame:
    """The event rows of a merge with unbroken ids that go on after ``after``.

    A row's id is its number within its hash bucket plus the sizes of the buckets before: no sort of all rows in one task,
    and the same ids whenever a lost partition is made again.
    """
    rows = merged.filter("event is not null").select(*KEY, "event", now.alias("happened_at"))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(*KEY), F.lit(buckets)))
    sizes = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over one row a bucket
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    number = F.row_number().over(Window.partitionBy("_b").orderBy(*KEY, "event"))
    return rows.join(F.broadcast(offsets), "_b").select((number + F.col("_o") + after).alias("id"), *KEY, "event", "happened_at")


def counts(merged: DataFrame) -> DataFrame:
    """Events by source and kind in columns, and how many rows are live."""
    n = lambda e: F.count(F.when(F.col("event") == e, 1)).alias(e)
    return merged.groupBy("source_key").agg(*map(n, ("new", "updated", "reopened", "restored", "closed")), F.count(F.when(F.col("active") & ~F.col("stale"), 1)).alias("live"))
