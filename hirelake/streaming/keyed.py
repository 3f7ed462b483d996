"""Keyed state of the streams: each vacancy's marks over snapshots, and entries that expire.

``lifecycle_stream`` holds the jobs table as state: a source falls into shards by its vacancies' ids, a shard is a key, and each
vacancy an entry of a map state in RocksDB; the mark of a run reaches every shard of its source. ``fresh_stream`` is a cache whose entries have a
lifetime; it is counted in event time, so a stream that is read again gives the same rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "source_key string, external_id string, event string, happened_at timestamp"
CACHED = "key string, event_id long, ts timestamp, hit boolean, filled_at timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """transformWithState needs the RocksDB provider; set it before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Lifecycle(StatefulProcessor):
    """Runs of one source, in order of time: new, updated, closed and reopened.

    A row is a sighting (external_id and fingerprint) or, with a null id, the mark of its run, which every run has: it tells
    that the run happened and whether missing rows count. A run's rows come in one batch, mark included.
    """

    def __init__(self, close_after: int):
        self.close_after = max(1, close_after)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "external_id string", "fingerprint string, active boolean, missing int, run long")
        self.last = handle.getValueState("last", "run timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows), ignore_index=True)
        for run, part in every.groupby("run_at", sort=True):
            last = self.last.get() if self.last.exists() else None
            if last is not None and run.to_pydatetime() <= last[0]:
                continue  # a run that was merged before
            self.last.update((run.to_pydatetime(),))
            yield from self._run(key[0], run, part)

    def _run(self, source: str, run, part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        marks = part[part["external_id"].isna()]
        counts = not (marks["authoritative"] == False).any()  # noqa: E712 null counts as true
        number, said = int(run.value // 1000), []
        seen = part[part["external_id"].notna()].groupby("external_id")["fingerprint"].max()
        for i, fingerprint in seen.items():
            held = self.held.getValue((i,)) if self.held.containsKey((i,)) else None
            event = "new" if held is None else "reopened" if not held[1] else "updated" if held[0] != fingerprint else None
            self.held.updateValue((i,), (fingerprint, True, 0, number))
            said.append((source, i, event))
        if counts:
            for (i,), (fingerprint, active, missing, at) in [*self.held.iterator()]:
                if active and at != number:
                    closes = missing + 1 >= self.close_after
                    self.held.updateValue((i,), (fingerprint, not closes, missing + 1, at))
                    said.append((source, i, "closed" if closes else None))
        told = [(*s, run) for s in said if s[2]]
        if told:
            yield pd.DataFrame(told, columns=["source_key", "external_id", "event", "happened_at"])

    def close(self) -> None:
        pass


def lifecycle_stream(snapshots: DataFrame, close_after: int = 2, shards: int = 16) -> DataFrame:
    """Events of a stream of snapshots: source_key, external_id (null: the run's mark), fingerprint, run_at, authoritative."""
    use_rocksdb(snapshots.sparkSession)
    own = F.pmod(F.xxhash64("external_id"), F.lit(shards)).cast("int")
    shard = F.when(F.col("external_id").isNull(), F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(own))
    rows = snapshots.select("source_key", "external_id", "fingerprint", "run_at", "authoritative", F.explode(shard).alias("shard"))
    return rows.groupBy("source_key", "shard").transformWithStateInPandas(Lifecycle(close_after), outputStructType=EVENTS, outputMode="Append", timeMode="None")


class Fresh(StatefulProcessor):
    """Look-ups of one key: a hit while the entry lives, else the entry is filled. A timer drops entries when they expire."""

    def __init__(self, seconds: float):
        self.life = dt.timedelta(seconds=seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "filled_at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"])
        filled = self.entry.get()[0] if self.entry.exists() else None
        said = []
        for ts, event in zip(every["ts"].dt.to_pydatetime(), every["event_id"]):
            hit = filled is not None and ts < filled + self.life
            filled = filled if hit else ts
            said.append((key[0], event, ts, hit, filled))
        self.entry.update((filled,))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((filled + self.life).timestamp() * 1000))
        yield pd.DataFrame(said, columns=["key", "event_id", "ts", "hit", "filled_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entry.clear()
        yield from ()

    def close(self) -> None:
        pass


def fresh_stream(lookups: DataFrame, seconds: float, late: str = "10 minutes") -> DataFrame:
    """key, event_id, ts, hit, filled_at of a stream of lookups (key, event_id, ts): does an entry filled less than so many
    seconds before serve it? A look-up that comes more than ``late`` behind the newest is left out by the watermark."""
    use_rocksdb(lookups.sparkSession)
    rows = lookups.select("key", "event_id", "ts").withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(Fresh(seconds), outputStructType=CACHED, outputMode="Append", timeMode="EventTime")


def fresh(lookups: DataFrame, seconds: float) -> DataFrame:
    """The same for a whole table.

    Whether a look-up hits depends on the fills before it, so look-ups are followed in order, with one entry in memory. A
    key's look-ups are cut where the gap to the one before reaches the lifetime, since the one after such a gap always fills;
    the parts are dealt by key and part, so only look-ups that are dense throughout stay in one task.
    """
    order = Window.partitionBy("key").orderBy("t", "event_id")
    life = int(seconds * 1_000_000)
    rows = lookups.select("key", "event_id", F.unix_micros("ts").alias("t"))
    starts = F.coalesce(F.col("t") - F.lag("t").over(order) >= life, F.lit(True)).cast("int")
    parts = rows.withColumn("starts", starts).withColumn("part", F.sum("starts").over(order))
    dealt = parts.select("key", "part", "t", "event_id").repartition("key", "part").sortWithinPartitions("key", "part", "t", "event_id")

    def follow(batches):
        at, filled = None, None
        for b in batches:
            fills = []
            for key, part, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                if (key, part) != at or t >= filled + life:
                    at, filled = (key, part), t
                    fills.append((t, False))
                else:
                    fills.append((filled, True))
            when, hit = zip(*fills) if fills else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(2), pa.array(hit, pa.bool_()), pa.array(when, pa.int64())], ["key", "event_id", "t", "hit", "filled"])

    told = dealt.mapInArrow(follow, f"key {rows.schema['key'].dataType.simpleString()}, event_id long, t long, hit boolean, filled long")
    return told.select("key", "event_id", F.timestamp_micros("t").alias("ts"), "hit", F.timestamp_micros("filled").alias("filled_at"))
