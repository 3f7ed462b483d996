"""Syncs in which every source stands alone: one that fails keeps the rows it had and gets a run with its error.

A source's new rows are staged in a folder of their own. Only when they are written whole is a run appended to the manifest,
one small file that names the folder; what readers see of a source is the folder of its last good run. Nothing is overwritten, so a
reader or a sync that is lost midway leaves all sources as they were.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "source_key string, at timestamp, status string, error string, folder string, n long"
#: Characters of an error that a run keeps.
ERROR = 500


def runs(spark: SparkSession, store: str) -> DataFrame:
    spark.createDataFrame([], RUNS).write.mode("append").parquet(f"{store}/manifest")  # the folder exists
    return spark.read.schema(RUNS).parquet(f"{store}/manifest")


def _good(spark: SparkSession, store: str) -> dict[str, str]:
    """Folder of the last good run of each source; a row a source."""
    good = runs(spark, store).filter("status = 'ok'").groupBy("source_key").agg(F.max_by("folder", F.struct("at", "folder")).alias("folder"))
    return {r.source_key: r.folder for r in good.collect()}


def state(spark: SparkSession, store: str, schema, keys: Iterable[str] | None = None) -> DataFrame:
    """Rows of all sources, or of some, as their last good runs left them."""
    good = _good(spark, store)
    folders = sorted(f for k, f in good.items() if keys is None or k in keys)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{store}/{f}" for f in folders])


def sync(
    spark: SparkSession, store: str, schema, sources: dict[str, Callable[[DataFrame], DataFrame]], now, least: dict[str, int] | None = None, threads: int = 4
) -> DataFrame:
    """Run each source's function (its rows so far to its rows from now on) and return the runs of this sync.

    A function that raises, a plan that fails while it is written, and fewer rows than ``least`` asks for are errors of that
    source alone. now: a datetime, the same for all.
    """
    good = _good(spark, store)

    def one(key: str) -> tuple:
        folder = f"rows/{key}/{uuid.uuid4().hex}"
        try:
            before = spark.read.schema(schema).parquet(f"{store}/{good[key]}") if key in good else spark.createDataFrame([], schema)
            sources[key](before).write.parquet(f"{store}/{folder}")
            n = spark.read.schema(schema).parquet(f"{store}/{folder}").count()
            if n < (least or {}).get(key, 0):
                raise ValueError(f"{n} rows, at least {least[key]} expected")
        except Exception as wrong:  # noqa: BLE001 any failure is this source's own
            return key, now, "error", f"{type(wrong).__name__}: {wrong}"[:ERROR], None, None
        return key, now, "ok", None, folder, n

    with ThreadPoolExecutor(threads) as pool:
        done = list(pool.map(one, sorted(sources)))
    told = spark.createDataFrame(done, RUNS)
    told.coalesce(1).write.mode("append").parquet(f"{store}/manifest")
    return told
