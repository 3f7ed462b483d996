"""Notices from a stream of events: each micro-batch is matched, freed of what was sent, and put into the ledger.

The ledger has one folder a batch, overwritten when a batch is run again, so a restart neither loses nor repeats a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import notify

LEDGER = "event_id long, chat_id string, status string, batch long"


def deliveries(spark: SparkSession, ledger: str) -> DataFrame:
    """All results so far; of an event and chat the last one."""
    rows = spark.read.schema(LEDGER).parquet(ledger)
    return rows.groupBy("event_id", "chat_id").agg(F.max_by("status", "batch").alias("status"))


def notices(events: DataFrame, subscribers: DataFrame, ledger: str, checkpoint: str, send: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Runs over the events available now. send: event_id and chat_id to the same with a status, sent or error.

    A failed notice is tried again when its event is seen again, since only sent ones are left out.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        spark.createDataFrame([], LEDGER).write.mode("append").partitionBy("batch").parquet(ledger)  # the folder exists
        before = spark.read.schema(LEDGER).parquet(ledger).filter(F.col("batch") != number)
        left = notify.unsent(notify.matched(rows, subscribers), before)
        send(left).select("event_id", "chat_id", "status").write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
