"""Streaming forms: fixed-window rate limits with a watermark, and new events matched behind a checkpointed cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lifecycle import rate_limit


def stream_rate_limit(events: DataFrame, limit: int = 3, late: str = "10 minutes") -> DataFrame:
    """rate_limit over a stream; windows close once the watermark passes them."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rate_limit(timed.withWatermark("ts", late), limit)


def new_events(spark: SparkSession, path: str, schema, kinds: tuple[str, ...]) -> DataFrame:
    """Events of some kinds from files as they arrive; the checkpoint is the cursor."""
    return spark.readStream.schema(schema).parquet(path).filter(F.col("event_type").isin(*kinds))


def drain(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Everything available now into parquet, exactly once."""
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return query.outputMode("append").trigger(availableNow=True).start()
