"""Sources: the catalogue's tables, and generic readers for nested JSON and delimited listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as job rows: source, id, title (first line), company, location, description, and labelled state."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    state = labels.select("doc_id", "quality", "toxic")
    return docs.join(state, "doc_id", "left").select(
        F.col("source").alias("source_key"),
        F.col("doc_id").alias("external_id"),
        F.col("source").alias("company"),
        F.split("text", "\n")[0].alias("title"),
        F.col("lang").alias("location"),
        F.col("text").alias("description"),
        (F.coalesce("quality", F.lit(1)) == 1).alias("active"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("stale"),
    )


def json_records(raw: DataFrame, column: str, schema: T.StructType, path: str) -> DataFrame:
    """Rows of an array inside JSON texts: one row an element, malformed texts give none."""
    parsed = F.from_json(F.col(column), schema)
    return raw.select(F.explode(parsed[path] if path else parsed).alias("r")).select("r.*")


def epoch_millis_iso(ms: Column) -> Column:
    """Epoch milliseconds as ISO-8601 UTC."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_catalogue(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Sink with Spark's own commit protocol; csv has a header even when there are no rows."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv if fmt == "csv" else writer.json if fmt == "json" else writer.parquet)(path)
