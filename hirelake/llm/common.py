"""Column expressions and table cutting shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word: the complement of ``[^\x20\x09-\x0D]``.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: With this, Spark deletes a query's shuffle files when the query is over, not when the driver's heap is next swept.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text (null: none), split at ASCII white space only."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, so a lambda inside may refer to it freely."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The application's folder in the one all executors share, ``spark.checkpoint.dir``.

    Unset, it is a temporary folder in local mode and an error on a cluster, where no other folder is surely shared.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if named:
        return f"{named.rstrip('/')}/hirelake-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="hirelake-")
    return _OWN[app]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and that no later step reads."""
    for t in tables:
        _delete(t.sparkSession, t.cut_path)


def clean(spark: SparkSession) -> None:
    """Delete all tables that this application's operators wrote. Call it when their results are written."""
    _delete(spark, shared_dir(spark))


def row_numbers(docs: DataFrame, key: str = "doc_id", text: str = "text", row: str = "row") -> DataFrame:
    """docs with a number for each row, in the order of key (null first), the text's digest and the other columns' hash.

    The sorted table is written, so numbers never change afterwards; no sort key is hot, since the place of a row in the
    input comes last and parts only rows that are equal throughout.
    """
    others = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in docs.columns]), {"ignoreNullFields": "false"}))
    place = unused(docs, "place")
    order = [F.col(key).asc_nulls_first(), F.sha2(text, 256).asc_nulls_first(), others, F.col(place)]
    placed = docs.withColumn(place, F.monotonically_increasing_id()).orderBy(*order).drop(place)
    return cut(placed.withColumn(row, F.monotonically_increasing_id()), "rows")


def ids_clash(docs: DataFrame, key: str = "doc_id") -> bool:
    """Whether rows share a key or lack it, so that the key can't name a row."""
    seen = docs.groupBy(key).agg(F.count(F.lit(1)).alias("m")).filter((F.col("m") > 1) | F.col(key).isNull())
    return bool(seen.limit(1).count())


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem = "_" + stem
    return stem


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns: whatever else the table carries can't clash with working names."""
    return df.select(*columns)
