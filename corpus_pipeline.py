"""Corpus pipeline: quality rules, near-duplicate removal, decontamination, secret redaction, tokenisation.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept. Each operator's docstring defines
the odd cases. A stage's table is deleted when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm import bpe
from hirelake.llm.common import cut, discard, ids_clash, row_numbers, table
from hirelake.llm.decontamination import decontaminate
from hirelake.llm.jaccard_join import jaccard_join
from hirelake.llm.quality_rules import quality_rules
from hirelake.llm.queries import tokenizer_path
from hirelake.llm.secret_scan import secret_scan


def _bare(docs: DataFrame) -> DataFrame:
    """docs under names no operator uses: text, and c0, c1, ... by position, so that no column of docs can clash."""
    return docs.toDF(*["text" if n == "text" else f"c{i}" for i, n in enumerate(docs.columns)])


def _named(out: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs again, text taken from ``text``, and n_chars its length where the text was changed."""

    def column(i: int, name: str):
        if name == "text":
            return F.when(F.col("text").isNotNull(), F.col(text))
        if name == "n_chars" and text != "text":
            return F.when(F.col("text").isNotNull(), F.length(text).cast("long"))
        return F.col(f"c{i}")

    return out.select(*[column(i, n).alias(n) for i, n in enumerate(docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; failing lines of the others go."""
    return _named(quality_rules(_bare(docs)).filter("kept"), docs, "cleaned_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 the document with the smallest id stays.

    Rows without an id count as the smallest, and rows that share an id are documents of their own, the one whose text
    has the smaller SHA-256 counting as the smaller; of rows that share both one, any, stays.
    """
    shown, docs = docs.columns, _bare(docs)
    docs = docs.withColumnRenamed(f"c{shown.index('doc_id')}", "doc_id")
    row = "row" if ids_clash(docs) else "doc_id"
    if row == "row":
        docs = row_numbers(docs)
    found = jaccard_join(docs.select(F.col(row).alias("doc_id"), "text"), k=5, num=80, den=100)
    first = found.filter("doc_id = component_id").select(F.col("doc_id").alias(row))
    return docs.join(first, row, "left_semi").select([n for n in docs.columns if n != "row"]).toDF(*shown)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verified benchmark item go."""
    return _named(decontaminate(_bare(docs), table(spark, sf_dir, "benchmark")).filter("not contaminated"), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    return _named(secret_scan(_bare(docs)), docs, "redacted_text")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids (little-endian unsigned 32-bit) with their number and the digest of their decoding."""
    coded = bpe.bpe_encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path())
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secrets),
    ("bpe", tokenise),
]
#: Similarity groups, BM25 retrieval and tokenisation have no SQL; tests hold run() against plain versions of all stages after the first.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{name}")
            if number:
                discard(before)
    return docs
