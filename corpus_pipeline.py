"""A corpus pipeline: quality, near-duplicates, benchmark passages, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontaminate, line_crf, packing, secret_scan, simhash
from strandline.llm.common import forget, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF accepts, learned from the labels of documents outside the held-out quarter."""
    model = line_crf.train(docs, table(spark, sf_dir, "labels"))
    return line_crf.score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: that of the smallest id, rows without id last.

    Rows are told apart by all their columns, so different texts under one id are judged one by one, and rows that
    are equal in every column count as one. Of several rows of the smallest id in a component, the one whose columns
    have the smallest MD5 stays.
    """
    content = F.md5(F.to_json(F.struct(*docs.columns)).cast("binary"))
    rows = docs.withColumn("_row", F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), content.alias("content")))
    found = simhash.near_duplicates(rows, "_row")
    first = found.where("_row = component_id").select("_row").distinct()
    # equal rows are merged on the map side, and the join reuses their partitioning
    return rows.dropDuplicates(["_row"]).join(first, "_row", "left_semi").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; ``n_chars`` follows the text."""
    scanned = secret_scan.scan_secrets(docs)
    text = F.when(F.col("text").isNotNull(), secret_scan.redact(F.col("text"), F.col("secret_masks")))
    clean = scanned.withColumn("text", text)
    changed = F.size("secret_spans") > 0
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token pieces packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", keep_one_of_each),
    ("decontaminate", drop_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack_tokens),
]
#: SQL cannot express the stages; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written, read again by the next, and then deleted."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
