"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, secrets, mixing. Each stage works on all rows that the one before kept.

Null texts count as empty. Stages decide on each row by a key of its own, so rows without a doc_id, or with one that others have too, are judged like any other."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import decontamination, jaccard, mixing, secret_scan, toxicity
from lumenframe.llm.common import MADE, release, shared_dir, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Names one row, also where doc_id is null or repeated. The first stage adds it, the last one drops it.
ROW = "pipeline_row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rowed(docs: DataFrame) -> DataFrame:
    """docs with COLUMNS and ROW. Rows that bring no key get one and are written, so that every reading sees the same keys."""
    if ROW in docs.columns:
        return docs.select(*COLUMNS, ROW)
    return written(docs.select(*COLUMNS).withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows")


def toxicity_stage(spark, docs, sf_dir) -> DataFrame:
    """Drops documents that score as toxic by a model from the labels."""
    docs = docs.select(*COLUMNS)
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).filter("predicted = 0").select(*COLUMNS, F.monotonically_increasing_id().alias(ROW))


def jaccard_stage(spark, docs, sf_dir) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles, keeps the one of the smallest id (null last; of one
    id, the one of least hash). Documents without words link with nothing."""
    docs = rowed(docs)
    groups = jaccard.JaccardJoin(5, 80).run(docs.select(F.col(ROW).alias("doc_id"), "text"), "pipeline_jaccard").filter("size > 0")
    groups = written(groups.select(F.col("doc_id").alias(ROW), F.col("component_id").alias("component")), "pipeline-groups")
    order = docs.select(ROW, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text", "lang", "source", "n_chars").alias("hash"), ROW).alias("place"))
    # One least place a component, found before rows move; then rows meet by their own key, so a large component is in no one task.
    first = groups.join(order, ROW).groupBy("component").agg(F.min("place").alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    return docs.join(groups.select(ROW).join(first, ROW, "left_anti"), ROW, "left_anti").select(*COLUMNS, ROW)


def decontamination_stage(spark, docs, sf_dir) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    docs = rowed(docs)
    named = docs.select(F.col(ROW).alias("doc_id"), "text")
    hit = decontamination.contaminated(named, table(spark, sf_dir, "benchmark")).filter("n_hit > 0").select(F.col("doc_id").alias(ROW))
    return docs.join(hit, ROW, "left_anti").select(*COLUMNS, ROW)


def secrets_stage(spark, docs, sf_dir) -> DataFrame:
    """Replaces secrets by a mark; every document stays."""
    docs = rowed(docs)
    out = secret_scan.redacted(docs, secret_scan.trained(docs.select("doc_id", "text")))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS, ROW)


def mixing_stage(spark, docs, sf_dir) -> DataFrame:
    """The mix: documents that it takes, with copies and taken words."""
    docs = rowed(docs)
    mix = mixing.mixed(docs, carry=(ROW,)).filter("copies > 0").select(ROW, "copies", "taken")
    return docs.join(mix, ROW).select(*COLUMNS, "copies", "taken")


STAGES = [
    ("toxicity", toxicity_stage),
    ("jaccard", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]
#: SQL cannot train the models of two stages; tests hold jaccard, decontamination and mixing against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        before = len(MADE)
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        release(spark, before)  # what the stage wrote on the way
    return docs
