"""The corpus pipeline: five stages, each by one operator, over whole documents.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame, which the caller writes as Parquet and reads
again as the next stage's docs. All but the last return the columns of documents.

Null, empty and very long texts, null ids, sources and languages, repeated rows and empty tables go through all stages:
what is empty is neither toxic (it has the rate of label 1) nor a copy nor contaminated, and has no words to mix, so
mixing leaves it out. Columns beyond those of documents are dropped by the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm import decontaminate, minhash, mixing, sharding, toxicity
from seamline.llm.common import shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if its score is at least this.
REJECT = 0.5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    # Texts are read twice here, rather than stored a second time beside their terms.
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < REJECT).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the least doc_id, once. Rows without doc_id go if an exact copy stays."""
    docs = docs.select(*COLUMNS)
    found = minhash.near_duplicates(docs)
    gone = found.where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("gone")).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti")
    # Rows that say the same under the same id, or under none beside one with an id; hardly ever any.
    digest = F.md5(F.coalesce("text", F.lit("")))
    said = docs.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("doc_id", digest.alias("digest"))
    nameless = said.where("doc_id is null").select("digest").distinct()
    named = said.where("doc_id is not null").join(nameless, "digest", "left_semi").select("digest").distinct()
    again = said.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "digest")
    again = again.unionByName(named.withColumn("doc_id", F.lit(None).cast("long"))).distinct()
    again = again.select(F.col("doc_id").alias("a_id"), F.col("digest").alias("a_digest"))
    is_again = F.col("doc_id").eqNullSafe(F.col("a_id")) & (digest == F.col("a_digest"))
    once = left.join(again, is_again, "left_semi").withColumn("digest", digest)
    once = once.join(named.withColumn("has_id", F.lit(True)), "digest", "left").where("doc_id is not null or has_id is null")
    names = F.struct(*[c for c in COLUMNS if c != "doc_id"])
    once = once.groupBy("doc_id", "digest").agg(F.min(names).alias("r")).select("doc_id", "r.*").select(*COLUMNS)
    return left.join(again, is_again, "left_anti").select(*COLUMNS).unionByName(once)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("spans") == 0).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat(docs.select(*COLUMNS))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, keep=COLUMNS)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Block-max search and exact sets over all texts have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows lie in the shared folder of spark.checkpoint.dir."""
    at = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
