"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as
Parquet in the shared folder and reads it again for the next stage.  All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyfold.llm import mixing, near_dedup, packing, quality_rules, secrets
from keyfold.llm._tables import Scratch, documents
from keyfold.llm.queries import vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are more likely bad than good go."""
    return quality_rules.keep_good(docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (similarity 0.8 or more) the document with the smallest doc_id stays.

    Rows that repeat it stay with it; a null doc_id is in no group and stays.
    """
    gone = near_dedup.near_duplicates(docs, percent=80).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become a mark; no document goes."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or in up to three rows.

    Rows of one doc_id share what the mix takes of them, those with the smaller texts first.
    """
    copies = mixing.mix(docs).groupBy(F.col("doc_id").alias("mixed_id")).agg(F.sum("copies").alias("mixed_total"), F.count("*").alias("mixed_rows")).where("mixed_total > 0")
    share = lambda which: docs.join(copies.where(which), docs["doc_id"].eqNullSafe(copies["mixed_id"]))
    out = share("mixed_rows = 1").withColumn("mixed_times", F.col("mixed_total"))
    if not copies.where("mixed_rows > 1").isEmpty():
        place = F.row_number().over(Window.partitionBy("mixed_id").orderBy(docs["text"])) - 1
        several = share("mixed_rows > 1").withColumn("mixed_place", place)
        times = F.floor(F.col("mixed_total") / F.col("mixed_rows")) + (F.col("mixed_place") < F.col("mixed_total") % F.col("mixed_rows")).cast("long")
        out = out.union(several.withColumn("mixed_times", times).drop("mixed_place"))
    out = out.where("mixed_times > 0").withColumn("mixed_copy", F.explode(F.sequence(F.lit(1).cast("long"), "mixed_times")))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", keep_good),
    ("near-duplicates", keep_one),
    ("secret scans", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Automata, pivotal rounding and packing are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = documents(spark, sf_dir), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage{k}")
    return docs
