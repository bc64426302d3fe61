"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and
read again as the next stage's docs.  Part of the subpackage helixframe.llm.

Edge cases, in every stage: an empty table gives an empty result; columns other than those of documents are
left out, whatever their names; a null text counts as empty for the classifier, has no lines to drop, equals
other texts without shingles in near-dedup, holds no benchmark item and has no tokens; rows with a null
doc_id are scored, never edited, kept by near-dedup and mixed like any other; repeated rows share one
doc_id and therefore one fate.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontam, lines, mixing, quality, simhash
from helixframe.llm.common import shared_dir
from helixframe.plans.staging import delete
from helixframe.sources.tables import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of 0.3 or more)."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs.select(*COLUMNS), model).where("score >= 0.3").drop("score")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text.  A null text stays null."""
    return lines.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group at similarity 0.8 on five-word shingles.

    Rows without a doc_id are kept.
    """
    gone = simhash.near_duplicates(docs).where("doc_id != group_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.select(*COLUMNS).join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, with epoch, block, order_key, n_tokens."""
    return mixing.mix_sources(docs.select(*COLUMNS))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix),
]

#: The classifier's compression and the fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is between stages lies in the shared folder."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for i, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{i}")
            if i:
                delete(spark, f"{base}/{i - 1}")  # its only reader is written
            docs = spark.read.schema(docs.schema).parquet(f"{base}/{i}")
    return docs
