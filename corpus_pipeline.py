"""The corpus pipeline: drop toxic documents, keep one of each group of near copies, cut long repeats, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duochron.llm import oddsketch, packing, repeats, toxicity
from duochron.llm.common import stage
from duochron.llm.queries import held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is below one half; the model learns from the labels of these documents."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), train=~held_out(5, 0))
    return toxicity.clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group that five-word shingles link at a similarity of 0.8 or more."""
    return oddsketch.one_of_each(docs, size=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the stretches of over 50 words that other documents hold too (made of 200-byte strings; 51 words are seldom shorter)."""
    return repeats.cut(docs, repeats.SHORT, across=True, words=repeats.PASSAGE).withColumn("n_chars", F.length("text").cast("bigint"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("minhash near-dedup", drop_near_copies), ("suffix-array dedup", cut_repeats), ("best-fit packing", pack)]

#: SQL expresses none of the stages; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
