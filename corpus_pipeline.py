"""A corpus pipeline of five stages: quality rules, toxicity, near-dedup, substring dedup, packing.

Each stage takes what its predecessor kept and writes Parquet; all but the last return the columns of
`documents`. Classifiers and cutoffs are fitted on the labelled documents of the table at sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm import minhash, packing, quality, substring, toxicity
from deltaloom.llm.common import stage
from deltaloom.llm.queries import CLEAN_SAMPLE, TOXIC_SAMPLE, WORD_BPE


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor a certified cutoff rejects."""
    # Measured twice, for the rules and for the verdict: cheaper than moving texts to their labels.
    measured = stage(quality.measure(docs, ["doc_id"]), "measured")
    rules = quality.learn_rules(measured, _labels(spark, sf_dir))
    return quality.passing(docs, rules)


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic."""
    model = toxicity.fit(*toxicity.sample_labelled(docs, _labels(spark, sf_dir), TOXIC_SAMPLE, CLEAN_SAMPLE))
    return toxicity.without_toxic(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the smallest doc_id."""
    return minhash.first_of_each_class(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document has; n_chars follows the text."""
    cleaned = substring.without_repeats(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack(docs, WORD_BPE, end_id=0, capacity=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_filter),
    ("minhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]

#: No stage after the base rules can be stated in SQL: the chain is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
