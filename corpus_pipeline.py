"""A training corpus from documents: stages that each take and return a table of documents, the last one its result."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from slotward.llm import common, decontamination, minhash, pii, segmentation, toxicity
from slotward.llm.queries import tokenizer
from slotward.session import fresh_path

#: The last stage samples segmentations; a model and a random draw have no SQL.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    found = toxicity.detect(docs, common.table(spark, sf_dir, "labels"))
    return found.filter("predicted = 0").select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate class."""
    return minhash.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the new text."""
    spans = common.pinned(pii.annotated(docs).select("_spans"))
    found = pii.masked(docs, pii.fit(pii.patterns(spans)))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def segmentation_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document that is left."""
    return segmentation.digests(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("segmentation", segmentation_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written to the shared folder and read by the next."""

    def step(docs: DataFrame, stage) -> DataFrame:
        name, apply = stage
        path = fresh_path(spark, f"pipeline-{name}")
        apply(spark, docs, sf_dir).write.parquet(path)
        return spark.read.parquet(path)

    return functools.reduce(step, STAGES, common.table(spark, sf_dir, "documents"))
