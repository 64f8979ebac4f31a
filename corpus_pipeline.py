"""A corpus from documents, in five stages: toxicity, near duplicates, benchmark contamination, personal data, segmentation.

Each stage works on all rows that the one before kept. What it gives is
written as Parquet to the folder that the cluster shares and read again.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, near_dedup, pii, sentencepiece_sampling, toxicity
from tessera.llm.common import packed, removed, shared_folder

TOXIC = 0.3


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC stay.

    An empty or null text has the score of no feature; equal texts, also those
    that tie with TOXIC, share one fate. Texts of any length are read whole.
    Other columns may have any name. An empty table stays one.
    """
    rows = packed(docs)
    learnt = toxicity.fit(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return learnt.scores(rows, keep=["row"]).filter(F.col("__score") < TOXIC).select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one document stays: that with the least id, or else without an id, and of those the one with the least hash of its text.

    Rows of one id with unlike texts are documents of their own; equal rows are
    copies. All texts without words (null, empty, blank) are one class. Other
    columns may have any name. An empty table stays one.
    """
    return near_dedup.survivors(packed(docs), keep=["row"]).select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated stay.

    Texts without words stay; equal texts share one fate, with no id too. Texts
    of any length are read whole. Other columns may have any name. An empty
    table, or an empty benchmark, changes nothing.
    """
    judged = decontamination.decontaminate(packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["row"])
    return judged.filter("NOT contaminated").select("row.*")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data gives way to its kind, and n_chars, if there is one, follows.

    Null and empty texts stay as they are, equal texts get equal results. Other
    columns may have any name. An empty table stays one.
    """
    clean = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))


def segmentation_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, lossless, ids) of every document; null and empty texts have no pieces, equal rows equal ones."""
    return sentencepiece_sampling.encode(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("sentencepiece", segmentation_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage makes of the documents. What a stage read goes once the next is written; the last stage's input stays for the result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            removed(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)


#: The toxicity and segmentation stages have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
