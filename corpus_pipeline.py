"""A training corpus from raw documents: good ones, one of each near-copy, without repeated passages, mixed and packed.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept and is stored before the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rillflow.llm import mixing, packing, quality, simhash, suffix
from rillflow.llm.common import remove, shared_dir
from rillflow.llm.queries import labelled, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the table of labels, doesn't reject."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link."""
    return simhash.one_of_each(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words that also stand elsewhere: stretches covered by strings of 200 bytes that start anywhere else."""
    return suffix.remove_repeated(docs, 200, 50)


def balanced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages nearer to each other: rare ones are repeated, nothing is dropped."""
    return mixing.mixed(docs, labelled(docs, table(spark, sf_dir, "labels")), keep_all=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: where each piece of each document goes."""
    return packing.pack_documents(docs)


STAGES = [("quality", good), ("simhash", distinct), ("suffix", unrepeated), ("mixing", balanced), ("packing", packed)]
#: Trained models, groups and packing are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each stored as Parquet and read again as the next one's docs; only the last one's rows are left."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if k:
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
