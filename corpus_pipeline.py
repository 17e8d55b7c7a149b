"""Corpus pipeline: documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows of the stage before; its
result is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.llm import mixing, near_copies, packing, quality_classifier, quality_rules
from threadline.llm.queries import vocabulary
from threadline.session import delete_path, ensure_checkpoint_dir


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.classify(docs, labels).filter("kept").select("doc.*")


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.judge(docs, labels).filter("kept").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return near_copies.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in a sequence; ids as a checksum."""
    pieces = packing.token_pieces(docs, vocabulary(), ["doc_id"])
    pieces = pieces.select("doc.doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack_pieces(pieces)


STAGES = [
    ("quality_classifier", classify_quality),
    ("quality_rules", apply_rules),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Token ids and trained evidence are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's folder goes once the next one is written."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete_path(spark, before)
        before = f"{folder}/{name}"
    return docs
