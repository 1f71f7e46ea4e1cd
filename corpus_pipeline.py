"""A training corpus out of raw documents: five stages, each over all that its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hashloom.llm import mixing, pieces, quality, secrets, simhash
from hashloom.llm.common import scratch_dir
from hashloom.llm.queries import MODEL, WEIGHTS, domain, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; rows without doc_id are judged by their own statistics too."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least doc_id."""
    return simhash.keep_first(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are redacted in the text; every document stays."""
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the mixture's weights, once for each epoch that uses them."""
    return mixing.take(docs, domain(), WEIGHTS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text; null and empty texts have none, repeated rows each get a row, an empty table gives none."""
    return pieces.encode(docs, MODEL)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", tokenize),
]

#: No SQL: the learned rules and the segmentation are not expressible; tests compare the stages with plain versions where no rules are learned.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to shared storage and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = f"{scratch_dir(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
