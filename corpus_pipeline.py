"""Corpus pipeline: toxicity, near duplicates, decontamination, surrogates, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all documents that the stage before kept; its
result is written as Parquet and reread as the next stage's documents. All but the last return the columns of
documents. Stages only drop documents that their operator rejects: toxic ones, all but one of each group of near
duplicates, contaminated ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from survkit.llm import decontam, jaccard, packing, pii, toxicity
from survkit.llm.common import crc_mod, free_name, read, shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity score reaches the threshold; learnt from labels as in the operator's query."""
    learn = ~F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), learn)
    name = free_name(docs.columns, "toxicity")
    return toxicity.score(docs, model, name).where(F.col(name) < toxicity.THRESHOLD).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove(docs, read(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace(docs, pii.TABLES_KEY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", contaminated),
    ("pii", surrogates),
    ("packing", pack),
]

#: Stages by a fitted model, hashing and a tokenizer have no SQL; tests/llm checks them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
