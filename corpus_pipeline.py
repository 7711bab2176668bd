"""A corpus pipeline over ``documents``: toxicity, line dedup, MinHash near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``run`` writes every stage's result
to the shared folder and rereads it, so that a lost executor costs a stage's tasks and no more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import lines, minhash, mixing, packing, toxicity
from lodestone.workdir import Stash


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents over the toxicity threshold go."""
    return toxicity.reject(docs, toxicity.sample_of(spark, sf_dir))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: lines that an earlier line equals or nearly equals go, and documents that have none left."""
    return lines.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each group of near copies stays."""
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: blocks of each source up to its quota."""
    return mixing.mix(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: what is left, in bins of equal capacity."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: A recurrent network and a linear program are beyond SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each one's result is a Parquet table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stash = Stash(spark)
    for _, stage in STAGES:
        docs = stash.put(stage(spark, docs, sf_dir))
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
