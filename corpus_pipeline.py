"""A training corpus from ``documents``: toxic documents and near copies go, benchmark passages go, sources are mixed to
target weights, and the rows are dealt to shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet into the shared
folder and reads it again for the next one, so a lost executor costs a read of the last stage's table.  All stages but
the last return the columns of ``documents`` (a document that the mix takes twice is there twice).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, mixing, neardup, sharding, toxicity
from weftline.llm.common import written
from weftline.llm.queries import MIX, ORACLES, QUERIES, SHARDS, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the folded lexicon scores below its threshold."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return neardup.drop_near_duplicates(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"), coverage=0.0)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source up to its target, twice where the target is larger than the source."""
    return mixing.mixed(docs, **MIX)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row of the mix."""
    return sharding.shard_documents(docs, shards=SHARDS)


STAGES = [
    ("toxicity", toxic),
    ("minhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark_passages),
    ("mixing", mixture),
    ("sharding", shards),
]

#: A learned score and components of links can't be said in SQL; tests/llm hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


LLM_QUERIES = {**QUERIES, "pipeline": run}
LLM_ORACLES = dict(ORACLES) | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
