"""Training-data pipeline: five stages over `documents`, each written as Parquet and reread.

Quality rules, one document per near-duplicate group, decontamination, mixing to target weights,
token-ID output. A stage works on all rows that its predecessor kept; all but the last return the
columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tokenloom.llm.common import text_hash
from tokenloom.llm.contract import END_ID, VOCAB_SIZE, sized, tokenizer_path
from tokenloom.llm.decontamination import decontaminate
from tokenloom.llm.mixing import expand_copies, mix_groups
from tokenloom.llm.quality_rules import quality_rules
from tokenloom.llm.shingle_join import first_of_components
from tokenloom.llm.token_store import read_store, write_store
from tokenloom.session import scratch_path, ship_package, stage_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Equal rows share a verdict."""
    found = quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    dropped = found.where(~F.col("kept")).select("doc_id", "text_hash").distinct()
    match = docs["doc_id"].eqNullSafe(dropped["doc_id"]) & text_hash(docs["text"]).eqNullSafe(dropped["text_hash"])
    return docs.join(dropped, match, "left_anti")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return first_of_components(docs, size=5, percent=75)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once, or up to three times."""
    # The row travels as one value: its columns can't clash with the operator's.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document")
    mixed = mix_groups(sized(docs, "doc_id", "source", row), "source", cap=3.0)
    return expand_copies(mixed).select("document.*")


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The written token store, read back: doc_id, start, n_tokens, ids_crc32 of each row."""
    path = scratch_path(spark, "pipeline-tokens")
    write_store(docs, path, tokenizer_path(), END_ID, VOCAB_SIZE)
    return read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID output", tokens_stage),
]

#: Scores, hashed n-grams and token ids have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
