"""Corpus and vocabulary to blocks of input and target ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tokenloom.operators.cleaning import clean_corpus, clean_prose, with_eos
from tokenloom.operators.encoding import encode_corpus
from tokenloom.operators.ordering import order_bounds, with_split
from tokenloom.operators.packing import batch_blocks, pack_blocks, shift_targets
from tokenloom.operators.vocabulary import Vocabulary
from tokenloom.session import stage_table

# Default workload sizes.
BLOCK_SIZE = 512
BATCH_SIZE = 3
VAL_SET_SIZE = 3_000


def encode_documents(
    corpus: DataFrame,
    vocab: Vocabulary,
    dropout_chance: float = 0.5,
    seed: int = 0,
    split_mode: str = "literal",
    code: bool = True,
) -> DataFrame:
    """`doc_id, ids, n_tokens` of the non-empty cleaned documents, end mark included."""
    clean = clean_corpus if code else clean_prose
    ready = with_eos(clean(corpus, dropout_chance, seed)).select("doc_id", "clean_text")
    return encode_corpus(ready, vocab, split_mode=split_mode).withColumn("n_tokens", F.size("ids"))


def training_blocks(
    corpus: DataFrame,
    vocab: Vocabulary,
    block_size: int = BLOCK_SIZE,
    batch_size: int = BATCH_SIZE,
    n_val: int = VAL_SET_SIZE,
    dropout_chance: float = 0.5,
    seed: int = 0,
    split_mode: str = "literal",
    code: bool = True,
    encoded_path: str | None = None,
) -> DataFrame:
    """`split, batch_id, block_id, x, y`; the first `n_val` documents form the `val` side.

    Cleaning and encoding run once: the encoded corpus is staged (at `encoded_path`, else in the
    shared folder), and the pass that places the documents reads its counts alone.
    """
    encoded = stage_table(
        encode_documents(corpus, vocab, dropout_chance, seed, split_mode, code), "encoded", encoded_path
    )
    sided = with_split(encoded, n_val, corpus)
    blocks = pack_blocks(sided, block_size, ("split",), bounds=order_bounds(corpus, "doc_id"))
    return batch_blocks(shift_targets(blocks), batch_size)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Blocks as Parquet, one folder per split. `x` and `y` overlap, so their ids are kept once."""
    chunk = F.concat(F.slice("x", 1, 1), F.col("y")).alias("chunk")
    rows = blocks.select("split", "batch_id", "block_id", chunk)
    rows.write.mode("errorifexists").partitionBy("split").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    schema = "batch_id long, block_id long, chunk array<int>, split string"
    return shift_targets(spark.read.schema(schema).parquet(path))
