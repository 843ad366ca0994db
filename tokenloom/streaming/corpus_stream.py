"""The corpus as a stream of files, cleaned and encoded row by row without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tokenloom.operators.cleaning import clean_corpus, clean_prose, with_eos
from tokenloom.operators.encoding import encode_corpus
from tokenloom.operators.vocabulary import Vocabulary


def corpus_stream(
    spark: SparkSession,
    path: str,
    files_per_trigger: int = 1000,
    pattern: str = "*.parquet",
    text: str = "text",
    partitions: int | None = None,
) -> DataFrame:
    """`doc_id, content` of the files as they arrive.

    `partitions` spreads a micro-batch of few files over the cores before the work on it.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField(text, T.StringType())])
    rows = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", pattern)
        .parquet(path)
    )
    corpus = rows.select("doc_id", F.col(text).alias("content"))
    return corpus.repartition(partitions, "doc_id") if partitions else corpus


def stream_clean(
    stream: DataFrame, dropout_chance: float = 0.5, seed: int = 0, code: bool = True
) -> DataFrame:
    """Non-empty cleaned documents with their end mark."""
    clean = clean_corpus if code else clean_prose
    return with_eos(clean(stream, dropout_chance, seed)).select("doc_id", "clean_text")


def stream_encode(cleaned: DataFrame, vocab: Vocabulary, split_mode: str = "literal") -> DataFrame:
    return encode_corpus(cleaned, vocab, split_mode=split_mode)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all files there are, then stop; a rerun with the same checkpoint goes on from there."""
    (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
