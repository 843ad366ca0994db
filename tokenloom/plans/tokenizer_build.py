"""Corpus to vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tokenloom.operators.cleaning import clean_corpus, clean_prose
from tokenloom.operators.ordering import take_docs
from tokenloom.operators.segments import segment_corpus
from tokenloom.operators.training import train_bpe
from tokenloom.operators.vocabulary import Vocabulary
from tokenloom.session import scratch_path
from tokenloom.sources.artefacts import reuse_clean_corpus

# Default workload sizes.
NUM_SAMPLES = 50_000
VOCAB_SIZE = 16_384


def prepare_text(corpus: DataFrame, num_samples: int | None, dropout_chance: float, seed: int, code: bool):
    """Cleaned documents of the sample (all of them where `num_samples` is None)."""
    sample = corpus if num_samples is None else take_docs(corpus, num_samples)
    clean = clean_corpus if code else clean_prose
    return clean(sample, dropout_chance, seed).select("doc_id", "clean_text")


def build_tokenizer(
    corpus: DataFrame,
    num_samples: int | None = NUM_SAMPLES,
    vocab_size: int = VOCAB_SIZE,
    dropout_chance: float = 0.5,
    seed: int = 0,
    split_mode: str = "literal",
    code: bool = True,
    clean_path: str | None = None,
) -> Vocabulary:
    """Clean the sample once, keep it (at `clean_path` for later runs), learn the merges."""
    spark = corpus.sparkSession
    path = clean_path or scratch_path(spark, "clean")
    cleaned = reuse_clean_corpus(
        spark, path, lambda: prepare_text(corpus, num_samples, dropout_chance, seed, code)
    )
    return train_bpe(segment_corpus(cleaned, split_mode=split_mode), vocab_size)
