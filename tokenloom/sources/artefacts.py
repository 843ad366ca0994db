"""What the jobs leave behind: clean text, the prepared corpus, the vocabulary."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tokenloom.operators.segments import SPECIAL_TOKENS, UNKNOWN
from tokenloom.operators.vocabulary import MERGE_SCHEMA, VOCAB_SCHEMA, Vocabulary
from tokenloom.session import stage_table


def write_clean_text(cleaned: DataFrame, path: str, order: str = "doc_id") -> None:
    """Text part files in document order; every document ends with a newline, empty ones too.

    Range partitioning looks at its input twice, so the cleaned text is staged first.
    """
    staged = stage_table(cleaned.select(order, "clean_text"), "clean")
    ordered = staged.repartitionByRange(order).sortWithinPartitions(order)
    ordered.select("clean_text").write.mode("errorifexists").option("lineSep", "\n").text(path)


def read_clean_text(spark: SparkSession, path: str) -> DataFrame:
    """The lines of written clean text, as `line`."""
    return spark.read.option("lineSep", "\n").text(path).withColumnRenamed("value", "line")


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a job finished writing `path`."""
    try:
        spark.read.format("binaryFile").load(f"{path}/_SUCCESS").schema
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def reuse_clean_corpus(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The corpus prepared at `path`, built first if it is not there.

    A folder that an interrupted job left half written is not taken over and not overwritten.
    """
    if not is_complete(spark, path):
        build().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def save_tokenizer(vocab: Vocabulary, spark: SparkSession, path: str) -> None:
    # Bounded by the vocabulary size: one file each.
    vocab.vocab_table(spark).coalesce(1).write.mode("errorifexists").parquet(f"{path}/vocab")
    vocab.merge_table(spark).coalesce(1).write.mode("errorifexists").parquet(f"{path}/merges")


def load_tokenizer(spark: SparkSession, path: str) -> Vocabulary:
    return Vocabulary.from_tables(
        spark.read.schema(VOCAB_SCHEMA).parquet(f"{path}/vocab"),
        spark.read.schema(MERGE_SCHEMA).parquet(f"{path}/merges"),
    )


def to_exchange(vocab: Vocabulary, split_mode: str = "literal") -> str:
    """The vocabulary as the JSON text of the public `tokenizers` library; bounded by its size.

    In the literal mode the pattern is a plain string there, which never occurs: texts stay whole.
    """
    pattern = "(" + "|".join((*SPECIAL_TOKENS[1:], r"\n")) + ")"
    specials = [
        {"id": i, "content": t, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
        for t, i in sorted(vocab.ids().items(), key=lambda x: x[1])
        if t in vocab.specials
    ]
    model = {
        "type": "BPE", "dropout": None, "unk_token": UNKNOWN, "continuing_subword_prefix": None,
        "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
        "vocab": vocab.ids(), "merges": [[vocab.tokens[a], vocab.tokens[b]] for a, b, _ in vocab.merges],
    }
    split = {
        "type": "Split", "pattern": {"String" if split_mode == "literal" else "Regex": pattern},
        "behavior": "Isolated", "invert": False,
    }
    rest = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": specials, "normalizer": None}
    return json.dumps(rest | {"pre_tokenizer": split, "post_processor": None, "decoder": None, "model": model}, ensure_ascii=False)


def from_exchange(text: str) -> Vocabulary:
    """A vocabulary from such a text. Ids must be dense; merges are pairs or space-separated."""
    read = json.loads(text)
    ids = read["model"]["vocab"] | {t["content"]: t["id"] for t in read.get("added_tokens", ())}
    tokens = tuple(sorted(ids, key=ids.get))
    if [ids[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("vocabulary ids must be dense and start at 0")
    pairs = [m.split(" ") if isinstance(m, str) else m for m in read["model"]["merges"]]
    merges = tuple((ids[a], ids[b], ids[a + b]) for a, b in pairs)
    specials = {t["content"] for t in read.get("added_tokens", ()) if t["special"]}
    return Vocabulary(tokens, merges, tuple(t for t in tokens if t in specials))
