"""Whole-document cleaning as table operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tokenloom.functions.lexemes import clean_lexemes
from tokenloom.functions.text import append_eos, finish_text, sanitize_text
from tokenloom.operators.lexing import lex_documents


def clean_corpus(
    corpus: DataFrame, dropout_chance: float = 0.5, seed: int = 0, text: str = "content"
) -> DataFrame:
    """`doc_id, clean_text, lex_ok`: a document that does not lex becomes the empty text.

    Null contents stay out; `clean_audit` counts them.
    """
    safe = corpus.where(F.col(text).isNotNull()).select("doc_id", sanitize_text(F.col(text)).alias("content"))
    lexed = lex_documents(safe)
    cleaned = finish_text(
        clean_lexemes(F.col("lex"), F.col("doc_lines")), F.col("doc_id"), dropout_chance, seed
    )
    return lexed.select("doc_id", F.when(F.col("lex_ok"), cleaned).otherwise("").alias("clean_text"), "lex_ok")


def clean_prose(
    corpus: DataFrame, dropout_chance: float = 0.0, seed: int = 0, text: str = "content"
) -> DataFrame:
    """The character and line rules alone, for text that is not source code. Stays in the JVM."""
    cleaned = finish_text(sanitize_text(F.col(text)), F.col("doc_id"), dropout_chance, seed)
    return corpus.where(F.col(text).isNotNull()).select("doc_id", cleaned.alias("clean_text"))


def drop_empty_docs(cleaned: DataFrame) -> DataFrame:
    """Documents with text left.

    A plain filter would sink below the projection and compute every text twice, once to test
    it and once to keep it. Unfolding a list of one or none computes it once.
    """
    kept = F.filter(F.array("clean_text"), lambda text: text != "")
    others = [c for c in cleaned.columns if c != "clean_text"]
    return cleaned.select(*others, F.explode(kept).alias("clean_text")).select(*cleaned.columns)


def with_eos(cleaned: DataFrame) -> DataFrame:
    """Documents as the block packer reads them: non-empty, end mark on the last line."""
    return drop_empty_docs(cleaned).withColumn("clean_text", append_eos(F.col("clean_text")))


def clean_audit(corpus: DataFrame, cleaned: DataFrame, text: str = "content") -> DataFrame:
    """Documents and characters per outcome: ok, empty, lexer_failed, null."""
    lex_ok = F.col("lex_ok") if "lex_ok" in cleaned.columns else F.lit(True)
    outcomes = cleaned.select(
        F.when(~lex_ok, "lexer_failed")
        .when(F.col("clean_text") == "", "empty")
        .otherwise("ok")
        .alias("status"),
        F.length("clean_text").cast("long").alias("chars"),
    )
    nulls = corpus.where(F.col(text).isNull()).select(
        F.lit("null").alias("status"), F.lit(0).cast("long").alias("chars")
    )
    return (
        outcomes.unionByName(nulls)
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("docs"), F.sum("chars").alias("chars"))
    )
