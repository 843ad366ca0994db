"""The vocabulary as a table, and lookups in it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tokenloom.functions.text import END_OF_TEXT
from tokenloom.operators.segments import SPECIAL_TOKENS

VOCAB_SCHEMA = T.StructType(
    [
        T.StructField("token", T.StringType(), False),
        T.StructField("id", T.IntegerType(), False),
        T.StructField("is_special", T.BooleanType(), False),
    ]
)
MERGE_SCHEMA = T.StructType(
    [
        T.StructField("rank", T.IntegerType(), False),
        T.StructField("left_id", T.IntegerType(), False),
        T.StructField("right_id", T.IntegerType(), False),
        T.StructField("new_id", T.IntegerType(), False),
    ]
)

# Printable ASCII by code point.
ALPHABET = tuple(chr(c) for c in (*range(0x09, 0x0E), *range(0x20, 0x7F)))
BASE_TOKENS = SPECIAL_TOKENS + ALPHABET


@dataclass(frozen=True)
class Vocabulary:
    """Tokens by id plus the ordered merges; its size is bounded by the vocabulary size."""

    tokens: tuple[str, ...] = BASE_TOKENS
    merges: tuple[tuple[int, int, int], ...] = ()
    specials: tuple[str, ...] = SPECIAL_TOKENS
    rounds: int = field(default=0, compare=False)

    @property
    def size(self) -> int:
        return len(self.tokens)

    def ids(self) -> dict[str, int]:
        return {token: i for i, token in enumerate(self.tokens)}

    def id_of(self, token: str) -> int | None:
        return self.ids().get(token)

    @property
    def eos_id(self) -> int | None:
        """Id of the end mark; None unless it was reserved."""
        return self.id_of(END_OF_TEXT)

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        rows = [(t, i, t in self.specials) for i, t in enumerate(self.tokens)]
        return spark.createDataFrame(rows, VOCAB_SCHEMA)

    def merge_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r, *m) for r, m in enumerate(self.merges)], MERGE_SCHEMA)

    def with_special(self, token: str) -> "Vocabulary":
        """Reserve one more token, e.g. an end-of-text mark, under the next id."""
        if token in self.tokens:
            raise ValueError(f"{token!r} is in the vocabulary already")
        return Vocabulary(self.tokens + (token,), self.merges, self.specials + (token,))

    @staticmethod
    def from_tables(vocab: DataFrame, merges: DataFrame) -> "Vocabulary":
        """Both tables are bounded by the vocabulary size, so they may come to the driver."""
        rows = sorted(vocab.select("id", "token", "is_special").collect())
        if [r["id"] for r in rows] != list(range(len(rows))):
            raise ValueError("vocabulary ids must be dense and start at 0")
        triples = sorted(merges.select("rank", "left_id", "right_id", "new_id").collect())
        return Vocabulary(
            tuple(r["token"] for r in rows),
            tuple((m["left_id"], m["right_id"], m["new_id"]) for m in triples),
            tuple(r["token"] for r in rows if r["is_special"]),
        )


def base_vocab(spark: SparkSession) -> DataFrame:
    """Reserved tokens and the alphabet: ids 0..102."""
    return Vocabulary().vocab_table(spark)


def vocab_lookup(tokens: DataFrame, vocab: DataFrame, token: str = "token") -> DataFrame:
    """Id of each token, NULL where absent. Catalyst broadcasts `vocab` while its size allows."""
    known = vocab.select(F.col("token").alias(token), "id")
    return tokens.join(known, token, "left")


def special_tokens(vocab: DataFrame) -> DataFrame:
    """Tokens that look reserved: they start with `<` and end with `>`."""
    return vocab.where(F.startswith("token", F.lit("<")) & F.endswith("token", F.lit(">")))


def unk_tokens(chars: DataFrame, vocab: DataFrame, char: str = "ch") -> DataFrame:
    """Id of each character; those outside the vocabulary get the unknown id."""
    return vocab_lookup(chars, vocab, char).withColumn("id", F.coalesce("id", F.lit(0)))


def constant_strings(values: tuple[str, ...]) -> Column:
    """A string-array literal that Catalyst folds once; tokens never hold the separator."""
    separator = "\x1f"
    if any(separator in v for v in values):
        raise ValueError("token holds the list separator")
    return F.split(F.lit(separator.join(values)), separator)
