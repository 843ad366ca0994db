"""One step of pair merging, as table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tokenloom.operators.vocabulary import Vocabulary

# A segment of ids as text: one supplementary code point per id, so that merging a pair is a
# plain string replacement and a match can never start inside another id.
ID_PLANE = 0x20000


def id_char(token_id: int) -> str:
    return chr(ID_PLANE + token_id)


def char_ids(text: Column, vocab: Vocabulary) -> Column:
    """Character-level ids of a sanitised text (no merges)."""
    ids = vocab.ids()
    # ASCII only after sanitising, so one small positional array answers every character.
    by_code = ",".join(str(ids.get(chr(c), 0)) for c in range(128))
    table = F.split(F.lit(by_code), ",").cast("array<int>")
    chars = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
    return F.transform(chars, lambda c: F.coalesce(F.get(table, F.ascii(c)), F.lit(0)))


def coded(text: Column, vocab: Vocabulary) -> Column:
    """Sanitised text as id characters: `translate` swaps each symbol for its id's code point."""
    ids = vocab.ids()
    single = [t for t in vocab.tokens if len(t) == 1]
    return F.translate(text, "".join(single), "".join(id_char(ids[t]) for t in single))


def pair_counts(segments: DataFrame, ids: str = "ids", weight: str = "n") -> DataFrame:
    """Weighted count of every adjacent id pair; overlapping places all count."""
    # No filter on the array size: it would sink to the raw rows and compute every array twice.
    count = F.greatest(F.size(ids) - 1, F.lit(0))
    left, right = F.slice(F.col(ids), F.lit(1), count), F.slice(F.col(ids), F.lit(2), count)
    # One number per pair until the counts are in: cheaper to explode and to hash than a struct.
    pairs = F.zip_with(left, right, lambda a, b: F.shiftleft(a.cast("long"), 32) + b)
    return (
        segments.select(F.explode(pairs).alias("pair"), F.col(weight).alias("w"))
        .groupBy("pair")
        .agg(F.sum("w").alias("n"))
        .select(
            F.shiftright("pair", 32).cast("int").alias("left_id"),
            F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("right_id"),
            "n",
        )
    )


def best_pair(pairs: DataFrame, k: int = 1) -> DataFrame:
    """The `k` pairs that merge first: highest count, then smallest ids."""
    return pairs.orderBy(F.desc("n"), "left_id", "right_id").limit(k)


def apply_merge(coded_text: Column, left_id: int, right_id: int, new_id: int) -> Column:
    """Replace the pair from the left, without overlaps."""
    pair = id_char(left_id) + id_char(right_id)
    return F.replace(coded_text, F.lit(pair), F.lit(id_char(new_id)))
