"""Cutting the token stream of an ordered corpus into fixed blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tokenloom.operators.ordering import prefix_sum


def doc_offsets(
    encoded: DataFrame, groups: tuple[str, ...] = (), order: str = "doc_id", bounds=None
) -> DataFrame:
    """Add `offset`: tokens of the group before this document.

    Where the counts are stored as `n_tokens`, the pass that sums them skips the ids.
    """
    count = F.col("n_tokens") if "n_tokens" in encoded.columns else F.size("ids")
    return prefix_sum(encoded, order, count, "offset", groups, bounds)


def _whole(value: Column, width: int) -> Column:
    """Integer quotient; positions in a large corpus outgrow exact doubles."""
    return F.call_function("div", value, F.lit(width).cast("long"))


def _pieces(placed: DataFrame, width: int, keys: list[str], blocks: Column) -> DataFrame:
    """The ids of each document that fall into `blocks`: (block_id, pos, piece).

    Slicing happens per document, so no row outgrows one block before anything is grouped.
    """
    start, stop = F.col("offset"), F.col("offset") + F.size("ids")

    def piece(block):
        at = F.greatest(start, block * width)
        end = F.least(stop, (block + 1) * width)
        body = F.slice("ids", (at - start + 1).cast("int"), (end - at).cast("int"))
        return F.struct(block.alias("block_id"), at.alias("pos"), body.alias("piece"))

    return placed.where(F.size("ids") > 0).select(*keys, F.inline(F.transform(blocks, piece)))


def pack_placed(placed: DataFrame, block_size: int, groups: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of `block_size + 1` ids from documents with known `offset`; the rest is dropped.

    Blocks inside one document leave at once. Only the pieces at document borders are grouped,
    at most `block_size + 1` to a block, so no key can become hot.
    """
    width, keys = block_size + 1, list(groups)
    start, stop = F.col("offset"), F.col("offset") + F.size("ids")
    none = F.array().cast("array<bigint>")

    first_full, after_full = _whole(start + (width - 1), width), _whole(stop, width)
    inner = F.when(first_full < after_full, F.sequence(first_full, after_full - 1)).otherwise(none)
    whole = _pieces(placed, width, keys, inner).select(*keys, "block_id", F.col("piece").alias("chunk"))

    ends = F.array_distinct(F.array(_whole(start, width), _whole(stop - 1, width)))
    border = F.filter(ends, lambda b: (start > b * width) | (stop < (b + 1) * width))
    parts = (
        _pieces(placed, width, keys, border)
        .groupBy(*keys, "block_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("parts"))
    )
    joined = parts.select(
        *keys, "block_id", F.flatten(F.transform("parts", lambda p: p["piece"])).alias("chunk")
    ).where(F.size("chunk") == width)
    return whole.unionByName(joined)


def pack_blocks(
    encoded: DataFrame, block_size: int, groups: tuple[str, ...] = (), order: str = "doc_id", bounds=None
) -> DataFrame:
    """Concatenate ids in document order per group and cut non-overlapping blocks."""
    return pack_placed(doc_offsets(encoded, groups, order, bounds), block_size, groups)


def shift_targets(blocks: DataFrame) -> DataFrame:
    """Input `x` and target `y`, one position apart."""
    keys = [c for c in blocks.columns if c != "chunk"]
    span = F.size("chunk") - 1
    return blocks.select(
        *keys, F.slice("chunk", F.lit(1), span).alias("x"), F.slice("chunk", F.lit(2), span).alias("y")
    )


def batch_blocks(blocks: DataFrame, batch_size: int) -> DataFrame:
    """Number the batches; the last one may be short."""
    return blocks.withColumn("batch_id", _whole(F.col("block_id"), batch_size))


def lane_of(order: str, n_lanes: int) -> Column:
    """The lane of a document: its number in the corpus, before empty documents go, modulo lanes."""
    return F.pmod(F.col(order), F.lit(n_lanes)).cast("int")


def lanes(docs: DataFrame, n_lanes: int, order: str = "doc_id") -> DataFrame:
    """Deal documents round robin; each lane packs on its own. `order` is dense (`with_doc_id`)."""
    return docs.withColumn("lane", lane_of(order, n_lanes))


def tail_of(placed: DataFrame, block_size: int, groups: tuple[str, ...]) -> DataFrame:
    """Per group: how many whole blocks it has, and the ids after the last of them.

    Only documents that reach into the open block contribute, cut to their part of it. For few
    groups: their totals are broadcast (lanes are a parameter).
    """
    width, keys = block_size + 1, list(groups)
    ends = placed.groupBy(*keys).agg(F.sum(F.size("ids").cast("long")).alias("total"))
    open_at = F.col("total") - F.col("total") % width
    # One row per group: the totals go to the documents, and only those of an open block move.
    reaching = placed.where(F.size("ids") > 0).join(F.broadcast(ends), keys).where(F.col("offset") + F.size("ids") > open_at)
    skip = F.greatest(open_at - F.col("offset"), F.lit(0)).cast("int")
    parts = reaching.select(
        *keys, F.struct(F.col("offset"), F.slice("ids", skip + 1, F.size("ids") - skip).alias("piece")).alias("part")
    )
    tails = parts.groupBy(*keys).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    joined = F.flatten(F.transform("parts", lambda p: p["piece"]))
    counts = ends.select(*keys, _whole(F.col("total"), width).alias("n_blocks"))
    return counts.join(tails.select(*keys, joined.alias("ids")), keys, "left")
