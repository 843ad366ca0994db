"""Positions in document order without gathering the table in one task.

Running totals go level by level: an order value's high bits name its bucket, so a bucket
holds at most 2**RADIX_BITS rows whatever the distribution of the ids, and bucket totals are
themselves summed the same way one level up.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window, functions as F

from tokenloom.session import stage_table

RADIX_BITS = 12
#: Place of a row within its partition, as `monotonically_increasing_id` lays it out.
PLACE_BITS = 33


def with_doc_id(df: DataFrame, *order: str, doc_id: str = "doc_id") -> DataFrame:
    """Staged `df` with a dense 0-based long `doc_id` in the order of any sortable columns.

    Rows are dealt out by range and numbered inside their partition; only the partitions' counts
    are summed. Rows that tie get their numbers in any order, once: the table is written.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stage_table(placed.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", PLACE_BITS)
    # One row per partition.
    counts = sorted(map(tuple, rows.groupBy(part.alias("part")).count().collect()))
    starts = itertools.accumulate((n for _, n in counts), initial=0)
    shift = {k: s - (k << PLACE_BITS) for (k, _), s in zip(counts, starts, strict=False)}
    listed = ",".join(f"struct({k}L AS part, {v}L AS shift)" for k, v in shift.items())
    if not shift:
        return rows.withColumn(doc_id, F.col("_place")).drop("_place")
    moves = rows.sparkSession.sql(f"SELECT inline(array({listed}))")
    moved = rows.withColumn("_part", part).join(moves, F.col("_part") == F.col("part"))
    return moved.withColumn(doc_id, F.col("_place") + F.col("shift")).drop("_place", "_part", "part", "shift")


def order_bounds(df: DataFrame, order: str) -> tuple[int, int]:
    """Smallest and largest order value: one scan of one column. Refuses rows without one."""
    low, high, missing = df.agg(F.min(order), F.max(order), F.count_if(F.col(order).isNull())).first()
    if missing:
        raise ValueError(f"{missing} rows have no {order}; see with_doc_id")
    return (0, 0) if low is None else (low, high)


def _before(keys: list[str], bucket: str, order: str, value: str) -> Column:
    window = Window.partitionBy(*keys, bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def prefix_sum(
    df: DataFrame,
    order: str,
    value: Column,
    out: str,
    groups: tuple[str, ...] = (),
    bounds: tuple[int, int] | None = None,
) -> DataFrame:
    """Add `out`: the sum of `value` over all rows of the group before this one.

    `order` must be a unique integer within its group: a null or repeated one fails the job, since
    no place in the order can be told. Only order values and counts go through windows; what else a
    row holds is joined to its place afterwards. `df` is read once per branch, so pass it staged if
    it is costly.
    """
    low, high = bounds or order_bounds(df, order)
    keys = list(groups)
    # Shift before subtracting: the difference of two ids may not fit in 64 bits.
    floor, span = low >> RADIX_BITS, (high >> RADIX_BITS) - (low >> RADIX_BITS)
    missing = F.raise_error(F.lit(f"a row has no {order}")).cast("long")
    known = F.coalesce(F.col(order).cast("long"), missing)
    bucket = F.shiftright(known, RADIX_BITS) - F.lit(floor)

    totals = [
        df.select(*keys, bucket.alias("_k"), value.cast("long").alias("_v"))
        .groupBy(*keys, "_k")
        .agg(F.sum("_v").alias("_v"))
    ]
    while span >> (RADIX_BITS * len(totals)):
        totals.append(
            totals[-1]
            .select(*keys, F.shiftright("_k", RADIX_BITS).alias("_k"), "_v")
            .groupBy(*keys, "_k")
            .agg(F.sum("_v").alias("_v"))
        )
    base = None
    for level in reversed(totals):
        level = level.withColumn("_p", F.shiftright("_k", RADIX_BITS))
        level = level.withColumn("_b", _before(keys, "_p", "_k", "_v"))
        if base is not None:
            above = base.withColumnsRenamed({"_k": "_p", "_b": "_a"})
            level = level.join(above, [*keys, "_p"]).withColumn("_b", F.col("_b") + F.col("_a"))
        base = level.select(*keys, "_k", "_b")
    slim = df.select(*keys, order, bucket.alias("_k"), value.cast("long").alias("_v"))
    before = F.lag(order).over(Window.partitionBy(*keys, "_k").orderBy(order))
    repeated = F.raise_error(F.lit(f"{order} is repeated")).cast("long")
    ranked = slim.select(
        *keys,
        order,
        "_k",
        F.when(before == F.col(order), repeated).otherwise(_before(keys, "_k", order, "_v")).alias("_r"),
    )
    places = ranked.join(base, [*keys, "_k"]).select(*keys, order, (F.col("_r") + F.col("_b")).alias(out))
    rest = [c for c in df.columns if c not in (*keys, order)]
    return (df.join(places, [*keys, order]) if rest else places).select(*df.columns, out)


def doc_index(df: DataFrame, order: str = "doc_id", bounds=None) -> DataFrame:
    """Add the dense 0-based `doc_idx`."""
    return prefix_sum(df, order, F.lit(1), "doc_idx", bounds=bounds)


def last_of_first(df: DataFrame, n: int, order: str = "doc_id") -> int | None:
    """The order value of the n-th document; None if there are no more than n.

    Documents are counted by ranges of the order value, then inside the range that holds the n-th,
    until a range is one value: each count combines early and returns at most 2**RADIX_BITS rows.
    """
    low, high = order_bounds(df, order)
    ids, left = df.select(F.col(order).cast("long").alias("_o")), n
    shift = max(0, (high - low).bit_length() - RADIX_BITS) if high > low else 0
    while True:
        inside = ids.where(F.col("_o").between(low, high))
        counts = inside.groupBy(F.shiftright("_o", shift).alias("range")).count().orderBy("range").collect()
        for r in counts:
            if r["count"] >= left:
                break
            left -= r["count"]
        else:
            return None
        if shift == 0:
            return r["range"]
        low, high = max(low, r["range"] << shift), min(high, (r["range"] + 1 << shift) - 1)
        shift = max(0, shift - RADIX_BITS)


def take_docs(df: DataFrame, n: int, order: str = "doc_id") -> DataFrame:
    """The first `n` documents: a range of ids, which prunes the scan."""
    if n <= 0:
        return df.where(F.lit(False))
    bound = last_of_first(df, n, order)
    return df if bound is None else df.where(F.col(order) <= bound)


def skip_docs(df: DataFrame, n: int, order: str = "doc_id") -> DataFrame:
    """Everything after the first `n` documents."""
    if n <= 0:
        return df
    bound = last_of_first(df, n, order)
    return df.where(F.lit(False) if bound is None else F.col(order) > bound)


def with_split(df: DataFrame, n_val: int, corpus: DataFrame | None = None, order: str = "doc_id") -> DataFrame:
    """Mark the first `n_val` documents of `corpus` (default: `df`) `val`, the rest `train`."""
    if n_val <= 0:
        return df.withColumn("split", F.lit("train"))
    bound = last_of_first(df if corpus is None else corpus, n_val, order)
    first = F.lit(True) if bound is None else F.col(order) <= bound
    return df.withColumn("split", F.when(first, "val").otherwise("train"))
