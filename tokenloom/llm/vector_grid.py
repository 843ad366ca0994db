"""Vectors in blocks, and blocks of queries against blocks of rows.

Rows are dealt to slots and queries to groups by a hash of their id and vector, so that copies of
one vector spread, and every group meets every slot in a task of its own: what a task holds is
bounded by the sizes of one slot and one group.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def finite(vector: str) -> Column:
    """The vector is there and all its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: F.coalesce(bad(x), F.lit(True)))


def squared_length(vector: str) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))


def dealt(vectors: DataFrame, name: str, rows: int) -> tuple[DataFrame, int]:
    """`vectors` with the column `name`: one of as many blocks as hold about `rows` rows each."""
    n = max(1, math.ceil(vectors.count() / rows))
    key = F.xxhash64("vec_id", "vector")
    return vectors.withColumn(name, F.pmod(key, F.lit(n)).cast("int")), n


def matrix(rows: pa.Table | pa.RecordBatch, dtype: str = "float64") -> np.ndarray:
    """The column `vector`, whose lists have one length, as a matrix."""
    column = rows["vector"]
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0), dtype)


def ids_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(vec_id with 0 for null, whether it is null)."""
    column = rows["vec_id"].cast(pa.int64())
    return column.fill_null(0).to_numpy(), column.is_null().to_numpy()


def against(groups: DataFrame, n_groups: int, slots: DataFrame, n_slots: int, work: Callable, schema: str) -> DataFrame:
    """`work(rows of a group, rows of a slot)` for each of both; Arrow tables in, an Arrow table out."""
    left = groups.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n_slots - 1))))
    right = slots.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    keys = ["group", "slot"]
    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(work, schema)
