"""Hard negatives by coordinate pruning, after LEMP's search for large inner products.

Rows are sorted by length into buckets of similar length. A bucket holds its directions (vectors of
length one) as one sorted list for each coordinate. An anchor that asks for scores from t upwards
needs a cosine of at least c = t / (its length * the bucket's greatest length); above 1 it skips the
bucket. Otherwise the directions it wants lie in a cone around its own, which bounds each
coordinate: for the focus coordinates, those in which the anchor is largest, the bounds are a range
of the sorted list. Rows in all ranges are candidates, and their integer inner products decide.

t rises with the best rows found so far, and in a slot long rows come first. Nothing that could
be in the result is skipped, so the result is exact.

Results for awkward input: rows with a null label, a null vector, or a null or non-finite component
take no part (`finite`), nor do vectors whose squared length is 2**62 or more, whose scores a long
can't hold. Equal rows count once. Rows that share an id but differ are rows of their own, but none
is a positive or negative of its own id. A null id comes after all others. Vectors are compared
with those of the same number of components only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tokenloom.llm.vector_grid import against, dealt, ids_of, matrix, squared_length
from tokenloom.session import ship_package, stage_table

SLOT_ROWS = 8192
GROUP_ROWS = 1024
BUCKET_ROWS = 2048
#: A bucket of at least so many rows ends where a row is shorter than this share of its longest.
BUCKET_LEAST = 128
SIMILAR = 0.9
FOCUS = 3
#: Bounds are widened by so much, for rounding.
SLACK = 1e-9


class Bucket:
    """Rows of similar length, as exact integers and as one sorted list of directions for each coordinate."""

    def __init__(self, rows: pa.Table):
        self.ids, self.no_id = ids_of(rows)
        self.labels = rows["label"].to_numpy()
        self.vectors = matrix(rows, "int64")
        wide = self.vectors.astype(np.float64)
        lengths = np.sqrt((wide * wide).sum(axis=1))
        self.longest = float(lengths.max())
        # Sums of doubles are exact as long as they stay below 2**53.
        self.fast = wide if self.longest < 2**26 else None
        self.directions = wide / np.where(lengths > 0, lengths, 1)[:, None]
        self.order = np.argsort(self.directions, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(self.directions.T, self.order, axis=1)

    def scores(self, vector: np.ndarray, length: float, rows: np.ndarray) -> np.ndarray:
        """Exact inner products of `rows`."""
        whole = 2 * len(rows) > len(self.ids)
        if self.fast is not None and length < 2**26:
            q = vector.astype(np.float64)
            found = (self.fast @ q)[rows] if whole else self.fast[rows] @ q
            return found.astype(np.int64)
        return (self.vectors[rows] * vector).sum(axis=1)

    def candidates(self, direction: np.ndarray, length: float, least: int | None) -> np.ndarray:
        """Rows whose score can be `least` or more, by the focus coordinates; None asks for all."""
        everything = np.arange(len(self.ids))
        if least is None or least <= 0:
            return everything
        reach = length * self.longest
        cosine = least / reach - SLACK if reach else 2.0
        if cosine > 1:
            return everything[:0]
        cone = math.acos(max(cosine, -1.0))
        ranges = []
        for f in np.argsort(-np.abs(direction), kind="stable")[:FOCUS]:
            angle = math.acos(min(1.0, max(-1.0, float(direction[f]))))
            low = math.cos(min(math.pi, angle + cone)) - SLACK
            high = math.cos(max(0.0, angle - cone)) + SLACK
            at = np.searchsorted(self.sorted[f], low, "left"), np.searchsorted(self.sorted[f], high, "right")
            ranges.append((at[1] - at[0], f, at, low, high))
        _, f, (start, end), _, _ = min(ranges, key=lambda r: r[0])
        found = self.order[f][start:end]
        for _, g, _, low, high in ranges:
            if g != f:
                column = self.directions[found, g]
                found = found[(column >= low) & (column <= high)]
        return found


def buckets(rows: pa.Table) -> dict[int, list[Bucket]]:
    """The buckets of a slot by number of components, longest first."""
    found: dict[int, list[Bucket]] = {}
    ordered = rows.sort_by([("dim", "ascending"), ("length2", "descending"), ("vec_id", "ascending")])
    dims, lengths = ordered["dim"].to_numpy(), np.sqrt(ordered["length2"].to_numpy())
    start = 0
    for at in range(1, len(dims) + 1):
        size = at - start
        if at == len(dims) or dims[at] != dims[start] or size >= BUCKET_ROWS or (
            size >= BUCKET_LEAST and lengths[at] < SIMILAR * lengths[start]
        ):
            found.setdefault(int(dims[start]), []).append(Bucket(ordered.slice(start, size)))
            start = at
    return found


class Best:
    """The first `k` rows found so far: highest score first, ties by id, null ids last."""

    def __init__(self, k: int):
        self.k, self.score = k, np.zeros(0, np.int64)
        self.ids, self.no_id = self.score, np.zeros(0, bool)

    def least(self, floor: int | None) -> int | None:
        """A row below this score can't be among them."""
        if len(self.score) < self.k:
            return floor
        return int(self.score[-1]) if floor is None else max(floor, int(self.score[-1]))

    def add(self, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        if len(score):
            score, ids, no_id = (np.concatenate(x) for x in ((self.score, score), (self.ids, ids), (self.no_id, no_id)))
            first = np.lexsort((ids, no_id, -score))[: self.k]
            self.score, self.ids, self.no_id = score[first], ids[first], no_id[first]


def _searched(anchors: pa.Table, rows: pa.Table, k: int, same_label: bool) -> pa.Table:
    """For each window of each anchor the first `k` rows of `rows` in it."""
    out: list[tuple] = []
    by_dim = buckets(rows) if anchors.num_rows and rows.num_rows else {}
    vectors = anchors["vector"].to_pylist() if by_dim else []
    for i, vector in enumerate(vectors):
        q = np.array(vector, np.int64)
        length = math.sqrt(float((q.astype(np.float64) ** 2).sum()))
        direction = q / length if length else q.astype(np.float64)
        anchor_id, label = anchors["vec_id"][i].as_py(), anchors["label"][i].as_py()
        windows = [(w["low"], w["high"], w["place"], Best(k)) for w in anchors["windows"][i].as_py()]
        for bucket in by_dim.get(len(vector), []):
            floors = [best.least(low) for low, _, _, best in windows]
            if not floors:
                break
            least = None if None in floors else min(floors)
            some = bucket.candidates(direction, length, least)
            alike = bucket.labels[some] == label
            some = some[alike if same_label else ~alike]
            if anchor_id is not None:
                some = some[(bucket.ids[some] != anchor_id) | bucket.no_id[some]]
            if not len(some):
                continue
            score = bucket.scores(q, length, some)
            order = np.lexsort((bucket.ids[some], bucket.no_id[some], -score))
            some, score = some[order], score[order]
            for (_, high, _, best), floor in zip(windows, floors, strict=True):
                # Sorted by falling score: those up to `high` start here, those from `floor` end there.
                start = 0 if high is None else np.searchsorted(-score, -high, "left")
                end = len(score) if floor is None else np.searchsorted(-score, -floor, "right")
                pick = slice(start, max(start, min(end, start + k)))
                best.add(score[pick], bucket.ids[some[pick]], bucket.no_id[some[pick]])
        number = anchors["number"][i].as_py()
        for _, _, place, best in windows:
            ids = [None if none else int(x) for x, none in zip(best.ids, best.no_id, strict=True)]
            out += [(number, place, x, int(s)) for x, s in zip(ids, best.score, strict=True)]
    columns = list(zip(*out, strict=True)) if out else [[]] * 4
    kinds = zip(columns, [pa.int64(), pa.int32(), pa.int64(), pa.int64()], strict=True)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in kinds], ["number", "place", "vec_id", "score"])


def _first(anchors: DataFrame, n_groups: int, slots: DataFrame, n_slots: int, k: int, same_label: bool) -> DataFrame:
    """(number, place, rank, vec_id, score): the first `k` rows of each window."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        return _searched(left, right, k, same_label)

    found = against(anchors, n_groups, slots, n_slots, work, "number long, place int, vec_id long, score long")
    order = Window.partitionBy("number", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score).

    `vectors` has vec_id (an integer), label and vector (integers). Scores are inner products. An
    anchor's positives are its first rows of the same label; for each, the negatives are the first
    rows of another label that score from `low` to `high` percent of the positive. First means
    highest score, then smallest id.
    """
    ship_package(vectors.sparkSession)
    kept = vectors.where(F.col("label").isNotNull() & F.col("vector").isNotNull()).select("vec_id", "label", "vector")
    measured = kept.withColumn("length2", squared_length("vector")).where(F.col("length2") < float(2**62))
    rows = measured.distinct().select("*", F.size("vector").alias("dim"))
    rows = stage_table(rows, "vectors")
    slots, n_slots = dealt(rows, "slot", SLOT_ROWS)
    anchors, n_groups = dealt(rows.where(is_anchor), "group", GROUP_ROWS)
    numbered = stage_table(anchors.withColumn("number", F.monotonically_increasing_id()), "anchors")

    window = "array<struct<place int, low bigint, high bigint>>"
    open_ended = F.array(F.struct(F.lit(0).alias("place"), F.lit(None).alias("low"), F.lit(None).alias("high")))
    asked = numbered.withColumn("windows", open_ended.cast(window))
    nearest = stage_table(_first(asked, n_groups, slots, n_slots, positives, same_label=True), "positives")

    # In whole numbers: low * positive <= 100 * score <= high * positive.
    score = F.col("score").cast("decimal(38,0)")
    bounds = F.struct(
        F.col("rank").alias("place"),
        F.ceil(score * low / 100).cast("long").alias("low"),
        F.floor(score * high / 100).cast("long").alias("high"),
    )
    windows = nearest.where("score >= 0").groupBy("number").agg(F.collect_list(bounds).cast(window).alias("windows"))
    asked = numbered.join(windows, "number")
    found = _first(asked, n_groups, slots, n_slots, negatives, same_label=False)
    chosen = nearest.select(
        "number", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return (
        found.join(chosen, ["number", "place"])
        .join(numbered.select("number", F.col("vec_id").alias("anchor_id")), "number")
        .select(
            "anchor_id",
            "positive_id",
            F.col("place").alias("positive_rank"),
            "rank",
            F.col("vec_id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
