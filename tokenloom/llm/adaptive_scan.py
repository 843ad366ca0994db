"""Approximate nearest neighbours: inverted lists scanned in column blocks that give up early.

Largest inner product becomes smallest distance: a vector x of length at most M gets the component
sqrt(M^2 - |x|^2), a query 0. All are then turned by one random rotation, after which any first d
of the D components are a fair sample of a distance. Rows go to the list of their nearest centre.

A query probes the lists of its nearest centres. Within a list, distances grow block by block of
components. After d of them a row is given up if its distance so far, scaled by D / d, is above
r * (1 + EPSILON / sqrt(d)), where r is the distance of the k-th nearest row known: the hypothesis
that the row is nearer than that is then rejected. r comes from the nearest list, scanned first.
Rows that reach the last block are scored on the original vectors in double precision.

Results for awkward input: vectors that are null, zero, or hold null or non-finite components take
no part; equal rows (id and vector) count once; a null id is never a query, and comes last among
ties; vectors are compared with those of as many components only, each with an index of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tokenloom.llm.common import batch_of
from tokenloom.llm.vector_grid import against, dealt, finite, ids_of, matrix, squared_length
from tokenloom.session import ship_package, stage_table

#: The centres are fitted on at most so many rows, those with the lowest hash of id and vector.
SAMPLE_ROWS = 16_384
#: Lists: the square root of the rows, at most this.
MAX_LISTS = 1024
FIT_ROUNDS = 8
#: Each query probes this share of the lists, and as many as hold so many rows by the sample's count.
PROBE_SHARE = 0.65
PROBE_ROWS = 2048
#: Components in a block; the test of D components has this many standard deviations.
BLOCK = 16
EPSILON = 2.1
SLOT_ROWS = 16_384
GROUP_ROWS = 1024
#: Single-precision distances of vectors of length 1 are right to this.
SLACK = 1e-5
EXACT_PAIRS = 1 << 16
SEED = 20_240_613


class Index:
    """Rotation and centres: what is fitted on the sample, and bounded by it."""

    def __init__(self, sample: np.ndarray, n_rows: int, longest: float, n_lists: int):
        dim = sample.shape[1] + 1
        rng = np.random.default_rng(SEED)
        self.longest = longest
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        turned = self.rows(sample)
        self.centres = self._fit(turned, n_lists, rng)
        members = np.bincount(self.to_centres(turned).argmin(axis=1), minlength=len(self.centres))
        self.sizes = members * (n_rows / len(sample))

    def rows(self, vectors: np.ndarray) -> np.ndarray:
        """Rows lifted to length 1 and turned."""
        unit = vectors / self.longest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1)))
        return np.column_stack([unit, rest]) @ self.rotation

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        return np.column_stack([vectors / self.longest, np.zeros(len(vectors))]) @ self.rotation

    def to_centres(self, turned: np.ndarray) -> np.ndarray:
        """Squared distances to all centres, but for the vectors' own lengths."""
        return (self.centres**2).sum(axis=1) - 2.0 * turned @ self.centres.T

    def probes(self, turned: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Which lists each query probes: the nearest one, and the others."""
        order = np.argsort(self.to_centres(turned), axis=1, kind="stable")
        before = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        place = np.arange(order.shape[1])
        wanted = (place < math.ceil(share * order.shape[1])) | (before < PROBE_ROWS)
        found = np.zeros(order.shape, bool)
        np.put_along_axis(found, order, wanted, axis=1)
        first = np.zeros(order.shape, bool)
        np.put_along_axis(first, order[:, :1], True, axis=1)
        return first, found & ~first

    @staticmethod
    def _fit(points: np.ndarray, n_lists: int, rng) -> np.ndarray:
        """Lloyd's rounds from distinct points; a centre that loses all points stays where it is."""
        distinct = np.unique(points, axis=0)
        centres = distinct[rng.permutation(len(distinct))[:n_lists]].copy()
        for _ in range(FIT_ROUNDS):
            nearest = ((centres**2).sum(axis=1) - 2.0 * points @ centres.T).argmin(axis=1)
            n = np.bincount(nearest, minlength=len(centres))
            total = np.zeros_like(centres)
            np.add.at(total, nearest, points)
            centres[n > 0] = total[n > 0] / n[n > 0, None]
        return centres


def fit_index(rows: DataFrame, lists: int | None = None) -> Index:
    """An index for `rows` (vec_id, vector), all of one number of components; one row at least."""
    n, longest2 = rows.agg(F.count(F.lit(1)), F.max(squared_length("vector"))).first()
    sample = rows.orderBy(F.xxhash64("vec_id", "vector")).limit(SAMPLE_ROWS).select("vector").toArrow()
    wanted = lists or min(MAX_LISTS, round(math.sqrt(n)))
    return Index(matrix(sample), n, math.sqrt(longest2) * (1 + 1e-12), max(1, wanted))


def _scan(queries: pa.Table, rows: pa.Table, model, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the pairs that weren't given up, the first `k` of each query at least."""
    index, empty = model, np.zeros(0, np.int64)
    if not queries.num_rows or not rows.num_rows:
        return empty, empty, np.zeros(0)
    exact_q, exact_x = matrix(queries), matrix(rows)
    turned_q, turned_x = index.queries(exact_q).astype(np.float32), index.rows(exact_x).astype(np.float32)
    dim = turned_q.shape[1]
    q_ids, _ = ids_of(queries)
    x_ids, no_id = ids_of(rows)
    probes = np.unpackbits(np.frombuffer(b"".join(queries["probes"].to_pylist()), np.uint8).reshape(len(q_ids), -1), axis=1)
    # The largest squared distance of interest, where distances are of vectors divided by the longest.
    radius = queries["radius"].to_numpy().copy()
    slack = SLACK * (1.0 + (turned_q.astype(np.float64) ** 2).sum(axis=1))
    member = rows["list"].to_numpy()
    order = np.argsort(member, kind="stable")
    edges = np.flatnonzero(np.diff(member[order], prepend=-1, append=-1))
    cuts = [(at, min(at + BLOCK, dim)) for at in range(0, dim, BLOCK)]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for start, end in zip(edges, edges[1:], strict=False):
        inside = order[start:end]
        asking = np.flatnonzero(probes[:, member[inside[0]]])
        if not len(asking):
            continue
        # Column blocks of this list and of those who ask.
        blocks = [(turned_q[asking, a:b], turned_x[inside, a:b]) for a, b in cuts]
        near = np.zeros((len(asking), len(inside)), np.float32)
        qi = xi = None
        for (left, right), (_, seen) in zip(blocks, cuts, strict=True):
            if qi is None:
                near += (left**2).sum(axis=1)[:, None] + (right**2).sum(axis=1)[None, :] - 2.0 * (left @ right.T)
                so_far = near
            else:
                so_far = so_far + ((left[qi] - right[xi]) ** 2).sum(axis=1)
            sure = (1.0 + EPSILON / math.sqrt(seen)) ** 2 * seen / dim if seen < dim else 1.0
            most = (radius[asking] * sure + slack[asking]).astype(np.float32)
            if qi is None:
                alive = so_far <= most[:, None]
                if seen == dim or alive.mean() <= 0.25:
                    qi, xi = np.nonzero(alive)
                    so_far = so_far[qi, xi]
            else:
                alive = so_far <= most[qi]
                qi, xi, so_far = qi[alive], xi[alive], so_far[alive]
        own = (q_ids[asking[qi]] == x_ids[inside[xi]]) & ~no_id[inside[xi]]
        qi, xi, so_far = qi[~own], xi[~own], so_far[~own]
        # The k-th distance of each query in this list, if there are as many, bounds the next lists and this one.
        by = np.lexsort((so_far, qi))
        qi, xi, so_far = qi[by], xi[by], so_far[by]
        first = np.searchsorted(qi, np.arange(len(asking)))
        full = np.append(first[1:], len(qi)) - first >= k
        radius[asking[full]] = np.minimum(radius[asking[full]], so_far[first[full] + k - 1] + slack[asking[full]])
        keep = so_far <= radius[asking[qi]] + slack[asking[qi]]
        out.append((asking[qi[keep]], inside[xi[keep]]))
    if not out:
        return empty, empty, np.zeros(0)
    qi, xi = (np.concatenate(x) for x in zip(*out, strict=True))
    score = np.empty(len(qi))
    for at in range(0, len(qi), EXACT_PAIRS):
        some = slice(at, at + EXACT_PAIRS)
        total = np.zeros(len(qi[some]))
        # Component by component, so that equal vectors have equal scores wherever they stand.
        for d in range(exact_q.shape[1]):
            total += exact_q[qi[some], d] * exact_x[xi[some], d]
        score[some] = total
    by = np.lexsort((x_ids[xi], no_id[xi], -score, qi))
    qi, xi, score = qi[by], xi[by], score[by]
    place = np.arange(len(qi)) - np.searchsorted(qi, qi)
    return qi[place < k], xi[place < k], score[place < k]


def _nearest(queries: DataFrame, n_groups: int, slots: DataFrame, n_slots: int, model, k: int) -> DataFrame:
    """(number, vec_id, score): for each query rows of the lists it probes, the first `k` of each slot at least."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        qi, xi, score = _scan(left, right, model.value, k)
        numbers, ids = left["number"].combine_chunks(), right["vec_id"].cast(pa.int64()).combine_chunks()
        arrays = [numbers.take(pa.array(qi)), ids.take(pa.array(xi)), pa.array(score)]
        return pa.Table.from_arrays(arrays, ["number", "vec_id", "score"])

    return against(queries, n_groups, slots, n_slots, work, "number long, vec_id long, score double")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(rows: DataFrame, is_query: Column, k: int, share: float, lists: int | None) -> DataFrame:
    """The search among rows of one number of components."""
    spark, index = rows.sparkSession, fit_index(rows, lists)
    model = spark.sparkContext.broadcast(index)
    n_lists = len(index.centres)

    def to_list(batches):
        for batch in batches:
            nearest = model.value.to_centres(model.value.rows(matrix(batch))).argmin(axis=1) if batch.num_rows else []
            yield batch_of({"vec_id": batch["vec_id"], "vector": batch["vector"], "list": nearest}, list=pa.int32())

    def to_probes(batches):
        """The nearest list, and the others that are probed, as bits."""
        for batch in batches:
            if not batch.num_rows:
                continue
            turned = model.value.queries(matrix(batch))
            bits = [[x.tobytes() for x in np.packbits(some, axis=1)] for some in model.value.probes(turned, share)]
            lengths = (turned**2).sum(axis=1)
            columns = {"vec_id": batch["vec_id"], "vector": batch["vector"], "first": bits[0], "others": bits[1], "length2": lengths}
            yield batch_of(columns, first=pa.binary(), others=pa.binary())

    vector = f"vec_id long, vector {rows.schema['vector'].dataType.simpleString()}"
    slots, n_slots = dealt(rows.mapInArrow(to_list, f"{vector}, list int"), "slot", max(SLOT_ROWS, 64 * n_lists))
    slots = stage_table(slots, "lists")
    asked = rows.where(is_query).mapInArrow(to_probes, f"{vector}, first binary, others binary, length2 double")
    groups, n_groups = dealt(asked, "group", GROUP_ROWS)
    groups = stage_table(groups.withColumn("number", F.monotonically_increasing_id()), "queries")

    start = groups.withColumn("probes", F.col("first")).withColumn("radius", F.lit(math.inf))
    seeds = stage_table(_first(_nearest(start, n_groups, slots, n_slots, model, k), k), "seeds")
    # |q - x|^2 of the lifted vectors, divided by the longest: 1 + |q|^2 - 2 q.x.
    known = seeds.where(F.col("rank") == k).select("number", (F.col("score") / index.longest**2).alias("product"))
    radius = F.greatest(F.lit(0.0), 1.0 + F.col("length2") - 2.0 * F.col("product"))
    rest = (
        groups.join(known, "number", "left")
        .withColumn("radius", F.when(F.col("product").isNull(), math.inf).otherwise(radius))
        .withColumn("probes", F.col("others"))
        .drop("product")
    )
    found = _nearest(rest, n_groups, slots, n_slots, model, k).unionByName(seeds.drop("rank"))
    ranked = _first(found, k)
    return ranked.join(groups.select("number", F.col("vec_id").alias("query_id")), "number").select(
        "query_id", "rank", "vec_id", "score"
    )


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int = 20, share: float = PROBE_SHARE, lists: int | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` rows found with the largest inner product.

    `vectors` has vec_id (an integer) and vector. Queries are the rows where `is_query` holds;
    rows with a query's own id are no candidates for it. `share` is the share of lists probed.
    """
    ship_package(vectors.sparkSession)
    valid = vectors.where(finite("vector") & F.exists("vector", lambda x: x != 0))
    rows = valid.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").distinct()
    rows = stage_table(rows.withColumn("dim", F.size("vector")), "vectors")
    dims = [r["dim"] for r in rows.select("dim").distinct().collect()]
    asked = F.coalesce(is_query, F.lit(False)) & F.col("vec_id").isNotNull()
    found = [_search(rows.where(F.col("dim") == d).drop("dim"), asked, k, share, lists) for d in sorted(dims)]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole
