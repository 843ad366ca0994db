"""Hard negatives and nearest neighbours against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import adaptive_scan, hard_negatives as hn, vector_grid
from tokenloom.llm.contract import QUERIES

SCHEMA = "vec_id long, label int, embedding array<float>, number long, slot int, windows string"
BIG = float(2**62)


def rows(n=260, dim=9, seed=4):
    """Vectors of many lengths with copies, near copies, ties, repeated rows and every awkward kind."""
    rng = random.Random(seed)
    found = []
    for i in range(n):
        scale = rng.choice([0.01, 0.3, 1, 1, 1, 8, 200])
        found.append((i, rng.randrange(4), [scale * rng.gauss(0, 1) for _ in range(dim)]))
    hot = found[3][2]
    found += [(n + i, i % 3, hot) for i in range(90)]
    found += [(1000 + i, i % 3, [0.0] * dim) for i in range(25)]
    found += [(20, 1, found[20][2]), (40, 2, found[41][2]), (40, 2, found[41][2]), (None, 1, hot), (None, 2, found[9][2])]
    found += [(2000, None, hot), (2001, 1, None), (2100, 2, [math.nan] + hot[1:]), (2200, 3, [None] + hot[1:])]
    found += [(2300, 3, [math.inf] + hot[1:]), (2400, 1, []), (2500, 1, [1.0, 2.0]), (2600, 2, [2.0, 1.0]), (2700, 1, [3.0, 0.5])]
    return [(*r, 1, 2, "x") for r in found]


def usable(data, zeros):
    for vec_id, label, vector, *_ in data:
        if vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        vector = [float(np.float32(x)) for x in vector]
        if zeros or any(vector):
            yield vec_id, label, tuple(vector)


def order(score, vec_id):
    return (-score, vec_id is None, vec_id or 0)


def plain_negatives(data, step):
    kept = set()
    for vec_id, label, vector in usable(data, zeros=True):
        if label is not None:
            label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
            kept.add((vec_id, label, tuple(math.floor(256 * x) for x in vector)))
    found = []
    for a, label, q in kept:
        if a is None or a % step:
            continue
        others = [(sum(x * y for x, y in zip(q, v)), i, m) for i, m, v in kept if len(v) == len(q) and i != a]
        best = sorted((o for o in others if o[2] == label), key=lambda o: order(*o[:2]))[:5]
        for place, (ps, p, _) in enumerate(best, 1):
            inside = [o for o in others if o[2] != label and 30 * ps <= 100 * o[0] <= 90 * ps]
            for rank, (s, i, _) in enumerate(sorted(inside, key=lambda o: order(*o[:2]))[:10], 1):
                found.append((a, p, place, rank, i, ps, s))
    return found


def mined(spark, df, step=100):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vector")
    vectors = df.where(vector_grid.finite("embedding")).select("vec_id", label.alias("label"), whole, "number", "slot")
    return hn.hard_negatives(vectors, F.col("vec_id") % step == 0)


@pytest.mark.parametrize("slot,bucket", [(8192, 2048), (64, 16)])
def test_hard_negatives_against_loops(spark, monkeypatch, slot, bucket):
    monkeypatch.setattr(hn, "SLOT_ROWS", slot)
    monkeypatch.setattr(hn, "GROUP_ROWS", 7 if slot == 64 else 1024)
    monkeypatch.setattr(hn, "BUCKET_ROWS", bucket)
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = [tuple(r) for r in mined(spark, df, 10).collect()]
    assert sorted(got, key=str) == sorted(plain_negatives(data, 10), key=str)


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mined(spark, empty).collect() == []
    alone = spark.createDataFrame([(0, 1, [1.0, 0.0], 1, 1, "x")], SCHEMA)
    assert mined(spark, alone).collect() == []


def test_candidates_hold_all_rows_from_the_threshold():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    vectors = rng.integers(-300, 300, (500, 12))
    table = pa.table({"vec_id": np.arange(500), "label": np.zeros(500, np.int64), "vector": list(vectors)})
    bucket, fewer = hn.Bucket(table), 0
    for q in vectors[:60]:
        scores, length = vectors @ q, math.sqrt(float(q @ q))
        for least in np.percentile(scores, [50, 90, 99, 100]).astype(int).tolist() + [int(10 * scores.max())]:
            some = bucket.candidates(q / length, length, least)
            assert set(np.flatnonzero(scores >= least)) <= set(some.tolist())
            assert (bucket.scores(q, length, some) == scores[some]).all()
            fewer += len(some) < 400
    assert fewer > 100


def test_large_components_are_exact(spark):
    data = [(0, 1, [3 * 10**8, 10**8 + 1]), (1, 1, [10**8 + 1, 3]), (2, 2, [10**7 + 1, 7]), (3, 2, [2**40, 1])]
    df = spark.createDataFrame(data, "vec_id long, label int, vector array<long>")
    got = hn.hard_negatives(df, F.col("vec_id") == 0, low=0).collect()
    score = lambda a, b: sum(x * y for x, y in zip(data[a][2], data[b][2]))
    assert [(r.negative_id, r.positive_score, r.negative_score) for r in got] == [(2, score(0, 1), score(0, 2))]


def test_negatives_query_against_loops(spark, sf_dir):
    data = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    got = [tuple(r) for r in QUERIES["op12_hard_negatives"](spark, sf_dir).collect()]
    assert got and sorted(got, key=str) == sorted(plain_negatives(data, 100), key=str)


def plain_neighbours(data, step, k=20):
    """query id -> [(score, id)], nearest first, of all its rows."""
    kept, found = {(i, v) for i, _, v in usable(data, zeros=False)}, {}
    for q, vector in kept:
        if q is None or q % step:
            continue
        others = []
        for i, v in kept:
            if i != q and len(v) == len(vector):
                others.append((sum(x * y for x, y in zip(vector, v)), i))
        found[q, vector] = sorted(others, key=lambda o: order(*o))[:k]
    return found


def searched(df, step=20, **settings):
    vectors = df.select("vec_id", F.col("embedding").alias("vector"), "number", "slot")
    return adaptive_scan.nearest_neighbours(vectors, F.col("vec_id") % step == 0, **settings)


@pytest.mark.parametrize("group", [1024, 5])
def test_all_lists_give_the_exact_neighbours(spark, monkeypatch, group):
    monkeypatch.setattr(adaptive_scan, "GROUP_ROWS", group)
    data = [r for r in rows() if r[0] not in (20, 40)]  # ids of two different vectors: see the next test
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got: dict = {}
    for r in searched(df, share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = {q: best for (q, _), best in plain_neighbours(data, 20).items()}
    assert got.keys() == {q for q, best in want.items() if best}
    for q, best in got.items():
        assert [i for _, i in best] == [i for _, i in want[q]], q
        assert np.allclose([s for s, _ in best], [s for s, _ in want[q]], rtol=1e-12)


def test_one_id_with_two_vectors_and_no_rows(spark):
    data = [(20, 1, [1.0, 0.0], 1, 1, "x"), (20, 1, [0.0, 1.0], 1, 1, "x"), (21, 1, [1.0, 2.0], 1, 1, "x")]
    got = searched(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(20, 1, 21, 1.0), (20, 1, 21, 2.0)]
    assert searched(spark.createDataFrame([], SCHEMA)).collect() == []
    assert searched(spark.createDataFrame(data[2:], SCHEMA)).collect() == []


def test_lists_and_early_ends_keep_the_recall(spark, monkeypatch):
    monkeypatch.setattr(adaptive_scan, "PROBE_ROWS", 100)
    monkeypatch.setattr(adaptive_scan, "SLOT_ROWS", 1000)
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((4000, 48)).astype(np.float32)
    data = [(i, 1, [float(x) for x in v], 1, 1, "x") for i, v in enumerate(vectors)]
    got: dict = {}
    for r in searched(spark.createDataFrame(data, SCHEMA)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 4000, 20):
        score = vectors.astype(float) @ vectors[q].astype(float)
        score[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-score)[:20].tolist()))
    assert all(len(x) == 20 for x in got.values()) and hits >= 0.9 * 200 * 20


def test_neighbours_query_against_loops(spark, sf_dir):
    data = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    got: dict = {}
    for r in QUERIES["op13_adaptive_scan"](spark, sf_dir).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    want = plain_neighbours(data, 20)
    assert got.keys() == {q for q, _ in want}
    for (q, _), best in want.items():
        assert len(got[q]) == 20 and len(got[q].keys() & {i for _, i in best}) >= 18
