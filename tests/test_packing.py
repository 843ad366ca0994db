import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators.ordering import (
    last_of_first,
    prefix_sum,
    skip_docs,
    take_docs,
    with_doc_id,
    with_split,
)
from tokenloom.operators.packing import batch_blocks, doc_offsets, lanes, pack_blocks, shift_targets


def frame(spark, docs, parts=4):
    return spark.createDataFrame(docs, "doc_id long, ids array<int>").repartition(parts)


def plain_blocks(docs, width):
    stream = [i for _, ids in sorted(docs) for i in ids]
    return {b: stream[b * width : (b + 1) * width] for b in range(len(stream) // width)}


def random_docs(rng, n, sparse):
    keys = {rng.randint(-(2**63), 2**63 - 1) for _ in range(n)} if sparse else range(n)
    return [(k, [rng.randint(0, 99) for _ in range(rng.choice([0, 1, 3, 7, 40]))]) for k in keys]


def test_fixture_blocks(spark):
    docs = [(0, [1, 2, 3]), (1, [4, 5]), (2, [6, 7, 8, 9])]
    rows = shift_targets(pack_blocks(frame(spark, docs), 3)).orderBy("block_id").collect()
    assert [(r.block_id, r.x, r.y) for r in rows] == [
        (0, [1, 2, 3], [2, 3, 4]),
        (1, [5, 6, 7], [6, 7, 8]),
    ]


@pytest.mark.parametrize("sparse", [False, True])
@pytest.mark.parametrize("parts", [1, 7])
def test_blocks_equal_the_plain_stream(spark, sparse, parts):
    docs = random_docs(random.Random(1), 300, sparse)
    got = {r.block_id: r.chunk for r in pack_blocks(frame(spark, docs, parts), 9).collect()}
    assert got == plain_blocks(docs, 10)


def test_sparse_offsets_use_several_levels(spark):
    docs = random_docs(random.Random(2), 200, True)
    got = {r.doc_id: r.offset for r in doc_offsets(frame(spark, docs)).collect()}
    total = 0
    for key, ids in sorted(docs):
        assert got[key] == total
        total += len(ids)


def test_ids_around_zero_and_bucket_borders(spark):
    docs = [(k, [abs(k) % 97] * 3) for k in (-4097, -4096, -1, 0, 1, 4095, 4096, 2**24 - 1, 2**24)]
    got = {r.block_id: r.chunk for r in pack_blocks(frame(spark, docs), 3).collect()}
    assert got == plain_blocks(docs, 4)


def test_offsets_per_group(spark):
    df = spark.range(10_000).withColumn("g", (F.col("id") % 3).cast("string"))
    out = prefix_sum(df, "id", F.col("id"), "before", ("g",))
    rows = out.where("id IN (0, 4, 9000, 9999)").collect()
    for r in rows:
        assert r.before == sum(range(r.id % 3, r.id, 3))


def test_lanes_leave_one_remainder_each(spark):
    docs = random_docs(random.Random(4), 120, False)
    dealt = lanes(frame(spark, docs), 3)
    got = {(r.lane, r.block_id): r.chunk for r in pack_blocks(dealt, 9, ("lane",)).collect()}
    want = {}
    for lane in range(3):
        for b, chunk in plain_blocks([d for d in docs if d[0] % 3 == lane], 10).items():
            want[(lane, b)] = chunk
    assert got == want


def test_take_and_skip_split_the_corpus(spark):
    docs = random_docs(random.Random(5), 50, True)
    df = frame(spark, docs)
    order = sorted(k for k, _ in docs)
    for n in (0, 1, 20, 50, 80):
        assert sorted(r.doc_id for r in take_docs(df, n).collect()) == order[:n]
        assert sorted(r.doc_id for r in skip_docs(df, n).collect()) == order[n:]
    marked = {r.doc_id: r.split for r in with_split(df, 20).collect()}
    assert [marked[k] for k in order] == ["val"] * 20 + ["train"] * 30


def test_one_document_of_many_blocks_and_many_tiny_ones(spark):
    docs = [(0, list(range(5000)))] + [(i, [i]) for i in range(1, 5000)]
    got = {r.block_id: r.chunk for r in pack_blocks(frame(spark, docs), 99).collect()}
    assert got == plain_blocks(docs, 100)


def test_batches_in_order(spark):
    blocks = pack_blocks(frame(spark, [(0, list(range(50)))]), 4)
    ids = {r.block_id: r.batch_id for r in batch_blocks(blocks, 3).collect()}
    assert ids == {b: b // 3 for b in range(10)}


def test_rows_without_a_place_are_refused(spark):
    nulls = spark.createDataFrame([(1, [1]), (None, [2]), (3, [3])], "doc_id long, ids array<int>")
    with pytest.raises(ValueError):
        pack_blocks(nulls, 1)
    with pytest.raises(Exception, match="has no doc_id"):
        pack_blocks(nulls, 1, bounds=(1, 3)).collect()
    with pytest.raises(ValueError):
        take_docs(nulls, 1)
    twice = spark.createDataFrame([(1, [1]), (1, [2])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="repeated"):
        pack_blocks(twice, 1).collect()


def test_doc_ids_from_any_key(spark):
    keys = [(f"p{i % 7}", i) for i in range(300)]
    random.Random(1).shuffle(keys)
    df = spark.createDataFrame(keys, "path string, turn int").repartition(5)
    got = {(r.path, r.turn): r.doc_id for r in with_doc_id(df, "path", "turn").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    assert with_doc_id(df.where("false"), "path").columns == ["path", "turn", "doc_id"]


def test_the_nth_of_sparse_ids(spark):
    rng = random.Random(9)
    ids = sorted({rng.randint(-(2**62), 2**62) for _ in range(500)} | {0, 1, 2, 3})
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    for n in (1, 7, 250, len(ids)):
        assert sorted(r.doc_id for r in take_docs(df, n).collect()) == ids[:n]
    assert last_of_first(df, len(ids) + 1) is None
