"""Work and memory that must not grow faster than the input."""

import tracemalloc

import numpy as np

from tokenloom.contract import queries as q
from tokenloom.operators import training
from tokenloom.operators.merge_kernel import MergeTable, portion_for, replay
from tokenloom.operators.segments import segment_corpus


def test_ids_without_merges_need_no_scratch():
    tokens, table = np.tile(np.array([0, 1], np.int32), 1 << 19), MergeTable((), (), ())
    tracemalloc.start()
    replay(tokens, np.arange(0, len(tokens), 64), table, revisit=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(tokens)


def test_short_merge_lists_take_small_portions():
    assert portion_for(0) == portion_for(300) == 1 << 20
    assert portion_for(16_384) == 1 << 22


def test_units_are_kept_in_short_ids_with_the_same_merges(spark, sf_dir, monkeypatch):
    assert training._id_kind(1 << 16).itemsize == 2 and training._id_kind((1 << 16) + 1).itemsize == 4
    units = segment_corpus(q.prose(spark, sf_dir).limit(20)).persist()
    short = training.train_bpe(units, 160)
    monkeypatch.setattr(training, "_id_kind", lambda size: training._LONG_ID)
    assert training.train_bpe(units, 160) == short


def test_other_characters_join_the_alphabet(spark):
    units = spark.createDataFrame([("aé\n",), ("b😀a",), ("ab\n",)], "segment string")
    assert {"é", "😀"} <= set(training.train_bpe(units, 107).tokens)


def test_ids_as_text_need_no_lambda(spark):
    rows = spark.createDataFrame([([1, 20],), ([],), (None,)], "ids array<int>").select(q.as_text("ids").alias("t"))
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert [r.t for r in rows.collect()] == ["1,20", "", None]
