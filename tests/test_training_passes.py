"""Passes over the corpus in training: few, and each distinct run merged once."""

import random
import re

import numpy as np
import pytest

from tokenloom.contract import queries as q
from tokenloom.functions.text import tidy_lines
from tokenloom.operators import merge_kernel, training
from tokenloom.operators.merge_kernel import MergeTable, links_of, merge_runs, replay, split_runs, sum_pairs
from tokenloom.operators.segments import segment_corpus, units
from tokenloom.sources.corpus import scan_corpus
from pyspark.sql import functions as F

BATCHES = (
    [(1, 2, 9), (9, 3, 10), (10, 10, 11)],
    [(1, 1, 9), (9, 9, 10), (9, 1, 11)],
    [(1, 2, 9), (3, 9, 4)],
    [(2, 2, 9)],
)


def some_units(seed, width=5):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 30, 400)
    tokens = rng.integers(0, width, lengths.sum()).astype(np.int32)
    return tokens, np.cumsum(lengths) - lengths, rng.integers(1, 4, len(lengths))


@pytest.mark.parametrize("batch", BATCHES)
@pytest.mark.parametrize("small", [0, 1 << 22])
def test_merging_runs_equals_merging_units(batch, small, monkeypatch):
    monkeypatch.setattr(merge_kernel, "_SMALL_TABLE", small)
    for seed in range(20):
        tokens, starts, _ = some_units(seed)
        table = MergeTable(*zip(*batch))
        want = replay(tokens, starts, table, revisit=False)
        got = merge_runs(tokens, starts, table, links_of(batch))
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_a_run_is_merged_once(monkeypatch):
    seen = []
    monkeypatch.setattr(merge_kernel, "replay", lambda tokens, *a, **k: seen.append(len(tokens)) or replay(tokens, *a, **k))
    tokens, starts = np.tile(np.array([1, 2, 3, 5, 0], np.int32), 1000), np.arange(0, 5000, 50)
    merged, _ = merge_runs(tokens, starts, MergeTable((1, 9), (2, 3), (9, 10)), links_of([(1, 2, 9), (9, 3, 10)]))
    assert seen == [3] and merged.tolist() == [10, 5, 0] * 1000


@pytest.mark.parametrize("small", [0, 1 << 22])
def test_pairs_and_runs_of_either_table(small, monkeypatch):
    monkeypatch.setattr(merge_kernel, "_SMALL_TABLE", small)
    tokens, starts, n = some_units(3)
    want = {}
    bodies = np.split(tokens, starts[1:])
    for body, w in zip(bodies, n.tolist()):
        for pair in zip(body.tolist(), body[1:].tolist()):
            want[pair] = want.get(pair, 0) + w
    keys, sums = sum_pairs(tokens, starts, n)
    assert {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(v) for k, v in zip(keys, sums)} == want
    frontier = np.sort(keys[:6])
    runs = []
    for at, body in enumerate(bodies):
        run = body[:1].tolist()
        for a, b in [*zip(body.tolist(), body[1:].tolist()), (None, None)]:
            if a is not None and ((a << 32) | b) in frontier.tolist():
                run.append(b)
            else:
                runs += [(run, at)] if len(run) > 1 else []
                run = [b]
    flat, lengths, unit = split_runs(tokens, starts, frontier)
    assert [(r.tolist(), int(u)) for r, u in zip(np.split(flat, np.cumsum(lengths)[:-1]), unit)] == runs


def test_many_runs_are_learned_from_before_the_corpus_is_read_again(spark, sf_dir, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    rows = [(" ".join(rng.choices(words, k=12)) + "\n",) for _ in range(4000)]
    table = spark.createDataFrame(rows, "segment string").persist()
    few = training.train_bpe(table, 220, run_budget=500)
    monkeypatch.setattr(training, "_WORTH", 1 << 40)
    many = training.train_bpe(table, 220, run_budget=500)
    assert few == many == training.train_bpe(table, 220, run_budget=1 << 30)
    assert few.rounds < many.rounds


def test_units_without_a_pattern(spark):
    texts = [("a\n\nb",), ("",), ("\n",), ("x\n",), (None,), ("é\r\tz\n \n",)]
    df = spark.createDataFrame(texts, "clean_text string")
    want = df.select(F.explode(units(F.concat("clean_text", F.lit("\n")))).alias("segment"))
    got = segment_corpus(df)
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [r.segment for r in got.collect()] == [r.segment for r in want.collect()]


def test_a_corpus_of_many_splits_is_not_moved(spark, tmp_path):
    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat('x', 100) AS text")
    for files, moved in ((1, True), (64, False)):
        path = str(tmp_path / f"{files}")
        docs.repartition(files).write.parquet(path)
        corpus = scan_corpus(spark, path, partitions=q.default_spread(spark))
        assert ("Repartition" in corpus._jdf.queryExecution().optimizedPlan().toString()) == moved
        assert corpus.count() == 2000


def test_lines_are_tidied_as_by_the_plain_rules(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab \t\n\r\x0b\x0c", k=rng.randrange(25))) for _ in range(3000)]
    texts += ["", " ", "\n", " \n ", "a" + " " * 100_000 + "b" + "\t " * 50_000 + "\n" + " " * 100_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tidy_lines(F.col("t")).alias("got")).collect()
    lines = [[line.strip("\t ") for line in re.split(r"[\n\x0b\x0c\r]", t)] for t in texts]
    assert [r.got for r in rows] == ["\n".join(line for line in each if line) for each in lines]
