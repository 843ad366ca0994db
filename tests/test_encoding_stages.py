"""Encoding by runs, batch of merges after batch, gives what all merges give at once."""

import random

import numpy as np
import pytest

from tokenloom.operators import merge_kernel
from tokenloom.operators.encoding import encode_corpus
from tokenloom.operators.merge_kernel import MergeTable, merge_all, replay
from tokenloom.operators.vocabulary import Vocabulary


def random_merges(rng, n, fresh=True):
    made, merges = list(range(6)), []
    pairs = set()
    while len(merges) < n:
        pair = (rng.choice(made), rng.choice(made))
        if pair in pairs:
            continue
        pairs.add(pair)
        new = 6 + len(merges) if fresh or rng.random() < 0.8 else rng.choice(made)
        merges.append((*pair, new))
        made.append(new)
    return merges


@pytest.mark.parametrize("ends", [(1, 2, 3), (2, 9), (32, 128, 512)])
@pytest.mark.parametrize("fresh", [True, False])
def test_stages_give_the_same_ids(ends, fresh, monkeypatch):
    monkeypatch.setattr(merge_kernel, "_STAGE_ENDS", ends)
    for seed in range(30):
        rng = random.Random(seed)
        table = MergeTable(*zip(*random_merges(rng, 20, fresh)))
        lengths = np.array([rng.randint(1, 40) for _ in range(50)])
        tokens = np.array([rng.randrange(6) for _ in range(lengths.sum())], dtype=np.int32)
        starts = np.cumsum(lengths) - lengths
        want, got = replay(tokens, starts, table, revisit=True), merge_all(tokens, starts, table)
        assert [a.tolist() for a in got] == [a.tolist() for a in want]
        assert not fresh or len(table.stages) > (20 > ends[0])


def test_frequent_merges_are_made_once_for_a_run(monkeypatch):
    seen = []
    monkeypatch.setattr(merge_kernel, "replay", lambda tokens, *a, **k: seen.append(len(tokens)) or replay(tokens, *a, **k))
    merge_all(np.tile(np.array([1, 2, 0], np.int32), 5000), np.arange(0, 15000, 30), MergeTable((1,), (2,), (9,)))
    assert sum(seen) == 2


def test_reserved_and_other_characters(spark):
    vocab = Vocabulary()
    ids = vocab.ids()
    texts = ["<UNK>a<SCOPE_IN>\nb", "aé😀\n<SCOPE_OUT>", "", "<SCOPE_IN>", "plain\ntext"]
    want = [
        [0, ids["a"], 1, ids["\n"], ids["b"]],
        [ids["a"], 0, 0, ids["\n"], 2],
        [],
        [1],
        [ids[c] for c in "plain\ntext"],
    ]
    for rows in (texts, texts[2:], texts[:1]):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, clean_text string").coalesce(1)
        got = {r.doc_id: r.ids for r in encode_corpus(df, vocab).collect()}
        assert [got[i] for i in range(len(rows))] == [want[texts.index(t)] for t in rows]
