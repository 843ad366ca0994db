import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators.encoding import decode_tokens, encode_corpus
from tokenloom.operators.generation import beam_search, draw_next, heal_prompts, sample_lines
from tokenloom.operators.segments import segment_corpus
from tokenloom.operators.training import train_bpe
from tokenloom.operators.vocabulary import Vocabulary

NEWLINE = 0


def table(seed=1, n=12):
    """ctx -> {next_id: log-probability}; one context has no continuation."""
    rng = random.Random(seed)
    found = {}
    for ctx in range(n - 1):
        weights = {i: rng.choice([1, 1, 2, 5, 9]) for i in rng.sample(range(n), 7)}
        total = sum(weights.values())
        found[ctx] = {i: math.log(w / total) for i, w in weights.items()}
    return found


def frame(spark, scores):
    rows = [(c, i, s) for c, row in scores.items() for i, s in row.items()]
    return spark.createDataFrame(rows, "ctx int, next_id int, score double").repartition(3)


def test_draws_follow_the_probabilities(spark):
    scores = {1: {i: math.log(w) for i, w in enumerate([0.5, 0.3, 0.15, 0.05])}}
    rows = draw_next(frame(spark, scores), k=3, draws=4000, seed=5).collect()
    share = collections.Counter(r.next_id for r in rows)
    assert set(share) == {0, 1, 2}
    for i, p in enumerate([0.5, 0.3, 0.15]):
        assert abs(share[i] / 4000 - p / 0.95) < 0.03
    again = draw_next(frame(spark, scores).repartition(7), k=3, draws=4000, seed=5).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in again}


def test_sampled_lines_stop(spark):
    prompts = spark.createDataFrame([(p, p % 12) for p in range(60)], "prompt int, ctx int")
    scores = table()
    rows = {r.prompt: r.ids for r in sample_lines(prompts, frame(spark, scores), 9, NEWLINE, end_id=3, n_lines=2, k=4).collect()}
    assert len(rows) == 60
    for p, ids in rows.items():
        path = [p % 12, *ids]
        for a, b in zip(path, path[1:]):
            worst = sorted(scores[a].values(), reverse=True)[3]
            assert scores[a][b] >= worst and b != 3
        assert ids.count(NEWLINE) <= 2 and len(ids) <= 9
        if ids.count(NEWLINE) == 2:
            assert ids[-1] == NEWLINE
    assert {len(x) for x in rows.values()} != {9} and rows[11] == []


def plain_search(scores, start, width, max_steps, factor, blank, first=None):
    active, finished = [(0.0, [])], []
    for step in range(max_steps):
        grown = []
        for logp, ids in active:
            last = ids[-1] if ids else start
            best = sorted(scores.get(last, {}).items(), key=lambda x: (-x[1], x[0]))[:width]
            grown += [(logp + s, ids + [i]) for i, s in best]
        if step == 0 and first is not None:
            grown = [g for g in grown if g[1][-1] in first]
        grown.sort(key=lambda g: -g[0])
        active = [g for g in grown[:width] if g[1][-1] != NEWLINE]
        finished += [g for g in grown[:width] if g[1][-1] == NEWLINE]
        if not active:
            break
        if finished and max(a[0] for a in active) < max(f[0] for f in finished) - math.log(factor):
            break
    full = [f for f in finished if set(f[1]) - set(blank)]
    if not finished:
        return [], None
    logp, ids = max(full or finished, key=lambda f: f[0])
    return ids, logp


@pytest.mark.parametrize("width,factor", [(1, 2.0), (3, 1.5), (4, 100.0)])
def test_beam_search_equals_a_loop(spark, width, factor):
    scores = table(width)
    prompts = spark.createDataFrame([(f"p{c}", c) for c in range(14)], "prompt string, ctx int")
    only = [(f"p{c}", i) for c in (2, 5) for i in (1, 4, 6)]
    starts = spark.createDataFrame(only, "prompt string, next_id int")
    got = beam_search(prompts, frame(spark, scores), NEWLINE, width, 6, factor, starts, blank_ids=(NEWLINE, 1)).collect()
    assert len(got) == 14
    for r in got:
        c = int(r.prompt[1:])
        ids, logp = plain_search(scores, c, width, 6, factor, (NEWLINE, 1), {1, 4, 6} if c in (2, 5) else None)
        assert r.ids == ids, r
        assert (r.logp is None) == (logp is None) and (logp is None or abs(r.logp - logp) < 1e-9)


def plain_heal(text, vocab, survives):
    for i in range(len(text), -1, -1):
        if text[i:] in vocab.tokens:
            continue
        if not text[:i]:
            return "", text[i:]
        if survives(text[:i]):
            return text[:i], text[i:]
    return "", text


def test_healing_equals_a_loop_with_real_round_trips(spark):
    lines = ["for i in range(10):", "return value", "print(value)", "for value in values:"]
    corpus = spark.createDataFrame([(i, "\n".join(lines * 3)) for i in range(3)], "doc_id long, clean_text string")
    vocab = train_bpe(segment_corpus(corpus), 150)
    texts = ["", "for", "for é", "é", "return valu", "x<SCOPE_IN>for", "<SCOPE_OUT>", "a<UNK>", "val<SCOPE_I", "éfor i in range", "print(é", "<SCOPE_IN>"]
    texts += [f"{a}{b}" for a in ("for i", "é", "<UNK>") for b in ("", "return", "r", " value")]
    heads = sorted({t[:i] for t in texts for i in range(1, len(t) + 1)})
    docs = spark.createDataFrame(list(enumerate(heads)), "doc_id long, clean_text string")
    back = encode_corpus(docs, vocab).select("doc_id", decode_tokens(F.col("ids"), vocab).alias("back")).collect()
    survives = {heads[r.doc_id]: r.back == heads[r.doc_id] for r in back}
    prompts = spark.createDataFrame([(t, 1) for t in texts] + [(None, 2)], "text string, tag int")
    got = {r.text: (r.healed, r.tail) for r in heal_prompts(prompts, vocab).collect()}
    assert got.pop(None) == (None, None)
    for text in texts:
        assert got[text] == plain_heal(text, vocab, lambda head: survives[head]), text


def test_no_prompts(spark):
    none = spark.createDataFrame([], "prompt int, ctx int")
    scores = frame(spark, table())
    assert beam_search(none, scores, NEWLINE).collect() == [] and sample_lines(none, scores, 3, NEWLINE).collect() == []
    assert heal_prompts(spark.createDataFrame([], "text string"), Vocabulary()).collect() == []
