"""Language identification, language-model scoring and quality rules."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import helpers
from tokenloom.llm import hmm_language_model as hmm, language_id, quality_rules
from tokenloom.llm.common import bucket_of
from tokenloom.llm.contract import op2_language_id, op5_lm_scoring, op7_quality_rules


# --- language ----------------------------------------------------------------------------


def test_held_out_languages(spark, sf_dir):
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = op2_language_id(spark, sf_dir).join(truth, "doc_id").where("held_out").collect()
    assert len(got) > 20 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_mixture_and_unknown(spark, docs, empty):
    rng = random.Random(1)
    speak = {"aa": ["alpha", "beta", "gamma"], "bb": ["uno", "dos", "tres"], "cc": ["zwei", "drei", "vier"]}
    text = {k: " ".join(rng.choices(v, k=200)) for k, v in speak.items()}
    train = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(text.items())], "doc_id long, text string, lang string")
    model = language_id.train_languages(train)
    assert model.languages == ["aa", "bb", "cc"]
    both = language_id.infer_languages(model, text["aa"] + " " + " ".join(text["bb"].split()[:100]))
    assert [k for k, _ in both] == ["aa", "bb"] and 0.55 < both[0][1] < 0.85
    assert math.isclose(sum(s for _, s in both), 1, abs_tol=1e-9)
    assert [k for k, _ in language_id.infer_languages(model, text["cc"])] == ["cc"]
    found = language_id.identify_languages(docs, model)
    assert found.count() == docs.count()
    blank = found.where("doc_id IS NULL OR lang_pred = 'und'").collect()
    assert all(r.score == 0 for r in blank if r.lang_pred == "und") and any(r.lang_pred == "und" for r in blank)
    nothing = language_id.train_languages(empty)
    assert {r.lang_pred for r in language_id.identify_languages(docs, nothing).collect()} == {"und"}
    assert language_id.identify_languages(empty, model).count() == 0


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = "Straße und Käse, été 12 x" * 40
    whole = language_id.trigram_counts(text)
    monkeypatch.setattr(language_id, "CHUNK_CHARS", 7)
    pieces = language_id.trigram_counts(text)
    assert all(np.array_equal(a, b) for a, b in zip(whole, pieces, strict=True))


# --- hidden Markov model -----------------------------------------------------------------


def by_enumeration(model, s):
    """Likelihood of a short sequence: the sum over all state paths."""
    total = 0.0
    for path in itertools.product(range(len(model.start)), repeat=len(s)):
        p = model.start[path[0]] * model.emit[s[0], path[0]]
        for t in range(1, len(s)):
            p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
        total += p
    return total


def some_model(states=3, symbols=5, seed=0):
    rng = np.random.default_rng(seed)
    emit = rng.random((symbols, states))
    move = rng.random((states, states))
    return hmm.HiddenMarkov(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def test_forward_is_exact():
    model, rng = some_model(), np.random.default_rng(1)
    sequences = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 2, 6, 6)]
    symbols, offsets, order, owner = hmm.time_major(sequences)
    _, scale = hmm.forward(model, symbols, offsets)
    sums = np.bincount(owner, np.log10(scale), len(sequences))
    for place, i in enumerate(order):
        assert math.isclose(10 ** sums[place], by_enumeration(model, sequences[i]), rel_tol=1e-9)


def test_expected_counts_match_enumeration():
    model = some_model()
    s = np.array([0, 3, 1, 3], np.uint16)
    start, move, emit, _ = hmm.expected_counts(model, [s])
    want_start, want_move, want_emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    total = by_enumeration(model, s)
    for path in itertools.product(range(3), repeat=4):
        p = model.start[path[0]] * model.emit[s[0], path[0]]
        for t in range(1, 4):
            p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
        want_start[path[0]] += p / total
        for t in range(4):
            want_emit[s[t], path[t]] += p / total
        for t in range(3):
            want_move[path[t], path[t + 1]] += p / total
    assert np.allclose(start, want_start) and np.allclose(move, want_move) and np.allclose(emit, want_emit)


def plain_base(data):
    def tokens(text):
        return (text or "").encode().lower().split() + [b""]

    counts = collections.Counter()
    for r in data:
        if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2:
            counts.update(tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    out = []
    for r in data:
        t = tokens(r[1])
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)
        out.append((r[0], len(t), sum(counts[w] > 0 for w in t), n, round(base, 6)))
    return out


@pytest.mark.parametrize("head", [hmm.HEAD_SHARE, 200])
def test_base_scores(monkeypatch, docs, head):
    monkeypatch.setattr(hmm, "HEAD_SHARE", head)
    got = hmm.lm_scores(docs, bucket_of("doc_id", 7) != 2, states=2, steps=1).collect()
    found = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert sorted(found, key=str) == sorted(plain_base(helpers.rows()), key=str)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_training_raises_the_likelihood(spark, docs):
    counts = hmm.count_words(docs)
    lexicon = hmm.read_lexicon(counts)
    coded = hmm.encode_symbols(docs, lexicon, F.lit(True))
    _, history = hmm.baum_welch(coded, lexicon, 4, 4, 7)
    assert history == sorted(history)


def test_words_of_a_class_share_its_probability(docs):
    lexicon = hmm.read_lexicon(hmm.count_words(docs))
    table = hmm.Symbols(lexicon)
    words = {w for r in helpers.rows() for w in [*(r[1] or "").encode().lower().split(), hmm.END]}
    table.add(list(words))
    slots = [table.slots[w] for w in words]
    symbol, _, _, _, inner = table.columns
    mass = collections.Counter()
    for slot in slots:
        if symbol[slot] < hmm.CLASSES:
            mass[symbol[slot]] += 10 ** inner[slot]
    for c, total in mass.items():
        # What is left is the probability of a word never seen.
        assert math.isclose(total + 10 ** -lexicon.class_log[c], 1, rel_tol=1e-9)


def test_scores_beat_the_base(spark, sf_dir, empty):
    got = op5_lm_scoring(spark, sf_dir).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert hmm.lm_scores(empty, F.lit(True), 2, 1).count() == 0


def test_nothing_to_learn_from(docs):
    got = hmm.lm_scores(docs, F.lit(False), 2, 1).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and math.isfinite(r.score) for r in got)


# --- quality -----------------------------------------------------------------------------


def plain_rules(text):
    words = (text or "").encode().split()
    chars = sum(len(w.decode()) for w in words)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    grams = collections.defaultdict(list)
    for i in range(len(words) - 7):
        grams[tuple(words[i : i + 8])].append(i)
    hit = {i + k for places in grams.values() if len(places) > 1 for i in places for k in range(8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), chars, symbols, dup, len(hit), failed


def test_rules(spark, docs, empty):
    extra = [(900, "a b c d e f g h " * 9, *[None] * 7), (901, "<a> & | # $ %\n" * 20, *[None] * 7)]
    data = helpers.rows() + extra
    got = quality_rules.quality_rules(helpers.frame(spark, data), None).collect()
    found = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got]
    assert sorted(found, key=str) == sorted([(r[0], *plain_rules(r[1])) for r in data], key=str)
    assert all(r.kept != r.base_failed for r in got)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.quality_rules(empty, labels).count() == 0


def test_verdicts_follow_the_labels(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = op7_quality_rules(spark, sf_dir).where("NOT base_failed").join(labels, "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1 and not r.toxic]
    bad = [r.kept for r in got if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)
    again = {r.doc_id: (r.kept, r.score) for r in op7_quality_rules(spark, sf_dir).collect()}
    assert all(again[r.doc_id] == (r.kept, r.score) for r in got)


def test_threshold():
    good, bad = np.array([1.0, 2.0, 3.0]), np.array([-2.0, -1.0, 1.5])
    assert quality_rules.best_threshold(good, bad, 0.6) == 2.0
    assert quality_rules.best_threshold(good, bad, 1.0) == 1.0
    assert quality_rules.best_threshold(good, bad[:0], 1.0) == -np.inf
