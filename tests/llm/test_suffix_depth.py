"""Suffixes are compared only as far as the span."""

import numpy as np
import pytest

from tokenloom.llm import suffix_dedup


@pytest.mark.parametrize("span", [3, 8, 11, 50])
def test_repeats_are_found_without_a_full_suffix_order(monkeypatch, span):
    monkeypatch.setattr(suffix_dedup, "suffix_array", None)
    draw = np.random.default_rng(5)
    raw = np.concatenate([draw.integers(97, 99, 150), np.tile(draw.integers(97, 99, 70), 3)]).astype(np.uint8)
    starts = np.flatnonzero(draw.random(len(raw) - span + 1) < 0.8)
    docs = draw.integers(0, 5, len(starts))
    least = {}
    for at, doc in zip(starts, docs, strict=True):
        key = raw[at : at + span].tobytes()
        least[key] = min(doc, least.get(key, doc))
    expected = [doc > least[raw[at : at + span].tobytes()] for at, doc in zip(starts, docs, strict=True)]
    assert suffix_dedup.later_starts(raw, starts, docs, span).tolist() == expected
