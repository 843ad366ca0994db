"""Counts and thresholds come from all rows."""

import zlib

import numpy as np
import pytest

from tokenloom.llm import quality_rules


def test_every_label_counts(spark):
    """One bad document, whose label is the last of 20,001 by the crc32 of the id."""
    ids = sorted(range(20_001), key=lambda i: (zlib.crc32(str(i).encode()) % (1 << 20), i))
    bad = ids[-1]
    labels = spark.createDataFrame([(i, int(i != bad), 0) for i in ids], "doc_id long, quality int, toxic int")
    prose = "the quiet river runs past the old mill and the garden where children play on long summer days every year"
    junk = " ".join(f"buy{i}" for i in range(25))
    docs = spark.createDataFrame([*((i, f"{prose} {k}") for k, i in enumerate(ids[:20])), (bad, junk)], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, labels).collect()}
    assert not kept.pop(bad)
    assert all(kept.values())


@pytest.mark.parametrize("keep_good", [0.5, 0.9, 0.99, 1.0])
def test_threshold_of_a_table_is_that_of_the_lists(spark, keep_good):
    draw = np.random.default_rng(3)
    good, bad = np.round(draw.normal(1, 1, 300), 1), np.round(draw.normal(0, 1, 200), 1)
    rows = [(float(x), True, False) for x in good] + [(float(x), False, True) for x in bad]
    # Labelled neither way: no cut is placed there.
    rows += [(x / 20 - 3, False, False) for x in range(120)]
    scored = spark.createDataFrame(rows, "score double, trusted boolean, bad boolean")
    assert quality_rules.threshold_of(scored, keep_good) == quality_rules.best_threshold(good, bad, keep_good)
    assert quality_rules.threshold_of(scored.where("trusted"), keep_good) == -np.inf
