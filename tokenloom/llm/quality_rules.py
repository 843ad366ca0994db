"""Quality rules: fixed rules first, then a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed word n-grams are counted: one over trusted documents, one over the
whole raw corpus. A document's score is its log-likelihood ratio per n-gram. The threshold is found
on the labelled documents, so every document gets the same verdict on every run.

All labelled documents count: the trusted ones by a join, and the threshold is the best over the scores
of all of them, found by running totals in the order of the scores. The driver gets the buckets' counts
and one row for each partition of the scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tokenloom.llm.common import SPACES, WordHashes, batch_of, kind_of, text_hash, tidy
from tokenloom.operators.ordering import prefix_sum, with_doc_id
from tokenloom.session import ship_package, stage_table

SYMBOLS = "#*$%&|<>"
REPEAT_WORDS = 8
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIX = np.uint64(0x9E3779B97F4A7C15)


def ngram_buckets(hashes: np.ndarray, max_n: int = 2) -> np.ndarray:
    """Buckets of all word n-grams up to `max_n`."""
    parts, gram = [], np.zeros(len(hashes), np.uint64)
    for n in range(1, max_n + 1):
        if len(hashes) < n:
            break
        gram = gram[: len(hashes) - n + 1] * MIX + hashes[n - 1 :]
        mixed = (gram ^ (gram >> np.uint64(29))) * MIX
        parts.append((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def repeated_words(hashes: np.ndarray, n: int = REPEAT_WORDS) -> int:
    """Words inside an n-word window that occurs at least twice."""
    if len(hashes) <= n:
        return 0
    window = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        window = window * MIX + hashes[i : i + len(window)]
    order = np.argsort(window, kind="stable")
    ranked = window[order]
    equal = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(window), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + n, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def base_rules(text: str | None, hashes: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words; all 0 for a null text."""
    if not text:
        return 0, 0, 0, 0
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return word_chars, n_symbols, len(lines) - len(set(lines)), repeated_words(hashes)


def _labelled(labels: DataFrame) -> DataFrame:
    """(id, trusted, bad) of the labelled documents. Trusted: quality 1, not toxic."""
    good = F.col("quality") == 1
    return (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.min(good & (F.coalesce("toxic", F.lit(0)) == 0)).alias("trusted"), F.min(~good).alias("bad"))
    )


def ngram_counts(docs: DataFrame, trusted: DataFrame, max_n: int = 2) -> np.ndarray:
    """Two rows of counts per bucket: documents whose id is in `trusted` (id), all documents."""
    # By merging whatever the sizes: the ids grow with the documents, and may not go to every executor.
    ids = trusted.select("id", F.lit(True).alias("trusted")).hint("merge")
    marked = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("id"), "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, total = WordHashes(), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for known, text in zip(batch["trusted"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if not text:
                    continue
                grams = np.bincount(ngram_buckets(hashed.of(text.encode().split()), max_n), minlength=BUCKETS)
                total[1] += grams
                if known:
                    total[0] += grams
        some = np.flatnonzero(total[1])
        yield batch_of({"bucket": some, "trusted": total[0][some], "raw": total[1][some]})

    parts = marked.select("trusted", "text").mapInArrow(tidy(count), "bucket long, trusted long, raw long")
    # At most BUCKETS rows reach the driver.
    rows = parts.groupBy("bucket").agg(F.sum("trusted").alias("trusted"), F.sum("raw").alias("raw")).collect()
    counts = np.zeros((2, BUCKETS))
    for r in rows:
        counts[:, r["bucket"]] = r["trusted"], r["raw"]
    return counts


def _measured(docs: DataFrame, log_ratio: np.ndarray, max_n: int) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(log_ratio)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHashes()
        for batch in batches:
            counts, scores = [], []
            for text in batch["text"].to_pylist():
                words = text.encode().split() if text else []
                hashes = hashed.of(words)
                grams = ngram_buckets(hashes, max_n)
                scores.append(float(model.value[grams].mean()) if len(grams) else 0.0)
                counts.append((len(words), *base_rules(text, hashes)))
            columns = np.array(counts, np.int64).reshape(-1, len(COUNTS)).T
            own = {"doc_id": batch["doc_id"], "text_hash": batch["text_hash"]}
            yield batch_of(own | dict(zip(COUNTS, columns, strict=True)) | {"score": pa.array(scores, pa.float64())})

    schema = f"doc_id {kind_of(docs, 'doc_id')}, text_hash long, {', '.join(f'{c} long' for c in COUNTS)}, score double"
    return docs.select("doc_id", text_hash().alias("text_hash"), "text").mapInArrow(tidy(measure), schema)


def best_threshold(good: np.ndarray, bad: np.ndarray, keep_good: float) -> float:
    """The cut with the most (good kept + bad dropped), that keeps at least `keep_good` of the good."""
    if not len(good) or not len(bad):
        return -np.inf
    good, bad = np.sort(good), np.sort(bad)
    cuts = np.unique(np.concatenate([good, bad]))
    kept = 1 - np.searchsorted(good, cuts, "left") / len(good)
    dropped = np.searchsorted(bad, cuts, "left") / len(bad)
    allowed = kept >= keep_good
    worth = np.where(allowed, kept + dropped, -1)
    return float(cuts[int(np.argmax(worth))])


def threshold_of(scored: DataFrame, keep_good: float) -> float:
    """`best_threshold` of a table (score, trusted, bad) of any size; of equal cuts the lowest."""
    n = {c: F.sum(F.col(c).cast("long")).alias(c) for c in ("trusted", "bad")}
    by_score = stage_table(with_doc_id(scored.where("trusted OR bad").groupBy("score").agg(*n.values()), "score", doc_id="place"), "scores")
    good, bad = by_score.agg(F.sum("trusted"), F.sum("bad")).first()
    if not good or not bad:
        return -np.inf
    below = prefix_sum(by_score, "place", F.col("trusted"), "good_below")
    below = below.join(prefix_sum(by_score.select("place", "bad"), "place", F.col("bad"), "bad_below").drop("bad"), "place")
    kept, dropped = 1 - F.col("good_below") / F.lit(good), F.col("bad_below") / F.lit(bad)
    worth = F.when(kept >= keep_good, kept + dropped).otherwise(-1.0)
    return below.agg(F.max(F.struct(worth.alias("worth"), (-F.col("score")).alias("minus")))["minus"]).first()[0] * -1.0


def quality_rules(
    docs: DataFrame,
    labels: DataFrame | None,
    *,
    min_words: int = 20,
    max_repeat_percent: int = 30,
    max_n: int = 2,
    keep_good: float = 0.99,
    smoothing: float = 1.0,
) -> DataFrame:
    """One row per document row: doc_id, text_hash, counts, base_failed, score, threshold, kept.

    Without usable labels (none, or only of one quality) no document is dropped by its score.
    Null and empty texts have no words and fail the base rules. Equal rows get equal verdicts.
    """
    ship_package(docs.sparkSession)
    log_ratio, known = np.zeros(BUCKETS), None
    if labels is not None:
        known = stage_table(_labelled(labels), "labelled")
        known = None if known.where("trusted").isEmpty() else known
    if known is not None:
        target, raw = ngram_counts(docs, known.where("trusted"), max_n) + smoothing
        log_ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    measured = stage_table(_measured(docs, log_ratio, max_n), "quality")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    threshold = -np.inf
    if known is not None:
        met = measured.where(~failed).join(known, measured["doc_id"] == known["id"])
        threshold = threshold_of(met.groupBy("id", "trusted", "bad").agg(F.min("score").alias("score")), keep_good)
    return measured.select(
        "*",
        failed.alias("base_failed"),
        F.lit(float(threshold)).alias("threshold"),
        (~failed & (F.col("score") >= F.lit(float(threshold)))).alias("kept"),
    )
