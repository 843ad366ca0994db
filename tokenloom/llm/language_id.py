"""Language ID: which languages a document mixes, and in what proportions.

Every language is a multinomial over hashed character trigrams, counted over all training documents.
A document is a mixture of languages; expectation-maximisation estimates its proportions, and the
set of languages is the one with the best penalised likelihood among the nested sets of its largest
components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tokenloom.llm.common import batch_of, kind_of
from tokenloom.session import ship_package

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
UNKNOWN = "und"
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
CHUNK_CHARS = 1 << 20


@cache
def _letters() -> np.ndarray:
    """True for each code point that is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def trigram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the text's character trigrams; no bucket if it has no letter.

    Lower-cased; everything but letters counts as one kind of gap. Trigrams hold a letter.
    A long text is read in overlapping pieces, so memory is bounded.
    """
    total = np.zeros(BUCKETS, np.int64) if text and len(text) > CHUNK_CHARS else None
    grams = np.zeros(0, np.int64)
    for start in range(0, len(text or ""), CHUNK_CHARS):
        raw = text[max(0, start - 1) : start + CHUNK_CHARS + 1].lower().encode("utf-32-le", "replace")
        points = np.frombuffer(raw, np.uint32)
        letter = _letters()[points]
        points = np.where(letter, points, 0).astype(np.uint32)
        if start == 0:
            points = np.concatenate([np.zeros(1, np.uint32), points])
        if start + CHUNK_CHARS >= len(text):
            points = np.concatenate([points, np.zeros(1, np.uint32)])
        if len(points) < 3:
            continue
        a, b, c = points[:-2], points[1:-1], points[2:]
        mixed = a * FACTORS[0] ^ (b * FACTORS[1] + (c * FACTORS[2] >> np.uint32(7)))
        mixed = (mixed ^ (mixed >> np.uint32(15))) * FACTORS[1]
        grams = (mixed[b > 0] >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
        if total is not None:
            total += np.bincount(grams, minlength=BUCKETS)
    if total is None:
        return np.unique(grams, return_counts=True)
    found = np.flatnonzero(total)
    return found, total[found]


@dataclass
class LanguageModel:
    languages: list[str]
    #: (bucket, language) probabilities.
    probs: np.ndarray


def train_languages(docs: DataFrame, smoothing: float = 0.5) -> LanguageModel:
    """Trigram counts of every language in `lang`, over all rows that have one.

    The table that reaches the driver has `BUCKETS` cells per language.
    """
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found, n = trigram_counts(text)
                if len(found):
                    totals.setdefault(lang, np.zeros(BUCKETS, np.int64))[found] += n
        for lang, total in totals.items():
            some = np.flatnonzero(total)
            yield batch_of({"lang": [lang] * len(some), "bucket": some, "n": total[some]})

    rows = (
        docs.where(F.col("lang").isNotNull())
        .select("lang", "text")
        .mapInArrow(count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .groupBy("lang")
        .agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("counts"))
        .orderBy("lang")
        .collect()
    )
    counts = np.full((BUCKETS, len(rows)), smoothing)
    for k, r in enumerate(rows):
        counts[np.array(r["buckets"]), k] += np.array(r["counts"])
    return LanguageModel([r["lang"] for r in rows], counts / counts.sum(0, keepdims=True))


def fit_mixture(probs: np.ndarray, counts: np.ndarray, steps: int = 12) -> tuple[np.ndarray, float]:
    """Proportions of the columns of `probs` and the log-likelihood, by expectation-maximisation."""
    share = np.full(probs.shape[1], 1 / probs.shape[1])
    n = counts.sum()
    for _ in range(steps if probs.shape[1] > 1 else 0):
        joint = probs * share
        share = (counts / joint.sum(1)) @ joint / n
    return share, float(counts @ np.log(probs @ share))


def infer_languages(model: LanguageModel, text: str | None, penalty: float = 1.0) -> list[tuple[str, float]]:
    """(language, proportion) of the selected set, largest first; empty if nothing can be told.

    Sets grow in order of the full mixture's proportions while the penalised likelihood gains:
    each further language costs `penalty` * log(number of trigrams) per three trigrams of overlap.
    """
    found, counts = trigram_counts(text)
    if not len(found) or not model.languages:
        return []
    probs = model.probs[found]
    full, _ = fit_mixture(probs, counts)
    order = np.lexsort((np.arange(len(full)), -full))
    # Overlapping trigrams see each character three times: a third of the likelihood is evidence.
    cost = 3 * penalty * np.log(max(2, counts.sum())) / 2
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for size in range(1, len(order) + 1):
        chosen = order[:size]
        share, fit = fit_mixture(probs[:, chosen], counts)
        worth = fit - cost * size
        if best is not None and worth <= best[0]:
            break
        best = (worth, chosen, share)
    _, chosen, share = best
    ranked = sorted(zip(share, chosen, strict=True), key=lambda x: (-x[0], x[1]))
    return [(model.languages[k], float(s)) for s, k in ranked]


def identify_languages(docs: DataFrame, model: LanguageModel, penalty: float = 1.0) -> DataFrame:
    """One row per document row: doc_id, lang_pred, score, mixture (array of language, share).

    `lang_pred` is the largest component and `score` its share. A text that is null or has no letter
    is "und" with score 0, and so is every text if no language was learned.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mixtures = [infer_languages(shared.value, text, penalty) for text in batch["text"].to_pylist()]
            yield batch_of(
                {
                    "doc_id": batch["doc_id"],
                    "lang_pred": [m[0][0] if m else UNKNOWN for m in mixtures],
                    "score": [min(1.0, m[0][1]) if m else 0.0 for m in mixtures],
                    "mixture": [[{"lang": k, "share": s} for k, s in m] for m in mixtures],
                },
                lang_pred=pa.string(),
                score=pa.float64(),
                mixture=pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])),
            )

    kept = f"doc_id {kind_of(docs, 'doc_id')}, lang_pred string, score double"
    return docs.select("doc_id", "text").mapInArrow(
        predict, f"{kept}, mixture array<struct<lang:string,share:double>>"
    )
