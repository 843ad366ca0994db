"""Reductions over scored tables; the scores may come from any model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def topk_renormalize(scores: DataFrame, k: int = 10, temperature: float = 1.0) -> DataFrame:
    """Keep scores from the k-th largest up, ties included, and turn them into probabilities."""
    per_ctx = Window.partitionBy("ctx")
    ranked = scores.withColumn("_rank", F.rank().over(per_ctx.orderBy(F.desc("score"))))
    kept = ranked.where(F.col("_rank") <= k)
    weight = F.exp((F.col("score") - F.max("score").over(per_ctx)) / temperature)
    return (
        kept.withColumn("_w", weight)
        .withColumn("prob", F.col("_w") / F.sum("_w").over(per_ctx))
        .select("ctx", "next_id", "score", "prob")
    )


def topk_exact(scores: DataFrame, k: int = 5) -> DataFrame:
    """Exactly `k` continuations per context; equal scores go by id."""
    order = Window.partitionBy("ctx").orderBy(F.desc("score"), "next_id")
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def prune_beams(candidates: DataFrame, width: int) -> DataFrame:
    """The best `width` candidates (prompt, beam, next_id, logp) of each prompt."""
    order = Window.partitionBy("prompt").orderBy(F.desc("logp"), "beam", "next_id")
    return candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= width)


def heldout_loss(scored: DataFrame, n_batches: int) -> DataFrame:
    """Mean over the first batches of their mean negative log-probability, and how many there were.

    Rows may carry a multiplicity `n` (equal positions counted beforehand).
    """
    n = F.col("n") if "n" in scored.columns else F.lit(1)
    per_batch = (
        scored.where(F.col("batch_id") < n_batches)
        .groupBy("batch_id")
        .agg((F.sum(-F.col("logp") * n) / F.sum(n)).alias("loss"))
    )
    return per_batch.agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("batches"))
