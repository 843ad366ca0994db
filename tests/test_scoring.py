import math

from tokenloom.operators.scoring import heldout_loss, prune_beams, topk_exact, topk_renormalize

SCORES = [(1, 10, 3.0), (1, 11, 2.0), (1, 12, 2.0), (1, 13, 1.0), (2, 10, 0.5)]


def scores(spark):
    return spark.createDataFrame(SCORES, "ctx int, next_id int, score double")


def test_renormalize_keeps_ties(spark):
    rows = {(r.ctx, r.next_id): r.prob for r in topk_renormalize(scores(spark), 2, 0.5).collect()}
    top, tied = 1.0, math.exp(-1.0 / 0.5)
    total = top + 2 * tied
    assert set(rows) == {(1, 10), (1, 11), (1, 12), (2, 10)}
    assert abs(rows[(1, 10)] - top / total) < 1e-12
    assert abs(rows[(1, 11)] - tied / total) < 1e-12
    assert rows[(2, 10)] == 1.0


def test_renormalize_stands_large_scores(spark):
    df = spark.createDataFrame([(1, 1, 5000.0), (1, 2, 4999.0)], "ctx int, next_id int, score double")
    assert abs(sum(r.prob for r in topk_renormalize(df, 2).collect()) - 1.0) < 1e-12


def test_exact_keeps_k(spark):
    got = {(r.ctx, r.next_id, r.place) for r in topk_exact(scores(spark), 2).collect()}
    assert got == {(1, 10, 1), (1, 11, 2), (2, 10, 1)}


def test_beams_compete_within_a_prompt(spark):
    df = spark.createDataFrame(
        [(1, 0, 5, -1.0), (1, 1, 6, -0.5), (1, 1, 7, -2.0), (2, 0, 5, -9.0)],
        "prompt int, beam int, next_id int, logp double",
    )
    got = {(r.prompt, r.beam, r.next_id) for r in prune_beams(df, 2).collect()}
    assert got == {(1, 1, 6), (1, 0, 5), (2, 0, 5)}


def test_loss_is_the_mean_of_batch_means(spark):
    rows = [(0, -1.0), (0, -3.0), (1, -4.0), (2, -100.0)]
    df = spark.createDataFrame(rows, "batch_id long, logp double")
    assert tuple(heldout_loss(df, 2).first()) == (3.0, 2)
    assert heldout_loss(df, 10).first().batches == 3
    counted = spark.createDataFrame([(0, -1.0, 3), (0, -5.0, 1)], "batch_id long, logp double, n long")
    assert tuple(heldout_loss(counted, 2).first()) == (2.0, 1)
