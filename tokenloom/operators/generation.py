"""Generation as table jobs over next-token scores: draws, sampled lines, beam search, healed prompts.

`scores` has ctx (the id before), next_id and score (log-probability) and may come from any model
whose scores hang on the id before. All prompts advance together: a step joins the open rows with the
scored table, reduces them per prompt, and is written, so a lost executor repeats one step at most.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from tokenloom.operators.scoring import topk_exact, topk_renormalize
from tokenloom.operators.vocabulary import Vocabulary
from tokenloom.session import stage_table


def hashed_uniform(seed: int, *columns: str) -> Column:
    """A number between 0 and 1 that hangs on the values alone: reruns and retries agree."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns))
    head = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    return (head + 0.5) / float(1 << 32)


def _gumbel(seed: int, *columns: str) -> Column:
    return -F.log(-F.log(hashed_uniform(seed, *columns)))


def draw_next(scores: DataFrame, k: int = 10, temperature: float = 1.0, seed: int = 0, draws: int = 1) -> DataFrame:
    """(ctx, draw, next_id, prob): `draws` continuations of each context from its renormalised top k.

    The largest of log-probability plus Gumbel noise is a draw from the distribution, so a draw is
    one aggregation that combines early. Equal values go by the smaller id.
    """
    kept = topk_renormalize(scores, k, temperature)
    each = kept.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    noisy = F.col("score") / temperature + _gumbel(seed, "ctx", "draw", "next_id")
    picked = F.max(F.struct(noisy.alias("noisy"), (-F.col("next_id")).alias("minus"), "next_id", "prob")).alias("best")
    return each.groupBy("ctx", "draw").agg(picked).select("ctx", "draw", "best.next_id", "best.prob")


def sample_lines(
    prompts: DataFrame,
    scores: DataFrame,
    max_new: int,
    newline_id: int,
    end_id: int | None = None,
    n_lines: int = 1,
    k: int = 10,
    temperature: float = 1.0,
    seed: int = 0,
) -> DataFrame:
    """(prompt, ids): what is sampled after each prompt (prompt, ctx) until it stops.

    It stops before the end id, after `n_lines` newlines, after `max_new` ids, or where nothing may
    follow.
    """
    kept = stage_table(topk_renormalize(scores, k, temperature), "kept-scores")
    none = F.array().cast("array<int>")
    rows = prompts.select("prompt", "ctx", none.alias("ids"), F.lit(0).alias("lines"))
    done = []
    for step in range(max_new):
        noisy = F.col("score") / temperature + _gumbel(seed, "prompt", "step", "next_id")
        met = rows.withColumn("step", F.lit(step)).join(kept, "ctx", "left")
        best = F.struct(noisy.alias("noisy"), (-F.col("next_id")).alias("minus"), "next_id")
        grown = met.groupBy("prompt").agg(
            F.max(F.when(F.col("next_id").isNotNull(), best)).alias("best"), F.first("ids").alias("ids"), F.first("lines").alias("lines")
        )
        next_id = F.col("best.next_id")
        ended = next_id.isNull() | (next_id == end_id if end_id is not None else F.lit(False))
        lines = F.col("lines") + F.when(~ended & (next_id == newline_id), 1).otherwise(0)
        drawn = grown.select(
            "prompt",
            next_id.alias("ctx"),
            F.when(ended, F.col("ids")).otherwise(F.concat("ids", F.array(next_id))).alias("ids"),
            lines.alias("lines"),
            (ended | (lines >= n_lines)).alias("stopped"),
        )
        drawn = stage_table(drawn, "sampled")
        done.append(drawn.where("stopped").select("prompt", "ids"))
        rows = drawn.where("NOT stopped").drop("stopped")
        if rows.isEmpty():
            break
    found = rows.select("prompt", "ids")
    for some in done:
        found = found.unionByName(some)
    return found


def beam_search(
    prompts: DataFrame,
    scores: DataFrame,
    newline_id: int,
    width: int = 5,
    max_steps: int = 50,
    stop_factor: float = 10.0,
    starts: DataFrame | None = None,
    blank_ids: tuple[int, ...] = (),
) -> DataFrame:
    """(prompt, ids, logp): the most probable line after each prompt (prompt, ctx), newline included.

    Every step keeps the best `width` of all continuations of a prompt; those that end in the newline
    are finished, the others go on. A prompt stops when its best open beam is less probable than its
    best finished line by more than `stop_factor`, when no beam is open, or after `max_steps`. Of the
    finished lines the most probable wins that has an id outside `blank_ids`, else the most probable;
    equal ones go by the earlier step, then by place. Without a finished line ids is empty, logp null.
    `starts` (prompt, next_id) limits a prompt's first id, for prompts that are in it.
    """
    top = stage_table(topk_exact(scores, width).select("ctx", "next_id", "score", F.col("place").alias("rank")), "top-scores")
    none = F.array().cast("array<int>")
    open_beams = prompts.select("prompt", "ctx", F.lit(0).alias("beam"), none.alias("ids"), F.lit(0.0).alias("logp"))
    spark = prompts.sparkSession
    finished = spark.createDataFrame([], "prompt " + prompts.schema["prompt"].dataType.simpleString() + ", ids array<int>, logp double, step int, beam int")
    for step in range(max_steps):
        grown = open_beams.join(top, "ctx")
        if step == 0 and starts is not None:
            limited = starts.select("prompt").distinct().withColumn("limited", F.lit(True))
            allowed = starts.select("prompt", "next_id").distinct().withColumn("allowed", F.lit(True))
            grown = grown.join(limited, "prompt", "left").join(allowed, ["prompt", "next_id"], "left")
            grown = grown.where("limited IS NULL OR allowed").drop("limited", "allowed")
        grown = grown.select(
            "prompt", "next_id", "beam", "rank", F.concat("ids", F.array("next_id")).alias("ids"), (F.col("logp") + F.col("score")).alias("logp")
        )
        order = Window.partitionBy("prompt").orderBy(F.desc("logp"), "beam", "rank")
        best = grown.withColumn("place", F.row_number().over(order)).where(F.col("place") <= width)
        kept = stage_table(best.select("prompt", F.col("next_id").alias("ctx"), F.col("place").alias("beam"), "ids", "logp"), "beams")
        ended = kept.where(F.col("ctx") == newline_id).select("prompt", "ids", "logp", F.lit(step).alias("step"), "beam")
        finished = finished.unionByName(ended)
        open_beams = kept.where(F.col("ctx") != newline_id)
        # A prompt goes on while its best open beam is within reach of its best finished line.
        line = finished.groupBy("prompt").agg(F.max("logp").alias("line"))
        reach = open_beams.groupBy("prompt").agg(F.max("logp").alias("open")).join(line, "prompt", "left")
        going = reach.where(F.col("line").isNull() | (F.col("open") >= F.col("line") - math.log(stop_factor))).select("prompt")
        open_beams = stage_table(open_beams.join(going, "prompt", "left_semi"), "open-beams")
        if open_beams.isEmpty():
            break
    blank = F.array(*(F.lit(i) for i in blank_ids)).cast("array<int>")
    full = F.size(F.array_except("ids", blank)) > 0
    text = F.struct(full.alias("full"), "logp", (-F.col("step")).alias("step"), (-F.col("beam")).alias("beam"), "ids")
    won = finished.groupBy("prompt").agg(F.max(text).alias("won"))
    found = prompts.select("prompt").join(won, "prompt", "left")
    return found.select("prompt", F.coalesce("won.ids", none).alias("ids"), F.col("won.logp").alias("logp"))


def heal_prompts(prompts: DataFrame, vocab: Vocabulary, text: str = "text") -> DataFrame:
    """`prompts` with `healed` and `tail`: the text cut where its tail is no token and its head survives encoding.

    The shortest such tail wins; it may be empty. A head survives if it holds no reserved token and
    no character outside the vocabulary, since those are lost in decoding. Where no cut will do, the
    whole text is tail. Only tails as long as a token can be tokens, so that many cuts are tried.
    """
    alphabet = "".join(re.escape(t) for t in vocab.tokens if len(t) == 1)
    whole = F.col(text)
    known = F.length(F.regexp_extract(whole, f"^[{alphabet}]*+", 0)) if alphabet else F.lit(0)
    # A head may reach to the last character before a reserved token is complete.
    stops = [F.instr(whole, s) + len(s) - 2 for s in vocab.specials]
    clear = [F.when(F.instr(whole, s) > 0, stop).otherwise(F.length(whole)) for s, stop in zip(vocab.specials, stops, strict=True)]
    longest = F.least(F.length(whole), known, *clear)
    tokens = sorted(vocab.tokens, key=lambda t: (len(t), t))
    most = len(tokens[-1]) if tokens else 0
    table = F.broadcast(prompts.sparkSession.createDataFrame([(t,) for t in tokens], "_token string"))

    rows = stage_table(prompts.withColumn("_row", F.monotonically_increasing_id()).withColumn("_longest", longest), "prompts")
    cuts = F.sequence(F.col("_longest"), F.greatest(F.lit(0), F.length(whole) - most - 1, F.lit(0)), F.lit(-1))
    # The first cut whose tail is longer than any token always does.
    tried = F.when(F.length(whole) - F.col("_longest") > most, F.array("_longest")).otherwise(cuts)
    each = rows.where(whole.isNotNull()).select("_row", whole.alias("_text"), F.explode(tried).alias("_cut"))
    tails = each.withColumn("_token", F.expr("substring(_text, _cut + 1)"))
    free = tails.join(table, "_token", "left_anti").groupBy("_row").agg(F.max("_cut").alias("_cut"))
    cut = F.coalesce("_cut", F.lit(0))
    healed = rows.join(free, "_row", "left").withColumn("_at", cut)
    return healed.select(
        *prompts.columns,
        F.expr(f"substring(`{text}`, 1, _at)").alias("healed"),
        F.expr(f"substring(`{text}`, _at + 1)").alias("tail"),
    )
