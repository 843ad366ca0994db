"""Mixing sources to target weights by entropy balancing.

Among all mixes that meet the token targets, the one closest to the corpus (least relative entropy
of taken to available tokens, no document above `cap` times) gives each document the rate
min(cap, exp(sum of the duals of its groups)). The duals minimise a convex function; Newton steps
find them, each one a Spark job over the cells of the group columns. Duals, slopes and curvatures of
any number of groups stay in tables; the driver sees the largest relative error only. Several small
families take joint steps instead (`balance`), which need fewer of them.

Rates become whole copies without bias by size: in each cell documents go by a hash of their id,
and those below a threshold get one copy more. The threshold is found digit by digit (sums per
65,536 hash ranges, then inside one range), so no group is ever sorted or gathered.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tokenloom.llm.common import numbers
from tokenloom.operators.ordering import with_doc_id
from tokenloom.session import stage_table

#: Hashes have 48 bits: three digits of 16.
DIGIT_BITS = 16
DIGITS = 3
#: What one pass leaves of a target is offered to the documents that fit into the rest.
PASSES = 3
#: Several families of up to so many groups together take joint Newton steps; more go family by family.
MAX_GROUPS = 4096
#: Cells up to this number are broadcast; more are joined.
BROADCAST_CELLS = 65_536


@dataclass
class Family:
    """One set of token constraints: a column, its groups and each group's target."""

    column: str
    keys: list[str]
    targets: list[float]


def id_hash(doc_id: str | Column) -> Column:
    """48 bits of the md5 of the id as text; 0 for null."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.conv(F.substring(F.md5(col.cast("string")), 1, 12), 16, 10).cast("long"), F.lit(0))


def group_key(column: str | Column) -> Column:
    """A group's name; null is a group of its own, unlike any text."""
    col = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("~"))


def share_out(sizes: list[int], weights: list[float], cap: float = 3.0) -> list[float]:
    """Targets by weight that share the sum of `sizes`, none above `cap` times its own size."""
    total, limits = float(sum(sizes)), [cap * s for s in sizes]
    targets, free = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = total
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > limits[i]]
        if not over:
            for i in free:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = limits[i]
        free = [i for i in free if i not in over]
        left = total - sum(targets)
    return targets


def group_sizes(docs: DataFrame, column: str, size: str = "size") -> list[tuple[str, int]]:
    """(key, tokens) of each group by code point, null last; `MAX_GROUPS` at most (see `group_targets`)."""
    rows = (
        docs.groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.sum(size).alias("tokens"))
        .orderBy(F.col("value").asc_nulls_last())
        .limit(MAX_GROUPS + 1)
        .collect()
    )
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"{column} has more than {MAX_GROUPS} groups")
    return [("~" if r["value"] is None else "=" + r["value"], r["tokens"] or 0) for r in rows]


def _indexed(cells: DataFrame, families: list[Family]) -> DataFrame:
    """`cells` with `at`: the global indices of each cell's groups."""
    ids, offset = [], 0
    for f in families:
        keys = F.array(*(F.lit(k) for k in f.keys))
        ids.append((F.array_position(keys, group_key(f.column)) - 1 + offset).cast("int"))
        offset += len(f.keys)
    return cells.withColumn("at", F.array(*ids))


def _tilt(duals: np.ndarray, at: Column) -> Column:
    values = numbers([float(x) for x in duals], "double")
    return F.aggregate(at, F.lit(0.0), lambda total, i: total + F.get(values, i))


def _moments(cells: DataFrame, duals: np.ndarray, cap: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Potential, tokens taken per group, and curvature, summed over all cells by Spark."""
    n, top = len(duals), math.log(cap)
    tilted = cells.select("at", "tokens", _tilt(duals, F.col("at")).alias("eta"))
    taken = F.col("tokens") * F.least(F.exp("eta"), F.lit(cap))
    capped = F.col("eta") >= top
    potential = F.col("tokens") * F.when(capped, cap + cap * (F.col("eta") - top)).otherwise(F.exp("eta"))
    measured = tilted.select(
        "at", potential.alias("potential"), taken.alias("taken"), F.when(capped, 0.0).otherwise(taken).alias("curve")
    )
    pairs = F.flatten(
        F.transform("at", lambda i: F.transform("at", lambda j: F.struct(i.alias("i"), j.alias("j"))))
    )
    first = F.element_at("at", 1)
    parts = measured.select(F.explode(pairs).alias("p"), "taken", "curve", "potential", first.alias("first"))
    # A cell's potential counts once: with the pair of its first group.
    own = (F.col("p.i") == F.col("first")) & (F.col("p.j") == F.col("first"))
    rows = (
        parts.groupBy("p.i", "p.j")
        .agg(
            F.sum("taken").alias("taken"),
            F.sum("curve").alias("curve"),
            F.sum(F.when(own, F.col("potential"))).alias("potential"),
        )
        .collect()
    )
    taken_by, curve, total = np.zeros(n), np.zeros((n, n)), 0.0
    for r in rows:
        curve[r["i"], r["j"]] = r["curve"]
        total += r["potential"] or 0.0
        if r["i"] == r["j"]:
            taken_by[r["i"]] = r["taken"]
    return total, taken_by, curve


def balance(
    cells: DataFrame, families: list[Family], cap: float = 3.0, tolerance: float = 1e-10, max_steps: int = 60
) -> np.ndarray:
    """Duals of the token constraints. `cells` has the family columns and `tokens`.

    Damped Newton steps from zero on the convex dual; a step is halved until the dual falls. Groups
    with target 0 get a dual so low that their rate is 0. Targets no mix can meet are approached.
    """
    targets = np.array([t for f in families for t in f.targets], float)
    if sum(len(f.keys) for f in families) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    scale = max(1.0, targets.max(initial=0.0))
    duals = np.where(targets > 0, 0.0, -800.0)
    live = np.flatnonzero(targets > 0)
    if not len(live):
        return duals
    indexed = stage_table(_indexed(cells.where("tokens > 0"), families).select("at", "tokens"), "cells")

    def measure(x):
        potential, taken, curve = _moments(indexed, x, cap)
        return potential - float(x[live] @ targets[live]), (taken - targets)[live], curve[np.ix_(live, live)]

    value, slope, curve = measure(duals)
    for _ in range(max_steps):
        if np.abs(slope).max() <= tolerance * scale:
            break
        damped = curve + np.eye(len(live)) * 1e-9 * scale
        step = -np.linalg.solve(damped, slope)
        step *= min(1.0, 1.5 / np.abs(step).max())
        for _ in range(20):
            trial = duals.copy()
            trial[live] += step
            found = measure(trial)
            if found[0] <= value + 1e-12 * abs(value):
                break
            step /= 2
        else:
            break
        duals, (value, slope, curve) = trial, found
    return duals


def _step(dual: Column, taken: Column, curve: Column, target: Column, bound: Column) -> Column:
    """The dual after one Newton step; no further than `bound`, beyond which its group is all at the cap."""
    moved = dual + F.greatest((target - taken) / curve, F.lit(-1.5))
    return F.when(target > 0, F.least(moved, bound)).otherwise(dual)


def _start(target: Column) -> Column:
    """Duals begin at the untilted mix; a group with target 0 gets one whose rate is 0."""
    return F.when(target > 0, F.lit(0.0)).otherwise(F.lit(-800.0))


def _worst(target: Column, taken: Column) -> Column:
    return F.max(F.when(target > 0, F.abs(taken - target) / target))


def solve_duals(groups: DataFrame, cap: float = 3.0, tolerance: float = 1e-12, max_steps: int = 200) -> DataFrame:
    """`groups` (tokens and target, one family) with dual and rate, staged; any number of rows.

    The dual of one family splits into its groups, so its curvature is diagonal and a Newton step is
    one projection. Steps from above the solution never cross it, and the cap bounds those from below:
    each step is a descent. A group with a small rate needs about one step for each power of e.
    """
    target, top = F.col("target"), F.lit(math.log(cap))
    taken = F.col("tokens") * F.least(F.exp("dual"), F.lit(float(cap)))
    state = stage_table(groups.withColumn("dual", _start(target)), "duals")
    for _ in range(max_steps):
        worst = state.agg(_worst(target, taken)).first()[0]
        if worst is None or worst <= tolerance:
            break
        state = stage_table(state.withColumn("dual", _step(F.col("dual"), taken, taken, target, top)), "duals")
    return state.withColumn("rate", F.least(F.exp("dual"), F.lit(float(cap))))


def solve_families(
    cells: DataFrame, targets: list[DataFrame], cap: float = 3.0, tolerance: float = 1e-6, max_steps: int = 200
) -> DataFrame:
    """`cells` (_key0, _key1, ..., tokens) with rate; `targets[i]` has _key{i} and target, of any length.

    Family by family: with the other duals held, the curvature is diagonal, so a step sums taken
    tokens and curvature per group and moves each dual by itself. Targets no mix can meet are approached.
    """
    keys, top = [f"_key{i}" for i in range(len(targets))], math.log(cap)
    duals = [f"_dual{i}" for i in range(len(targets))]
    state = stage_table(cells.select(*keys, "tokens", *(F.lit(0.0).alias(d) for d in duals)), "duals")
    eta = sum((F.col(d) for d in duals), F.lit(0.0))
    taken = F.col("tokens") * F.least(F.exp(eta), F.lit(float(cap)))
    wanted = [stage_table(t.select(k, "target"), "targets") for t, k in zip(targets, keys, strict=True)]
    for _ in range(max_steps):
        errors = []
        for key, dual, goal in zip(keys, duals, wanted, strict=True):
            # A cell at the cap counts with its curvature from below.
            free = F.sum(F.when(eta <= top + 1e-9, taken))
            sums = state.where("tokens > 0").groupBy(key).agg(
                F.sum(taken).alias("taken"), F.coalesce(free, F.sum(taken)).alias("curve"),
                F.first(dual).alias("dual"), (F.lit(top) - F.min(eta - F.col(dual))).alias("bound"),
            )
            met = stage_table(sums.join(goal, key), "slopes")
            errors.append(met.agg(_worst(F.col("target"), F.col("taken"))).first()[0] or 0.0)
            step = _step(F.col("dual"), F.col("taken"), F.greatest("curve", F.lit(1e-300)), F.col("target"), F.col("bound"))
            step = F.when(F.col("target") > 0, step).otherwise(F.lit(-800.0))
            moved = met.select(key, step.alias("moved"))
            state = stage_table(
                state.join(_small(moved), key, "left").withColumn(dual, F.coalesce("moved", dual)).drop("moved"), "duals"
            )
        if max(errors) <= tolerance:
            break
    return state.select(*keys, "tokens", F.least(F.exp(eta), F.lit(float(cap))).alias("rate"))


def _thresholds(docs: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """`cells` with `rules`: per pass the hashes from..below and the largest size that get one more copy.

    `docs` has the keys, size and h; `cells` the keys and need (tokens still wanted).
    """
    state = cells.select(
        *keys,
        F.col("need").alias("rest"),
        F.lit(0).cast("long").alias("start"),
        F.array().cast("array<struct<start:bigint,below:bigint,most:bigint>>").alias("rules"),
    )
    for _ in range(PASSES):
        state = _one_pass(docs, state, keys)
    return state.select(*keys, "rules")


def _small(cells: DataFrame) -> DataFrame:
    return F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells


def _one_pass(docs: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Take documents by hash while they fit; `most` keeps out those larger than the whole rest."""
    edge = stage_table(state.withColumns({"prefix": F.lit(0).cast("long"), "left": F.col("rest"), "open": F.lit(True)}), "edge")
    for digit in range(1, DIGITS + 1):
        shift = DIGIT_BITS * (DIGITS - digit)
        met = docs.join(_small(edge.where("open AND rest > 0")), keys).where(
            (F.col("h") >= F.col("start"))
            & (F.col("size") <= F.col("rest"))
            & (F.shiftright("h", shift + DIGIT_BITS) == F.col("prefix"))
        )
        sums = met.groupBy(*keys, F.shiftright("h", shift).alias("range"), "left").agg(F.sum("size").alias("tokens"))
        running = F.sum("tokens").over(Window.partitionBy(*keys).orderBy("range"))
        over = sums.withColumn("running", running).where(F.col("running") > F.col("left"))
        first = over.groupBy(*keys).agg(
            F.min(F.struct("range", (F.col("left") - F.col("running") + F.col("tokens")).alias("left"))).alias("found")
        )
        # A cell with no range that overflows takes everything: it stays without an upper bound.
        edge = stage_table(
            edge.join(first, keys, "left").select(
                *keys, "rest", "start", "rules",
                F.coalesce("found.range", "prefix").alias("prefix"),
                F.coalesce("found.left", "left").alias("left"),
                (F.col("open") & F.col("found").isNotNull()).alias("open"),
            ),
            "edge",
        )
    last = F.lit(1 << (DIGIT_BITS * DIGITS)).cast("long")
    below = F.when(F.col("rest") <= 0, F.col("start")).when(F.col("open"), F.col("prefix")).otherwise(last)
    rule = F.struct(F.col("start"), below.alias("below"), F.col("rest").alias("most"))
    rest = F.when(F.col("rest") > 0, F.when(F.col("open"), F.col("left")).otherwise(F.lit(0))).otherwise(F.lit(0))
    return edge.select(
        *keys, rest.cast("long").alias("rest"), below.alias("start"), F.concat("rules", F.array(rule)).alias("rules")
    )


def mix_copies(docs: DataFrame, families: list[Family], cap: float = 3.0) -> DataFrame:
    """`docs` (with columns size and h, see `id_hash`) with rate and copies.

    Deterministic: the same rows give the same copies. A document without tokens gets the whole part
    of its cell's rate. Rows with one id go together.
    """
    columns = [f.column for f in families]
    keys = [f"_key{i}" for i in range(len(families))]
    keyed = docs.withColumns({k: group_key(c) for k, c in zip(keys, columns, strict=True)})
    sums = keyed.groupBy(*keys).agg(F.first(F.struct(*columns)).alias("own"), F.sum("size").alias("tokens"))
    cells = stage_table(sums.select(*keys, "own.*", "tokens"), "cell-sizes")
    if sum(len(f.keys) for f in families) <= MAX_GROUPS:
        duals = balance(cells, families, cap)
        rate = F.least(F.exp(_tilt(duals, F.col("at"))), F.lit(float(cap)))
        rated = _indexed(cells, families).withColumn("rate", rate)
    else:
        spark = docs.sparkSession
        tables = [
            spark.createDataFrame(list(zip(f.keys, map(float, f.targets), strict=True)), f"{k} string, target double")
            for f, k in zip(families, keys, strict=True)
        ]
        rated = solve_families(cells, tables, cap)
    rated = rated.withColumn("wanted", F.col("rate") * F.col("tokens"))
    return _whole_copies(docs, keyed, keys, rated, cap)


def _whole_copies(docs: DataFrame, keyed: DataFrame, keys: list[str], rated: DataFrame, cap: float, *beside: str) -> DataFrame:
    """`docs` with rate, copies and the columns `beside` of `rated` (the keys, tokens, rate and wanted tokens)."""
    # Rates a rounding error away from a whole number are that number.
    base = F.least(F.floor(F.col("rate") + 1e-9), F.lit(int(cap))).cast("long")
    need = F.round("wanted").cast("long") - base * F.col("tokens")
    rated = stage_table(
        rated.select(*keys, "rate", *beside, base.alias("base"), F.greatest(need, F.lit(0)).cast("long").alias("need")), "rates"
    )
    rules = stage_table(_thresholds(keyed.select(*keys, "size", "h"), rated, keys), "copy-rules")
    plan = stage_table(rated.join(rules, keys).select(*keys, "rate", *beside, "base", "rules"), "copy-plan")
    more = F.exists(
        "rules", lambda r: (F.col("h") >= r["start"]) & (F.col("h") < r["below"]) & (F.col("size") <= r["most"])
    )
    # Which document tops up matters only for those that have tokens.
    extra = F.when((F.col("size") > 0) & more, 1).otherwise(0)
    return keyed.join(_small(plan), keys).select(
        *docs.columns, "rate", (F.col("base") + extra).cast("int").alias("copies"), *beside
    )


#: Weights of the sorted groups, over and over.
CYCLE = (5, 2, 1)


def group_targets(docs: DataFrame, column: str, cap: float = 3.0, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """Staged (_key0, group_size, target) of any number of groups: `share_out` as a table.

    Weights go by the groups' code points, null last. The level of target to weight rises until no
    further group is over its limit: each step is one sum, and fills one group more at least.
    """
    sums = docs.groupBy(F.col(column).cast("string").alias("value")).agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("group_size")
    )
    ranked = with_doc_id(sums.withColumn("no_value", F.isnull("value")), "no_value", "value", doc_id="nth")
    weight = F.get(F.array(*(F.lit(float(w)) for w in cycle)), (F.col("nth") % len(cycle)).cast("int"))
    groups = stage_table(ranked.select(group_key("value").alias("_key0"), "group_size", weight.alias("weight")), "groups")
    limit = F.col("group_size") * F.lit(float(cap))
    some = groups.where("group_size > 0")
    level, filled = 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") > limit
        n, total, at_limit, weights = some.agg(
            F.count_if(full),
            F.coalesce(F.sum("group_size"), F.lit(0)),
            F.coalesce(F.sum(F.when(full, F.col("group_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == filled or not weights:
            break
        level, filled = (total - cap * at_limit) / weights, n
    target = F.least(limit, F.lit(level) * F.col("weight")) if weights else limit
    target = F.when(F.col("group_size") > 0, target).otherwise(F.lit(0.0))
    return stage_table(groups.select("_key0", "group_size", target.alias("target")), "targets")


def mix_groups(docs: DataFrame, column: str = "source", cap: float = 3.0, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """`docs` (see `mix_copies`) with rate, copies, and its group's group_size and target; any number of groups."""
    targets = group_targets(docs, column, cap, cycle)
    rated = solve_duals(targets.withColumn("tokens", F.col("group_size")), cap)
    # The tilted tokens are the target but for a rounding error, which must not move a half to the other side.
    rated = rated.withColumn("wanted", F.round(F.col("rate") * F.col("tokens"), 6))
    keyed = docs.withColumn("_key0", group_key(column))
    return _whole_copies(docs, keyed, ["_key0"], rated, cap, "group_size", "target")


def cycled_weights(n: int, cycle: tuple[float, ...] = CYCLE) -> list[float]:
    return [float(cycle[i % len(cycle)]) for i in range(n)]


def mix_sources(docs: DataFrame, column: str = "source", cap: float = 3.0, weights=cycled_weights) -> tuple[DataFrame, Family, list[int]]:
    """(docs with rate and copies, the targets, the group sizes), targets by weight of the sorted groups.

    `docs` needs size and h columns next to `column`. The targets come to the driver; `mix_groups`
    leaves them in a table.
    """
    found = group_sizes(docs, column)
    sizes = [n for _, n in found]
    family = Family(column, [k for k, _ in found], share_out(sizes, weights(len(found)), cap))
    return mix_copies(docs, [family], cap), family, sizes


def expand_copies(mixed: DataFrame) -> DataFrame:
    """Each row as often as `copies` says; rows without a copy go."""
    times = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies")))
    return mixed.withColumn("_copy", F.explode(times)).drop("_copy")
