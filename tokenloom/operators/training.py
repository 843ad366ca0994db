"""Vocabulary training: serial BPE results from few passes over the data.

Serial BPE merges one pair per pass. Here a pass settles a whole batch, with the same result:

1. Count all adjacent pairs and take the K first in merge order (count down, then ids up).
   Call them the frontier; every other pair sorts after its last member.
2. Cut each unit wherever an adjacent pair is outside the frontier, and count the distinct
   pieces ("runs"). A pair that later forms across a cut stems from one outside pair, so its
   count is no higher and its ids are no smaller: it sorts after the frontier as well.
3. Merging over the counted runs alone therefore picks the very pairs serial BPE would pick,
   for as long as the best pair sorts no later than the frontier's end. At least one does.
4. Apply the batch to all units, in rank order, and go on.

What reaches the driver is bounded by `run_budget` tokens, whatever the corpus size: the size
is read first. More runs than that stay in a table, and the same steps over this table alone settle
the merges up to the frontier's end, if it is far smaller than the units; else K shrinks until it
fits (K = 1 yields one run per pair repetition). So a large corpus is not read for every batch.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tokenloom.operators.merge_kernel import (
    MergeTable,
    links_of,
    merge_runs,
    pair_keys,
    portion_for,
    portions,
    split_runs,
    sum_pairs,
)
from tokenloom.operators.segments import segment_counts
from tokenloom.operators.vocabulary import ALPHABET, SPECIAL_TOKENS, Vocabulary
from tokenloom.operators.worker import tidy
from tokenloom.session import shared_dir


# Between the passes a unit is a BINARY of little-endian ids: it goes to Arrow and back as one
# copy, where an array column is converted element by element. The units are kept and read in
# every pass, so ids take 16 bits where the vocabulary allows.
_SHORT_ID, _LONG_ID = np.dtype("<u2"), np.dtype("<i4")
_PARTITION_CHARS = 1 << 24
# The counted units stay as they are in partitions of at most so many times these characters, and in at
# most so many times the partitions (before the former).
_ENOUGH, _MANY = 4, 64
# Runs are a table to learn from if they have so many times fewer tokens than their units. A table of so
# many times the driver's budget begins with the larger frontier.
_WORTH, _LARGE_FROM, _LARGE_START = 12, 64, 64


def _id_kind(vocab_size: int) -> np.dtype:
    return _SHORT_ID if vocab_size <= 1 << 16 else _LONG_ID


def _portions(batches, kind: np.dtype, n_merges: int = 0):
    """The units of a partition in stretches that bound a task's memory."""
    for batch in batches:
        ids = batch.column("ids")
        ends = np.frombuffer(ids.buffers()[1], dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1]
        for first, last in portions(np.diff(ends) // kind.itemsize, portion_for(n_merges)):
            yield batch.slice(first, last - first)


def _flat(batch: pa.RecordBatch, kind: np.dtype):
    """Tokens, unit starts and weights of a batch of non-empty units."""
    ids = batch.column("ids")
    _, ends, data = ids.buffers()
    offsets = np.frombuffer(ends, dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1] // kind.itemsize
    tokens = np.frombuffer(data, dtype=kind)[offsets[0] : offsets[-1]] if len(ids) else np.empty(0, kind)
    return tokens.astype(np.int32), offsets[:-1].astype(np.int64) - offsets[0], batch.column("n").to_numpy()


def _packed(tokens: np.ndarray, lengths: np.ndarray, kind: np.dtype) -> pa.Array:
    """One BINARY value per stretch of `lengths` tokens."""
    offsets = np.concatenate(([0], np.cumsum(lengths) * kind.itemsize)).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(tokens.astype(kind).tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(lengths), buffers)


# A pass that makes units also counts their pairs, so that they are not read for it again. Its rows are
# units (ids, n), and at the end of a partition its pair sums (pairs).
_UNITS = "ids binary, n long, pairs binary"
_PAIR = np.dtype([("key", "<i8"), ("n", "<i8")])
# Pairs, and bytes of runs, that a task holds before it adds up equal ones; pairs in one row.
_HELD_PAIRS, _HELD_RUNS, _PAIRS_IN_ROW = 1 << 20, 1 << 24, 1 << 16


class _PairSums:
    """Pair sums of a partition in bounded memory."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, tokens: np.ndarray, starts: np.ndarray, weights: np.ndarray):
        """Count the pairs of more units; yields rows if there are too many pairs to hold."""
        if len(tokens) < 2:
            return
        self.parts.append(sum_pairs(tokens, starts, weights))
        self.held += len(self.parts[-1][0])
        if self.held > _HELD_PAIRS:
            self._add_up()
            if self.held > _HELD_PAIRS // 2:
                yield from self.rows()

    def _add_up(self) -> None:
        keys, n = (np.concatenate(c) for c in zip(*self.parts))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        self.parts, self.held = [(keys[heads], np.add.reduceat(n, heads))], len(heads)

    def rows(self):
        if not self.held:
            return
        self._add_up()
        ((keys, n),) = self.parts
        packed = np.empty(len(keys), dtype=_PAIR)
        packed["key"], packed["n"] = keys, n
        for at in range(0, len(packed), _PAIRS_IN_ROW):
            some = pa.array([packed[at : at + _PAIRS_IN_ROW].tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), some], ["ids", "n", "pairs"])
        self.parts, self.held = [], 0


def _unit_rows(tokens: np.ndarray, lengths: np.ndarray, n: pa.Array, kind: np.dtype) -> pa.RecordBatch:
    units = [_packed(tokens, lengths, kind), n, pa.nulls(len(n), pa.binary())]
    return pa.RecordBatch.from_arrays(units, ["ids", "n", "pairs"])


def _units(rows: DataFrame) -> DataFrame:
    return rows.where("ids IS NOT NULL").select("ids", "n")


def _pair_counts(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for sums in batch.column("pairs"):
                found = np.frombuffer(sums.as_buffer(), dtype=_PAIR)
                left, right = (found["key"] >> 32).astype(np.int32), (found["key"] & 0xFFFFFFFF).astype(np.int32)
                columns = [pa.array(left), pa.array(right), pa.array(found["n"].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["left_id", "right_id", "n"])

    sums = rows.where("pairs IS NOT NULL").select("pairs").mapInArrow(tidy(run), "left_id int, right_id int, n long")
    return sums.groupBy("left_id", "right_id").agg(F.sum("n").alias("n"))


def _sum_runs(pieces: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(pieces).group_by("run", use_threads=False).aggregate([("n", "sum")])
    return sums.rename_columns({"n_sum": "n"}).select(["run", "n"])


def _count_runs(segments: DataFrame, frontier: np.ndarray, kind: np.dtype) -> DataFrame:
    def run(batches):
        held = []
        for batch in _portions(batches, kind):
            tokens, starts, n = _flat(batch, kind)
            if len(tokens) < 2:
                continue
            flat, lengths, unit = split_runs(tokens, starts, frontier)
            if not len(lengths):
                continue
            held.append(_sum_runs([pa.table({"run": _packed(flat, lengths, kind), "n": pa.array(n[unit])})]))
            if sum(t.nbytes for t in held) > _HELD_RUNS:
                held = [_sum_runs(held)]
                if held[0].nbytes > _HELD_RUNS // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from _sum_runs(held).to_batches()

    return segments.mapInArrow(tidy(run), "run binary, n long").groupBy("run").agg(F.sum("n").alias("n"))


def _merge_units(segments: DataFrame, merges: list[tuple[int, int, int]], kind: np.dtype) -> DataFrame:
    left, right, new = zip(*merges)
    links = links_of(merges)

    def run(batches):
        table, sums = MergeTable(left, right, new), _PairSums()
        for batch in _portions(batches, kind, len(merges)):
            tokens, starts, n = _flat(batch, kind)
            if not len(starts):
                continue
            merged, lengths = merge_runs(tokens, starts, table, links)
            yield _unit_rows(merged, lengths, batch.column("n"), kind)
            yield from sums.add(merged, np.cumsum(lengths) - lengths, n)
        yield from sums.rows()

    return segments.mapInArrow(tidy(run), _UNITS)


def _replace_pair(run: list[int], left: int, right: int, new: int) -> list[int]:
    out, i, last = [], 0, len(run) - 1
    while i <= last:
        hit = i < last and run[i] == left and run[i + 1] == right
        out.append(new if hit else run[i])
        i += 2 if hit else 1
    return out


def plan_batch(runs, limit_key, tokens: list[str], ids: dict[str, int], room: int):
    """The merges serial BPE makes next, as far as the counted runs settle them.

    `runs` is a list of (ids, weight); `limit_key` is (-count, left, right) of the frontier's
    end. Extends `tokens`/`ids` in place and returns the merges. Stops after a merge whose text
    is a known token: counts of that token's pairs outside the runs are then unknown.
    """
    counts: dict[tuple[int, int], int] = defaultdict(int)
    holders: dict[tuple[int, int], set[int]] = defaultdict(set)
    bodies = [run for run, _ in runs]
    for at, (run, n) in enumerate(runs):
        for pair in zip(run, run[1:]):
            counts[pair] += n
            holders[pair].add(at)
    queue = [(-n, *pair) for pair, n in counts.items()]
    heapq.heapify(queue)
    merges: list[tuple[int, int, int]] = []
    while queue and room > 0:
        head = heapq.heappop(queue)
        pair = head[1:]
        if counts.get(pair, 0) != -head[0] or head[0] == 0:
            continue
        if head > limit_key:
            break
        text = tokens[pair[0]] + tokens[pair[1]]
        known = ids.get(text)
        new = len(tokens) if known is None else known
        merges.append((*pair, new))
        if known is not None:
            break
        tokens.append(text)
        ids[text] = new
        room -= 1
        changed = set()
        for at in holders.pop(pair):
            old, n = bodies[at], runs[at][1]
            fresh = bodies[at] = _replace_pair(old, *pair, new)
            for p in zip(old, old[1:]):
                counts[p] -= n
                changed.add(p)
            for p in zip(fresh, fresh[1:]):
                counts[p] += n
                holders[p].add(at)
                changed.add(p)
        counts.pop(pair, None)
        changed.discard(pair)
        for p in changed:
            if counts[p] > 0:
                heapq.heappush(queue, (-counts[p], *p))
    return merges


# A character outside the fixed alphabet, which holds all of printable ASCII.
_OTHER = r"[^\x09-\x0d\x20-\x7e]"


def _alphabet(counted: DataFrame) -> list[str]:
    """The fixed alphabet plus any further character of the corpus, by code point."""
    # What is left of a unit without the fixed alphabet is nearly always nothing.
    other = F.regexp_replace("segment", r"[\x09-\x0d\x20-\x7e]+", "")
    chars = F.array_distinct(F.split(other, ""))
    rows = counted.select(F.explode(chars).alias("ch")).distinct().where("ch <> ''").collect()
    return sorted(set(ALPHABET) | {r["ch"] for r in rows})


def _encode_characters(counted: DataFrame, tokens: list[str], kind: np.dtype) -> DataFrame:
    codes = np.array([ord(t) for t in tokens[len(SPECIAL_TOKENS) :]], dtype=np.int64)
    by_byte = (np.searchsorted(codes, np.arange(128)) + len(SPECIAL_TOKENS)).astype(np.int32)

    def run(batches):
        sums = _PairSums()
        for batch in batches:
            texts, n = batch.column("segment").cast(pa.large_string()), batch.column("n")
            ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            sizes = np.diff(ends)
            for first, last in portions(sizes):
                points = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[ends[first] : ends[last]]
                if (points < 128).all():
                    ids, lengths = by_byte.take(points), sizes[first:last]
                else:
                    some = texts.slice(first, last - first).to_pylist()
                    lengths = np.fromiter(map(len, some), dtype=np.int64, count=len(some))
                    points = np.frombuffer("".join(some).encode("utf-32-le"), dtype="<u4")
                    ids = (np.searchsorted(codes, points) + len(SPECIAL_TOKENS)).astype(np.int32)
                counts = n.slice(first, last - first)
                yield _unit_rows(ids, lengths, counts, kind)
                yield from sums.add(ids, np.cumsum(lengths) - lengths, counts.to_numpy())
        yield from sums.rows()

    return counted.mapInArrow(tidy(run), _UNITS)


class _Learner:
    """Merges learned so far, and the bounds that hold for all tables of units."""

    def __init__(self, tokens: list[str], vocab_size: int, run_budget: int, checkpoint_every: int, log):
        self.tokens, self.ids = tokens, {t: i for i, t in enumerate(tokens)}
        self.vocab_size, self.run_budget = vocab_size, run_budget
        self.checkpoint_every, self.log = checkpoint_every, log
        self.kind = _id_kind(max(vocab_size, len(tokens)))
        self.rounds = 0

    def _top(self, rows: DataFrame, k: int) -> list[tuple[int, int, int]]:
        """The `k` first pairs as (-count, left, right)."""
        top = _pair_counts(rows).orderBy(F.desc("n"), "left_id", "right_id").limit(k).collect()
        return [(-p["n"], p["left_id"], p["right_id"]) for p in top]

    def learn(self, current: DataFrame, size: int, held: list[DataFrame], known=None, limit=None) -> list[tuple[int, int, int]]:
        """The merges serial BPE makes next on the units of `current`, which has about `size` tokens.

        Without `limit` all there are; else `current` are the runs of a table of units, `known` its frontier
        (all pairs of the runs) and `limit` the end of it: merges that sort no later are settled. Runs too
        many for the driver, but far fewer than the tokens they come from, are learned from in the same way
        before the larger table is touched again.
        """
        merges: list[tuple[int, int, int]] = []
        fits = max(self.run_budget, size // _WORTH)
        frontier_size = _LARGE_START if limit is None and size > _LARGE_FROM * self.run_budget else 24
        level_rounds = 0
        while len(self.tokens) < self.vocab_size:
            frontier = self._top(current, frontier_size) if known is None else known[:frontier_size]
            whole = len(frontier) < frontier_size
            if limit is not None:
                settled = [p for p in frontier if p <= limit]
                whole |= len(settled) < len(frontier)
                frontier = settled
            known = None
            if not frontier:
                break
            while held:
                held.pop().unpersist()
            while True:
                _, left, right = np.array(frontier, dtype=np.int64).T
                keys = np.sort(pair_keys(left, right))
                runs = _count_runs(_units(current), keys, self.kind).persist()
                total = int(runs.agg(F.sum(F.octet_length("run") / self.kind.itemsize)).first()[0] or 0)
                if total <= fits or len(frontier) == 1:
                    break
                runs.unpersist()
                ratio = min(0.5, max(0.2, (fits / total) ** 0.5))
                frontier, whole = frontier[: max(1, int(len(frontier) * ratio))], False
            # Where the frontier has all pairs up to the limit, no other pair sorts before that.
            end = limit if whole and limit is not None else frontier[-1]
            before = len(self.tokens)
            if len(frontier) == 1:
                # One pair always settles one merge; its runs need not come to the driver.
                n, left, right = frontier[0]
                batch = self._plan([([left, right], -n)], end)
            elif total <= self.run_budget:
                batch = self._plan([(np.frombuffer(r["run"], dtype=self.kind).tolist(), r["n"]) for r in runs.collect()], end)
            else:
                units = runs.select(F.col("run").alias("ids"), "n", F.lit(None).cast("binary").alias("pairs"))
                batch = self.learn(units, total, [], frontier, end)
            runs.unpersist()
            merges += batch
            level_rounds += 1
            if self.log:
                self.log(f"{'round' if limit is None else '  of runs,'} {level_rounds}: frontier {len(frontier)}, run tokens {total}, merges {len(batch)}")
            # Merging flattens the counts, so as many runs soon hold more pairs.
            growth = max(1.25, min(2.5, 0.5 * fits / max(total, 1)))
            frontier_size = min(int(len(frontier) * growth) + 1, 50_000)
            if len(self.tokens) >= self.vocab_size:
                break
            if limit is not None and len(self.tokens) - before < len(batch):
                # The last merge made a known token, whose other pairs are not all in the runs.
                break
            merged = _merge_units(_units(current), batch, self.kind).persist()
            held.append(current)
            if level_rounds % self.checkpoint_every == 0:
                cut = merged.checkpoint()
                held.append(merged)
                merged = cut
            current = merged
        for df in (*held, current):
            df.unpersist()
        if limit is None:
            self.rounds = level_rounds
        return merges

    def _plan(self, runs, end) -> list[tuple[int, int, int]]:
        return plan_batch(runs, end, self.tokens, self.ids, self.vocab_size - len(self.tokens))


def train_bpe(
    segments: DataFrame,
    vocab_size: int = 16_384,
    run_budget: int = 200_000,
    checkpoint_every: int = 8,
    log=None,
) -> Vocabulary:
    """Learn merges from the `segment` column until `vocab_size` tokens exist or no pair is left."""
    spark = segments.sparkSession
    shared_dir(spark)
    counted = segment_counts(segments).where("segment <> ''").persist()
    chars, other = counted.agg(F.sum(F.length("segment")), F.max(F.col("segment").rlike(_OTHER))).first()
    chars = chars or 0
    # The units stay in these partitions for all passes: a share per core, none beyond its bound.
    width = max(spark.sparkContext.defaultParallelism, -(-chars // _PARTITION_CHARS))
    # Those of the counts will do, which saves moving the corpus again, unless they are too few or too many by far.
    will_do = width <= _ENOUGH * counted.rdd.getNumPartitions() <= _MANY * width
    spread = counted if will_do else counted.repartition(width, "segment")
    learner = _Learner(
        list(SPECIAL_TOKENS) + (_alphabet(counted) if other else list(ALPHABET)), vocab_size, run_budget, checkpoint_every, log
    )
    current = _encode_characters(spread, learner.tokens, learner.kind).persist()
    merges = learner.learn(current, chars, [counted])
    return Vocabulary(tuple(learner.tokens), tuple(merges), SPECIAL_TOKENS, learner.rounds)
