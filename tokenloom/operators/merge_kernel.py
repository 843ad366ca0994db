"""Vectorised per-batch helpers of the BPE jobs.

Spark partitions the units (lines) and shuffles what these functions emit; each call sees
one Arrow batch as a flat token array plus unit boundaries and never loops over rows.
"""

from __future__ import annotations

import functools
import heapq
import itertools

import numpy as np
import pyarrow as pa


# Tokens handled in one vector step; the scratch arrays take about forty bytes for each.
PORTION = 1 << 20
# Each merge costs a step of its own: long merge lists take longer portions, up to so many tokens.
PORTION_FOR_MERGE, LARGEST_PORTION = 1 << 8, 1 << 22


def portion_for(n_merges: int) -> int:
    return min(LARGEST_PORTION, max(PORTION, n_merges * PORTION_FOR_MERGE))


def portions(lengths: np.ndarray, limit: int = PORTION):
    """Row ranges whose lengths add up to `limit` at most; a longer row stands alone."""
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield first, last
        first = last


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One sortable integer per (left, right)."""
    return (left.astype(np.int64) << 32) | right.astype(np.int64)


def sum_pairs(tokens: np.ndarray, starts: np.ndarray, weights: np.ndarray):
    """Weighted counts of adjacent pairs within units: (pair keys, sums)."""
    left, right = tokens[:-1].astype(np.int64), tokens[1:].astype(np.int64)
    lengths = np.diff(np.append(starts, len(tokens)))
    width = int(tokens.max()) + 1
    if width * width <= 2 * len(tokens) + _SMALL_TABLE:
        cells = left * width + right
        # One more cell for what is no pair: the places between units.
        cells[starts[1:] - 1] = width * width
        alike = bool((weights == 1).all())
        sums = np.bincount(cells, weights=None if alike else np.repeat(weights, lengths)[:-1], minlength=width * width + 1)
        found = np.flatnonzero(sums[:-1])
        return pair_keys(found // width, found % width), sums[found].astype(np.int64)
    per_place = np.repeat(weights, lengths)[:-1].astype(np.float64)
    per_place[starts[1:] - 1] = 0
    keys = pair_keys(left, right)
    order = np.argsort(keys, kind="stable")
    keys, per_place = keys[order], per_place[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sums = np.add.reduceat(per_place, heads).astype(np.int64)
    return keys[heads][sums > 0], sums[sums > 0]


# Cells of a dense pair table that are cheap to hold in any task.
_SMALL_TABLE = 1 << 22


# The first merges join most tokens, and within few distinct runs: they are applied in batches of their own.
_STAGE_ENDS = (32, 128, 512)


class MergeTable:
    """Merges prepared for lookup: pair -> (rank, new id)."""

    def __init__(self, left, right, new_id):
        self.new_id = np.asarray(new_id, dtype=np.int32)
        self.size = len(self.new_id)
        self.merges = [*zip(left, right, new_id)]
        keys = pair_keys(np.asarray(left, dtype=np.int32), np.asarray(right, dtype=np.int32))
        # A pair listed twice keeps its last rank.
        by_key = np.argsort(keys, kind="stable")
        sorted_keys = keys[by_key]
        last = np.ones(self.size, dtype=bool)
        last[:-1] = sorted_keys[1:] != sorted_keys[:-1]
        self.keys = sorted_keys[last]
        self.ranks = by_key[last].astype(np.int32)
        self.self_pair = np.asarray(left, dtype=np.int32) == np.asarray(right, dtype=np.int32)
        # A merge is fresh when its id is newer than every id before it.
        seen = np.maximum.accumulate(self.new_id) if self.size else self.new_id
        self.fresh = np.ones(self.size, dtype=bool)
        self.fresh[1:] = self.new_id[1:] > seen[:-1]
        parts = np.maximum(np.asarray(left, dtype=np.int32), np.asarray(right, dtype=np.int32))
        self.fresh &= self.new_id > parts
        self.all_fresh = bool(self.fresh.all())
        width = int(max(parts.max(), self.new_id.max())) + 1 if self.size else 0
        self.dense = None
        if 0 < width * width <= _SMALL_TABLE:
            # The last row and column stand for ids no merge mentions.
            self.dense = np.full((width + 1, width + 1), self.size, dtype=np.int32)
            self.dense[self.keys >> 32, self.keys & 0xFFFFFFFF] = self.ranks

    @functools.cached_property
    def stages(self) -> list[tuple[MergeTable, np.ndarray]]:
        """The merges in batches with their links, if each makes a token of its own from earlier ones; else none.

        Then no merge leads back to a lower rank, and one batch after another gives what all give at once.
        """
        if not self.all_fresh or len(self.keys) < self.size:
            return []
        cuts = [0, *(c for c in _STAGE_ENDS if c < self.size), self.size]
        batches = [self.merges[a:b] for a, b in itertools.pairwise(cuts) if a < b]
        return [(MergeTable(*zip(*batch)), links_of(batch)) for batch in batches]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or `size` where the pair is never merged."""
        if not self.size:
            return np.zeros(len(left), dtype=np.int32)
        if self.dense is not None:
            edge = self.dense.shape[0] - 1
            cells = np.minimum(left, edge).astype(np.int64) * (edge + 1) + np.minimum(right, edge)
            return self.dense.ravel().take(cells)
        wanted = pair_keys(left, right)
        slot = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[slot] == wanted, self.ranks[slot], self.size).astype(np.int32)


def replay(tokens: np.ndarray, starts: np.ndarray, table: MergeTable, revisit: bool):
    """Apply the merges lowest rank first, all units side by side.

    `starts` holds the first position of each (non-empty) unit. Returns the merged tokens and
    the new unit lengths. All places of one rank merge in one vector step; the pairs this
    creates queue up under their own rank. `revisit` lets a pair of lower rank fire again,
    which only a merge onto an already known token can bring about: encoding wants that,
    replaying a training batch does not.
    """
    n = len(tokens)
    tok = tokens.astype(np.int32, copy=True)
    if n == 0:
        return tok, np.zeros(len(starts), dtype=np.int64)
    none = table.size
    if not none:
        return tok, np.diff(np.append(starts, n)).astype(np.int64)
    place = np.int32 if n < 1 << 31 else np.int64
    nxt = np.arange(1, n + 1, dtype=place)
    prv = np.arange(-1, n - 1, dtype=place)
    nxt[np.append(starts[1:] - 1, n - 1)] = -1
    prv[starts] = -1
    alive = np.ones(n, dtype=bool)
    rank = np.full(n, none, dtype=np.int32)
    marked = np.zeros(n, dtype=bool)
    inner = np.flatnonzero(nxt >= 0)
    rank[inner] = table.rank_of(tok[inner], tok[inner + 1])

    waiting: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def enqueue(places: np.ndarray, above: int) -> None:
        ranks = rank[places]
        keep = (ranks < none) & (ranks > above)
        places, ranks = places[keep], ranks[keep]
        if not len(places):
            return
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        firsts = ranks[np.concatenate(([0], cuts))].tolist()
        for r, group in zip(firsts, np.split(places, cuts)):
            if r not in waiting:
                waiting[r] = []
                heapq.heappush(queue, r)
            waiting[r].append(group)

    enqueue(inner, -1)
    while queue:
        r = heapq.heappop(queue)
        groups = waiting.pop(r)
        at = groups[0] if len(groups) == 1 else np.concatenate(groups)
        at = at[alive[at] & (rank[at] == r)]
        if not len(at):
            continue
        # A place meets one rank once, unless a merge can lead back to an older token.
        if not table.all_fresh:
            at = np.unique(at)
        elif table.self_pair[r]:
            at = np.sort(at)
        if table.self_pair[r] and len(at) > 1:
            # In a run of equal tokens every second place starts a merge.
            linked = np.zeros(len(at), dtype=bool)
            linked[1:] = nxt[at[:-1]] == at[1:]
            index = np.arange(len(at))
            head = np.maximum.accumulate(np.where(linked, 0, index))
            at = at[(index - head) % 2 == 0]
        if revisit and not table.fresh[r]:
            # The new neighbours may outrank the remaining places: one place per unit, then requeue.
            unit = np.searchsorted(starts, at, side="right")
            first = np.ones(len(at), dtype=bool)
            first[1:] = unit[1:] != unit[:-1]
            later, at = at[~first], at[first]
        else:
            later = at[:0]
        gone = nxt[at]
        after = nxt[gone]
        tok[at] = table.new_id[r]
        nxt[at] = after
        linked_on = after >= 0
        prv[after[linked_on]] = at[linked_on]
        alive[gone] = False
        rank[gone] = none
        before = prv[at]
        marked[at] = True
        before = before[(before >= 0) & ~marked[before]]
        marked[at] = False
        touched = np.concatenate((at, before))
        follow = nxt[touched]
        ends = follow < 0
        ranks = table.rank_of(tok[touched], tok[np.where(ends, 0, follow)])
        rank[touched] = np.where(ends, none, ranks)
        enqueue(touched if not len(later) else np.union1d(touched, later), -1 if revisit else r)
    return tok[alive], np.add.reduceat(alive, starts, dtype=np.int64)


def _runs(tokens: np.ndarray, starts: np.ndarray, frontier: np.ndarray):
    """Which places are in a run, and the runs' first and last places: stretches whose adjacent pairs
    are all in the sorted `frontier` keys."""
    n = len(tokens)
    # A place before and one after all pairs: every run has a beginning and an end.
    link = np.zeros(n + 1, dtype=bool)
    left, right = frontier >> 32, frontier & 0xFFFFFFFF
    width = int(max(tokens.max(), left.max(), right.max())) + 1
    if width * width <= _SMALL_TABLE:
        table = np.zeros(width * width, dtype=bool)
        table[left * width + right] = True
        cells = tokens[:-1].astype(np.int32) * width + tokens[1:]
        link[1:n] = table.take(cells)
    else:
        keys = pair_keys(tokens[:-1], tokens[1:])
        slot = np.minimum(np.searchsorted(frontier, keys), len(frontier) - 1)
        link[1:n] = frontier[slot] == keys
    link[starts[1:]] = False
    turns = np.flatnonzero(link[1:] != link[:-1])
    return link[1:] | link[:-1], turns[::2], turns[1::2]


def split_runs(tokens: np.ndarray, starts: np.ndarray, frontier: np.ndarray):
    """Cut each unit wherever the adjacent pair is outside the sorted `frontier` keys.

    Returns (tokens of all runs of two or more, run lengths, unit index of each run).
    """
    member, heads, tails = _runs(tokens, starts, frontier)
    units = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(tokens))))
    return tokens[member], tails - heads + 1, units[heads]


def links_of(merges) -> np.ndarray:
    """The adjacent pairs, as sorted keys, at which a batch of merges joins what was apart before it."""
    first, last, found = {}, {}, set()
    for left, right, new in merges:
        found.add((last.get(left, left), first.get(right, right)))
        first[new], last[new] = first.get(left, left), last.get(right, right)
    return np.sort(np.array([(a << 32) | b for a, b in found], dtype=np.int64))


def merge_runs(tokens: np.ndarray, starts: np.ndarray, table: MergeTable, links: np.ndarray):
    """`replay` of a training batch without revisits, each distinct run between `links` merged once.

    A batch makes every token in one way, so it joins nothing across any other pair.
    """
    member, heads, tails = _runs(tokens, starts, links)
    out = tokens.astype(np.int32)
    if len(heads):
        ends = np.concatenate(([0], np.cumsum(tails - heads + 1))).astype(np.int32)
        data = [None, pa.py_buffer(ends * 4), pa.py_buffer(out[member])]
        runs = pa.Array.from_buffers(pa.binary(), len(heads), data).dictionary_encode()
        _, ends, data = runs.dictionary.buffers()
        ends = np.frombuffer(ends, dtype=np.int32)[: len(runs.dictionary) + 1] // 4
        merged, lengths = replay(np.frombuffer(data, dtype=np.int32)[: ends[-1]], ends[:-1].astype(np.int64), table, revisit=False)
        # A merged run takes the first places of the old one; the places left over go.
        padded = np.full(ends[-1], -1, dtype=np.int32)
        padded[np.arange(len(merged)) + np.repeat(ends[:-1] - (np.cumsum(lengths) - lengths), lengths)] = merged
        shortened = pa.ListArray.from_arrays(pa.array(ends), pa.array(padded))
        out[member] = shortened.take(runs.indices).flatten().to_numpy()
    kept = out >= 0
    return out[kept], np.add.reduceat(kept, starts, dtype=np.int64)


def merge_all(tokens: np.ndarray, starts: np.ndarray, table: MergeTable):
    """`replay` with revisits, as encoding wants it, by runs where the merges allow."""
    if not table.stages or not len(tokens):
        return replay(tokens, starts, table, revisit=True)
    for batch, links in table.stages:
        tokens, lengths = merge_runs(tokens, starts, batch, links)
        starts = np.cumsum(lengths) - lengths
    return tokens, lengths
