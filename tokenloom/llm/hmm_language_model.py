"""LM scoring with a hidden Markov model over words.

Tokens are the words of a text (A-Z lowered) and one end token. Counts cover all training documents.
The most frequent words (at least 1/8192 of all tokens, so 8,192 at most) are emitted one by one; the
other words belong to classes by their last bytes, and inside a class a word has the probability
(count + 1) / (sum of the class's counts + its words + 1). So the model that travels is bounded
whatever the vocabulary, and every word, seen or not, has a probability.

Baum-Welch: each partition runs forward-backward over its documents and emits expected counts, Spark
sums them, the driver normalises the (states x symbols) table. Scoring runs the scaled forward
recursion over whole documents. Counts of words that are too rare to travel (below 1/2^20 of all
tokens) meet their documents in a join.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tokenloom.llm.common import batch_of, kind_of, slices, words_of
from tokenloom.session import ship_package, stage_table

#: Shares of all tokens from which a word has its own symbol, or a place in the broadcast table.
TOP_SHARE = 1 << 13
HEAD_SHARE = 1 << 20
CLASSES = 256
SUFFIX_BYTES = 3
FLUSH_WORDS = 300_000
GROUP_TOKENS = 1 << 18
#: Longer documents are several training sequences; they are scored whole.
TRAIN_TOKENS = 1 << 16
END = b""


def word_hash(word: bytes) -> int:
    """64 bits, signed as Spark has it."""
    value = xxhash.xxh3_64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


def word_class(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word[-SUFFIX_BYTES:], 1) % CLASSES


def count_words(docs: DataFrame) -> DataFrame:
    """(h, class, n) of every distinct token of `docs`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}

        def flush():
            words = list(seen)
            columns = {"h": list(map(word_hash, words)), "class": list(map(word_class, words)), "n": list(seen.values())}
            seen.clear()
            return batch_of(columns, h=pa.int64(), n=pa.int64(), **{"class": pa.int32()})

        for batch in batches:
            for part in slices(batch):
                words, places, _ = words_of(part["text"])
                for word, n in zip(words, np.bincount(places, minlength=len(words)).tolist(), strict=True):
                    seen[word] = seen.get(word, 0) + n
                seen[END] = seen.get(END, 0) + part.num_rows
                if len(seen) > FLUSH_WORDS:
                    yield flush()
        yield flush()

    parts = docs.select("text").mapInArrow(count, "h long, class int, n long")
    return parts.groupBy("h", "class").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """What travels of the counts: hashes (sorted) and counts of the head, symbols of the top."""

    hashes: np.ndarray
    counts: np.ndarray
    #: Symbol of a head word, -1 if it is only a member of its class.
    symbols: np.ndarray
    #: log10 of (sum of counts + words + 1) per class, without the top words.
    class_log: np.ndarray
    n_symbols: int
    symbol_share: np.ndarray
    total: int
    distinct: int


def read_lexicon(counts: DataFrame) -> Lexicon:
    """The bounded part of a staged count table: at most 2^20 words."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least, top = total // HEAD_SHARE + 1, total // TOP_SHARE + 1
    head = counts.where(F.col("n") >= least).orderBy("h").select("h", "n", "class").toArrow()
    hashes, ns, classes = (head[c].to_numpy() for c in ("h", "n", "class"))
    own = ns >= top
    symbols = np.full(len(ns), -1)
    symbols[own] = CLASSES + np.arange(own.sum())
    sums = np.zeros((CLASSES, 2))
    for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect():
        sums[r["class"]] = r["n"], r["k"]
    np.subtract.at(sums[:, 0], classes[own], ns[own])
    np.subtract.at(sums[:, 1], classes[own], 1)
    share = np.concatenate([sums[:, 0] + 1, ns[own]]).astype(float)
    return Lexicon(
        hashes, ns, symbols, np.log10(sums.sum(1) + 1), CLASSES + int(own.sum()), share / share.sum(), total, distinct
    )


class Symbols:
    """Slots of the words seen, and per slot: symbol, log10(count + 1), hash, rareness, inner log.

    The inner log is log10 of a word's probability within its class, as far as the head tells.
    """

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.reset()

    def reset(self):
        self.slots: dict[bytes, int] = {}
        self.columns = (np.zeros(0, np.uint16), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0))

    def add(self, words: list[bytes]) -> None:
        """`words` are distinct."""
        lex = self.lexicon
        new = [w for w in words if w not in self.slots]
        if not new:
            return
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in new], np.uint64).view(np.int64)
        at = np.searchsorted(lex.hashes, h)
        found = at < len(lex.hashes)
        found[found] = lex.hashes[at[found]] == h[found]
        log_count = np.zeros(len(new))
        log_count[found] = np.log10(lex.counts[at[found]] + 1)
        symbol = np.full(len(new), -1)
        symbol[found] = lex.symbols[at[found]]
        member = np.flatnonzero(symbol < 0)
        symbol[member] = [word_class(new[i]) for i in member.tolist()]
        inner = np.zeros(len(new))
        inner[member] = log_count[member] - lex.class_log[symbol[member]]
        self.slots.update(zip(new, range(len(self.slots), len(self.slots) + len(new)), strict=True))
        more = (symbol.astype(np.uint16), log_count, h, ~found, inner)
        self.columns = tuple(np.concatenate(c) for c in zip(self.columns, more, strict=True))


def encode_symbols(docs: DataFrame, lexicon: Lexicon, training: Column) -> DataFrame:
    """One staged row per document row: row, doc_id, training, symbols (uint16 bytes), n_tokens,
    n_head (tokens in the broadcast table), log_counts and inner (sums over those), rare (h, n)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Symbols(shared.value)
        for whole in batches:
            for batch in slices(whole):
                if len(table.slots) > FLUSH_WORDS:
                    table.reset()
                words, places, bounds = words_of(batch["text"])
                words.append(END)
                table.add(words)
                slots = np.fromiter(map(table.slots.__getitem__, words), np.int32, len(words))
                # The end token closes each document.
                flat = slots[np.insert(places, bounds[1:], len(words) - 1)]
                closed = bounds + np.arange(len(bounds))
                found = [flat[a:b] for a, b in itertools.pairwise(closed.tolist())]
                symbol, log_count, h, rare, inner = table.columns
                rows = {k: [] for k in ("symbols", "n_tokens", "n_head", "log_counts", "inner")}
                rare_words = []
                for s in found:
                    out = rare[s]
                    rare_words.append(np.unique(h[s[out]], return_counts=True))
                    rows["symbols"].append(symbol[s].tobytes())
                    rows["n_tokens"].append(len(s))
                    rows["n_head"].append(len(s) - int(out.sum()))
                    rows["log_counts"].append(float(log_count[s].sum()))
                    rows["inner"].append(float(inner[s].sum()))
                hashes, times = (np.concatenate(c) for c in zip(*rare_words, strict=True))
                ends = np.cumsum([0, *(len(x) for x, _ in rare_words)]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(hashes, pa.int64()), pa.array(times, pa.int64())], ["h", "n"])
                yield batch_of(
                    {"doc_id": batch["doc_id"], "training": batch["training"]}
                    | rows
                    | {"rare": pa.ListArray.from_arrays(pa.array(ends), pairs)},
                    symbols=pa.binary(), n_tokens=pa.int64(), n_head=pa.int64(), log_counts=pa.float64(), inner=pa.float64(),
                )

    schema = (
        f"doc_id {kind_of(docs, 'doc_id')}, training boolean, symbols binary, n_tokens long, n_head long, "
        "log_counts double, inner double, rare array<struct<h:bigint,n:bigint>>"
    )
    coded = docs.select("doc_id", "text", training.alias("training")).mapInArrow(encode, schema)
    return stage_table(coded.withColumn("row", F.monotonically_increasing_id()), "symbols")


@dataclass
class HiddenMarkov:
    start: np.ndarray
    move: np.ndarray
    #: (symbol, state)
    emit: np.ndarray


def time_major(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences, longest first, laid out step by step: (symbols, offsets of steps, order, document)."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    ranked = lengths[order]
    steps = int(ranked[0])
    active = np.searchsorted(-ranked, -np.arange(1, steps + 1), "right")
    offsets = np.concatenate([[0], np.cumsum(active)])
    flat = np.concatenate([sequences[i] for i in order]).astype(np.int64)
    doc = np.repeat(np.arange(len(ranked)), ranked)
    step = np.arange(len(flat)) - np.repeat(np.cumsum(ranked) - ranked, ranked)
    place = offsets[step] + doc
    symbols, owner = np.empty_like(flat), np.empty_like(doc)
    symbols[place], owner[place] = flat, doc
    return symbols, offsets, order, owner


def forward(model: HiddenMarkov, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward probabilities and the scale of every token (their logs sum to the likelihood)."""
    alpha = model.emit[symbols]
    scale = np.empty(len(symbols), alpha.dtype)
    alpha[: offsets[1]] *= model.start
    for t in range(len(offsets) - 1):
        low, high = offsets[t], offsets[t + 1]
        here = alpha[low:high]
        if t:
            before = offsets[t - 1]
            here *= alpha[before : before + high - low] @ model.move
        total = here.sum(1)
        here /= total[:, None]
        scale[low:high] = total
    return alpha, scale


def expected_counts(model: HiddenMarkov, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of start, move and emit, and the log10 likelihood."""
    symbols, offsets, _, _ = time_major(sequences)
    alpha, scale = forward(model, symbols, offsets)
    weighted = model.emit[symbols] / scale[:, None]
    beta = np.ones_like(alpha)
    steps = len(offsets) - 1
    for t in range(steps - 2, -1, -1):
        low, n = offsets[t], offsets[t + 2] - offsets[t + 1]
        after = slice(offsets[t + 1], offsets[t + 2])
        weighted[after] *= beta[after]
        beta[low : low + n] = weighted[after] @ model.move.T
    widths = np.diff(offsets)
    later = np.arange(offsets[1], len(symbols))
    earlier = later - np.repeat(widths[:-1], widths[1:])
    move = model.move * (alpha[earlier].T @ weighted[later])
    gamma = alpha * beta
    states = gamma.shape[1]
    emit = np.stack([np.bincount(symbols, gamma[:, k], len(model.emit)) for k in range(states)], 1)
    return gamma[: offsets[1]].sum(0), move, emit, float(np.log10(scale).sum(dtype=float))


def grouped(rows: Iterator[tuple[object, np.ndarray]]) -> Iterator[list[tuple[object, np.ndarray]]]:
    """Documents in groups of bounded size and of similar lengths, so that few steps run half empty."""
    pending, held = [], 0
    for key, s in rows:
        pending.append((key, s))
        held += len(s)
        if held >= 4 * GROUP_TOKENS:
            yield from _by_length(pending)
            pending, held = [], 0
    yield from _by_length(pending)


def _by_length(pending):
    group, size = [], 0
    for item in sorted(pending, key=lambda x: len(x[1])):
        if group and size + len(item[1]) > GROUP_TOKENS:
            yield group
            group, size = [], 0
        group.append(item)
        size += len(item[1])
    if group:
        yield group


def _sequences(batches: Iterator[pa.RecordBatch], key: str | None, piece: int | None):
    for batch in batches:
        keys = batch[key].to_pylist() if key else [None] * batch.num_rows
        for k, raw in zip(keys, batch["symbols"].to_pylist(), strict=True):
            s = np.frombuffer(raw, np.uint16)
            for at in range(0, len(s), piece or len(s)):
                yield k, s[at : at + (piece or len(s))]


def first_model(lexicon: Lexicon, states: int, seed: int) -> HiddenMarkov:
    """Sticky states whose emissions are the symbol shares under seeded noise."""
    noise = np.random.default_rng(seed).normal(0, 0.6, (lexicon.n_symbols, states))
    emit = lexicon.symbol_share[:, None] * np.exp(noise)
    move = np.full((states, states), 0.1 / states) + np.eye(states) * 0.9
    return HiddenMarkov(np.full(states, 1 / states), move, emit / emit.sum(0))


def baum_welch(coded: DataFrame, lexicon: Lexicon, states: int, steps: int, seed: int) -> tuple[HiddenMarkov, list[float]]:
    """The trained model and the training log10 likelihood before each step.

    Expected counts are computed in single precision, their sums and the model in double.
    """
    model, history = first_model(lexicon, states, seed), []
    cells = states * (lexicon.n_symbols + states + 1) + 1
    for _ in range(steps):
        single = HiddenMarkov(*(x.astype(np.float32) for x in (model.start, model.move, model.emit)))
        shared = coded.sparkSession.sparkContext.broadcast(single)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(cells)
            for group in grouped(_sequences(batches, None, TRAIN_TOKENS)):
                start, move, emit, fit = expected_counts(shared.value, [s for _, s in group])
                total += np.concatenate([start, move.ravel(), emit.ravel(), [fit]])
            some = np.flatnonzero(total)
            yield batch_of({"cell": some, "value": total[some]})

        parts = coded.where("training").select("symbols").mapInArrow(expect, "cell long, value double")
        # One row per cell of the model reaches the driver.
        sums = parts.groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
        total = np.zeros(cells)
        total[sums["cell"].to_numpy()] = sums["value"].to_numpy()
        shared.unpersist()
        history.append(float(total[-1]))
        start = total[:states] + 1
        move = total[states : states + states**2].reshape(states, states) + 1
        emit = total[states + states**2 : -1].reshape(-1, states) + lexicon.symbol_share[:, None]
        model = HiddenMarkov(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    return model, history


def forward_scores(coded: DataFrame, model: HiddenMarkov) -> DataFrame:
    """(row, symbols_log): exact log10 likelihood of every document's symbols."""
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(_sequences(batches, "row", None)):
            symbols, offsets, order, owner = time_major([s for _, s in group])
            _, scale = forward(shared.value, symbols, offsets)
            sums = np.bincount(owner, np.log10(scale), len(group))
            yield batch_of({"row": [group[i][0] for i in order], "symbols_log": sums}, row=pa.int64())

    return coded.select("row", "symbols").mapInArrow(score, "row long, symbols_log double")


def lm_scores(docs: DataFrame, training: Column, states: int = 8, steps: int = 5, seed: int = 7) -> DataFrame:
    """One row per document row: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    `training` tells which documents are learned from. A null or empty text is the end token alone.
    With nothing to learn from, every token has the probability of an unknown one.
    """
    ship_package(docs.sparkSession)
    counts = stage_table(count_words(docs.where(training)), "word-counts")
    lexicon = read_lexicon(counts)
    coded = encode_symbols(docs, lexicon, training)
    model, _ = baum_welch(coded, lexicon, states, steps, seed)
    scored = stage_table(forward_scores(coded, model), "symbol-scores")
    rare = coded.select("row", F.explode("rare").alias("r")).select("row", "r.h", "r.n")
    known = counts.select("h", F.log10(F.col("n") + 1).alias("log_count"))
    met = rare.join(known, "h").groupBy("row").agg(
        F.sum("n").alias("n_rare"), F.sum(F.col("n") * F.col("log_count")).alias("rare_log")
    )
    whole = coded.drop("symbols", "rare", "training").join(scored, "row").join(met, "row", "left")
    n_rare, rare_log = F.coalesce("n_rare", F.lit(0)), F.coalesce("rare_log", F.lit(0.0))
    space = float(np.log10(lexicon.total + lexicon.distinct + 1))
    return whole.select(
        "doc_id",
        "n_tokens",
        (F.col("n_head") + n_rare).alias("n_known"),
        F.lit(lexicon.total).cast("long").alias("train_tokens"),
        (F.col("log_counts") + rare_log - F.col("n_tokens") * F.lit(space)).alias("base_score"),
        (F.col("symbols_log") + F.col("inner") + rare_log).alias("score"),
    )
