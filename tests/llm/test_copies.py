"""Suffix dedup, the shingle join, and components against brute force."""

import collections
import random

import numpy as np
import pytest

from tests.llm import helpers
from tokenloom.llm import batches, graph, shingle_join, suffix_dedup


def test_suffix_arrays():
    rng = random.Random(4)
    for n in (*range(12), 30, 31, 32, 400):
        for k in (1, 2, 3, 250):
            s = np.array([rng.randint(1, k) for _ in range(n)], np.int64)
            if n <= 32 or k > 1:
                assert suffix_dedup.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_fragments_cover_every_start():
    rng = np.random.default_rng(1)
    raw, lengths = rng.integers(97, 99, 700).astype(np.uint8), np.array([60, 49, 0, 50, 541])
    doc, start, covered, key = suffix_dedup.fragments(raw, lengths, 50)
    starts = np.concatenate([np.arange(s, s + c) for s, c in zip(start, covered, strict=True)])
    assert starts.tolist() == [*range(11), 109, *range(159, 651)]
    by_text = collections.defaultdict(set)
    for s, c, k in zip(start, covered, key, strict=True):
        for i in range(s, s + c):
            by_text[raw[i : i + 50].tobytes()].add(int(k))
    assert all(len(keys) == 1 for keys in by_text.values())


def plain_removal(data, span):
    """By id, null first; rows with one id are not earlier than each other."""
    first, out = {}, []
    order = [(-1 if r[0] is None else r[0], (r[1] or "").encode()) for r in data]
    for doc, raw in order:
        for i in range(len(raw) - span + 1):
            w = raw[i : i + span]
            first[w] = min(first.get(w, doc), doc)
    for doc, raw in order:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - span + 1):
            if first[raw[i : i + span]] < doc:
                gone[i : i + span] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((None if doc < 0 else doc, len(raw), int(gone.sum()), spans, kept))
    return out


@pytest.mark.parametrize(("span", "batch"), [(50, 2 << 20), (50, 3000), (12, 2000), (7, 5000)])
def test_repeats_go(monkeypatch, spark, span, batch):
    monkeypatch.setattr(batches, "BATCH_BYTES", batch)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 4000)
    data = helpers.rows()
    got = suffix_dedup.drop_repeats(helpers.frame(spark, data), span).collect()
    found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got]
    assert sorted(found, key=str) == sorted(plain_removal(data, span), key=str)
    assert sum(f[2] for f in found) > 1000


def phrases(n):
    """A phrase and rulers between texts of their own; some of it repeated in one document."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij ", k=rng.randint(20, 60)))
    texts = [f"{word()} all rights reserved worldwide {word()}\n{'-' * rng.randint(30, 90)}{word()}" for _ in range(n)]
    texts += [texts[3] * 3, "-" * 4000, texts[5] + texts[3], texts[5]]
    return [(None if i == 40 else i // 2 if i % 50 == 1 else i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("hot_bytes", [0, 3000])
def test_hot_minimisers_lose_no_repeat(monkeypatch, spark, hot_bytes):
    monkeypatch.setattr(batches, "BATCH_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 4000)
    data = phrases(150)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = suffix_dedup.drop_repeats(docs, 50, hot_bytes).collect()
    found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got]
    assert collections.Counter(found) == collections.Counter(plain_removal(data, 50))


def test_no_bucket_holds_all_uses_of_a_phrase(monkeypatch, spark):
    monkeypatch.setattr(batches, "BATCH_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 4000)
    ask, largest = suffix_dedup.ask, []

    def measured(asked, send, answer, *more):
        sent = asked.mapInArrow(send, "batch long, bucket long, message binary").where("bucket >= 0").collect()
        sizes = collections.Counter()
        for row in sent:
            # Key messages are not packed; fragments and digests are.
            sizes[row.bucket] += len(batches.unpacked(row.message)) if largest else 0
        largest.append(max(sizes.values()))
        return ask(asked, send, answer, *more)

    monkeypatch.setattr(suffix_dedup, "ask", measured)
    docs = spark.createDataFrame(phrases(1500), "doc_id long, text string").repartition(3)
    suffix_dedup.drop_repeats(docs, 50, **({"hot_bytes": 3000} if hasattr(suffix_dedup, "HOT_BYTES") else {})).count()
    # A bucket of every use holds 1,500 fragments with 34 to 80 bytes of text each.
    assert largest[1] < 30_000, largest


def test_nothing_to_remove(empty, spark):
    assert suffix_dedup.drop_repeats(empty).count() == 0
    alone = suffix_dedup.drop_repeats(helpers.frame(spark, helpers.rows()[:1])).first()
    assert alone.n_removed == 0 and alone.kept == helpers.rows()[0][1].encode()


def family(seed, n, edits, words=80):
    """A document and `n` copies with a few changed words."""
    rng = random.Random(seed)
    base = [f"w{seed}_{rng.randint(0, 10**6)}" for _ in range(words)]
    out = [base]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 10**6)}"
        out.append(copy)
    return [" ".join(w) for w in out]


def copies():
    passage = " ".join(f"common{i}" for i in range(12))
    data = helpers.rows()
    texts = [t for k in range(4) for t in family(k, 25, 3)] + family(9, 6, 4, 300) + family(10, 10, 1, 9)
    data += [(1000 + i, f"{t} {passage}" if i % 3 else t, *[None] * 7) for i, t in enumerate(texts)]
    return data


def plain_components(data, percent):
    sets = []
    for r in data:
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(data)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(root(i)) if sets[i] else r[0]) for i, r in enumerate(data)]


@pytest.mark.parametrize(("percent", "block"), [(75, 1 << 20), (75, 800), (90, 300)])
def test_components(monkeypatch, spark, percent, block):
    monkeypatch.setattr(batches, "BATCH_BYTES", 20_000)
    monkeypatch.setattr(shingle_join, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(shingle_join, "BLOCK_TOKENS", block)
    data = copies()
    got = shingle_join.shingle_components(helpers.frame(spark, data), 5, percent).collect()
    want = plain_components(data, percent)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == sorted(want, key=str)
    assert len({w[2] for w in want}) < len({w[0] for w in want}) - 30


def test_one_of_each_group_stays(spark, docs, empty):
    kept = shingle_join.first_of_components(docs)
    want = [r for r, (i, _, c) in zip(helpers.rows(), plain_components(helpers.rows(), 75), strict=True) if i == c]
    # The table holds one row twice; a repeated text stays once.
    assert len(set(want)) < len(want)
    want = [*{r for r in want if r[1] and r[1].split()}, *(r for r in want if not (r[1] and r[1].split()))]
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
    assert shingle_join.first_of_components(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_trees_lose_no_link(seed):
    rng = np.random.default_rng(seed)
    centres = [rng.choice(5000, 60, replace=False) for _ in range(4)]
    tokens = []
    for k in range(150):
        own = centres[k % 4].copy()
        change = rng.integers(0, 16)
        own[:change] = rng.integers(5000, 9000, change)
        tokens.append(np.unique(own[: rng.integers(35, 61)]))
    everyone = np.arange(150)

    def components(pairs):
        parent = list(range(150))
        for i, j in pairs:
            a, b = i, j
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
        out = []
        for i in range(150):
            while parent[i] != i:
                i = parent[i]
            out.append(i)
        return out

    def links(left, right):
        sets = [set(t.tolist()) for t in tokens]
        return [(i, j) for i in left for j in right if i != j and shingle_join.linked(len(sets[i] & sets[j]), len(sets[i]), len(sets[j]), 75)]

    found = shingle_join.tree_links(everyone, None, tokens, 9000, 75).found
    assert components(found) == components(links(everyone, everyone))
    left, right = everyone[:70], everyone[70:]
    across = shingle_join.tree_links(left, right, tokens, 9000, 75).found
    within = links(left, left) + links(right, right)
    assert components(across + within) == components(links(left, right) + within)


def test_graph(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(500, 540)]
    got = {r.node: r.label for r in graph.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {i: root(i) for i in list(parent)}
    assert graph.connected(spark.createDataFrame([], "a long, b long")).count() == 0
