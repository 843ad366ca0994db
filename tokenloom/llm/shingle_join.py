"""N-gram Jaccard join: documents whose shingle sets overlap enough, by signature trees.

1. Equal sets are one set from here on.
2. How many documents have a shingle is counted bucket by bucket. In the order of (count, hash) a
   linked pair must share one of each set's first n - ceil(t n) + 1 shingles. Shingles of one
   document are no candidates, common passages come last: what is left ties near copies together.
3. Documents that share such a shingle form candidate clusters (connected components). A cluster is
   cut into blocks of bounded size; blocks of one cluster meet in pairs.
4. A pair of blocks is joined by signature trees: documents by size are leaves, inner nodes hold the
   OR of their token bitmaps and their range of sizes. Both trees are walked together, and a pair of
   nodes is left out if its largest possible overlap is too small, or if all its documents are
   linked already. Documents are compared exactly.
5. Links become components.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tokenloom.llm.batches import (
    ask,
    batch_texts,
    bucket_slices,
    from_low_bytes,
    low_bytes,
    mixed,
    packed,
    unpacked,
    with_answers,
)
from tokenloom.llm.common import WordHashes, batch_of, text_hash, tidy
from tokenloom.llm.graph import connected
from tokenloom.session import ship_package, stage_table

#: Bytes of a shingle on the way to its bucket; a false match adds a candidate, nothing else.
KEY_BYTES = 4
BUCKET_BYTES = 2 << 20
#: Shingles in a block of a cluster.
BLOCK_TOKENS = 1 << 20
LEAF_DOCS = 16
FANOUT = 4
#: Fixed value: the seed of Spark's xxhash64.
SPARK_SEED = 42
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: list[bytes], hashed: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct hashes of `size` consecutive words; of all words if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    h = hashed.of(words)
    width = min(size, len(h))
    gram = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        gram = gram * MULTIPLIER + h[i : i + len(gram)]
    return np.unique(mixed(gram))


def signed(value: int) -> int:
    """The same 64 bits as a signed number."""
    return value - (1 << 64) if value >> 63 else value


def _sets(row: dict, hashed: WordHashes, size: int) -> list[np.ndarray]:
    raw, at, out = unpacked(row["texts"]), 0, []
    for n in row["lengths"]:
        out.append(shingles(raw[at : at + n].lower().split(), hashed, size))
        at += n
    return out


def set_keys(batches: DataFrame, size: int) -> DataFrame:
    """(row, batch, doc_id, text_hash, n, s1, s2): the size of each document's set and 128 bits of its hash.

    `text_hash` is Spark's xxhash64 of the text (of '' for null).
    """

    def measure(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHashes()
        for batch in rows:
            own = batch.schema.field("doc_ids").type.value_type
            for row in batch.to_pylist():
                sets, raw = _sets(row, hashed, size), unpacked(row["texts"])
                edges = [0, *itertools.accumulate(row["lengths"])]
                own_hash = [signed(xxhash.xxh64_intdigest(raw[a:b], SPARK_SEED)) for a, b in itertools.pairwise(edges)]
                sums = [
                    (int(s.sum(dtype=np.uint64).view(np.int64)), int(mixed(s ^ MULTIPLIER).sum(dtype=np.uint64).view(np.int64)))
                    for s in sets
                ]
                yield batch_of(
                    {
                        "row": np.arange(len(sets)) + row["batch"],
                        "batch": np.full(len(sets), row["batch"]),
                        "doc_id": row["doc_ids"],
                        "text_hash": own_hash,
                        "n": [len(s) for s in sets],
                        "s1": [a for a, _ in sums],
                        "s2": [b for _, b in sums],
                    },
                    doc_id=own, text_hash=pa.int64(), n=pa.int64(), s1=pa.int64(), s2=pa.int64(),
                )

    kind = batches.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"row long, batch long, doc_id {kind}, text_hash long, n long, s1 long, s2 long"
    return stage_table(batches.select("batch", "doc_ids", "lengths", "texts").mapInArrow(tidy(measure), schema), "set-keys")


def _distinct(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of a batch and how many of its different sets have them."""
    different = list({s.tobytes(): s for s in sets}.values())
    return np.unique(np.concatenate([*different, np.zeros(0, np.uint64)]), return_counts=True)


def _send_shingles(size: int, n_buckets: int):
    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHashes()
        for batch in rows:
            for row in batch.to_pylist():
                keys, counts = _distinct(_sets(row, hashed, size))
                order, rest, slices = bucket_slices(keys, n_buckets)
                counts = counts[order].astype("<u4")
                messages = [
                    np.int64(b - a).tobytes() + low_bytes(rest[a:b], KEY_BYTES) + packed(counts[a:b].tobytes())
                    for _, a, b in slices
                ]
                yield batch_of(
                    {"batch": [row["batch"]] * len(slices), "bucket": [s[0] for s in slices], "message": messages},
                    batch=pa.int64(), bucket=pa.int64(), message=pa.binary(),
                )

    return send


def _answer_shingles(table: pa.Table) -> pa.Table:
    """For each shingle the number of bits of its count: 1 if one set has it, more if several."""
    values, counts, sizes = [], [], []
    for message in table["message"].to_pylist():
        n = int(np.frombuffer(message[:8], np.int64)[0])
        values.append(from_low_bytes(message[8 : 8 + KEY_BYTES * n], KEY_BYTES))
        counts.append(np.frombuffer(unpacked(message[8 + KEY_BYTES * n :]), "<u4"))
        sizes.append(n)
    _, place = np.unique(np.concatenate(values), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts).astype(float))
    bits = (np.floor(np.log2(total)) + 1).astype(np.uint8)
    answers = [packed(x.tobytes()) for x in np.split(bits[place], np.cumsum(sizes)[:-1])]
    return pa.table({"batch": table["batch"], "bucket": table["bucket"], "answer": pa.array(answers, pa.binary())})


def candidates(batches: DataFrame, keys: DataFrame, n_buckets: int, size: int, percent: int) -> DataFrame:
    """Staged (row, n, probes, tokens) of the first document of each set that has a shared probe.

    probes: the shingles of the prefix that several sets have; tokens: the whole set.
    """
    first = keys.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "row", "batch")).alias("first"))
    chosen = first.groupBy(F.col("first.batch").alias("batch")).agg(F.collect_list("first.row").alias("chosen"))
    counts = ask(batches, _send_shingles(size, n_buckets), _answer_shingles)
    met = with_answers(batches, counts).join(chosen, "batch")

    def probe(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHashes()
        for batch in rows:
            for row in batch.to_pylist():
                sets = _sets(row, hashed, size)
                distinct, _ = _distinct(sets)
                order, _, slices = bucket_slices(distinct, n_buckets)
                by_bucket = {a["bucket"]: a["answer"] for a in row["answers"]}
                bits = np.empty(len(distinct), np.uint8)
                for bucket, a, b in slices:
                    bits[order[a:b]] = np.frombuffer(unpacked(by_bucket[bucket]), np.uint8)
                out = {"row": [], "n": [], "probes": [], "tokens": []}
                for number in sorted(row["chosen"]):
                    tokens = sets[number - row["batch"]]
                    own = bits[np.searchsorted(distinct, tokens)]
                    length = len(tokens) - -(-percent * len(tokens) // 100) + 1
                    prefix = np.lexsort((tokens, own))[:length]
                    probes = tokens[prefix[own[prefix] > 1]]
                    if len(probes):
                        out["row"].append(number)
                        out["n"].append(len(tokens))
                        out["probes"].append(probes.view(np.int64))
                        out["tokens"].append(tokens.view(np.int64))
                long = pa.list_(pa.int64())
                yield batch_of(out, row=pa.int64(), n=pa.int64(), probes=long, tokens=long)

    return stage_table(
        met.mapInArrow(tidy(probe), "row long, n long, probes array<long>, tokens array<long>"), "candidates"
    )


# --- signature trees ---------------------------------------------------------------------


class Links:
    """Which documents of a task are linked already."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.found: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.found.append((i, j))


class SignatureTree:
    """Documents by size under nodes with OR-combined token bitmaps and size ranges."""

    def __init__(self, docs: np.ndarray, tokens: list[np.ndarray], n_tokens: int):
        sizes = np.array([len(tokens[i]) for i in docs])
        least = np.array([tokens[i][0] for i in docs])
        self.docs = docs[np.lexsort((least, sizes))]
        ranges = [(k, min(k + LEAF_DOCS, len(docs))) for k in range(0, len(docs), LEAF_DOCS)]
        bits = []
        for a, b in ranges:
            flags = np.zeros(n_tokens, bool)
            for i in self.docs[a:b]:
                flags[tokens[i]] = True
            bits.append(np.packbits(flags))
        #: Levels from the leaves up: (first and last place, bitmap) of each node.
        self.levels = [(ranges, np.stack(bits))]
        while len(self.levels[-1][0]) > 1:
            below, words = self.levels[-1]
            parts = range(0, len(below), FANOUT)
            self.levels.append(
                (
                    [(below[k][0], below[min(k + FANOUT, len(below)) - 1][1]) for k in parts],
                    np.stack([np.bitwise_or.reduce(words[k : k + FANOUT]) for k in parts]),
                )
            )
        self.sizes = np.array([len(tokens[i]) for i in self.docs])

    def children(self, level: int, node: int) -> list[int]:
        return list(range(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][0]))))


def linked(overlap, one, other, percent: int):
    """100 * overlap >= percent * union."""
    return 100 * overlap >= percent * (one + other - overlap)


def _possible(left: SignatureTree, right: SignatureTree, at: tuple[int, int], node: tuple[int, int], percent: int) -> bool:
    """Whether some pair under the two nodes can be linked: by sizes, then by common tokens."""
    (a, b), (c, d) = left.levels[at[0]][0][node[0]], right.levels[at[1]][0][node[1]]
    low, high, other_low, other_high = left.sizes[a], left.sizes[b - 1], right.sizes[c], right.sizes[d - 1]
    if 100 * high < percent * other_low or 100 * other_high < percent * low:
        return False
    common = int(np.bitwise_count(left.levels[at[0]][1][node[0]] & right.levels[at[1]][1][node[1]]).sum())
    return (100 + percent) * min(common, high, other_high) >= percent * (low + other_low)


def _compare(left: np.ndarray, right: np.ndarray, tokens: list[np.ndarray], flags: np.ndarray, links: Links, percent: int) -> None:
    """Exact comparison of each left document with all right ones."""
    flat = np.concatenate([tokens[j] for j in right])
    sizes = np.array([len(tokens[j]) for j in right])
    first = np.cumsum(sizes) - sizes
    roots = {links.root(int(j)) for j in right}
    for i in left.tolist():
        if roots == {links.root(i)}:
            continue
        flags[tokens[i]] = True
        overlap = np.add.reduceat(flags[flat], first, dtype=np.int64)
        flags[tokens[i]] = False
        for j in right[linked(overlap, len(tokens[i]), sizes, percent)].tolist():
            if i != j:
                links.join(i, j)
        roots = {links.root(int(j)) for j in right}


def tree_links(left: np.ndarray, right: np.ndarray | None, tokens: list[np.ndarray], n_tokens: int, percent: int) -> Links:
    """Links that connect what is linked between `left` and `right` documents, or within `left`."""
    links, flags = Links(len(tokens)), np.zeros(n_tokens, bool)
    one = SignatureTree(left, tokens, n_tokens)
    other = one if right is None else SignatureTree(right, tokens, n_tokens)
    # A family of copies is connected through its middle one; what follows skips linked nodes.
    middle = one.docs[len(one.docs) // 2 : len(one.docs) // 2 + 1]
    _compare(middle, other.docs, tokens, flags, links, percent)
    todo = [((len(one.levels) - 1, len(other.levels) - 1), (0, 0))]
    while todo:
        at, node = todo.pop()
        if right is None and at[0] == at[1] and node[0] > node[1]:
            continue
        if not _possible(one, other, at, node, percent):
            continue
        (a, b), (c, d) = one.levels[at[0]][0][node[0]], other.levels[at[1]][0][node[1]]
        if len({links.root(int(i)) for i in (*one.docs[a:b], *other.docs[c:d])}) == 1:
            continue
        if at == (0, 0):
            _compare(one.docs[a:b], other.docs[c:d], tokens, flags, links, percent)
            continue
        # Both trees go down together, the shorter one waits.
        down = (at[0] and at[0] >= at[1], at[1] and at[1] >= at[0])
        lefts = one.children(at[0], node[0]) if down[0] else [node[0]]
        rights = other.children(at[1], node[1]) if down[1] else [node[1]]
        below = (at[0] - 1 if down[0] else at[0], at[1] - 1 if down[1] else at[1])
        todo += [(below, (i, j)) for i in lefts for j in rights]
    return links


def _join_blocks(percent: int):
    def join(table: pa.Table) -> pa.Table:
        rows, block = table["row"].to_numpy(), np.array(table["block"].to_pylist(), object)
        column = table["tokens"].combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0)
        flat, edges = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(column).to_numpy())])
        distinct, local = np.unique(flat, return_inverse=True)
        tokens = [np.sort(local[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        names = sorted(set(block.tolist()))
        sides = [np.flatnonzero(block == name) for name in names]
        own = table["a"][0].as_py() == table["b"][0].as_py()
        if not own and len(sides) < 2:
            found = []
        else:
            found = tree_links(sides[0], None if own else sides[1], tokens, len(distinct), percent).found
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(rows[pairs[:, 0]], pa.int64()), "b": pa.array(rows[pairs[:, 1]], pa.int64())})

    return join


def cluster_links(found: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect all linked documents of `candidates`."""
    probes = found.select("row", F.explode("probes").alias("probe"))
    leaders = probes.groupBy("probe").agg(F.min("row").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ties = probes.join(leaders, "probe").where("row <> leader").select(F.col("row").alias("a"), F.col("leader").alias("b"))
    clusters = connected(ties).select(F.col("node").alias("row"), F.col("label").alias("cluster"))
    members = stage_table(found.select("row", "n", "tokens").join(clusters, "row"), "clusters")
    sizes = members.groupBy("cluster").agg(F.sum("n").alias("cluster_tokens"))
    large = sizes.where(F.col("cluster_tokens") > BLOCK_TOKENS)
    # In a large cluster, what is linked with its first document is connected and need not meet again.
    lead = members.where(F.col("row") == F.col("cluster")).select(
        "cluster", F.col("n").alias("lead_n"), F.col("tokens").alias("lead_tokens")
    )
    near = members.join(large.join(lead, "cluster"), "cluster")
    overlap = F.size(F.array_intersect("tokens", "lead_tokens"))
    near = near.where(linked(overlap, F.col("n"), F.col("lead_n"), percent))
    star = stage_table(near.select(F.col("row").alias("a"), F.col("cluster").alias("b")), "stars")
    placed = _blocks(members, sizes, star, percent)
    blocks = placed.select("cluster", "block", "band", "merged").distinct()
    one, two = blocks.alias("one"), blocks.alias("two")
    meet = (
        (F.col("one.cluster") == F.col("two.cluster"))
        & (F.col("one.block") <= F.col("two.block"))
        & (F.abs(F.col("one.band") - F.col("two.band")) <= 1)
        & ~(F.col("one.merged") & F.col("two.merged"))
    )
    pairs = one.join(two, meet).select(
        F.col("one.cluster").alias("cluster"), F.col("one.block").alias("a"), F.col("two.block").alias("b")
    )
    seats = pairs.select("*", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    met = members.join(placed.select("row", "block"), "row").join(seats, ["cluster", "block"])
    links = met.select("cluster", "a", "b", "block", "row", "tokens").groupBy("cluster", "a", "b")
    return links.applyInArrow(_join_blocks(percent), "a long, b long").unionByName(star)


def _blocks(members: DataFrame, sizes: DataFrame, star: DataFrame, percent: int) -> DataFrame:
    """(row, cluster, band, merged, block): small clusters are one block, large ones go by size bands."""
    slim = members.select("row", "n", "cluster").join(sizes, "cluster")
    merged = star.select(F.col("a").alias("row"), F.lit(True).alias("linked"))
    slim = slim.join(merged, "row", "left").withColumn("merged", F.coalesce("linked", F.lit(False)))
    large = F.col("cluster_tokens") > BLOCK_TOKENS
    # Linked sizes differ by the ratio of two neighbouring bands at most.
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("long")
    slim = slim.withColumn("band", F.when(large, band).otherwise(F.lit(0).cast("long")))
    counts = slim.groupBy("cluster", "band", "merged").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).alias("parts"))
    slot = F.pmod(F.xxhash64("row"), F.col("parts"))
    name = F.concat_ws("-", F.col("merged").cast("int").cast("string"), F.col("band").cast("string"), slot.cast("string"))
    whole = slim.join(counts, ["cluster", "band", "merged"])
    return stage_table(whole.select("row", "cluster", "band", "merged", name.alias("block")), "blocks")


def shingle_components(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """One row per document row: doc_id, text_hash, n_shingles, component_id.

    Two documents are linked if 100 * common shingles >= `percent` * all shingles of both; the
    component is named by its smallest doc_id (null only if all of its ids are). Null and blank
    texts have no shingles and no links. Documents with fewer than `size` words have one shingle.
    """
    ship_package(docs.sparkSession)
    batches = batch_texts(docs)
    keys = set_keys(batches, size)
    total = batches.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    found = candidates(batches, keys, max(1, total // BUCKET_BYTES), size, percent)
    labels = connected(stage_table(cluster_links(found, percent), "links"))
    return _named(keys, labels)


def _named(keys: DataFrame, labels: DataFrame) -> DataFrame:
    sets = keys.where("n > 0").groupBy("s1", "s2", "n").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "row", "batch"))["row"].alias("row")
    )
    tied = stage_table(sets.join(labels, sets["row"] == labels["node"], "left").drop("node", "row"), "set-labels")
    names = tied.where("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("name"))
    named = tied.join(names, "label", "left").select(
        "s1", "s2", "n", F.coalesce("name", "least").alias("component_id")
    )
    met = keys.join(named, ["s1", "s2", "n"], "left")
    own: Column = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return met.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), own.alias("component_id"))


def first_of_components(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """`docs` with one row of each component: one with the smallest id. All columns stay.

    Of rows that repeat this id and text one stays. Where no row of a component has an id, one row of
    each different text stays. Blank texts belong to no component: their rows all stay.
    """
    found = shingle_components(docs, size, percent).where("n_shingles > 0")
    copy = F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    # Partial sums absorb a text with a third of all rows.
    texts = found.groupBy("doc_id", "text_hash").agg(F.max(copy).alias("copy"), F.count(F.lit(1)).alias("n"))
    marked = stage_table(texts.where("copy OR n > 1"), "later-copies")
    match = docs["doc_id"].eqNullSafe(marked["doc_id"]) & (text_hash(docs["text"]) == marked["text_hash"])
    rest = docs.join(marked, match, "left_anti")
    repeated = marked.where("NOT copy").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    if repeated.isEmpty():
        return rest
    same = docs["doc_id"].eqNullSafe(repeated["_id"]) & (text_hash(docs["text"]) == repeated["_hash"])
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row")
    once = docs.join(repeated, same).select("_id", "_hash", row).groupBy("_id", "_hash").agg(F.first("_row").alias("_row"))
    return rest.unionByName(once.select("_row.*"))
