"""Benchmark decontamination: windows of test items found in documents.

The windows of all items become a hash set that every task holds; each document's own windows are
looked up in it inside one projection, so scanning needs no shuffle. Hits are verified by their
words, and only hits are grouped. A benchmark of more than `max_inline` windows is met by a join on
the window hash instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tokenloom.llm.common import let, lower_ascii, same, text_hash
from tokenloom.session import stage_table

#: Fixed value: words are runs of these characters, after lower-casing A-Z.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
HIT = "array<struct<len:int,pos:int,window:string>>"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def _window(words: Column, start: Column, length: int) -> Column:
    """Words hold no space, so the joined text is one to one with the window."""
    return F.array_join(F.slice(words, start, F.lit(length)), " ")


def _starts(words: Column, length: int) -> Column:
    last = F.size(words) - (length - 1)
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def _with_words(words: Column, starts: Column, size: int) -> Column:
    def hit(i: Column) -> Column:
        return F.struct(F.lit(size).alias("len"), i.alias("pos"), _window(words, i, size).alias("window"))

    return F.transform(starts, hit)


def item_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(item_id string, len, window), distinct. An item of 1 to n-1 words is one window; of none, nothing."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    size = F.size("words")
    whole = F.array(F.array_join("words", " "))
    windows = F.when(size >= n, F.transform(_starts(F.col("words"), n), lambda i: _window(F.col("words"), i, n)))
    rows = items.where(size > 0).select(
        "item_id", F.least(size, F.lit(n)).alias("len"), F.explode(F.coalesce(windows, whole)).alias("window")
    )
    return rows.distinct()


def find_windows(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, max_inline: int = 50_000
) -> tuple[DataFrame, DataFrame]:
    """(scanned, windows).

    scanned: one staged row per document row: doc_id, text_hash, n_words, hits (start position from
    1, length and words of each window found by hash). windows: `item_windows`, staged.
    """
    windows = stage_table(item_windows(benchmark, n), "item-windows")
    lengths = [r["len"] for r in windows.select("len").distinct().orderBy("len").collect()]
    inline = windows.select("len", "window").distinct().limit(max_inline + 1).count() <= max_inline
    base = docs.select("doc_id", text_hash().alias("text_hash"), F.col("text"))
    if inline:
        scanned = _scan_inline(base, windows, lengths)
    else:
        scanned = _scan_joined(base, windows, lengths)
    return stage_table(scanned, "window-hits"), windows


def _scan_inline(base: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    hashed = windows.select("len", F.xxhash64("window").alias("h")).distinct().collect()
    sets = {size: sorted(r["h"] for r in hashed if r["len"] == size) for size in lengths}

    def found_at(words: Column, size: int) -> Column:
        known = sets[size]
        return F.filter(_starts(words, size), lambda i: F.xxhash64(_window(words, i, size)).isin(known))

    def scan(words: Column) -> Column:
        hits = [F.array().cast(HIT), *(_with_words(words, found_at(words, size), size) for size in lengths)]
        return F.struct(F.size(words).cast("long").alias("n_words"), F.concat(*hits).alias("hits"))

    found = base.select("doc_id", "text_hash", let(words_of(F.col("text")), scan).alias("found"))
    return found.select("doc_id", "text_hash", "found.n_words", "found.hits")


def _scan_joined(base: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    hashed = windows.select("len", F.xxhash64("window").alias("h")).distinct()
    cut = base.select("doc_id", "text_hash", words_of(F.col("text")).alias("words"))

    def each(words: Column) -> Column:
        return F.concat(*(_with_words(words, _starts(words, size), size) for size in lengths))

    rows = cut.select("doc_id", "text_hash", F.explode(let(F.col("words"), each)).alias("hit"))
    rows = rows.select("doc_id", "text_hash", "hit", F.col("hit.len"), F.xxhash64("hit.window").alias("h"))
    met = rows.join(hashed, ["len", "h"], "left_semi")
    hits = met.groupBy("doc_id", "text_hash").agg(F.collect_set("hit").alias("hits"))
    sizes = cut.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"))
    return sizes.join(hits, same(sizes, hits, "doc_id", "text_hash"), "left").select(
        sizes["doc_id"], sizes["text_hash"], "n_words", F.coalesce(hits["hits"], F.array().cast(HIT)).alias("hits")
    )


def verified(scanned: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, covered, items) of contaminated documents.

    covered: sorted positions (from 1) of the words inside any window; items: sorted item ids.
    """
    some = scanned.where(F.size("hits") > 0).dropDuplicates(["doc_id", "text_hash"])
    each = some.select("doc_id", "text_hash", F.explode("hits").alias("hit"))
    each = each.select("doc_id", "text_hash", "hit.len", "hit.pos", "hit.window")
    found = stage_table(each.join(windows.select("window").distinct(), "window", "left_semi"), "verified-hits")
    span = F.sequence(F.col("pos"), F.col("pos") + F.col("len") - 1)
    covered = found.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(span)))).alias("covered")
    )
    matched = found.select("doc_id", "text_hash", "window").distinct().join(windows, "window")
    items = matched.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return covered.join(items, same(covered, items, "doc_id", "text_hash")).select(
        covered["doc_id"], covered["text_hash"], "covered", "items"
    )


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_inline: int = 50_000) -> DataFrame:
    """One row per document row: doc_id, n_words, covered (word positions), items (ids as text).

    Null and empty texts have no words and no hits; an empty benchmark hits nothing.
    """
    scanned, windows = find_windows(docs, benchmark, n, max_inline)
    bad = stage_table(verified(scanned, windows), "contaminated")
    return scanned.join(bad, same(scanned, bad, "doc_id", "text_hash"), "left").select(
        scanned["doc_id"],
        "n_words",
        F.coalesce("covered", F.array().cast("array<int>")).alias("covered"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "documents", max_inline: int = 50_000
) -> DataFrame:
    """`docs` without contamination; all its columns stay.

    `mode="documents"` removes documents with a hit; `mode="spans"` removes the hit words (each with
    the characters up to the next word) and keeps the rest of the text.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode is 'documents' or 'spans'")
    bad = stage_table(verified(*find_windows(docs, benchmark, n, max_inline)), "contaminated")
    hashed = text_hash(docs["text"])
    match = docs["doc_id"].eqNullSafe(bad["doc_id"]) & hashed.eqNullSafe(bad["text_hash"])
    if mode == "documents":
        return docs.join(bad, match, "left_anti")
    # Each piece is a word with what follows it; the first may lack a word.
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.regexp_extract_all(docs["text"], F.lit(rf"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+{gap}*"), F.lit(0))
    head = F.regexp_extract(docs["text"], f"^{gap}+", 0)
    positions = F.map_from_arrays("covered", F.transform("covered", lambda p: F.lit(True)))
    kept = let(positions, lambda hit: F.filter(pieces, lambda _, i: ~F.map_contains_key(hit, i + 1)))
    text = F.when(bad["covered"].isNull(), docs["text"]).otherwise(F.concat(head, F.array_join(kept, "")))
    rest = [text.alias(c) if c == "text" else docs[c] for c in docs.columns]
    return docs.join(bad, match, "left").select(*rest)
