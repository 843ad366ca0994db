"""Line dedup: repeated lines as compressed keep bitmaps, one per document.

Lines become 128-bit hashes. Hashes are dealt out by range and sorted by document and position
inside a range, so a window streams over each hash once: its documents are counted and its first
occurrence is seen in passing. A hash with over 1/4096 of all lines would fill a range by itself;
there are at most 4,096 such hashes, so they are counted with partial sums and met by a broadcast.
Texts are never shuffled to find repeats: only (hash, document, position) is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tokenloom.llm.common import SPACES, let, lower_ascii, same, text_hash
from tokenloom.session import stage_table

#: A hash is heavy from this share of all lines on, so there are at most as many heavy hashes.
HEAVY_SHARE = 4096
WORD_BITS = 64


def split_lines(text: Column) -> Column:
    """Lines of a text; null and '' are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def line_keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """Bitmaps of the documents that lose lines.

    A line is repeated if its key (trimmed, A-Z lowered) has at least `min_chars` code points and
    is found in at least `min_docs` documents. `keep="none"` drops every repeated line,
    `keep="first"` keeps the first by (doc_id, text hash, position).

    Returns (doc_id, text_hash, keep_words): `keep_words` lists, in order, the 64-line words that
    lose a line, with a set bit for each line that stays; words that are absent keep all lines.
    Equal rows are one document. A null text is one empty line, whose key is too short to count.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    each = docs.select(
        "doc_id", text_hash().alias("text_hash"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line")
    )
    keyed = each.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= max(1, min_chars))
    lines = stage_table(
        keyed.select(
            "doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
        ),
        "lines",
    )
    least = max(min_docs, lines.count() // HEAVY_SHARE + 1)
    heavy = stage_table(
        lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("h1", "h2"),
        "heavy-lines",
    )
    dropped = _dropped_light(lines, heavy, min_docs, keep).unionByName(
        _dropped_heavy(lines, heavy, min_docs, keep)
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % WORD_BITS)
    words = dropped.groupBy(
        "doc_id", "text_hash", F.floor(F.col("pos") / WORD_BITS).cast("int").alias("word")
    ).agg(F.bitwise_not(F.bit_or(bit)).alias("keep"))
    return words.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_list(F.struct("word", "keep"))).alias("keep_words")
    )


def _dropped_light(lines: DataFrame, heavy: DataFrame, min_docs: int, keep: str) -> DataFrame:
    light = lines.join(F.broadcast(heavy), ["h1", "h2"], "left_anti").repartitionByRange("h1", "h2")
    by_hash = Window.partitionBy("h1", "h2")
    stream = by_hash.orderBy("doc_id", "text_hash", "pos")
    same_doc = F.lag("doc_id").over(stream).eqNullSafe(F.col("doc_id")) & F.lag("text_hash").over(stream).eqNullSafe(
        F.col("text_hash")
    )
    rank = F.row_number().over(stream)
    seen = light.select("*", rank.alias("rank"), F.when((rank > 1) & same_doc, 0).otherwise(1).alias("new_doc"))
    counted = seen.withColumn("n_docs", F.sum("new_doc").over(by_hash)).where(F.col("n_docs") >= min_docs)
    if keep == "first":
        counted = counted.where(F.col("rank") > 1)
    return counted.select("doc_id", "text_hash", "pos")


def _dropped_heavy(lines: DataFrame, heavy: DataFrame, min_docs: int, keep: str) -> DataFrame:
    met = lines.join(F.broadcast(heavy), ["h1", "h2"])
    in_doc = met.groupBy("h1", "h2", "doc_id", "text_hash").agg(F.min("pos").alias("pos"))
    first = F.min(F.struct("doc_id", "text_hash", "pos")).alias("first")
    repeated = in_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), first)
    repeated = repeated.where(F.col("n_docs") >= min_docs).select("h1", "h2", "first")
    # No more rows than `heavy`, which is bounded.
    found = lines.join(F.broadcast(repeated), ["h1", "h2"])
    if keep == "first":
        found = found.where(~F.struct("doc_id", "text_hash", "pos").eqNullSafe(F.col("first")))
    return found.select("doc_id", "text_hash", "pos")


def kept_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, lines, kept): every row's lines, and those its bitmap keeps."""
    left = docs.select("doc_id", "text", text_hash().alias("text_hash"))
    met = left.join(bitmaps, same(left, bitmaps, "doc_id", "text_hash"), "left").select(
        left["doc_id"], left["text"], bitmaps["keep_words"]
    )

    def kept(lines: Column) -> Column:
        n_words = F.floor((F.size(lines) - 1) / WORD_BITS).cast("int")
        entries = F.map_from_entries("keep_words")
        dense = F.transform(
            F.sequence(F.lit(0), n_words), lambda w: F.coalesce(F.try_element_at(entries, w), F.lit(-1).cast("long"))
        )

        def pick(words: Column) -> Column:
            def stays(_, i):
                word = F.get(words, F.floor(i / WORD_BITS).cast("int"))
                return F.call_function("shiftright", word, i % WORD_BITS).bitwiseAND(F.lit(1).cast("long")) == 1

            return F.filter(lines, stays)

        return F.when(F.col("keep_words").isNull(), lines).otherwise(let(dense, pick))

    found = let(split_lines(F.col("text")), lambda lines: F.struct(lines.alias("lines"), kept(lines).alias("kept")))
    return met.select("doc_id", found.alias("found")).select("doc_id", "found.lines", "found.kept")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """Documents without their repeated lines: (doc_id, text, n_lines, n_dropped)."""
    bitmaps = line_keep_bitmaps(docs, min_docs, min_chars, keep)
    return kept_lines(docs, bitmaps).select(
        "doc_id",
        F.array_join("kept", "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
    )
