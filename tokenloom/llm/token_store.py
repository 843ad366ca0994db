"""Token-ID output: encoded documents as separately compressed frames with a shared dictionary.

Format (a folder):
- `dictionary`: one Parquet row: the zstandard dictionary, its sha256, the id width in bytes.
- `shards`: Parquet rows in ascending document order, each a run of documents: part and seq (its
  place in the order), dict_hash, first_doc and last_doc, n_docs, n_tokens, and for its documents
  doc_ids, counts (ids of each) and offsets (n_docs + 1 positions in payload), then payload: the
  documents' frames, one after another. A frame is one document's ids, little-endian, compressed
  with the dictionary by itself, so a short document is read without its neighbours.
- `starts`: Parquet rows (part, start): ids of all documents before each part.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tokenloom.llm.common import batch_of, bounds_of, kind_of, slices, tidy, utf8_of
from tokenloom.session import ship_package, stage_table

#: Payload bytes after which a shard is closed.
SHARD_BYTES = 1 << 20
#: The dictionary is trained on at most so many documents of at most so many characters.
SAMPLE_DOCS = 1000
SAMPLE_CHARS = 8192
DICT_BYTES = 32 << 10
LEVEL = 3
#: What a worker remembers of units: so many bytes, twice over at most.
CACHED_BYTES = 48 << 20
#: Bytes of an entry besides its characters and ids: two objects and their place in the table.
ENTRY_BYTES = 190
ENCODE_TEXTS = 64
JOINED_PIECES = 100
#: A control character: a byte of its own in UTF-8, which no other character contains.
MARK = "\x01"
#: A longer unit is not remembered.
CACHED_CHARS = 48
#: Runs of letters, and of what stands between them, in ASCII and Latin-1; `KINDS` and `PAIRS` say the same of bytes.
RUNS = re.compile("[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[^A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: Kinds of bytes: what ends a piece, a letter, anything else.
GAP, LETTER, OTHER = 0, 1, 2
KINDS = np.full(256, OTHER, np.uint8)
KINDS[[ord(c) for c in " \n"]] = GAP
KINDS[[b for b in range(128) if chr(b).isalpha()]] = LETTER
#: Letters among the characters from U+0080 on, by their second byte, behind 0xC2 and 0xC3.
PAIRS = np.full((2, 256), OTHER, np.uint8)
PAIRS[0, [0xAA, 0xB5, 0xBA]] = LETTER
PAIRS[1, [b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = LETTER
#: Fixed value: how vocabularies of this kind spell the end of a word.
WORD_END = "</w>"
#: Frames in a part of the ordered shuffle.
PART_BYTES = 16 << 20


class Remembered:
    """text -> ids, bounded by bytes: when full, what was asked for since the last time is kept once more."""

    def __init__(self, most: int = CACHED_BYTES):
        self.most, self.size = most, 0
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def unknown(self, texts: Iterable[str]) -> list[str]:
        """Those of `texts` that must be learned, each once."""
        if self.size > self.most:
            self.known, self.older, self.size = {}, self.known, 0
        known, older = self.known, self.older
        missing = {t for t in texts if t not in known}
        if older:
            back = [t for t in missing if t in older]
            self.learn(back, [older[t] for t in back])
            missing.difference_update(back)
        return list(missing)

    def learn(self, texts: list[str], ids: list[bytes]) -> None:
        self.known.update(zip(texts, ids, strict=True))
        self.size += sum(map(len, texts)) + sum(map(len, ids)) + ENTRY_BYTES * len(texts)

    def forget(self, texts: Iterable[str]) -> None:
        for t in texts:
            ids = self.known.pop(t, b"")
            self.size -= len(t) + len(ids) + ENTRY_BYTES


class PieceEncoder:
    """Ids of whole texts with a `tokenizers` file, each distinct unit of a slice of texts looked up once.

    A unit is a piece between spaces. That is valid for tokenizers whose pre-tokenizer never joins
    characters across an ASCII space or line end and drops both, which the class checks on a probe;
    others are encoded text by text. If the probe shows too that letters never join other characters
    and that case plays no part, the units of a piece are its runs of letters and of non-letters.
    Texts are cut, their units made distinct, and ids put in place by whole arrays.
    """

    PROBE = "A b\n\nc d's 12 3! x"
    RUN_PROBE = "Ab,cD12e ...\xc9t\xe9-x\xb5 \xaa\xba&&\xdf7\xf8 q_r \xd7s\xf7T"

    def __init__(self, path: str):
        # Spark's tasks are the parallelism; the library's own threads would only compete with them.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.units = Remembered()
        alone = np.frombuffer(self._ids([MARK])[0], "<u4")
        self.mark = int(alone[0]) if len(alone) == 1 else None
        self.by_piece = self._ids([self.PROBE]) == [b"".join(self._ids(self.PROBE.split()))]
        added = [re.escape(token.content) for token in self.tokenizer.get_added_tokens_decoder().values()]
        #: What `_plain` leaves to the library: an apostrophe may join what follows, an added token is no run.
        self.joining = re.compile("|".join(["'", *added]))
        #: Bytes that keep their piece whole: of characters beyond Latin-1, and those such a match begins with.
        self.whole = np.arange(256) >= 0xC4
        self.whole[[ord("'"), *(t.content.encode()[0] for t in self.tokenizer.get_added_tokens_decoder().values())]] = True
        words = self.RUN_PROBE.split()
        self.by_run = self.by_piece and all(
            self._ids([w]) == [b"".join(self._ids([r.lower() for r in RUNS.findall(w)]))] for w in words
        )
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids; few texts at a time, since the library's results are large."""
        found = []
        for at in range(0, len(texts), ENCODE_TEXTS):
            some = self.tokenizer.encode_batch_fast(texts[at : at + ENCODE_TEXTS], add_special_tokens=False)
            found += [np.array(e.ids, "<u4").tobytes() for e in some]
        return found

    def _apart(self, pieces: list[str], between: str, ends) -> list[bytes]:
        """As `_ids`, for many pieces in one text, which is cut again where `ends` says (from, to)."""
        groups = [pieces[at : at + JOINED_PIECES] for at in range(0, len(pieces), JOINED_PIECES)]
        found = []
        for group, raw in zip(groups, self._ids([between.join(g) for g in groups]), strict=True):
            cuts = ends(np.frombuffer(raw, "<u4"))
            found += [raw[4 * low : 4 * high] for low, high in cuts] if len(cuts) == len(group) else self._ids(group)
        return found

    def _between_marks(self, ids: np.ndarray) -> list[tuple[int, int]]:
        marks = np.flatnonzero(ids == self.mark).tolist()
        return list(zip([0, *(m + 1 for m in marks)], [*marks, len(ids)], strict=True))

    def _words(self, ids: np.ndarray) -> list[tuple[int, int]]:
        ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
        return list(zip([0, *ends], ends, strict=False)) if ends and ends[-1] == len(ids) else []

    def _piece_ids(self, pieces: list[str]) -> list[bytes]:
        """As `_ids`, for pieces without white space; a mark that no piece holds stands between them."""
        if self.mark is None or any(MARK in p for p in pieces):
            return self._ids(pieces)
        return self._apart(pieces, f" {MARK} ", self._between_marks)

    def _plain(self, unit: str) -> bool:
        """A run; beyond Latin-1 characters may combine."""
        return self.by_run and (unit.isascii() or max(unit) <= "\xff") and not self.joining.search(unit)

    def _learn(self, units: list[str]) -> None:
        """A run of letters is one word to the tokenizer, so many of them go into one text."""
        letters, others = [], []
        for u in units:
            (letters if u.isalpha() and self._plain(u) else others).append(u)
        self.units.learn(letters, self._apart(letters, " ", self._words))
        self.units.learn(others, self._piece_ids(others))

    def _cut(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last + 1 byte of the units of UTF-8 texts, which `edges` divide, in order; the bytes.

        Runs are lower-cased as far as ASCII goes, so that one unit serves both cases.
        """
        kind = KINDS[raw]
        lead = np.flatnonzero((raw == 0xC2) | (raw == 0xC3))
        kind[lead] = kind[lead + 1] = PAIRS[raw[lead] - 0xC2, raw[lead + 1]]
        text = kind != GAP
        begins, ends = bounds_of(text, edges)
        firsts, lasts = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if not self.by_run or not len(firsts):
            return firsts, lasts, raw
        begins[1:] |= text[1:] & (kind[1:] != kind[:-1])
        starts = np.flatnonzero(begins)
        heads = np.zeros(len(raw), bool)
        heads[firsts] = True
        head = heads[starts]
        kept_whole = np.zeros(len(firsts), bool)
        kept_whole[np.searchsorted(firsts, np.flatnonzero(self.whole[raw] & text), "right") - 1] = True
        capitals = np.flatnonzero((raw >= ord("A")) & (raw <= ord("Z")))
        capitals = capitals[~kept_whole[np.searchsorted(firsts, capitals, "right") - 1]]
        raw = raw.copy()
        raw[capitals] += ord("a") - ord("A")
        stay = head | ~kept_whole[np.cumsum(head) - 1]
        starts, head = starts[stay], head[stay]
        stops = np.append(starts[1:], 0)
        stops[np.append(head[1:], True)] = lasts
        return starts, stops, raw

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text; null is empty."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.by_piece:
            return self._ids(pc.fill_null(column, "").to_pylist())
        raw, edges = utf8_of(column)
        if not len(raw):
            return [b""] * len(column)
        starts, stops, raw = self._cut(raw, edges)
        if not len(starts):
            return [b""] * len(column)
        # Between two units are gaps only, so what is left of the bytes is the units, end to end.
        places = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
        buffers = pa.py_buffer(places), pa.py_buffer(raw[KINDS[raw] != GAP])
        coded = pa.LargeStringArray.from_buffers(len(starts), *buffers).dictionary_encode()
        units = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = self.units.unknown(units)
        self._learn(new)
        ids = list(map(self.units.known.__getitem__, units))
        self.units.forget(u for u in new if len(u) > CACHED_CHARS)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        offsets = np.cumsum(lengths) - lengths
        unit = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(lengths[unit])])
        taken = np.repeat(offsets[unit] - ends[:-1], lengths[unit]) + np.arange(ends[-1])
        found = np.frombuffer(b"".join(ids), "<u4")[taken]
        bounds = ends[np.searchsorted(starts, edges)].tolist()
        return [found[a:b].tobytes() for a, b in itertools.pairwise(bounds)]


@cache
def encoder_of(path: str) -> PieceEncoder:
    """One encoder for all tasks of a Python worker: what it has seen serves the next task."""
    return PieceEncoder(path)


def encoded(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int):
    """(a slice of a batch, its documents' ids as little-endian uint32 bytes, ended by the end id)."""
    encoder, end = encoder_of(tokenizer_path), np.array([end_id], "<u4").tobytes()
    for whole in batches:
        for batch in slices(whole):
            yield batch, [x + end for x in encoder.encode(batch["text"])]


def encode_texts(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(doc_id, ids as little-endian uint32 bytes); the end id closes each document, null is empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in encoded(batches, tokenizer_path, end_id):
            yield batch_of({"doc_id": batch["doc_id"], "ids": ids}, ids=pa.binary())

    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind_of(docs, 'doc_id')}, ids binary")


@dataclass(frozen=True)
class FrameCodec:
    """Compresses one document's ids. `width` is 2 bytes if every id fits, else 4."""

    dictionary: bytes
    width: int
    level: int = LEVEL

    @property
    def dict_hash(self) -> str:
        return hashlib.sha256(self.dictionary).hexdigest()

    def _dict(self):
        return zstandard.ZstdCompressionDict(self.dictionary) if self.dictionary else None

    def writer(self):
        packer = zstandard.ZstdCompressor(level=self.level, dict_data=self._dict(), write_dict_id=False)
        return lambda ids: packer.compress(np.frombuffer(ids, "<u4").astype(f"<u{self.width}").tobytes())

    def reader(self):
        opener = zstandard.ZstdDecompressor(dict_data=self._dict())
        return lambda frame: np.frombuffer(opener.decompress(frame), f"<u{self.width}").astype(np.uint32)


def train_codec(docs: DataFrame, tokenizer_path: str, end_id: int, max_id: int) -> FrameCodec:
    """A codec whose dictionary learned from a bounded sample: the documents with the lowest id hashes.

    With too few samples for a dictionary, frames are compressed without one.
    """
    width = 2 if max_id < 1 << 16 else 4
    short = docs.select("doc_id", "text").where(F.length("text").between(1, SAMPLE_CHARS))
    picked = short.orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(SAMPLE_DOCS)
    rows = encode_texts(picked, tokenizer_path, end_id).collect()
    samples = [np.frombuffer(r["ids"], "<u4").astype(f"<u{width}").tobytes() for r in rows]
    try:
        trained = zstandard.train_dictionary(DICT_BYTES, sorted(samples)).as_bytes()
    except zstandard.ZstdError:
        trained = b""
    return FrameCodec(trained, width)


SHARD = (
    "part int, seq int, dict_hash string, first_doc {kind}, last_doc {kind}, n_docs long, n_tokens long, "
    "doc_ids array<{kind}>, counts array<long>, offsets array<long>, payload binary"
)


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, vocab_size: int) -> FrameCodec:
    """Encode `docs` (doc_id, text) and write the folder. Documents are ordered by id, null first.

    Rows with one id are ordered by their ids, so reruns give the same files whatever the partitions.
    """
    spark = docs.sparkSession
    ship_package(spark)
    codec = train_codec(docs, tokenizer_path, end_id, max(end_id, vocab_size - 1))
    kind = kind_of(docs, "doc_id")
    spark.sql("SELECT 1").select(
        F.lit(codec.dictionary).alias("dictionary"),
        F.lit(codec.dict_hash).alias("dict_hash"),
        F.lit(codec.width).alias("width"),
    ).write.parquet(f"{path}/dictionary")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = codec.writer()
        for batch, ids in encoded(batches, tokenizer_path, end_id):
            counts, crcs = [len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids]
            frames = [pack(x) for x in ids]
            columns = {"doc_id": batch["doc_id"], "n": counts, "crc": crcs, "frame": frames}
            yield batch_of(columns, n=pa.int64(), crc=pa.int64(), frame=pa.binary())

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, rows, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            ids, counts, frames = zip(*rows, strict=True)
            cells = [part, seq, codec.dict_hash, ids[0], ids[-1], len(rows), sum(counts), list(ids), list(counts)]
            offsets = [0, *itertools.accumulate(map(len, frames))]
            return pa.RecordBatch.from_arrays(
                [pa.array([c], t) for c, t in zip([*cells, offsets, b"".join(frames)], types(batch), strict=True)],
                NAMES,
            )

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("doc_id", "n", "frame")), strict=True):
                rows.append(row)
                size += len(row[2])
                if size >= SHARD_BYTES:
                    yield close()
                    seq, rows, size = seq + 1, [], 0
        if rows:
            yield close()

    def types(batch):
        own, long = batch.schema.field("doc_id").type, pa.int64()
        i32 = pa.int32()
        return [i32, i32, pa.string(), own, own, long, long, pa.list_(own), pa.list_(long), pa.list_(long), pa.binary()]

    # Staged, so that the range shuffle's sample of ids does not encode the texts a second time.
    frames = docs.select("doc_id", "text").mapInArrow(tidy(compress), f"doc_id {kind}, n long, crc long, frame binary")
    frames = stage_table(frames, "frames")
    size = frames.agg(F.sum(F.octet_length("frame"))).first()[0] or 0
    # Rows of one id, or without one, spread over parts by what they hold.
    ordered = frames.repartitionByRange(max(1, -(-size // PART_BYTES)), "doc_id", "crc", "n")
    ordered = ordered.sortWithinPartitions("doc_id", "crc", "n")
    ordered.drop("crc").mapInArrow(tidy(shards), SHARD.format(kind=kind)).write.parquet(f"{path}/shards")
    # One row per part of the range shuffle.
    totals = spark.read.parquet(f"{path}/shards").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts = list(itertools.accumulate([0, *(r["n"] for r in totals)]))
    table = [f"({r['part']}, {s}L)" for r, s in zip(totals, starts, strict=False)]
    values = ", ".join(table) if table else "(-1, 0L)"
    spark.sql(f"SELECT * FROM VALUES {values} AS t(part, start)").write.parquet(f"{path}/starts")
    return codec


NAMES = ["part", "seq", "dict_hash", "first_doc", "last_doc", "n_docs", "n_tokens", "doc_ids", "counts", "offsets", "payload"]


def load_codec(spark: SparkSession, path: str) -> FrameCodec:
    row = spark.read.parquet(f"{path}/dictionary").first()
    codec = FrameCodec(bytes(row["dictionary"]), row["width"])
    if codec.dict_hash != row["dict_hash"]:
        raise ValueError(f"the dictionary in {path} does not match its hash")
    return codec


def read_store(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents, or of those from `first` to `last`.

    The bounds prune shards by their document range, and frames by the offset index. `start` is the
    number of ids of all documents before.
    """
    ship_package(spark)
    codec = load_codec(spark, path)
    files = spark.read.parquet(f"{path}/shards")
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    index = files.select("part", "seq", "n_tokens").withColumn("before", F.coalesce(before, F.lit(0)))
    index = index.join(spark.read.parquet(f"{path}/starts"), "part").select(
        "part", "seq", (F.col("start") + F.col("before")).alias("start")
    )
    wanted = files.select("part", "seq", "dict_hash", "doc_ids", "counts", "offsets", "payload", "first_doc", "last_doc")
    if first is not None:
        wanted = wanted.where(F.col("last_doc") >= first)
    if last is not None:
        # A shard that begins with documents without an id may hold others too.
        wanted = wanted.where(F.col("first_doc").isNull() | (F.col("first_doc") <= last))
    kind = wanted.schema["first_doc"].dataType.simpleString()
    expected = codec.dict_hash

    def open_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = codec.reader()
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["dict_hash"] != expected:
                    raise ValueError("a shard was written with another dictionary")
                start, out = row["start"], []
                ends = zip(row["doc_ids"], row["counts"], row["offsets"], row["offsets"][1:], strict=False)
                for doc_id, n, low, high in ends:
                    inside = (first is None or (doc_id is not None and doc_id >= first)) and (
                        last is None or (doc_id is not None and doc_id <= last)
                    )
                    if inside:
                        out.append((doc_id, start, n, unpack(row["payload"][low:high]).astype("<u4").tobytes()))
                    start += n
                if out:
                    ids, starts, counts, blobs = zip(*out, strict=True)
                    own = batch.schema.field("doc_ids").type.value_type
                    yield batch_of(
                        {"doc_id": ids, "start": starts, "n_tokens": counts, "ids": blobs}, doc_id=own, ids=pa.binary()
                    )

    met = wanted.drop("first_doc", "last_doc").join(index, ["part", "seq"])
    return met.mapInArrow(tidy(open_shards), f"doc_id {kind}, start long, n_tokens long, ids binary")
