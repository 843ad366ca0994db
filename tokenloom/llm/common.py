"""Small pieces that several operators share."""

from __future__ import annotations

import itertools
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tokenloom.operators.worker import give_back, tidy  # noqa: F401 (the operators import them from here)

#: The six ASCII white-space characters that end a word.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: By byte: whether it ends a word, and itself with A-Z lowered.
IS_SPACE = np.isin(np.arange(256), [ord(c) for c in SPACES])
LOWERED = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: Documents that begin within so many bytes of each other are handled at once.
SLICE_BYTES = 4 << 20
#: Words whose hash a task remembers before it starts over.
CACHED_WORDS = 300_000


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once: a lambda variable is never inlined."""
    return F.transform(F.array(value), body)[0]


def text_hash(text: str | Column = "text") -> Column:
    """With the document id, the identity of a row: equal rows are one document."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def bucket_of(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo `n`; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def same(left: DataFrame, right: DataFrame, *columns: str) -> Column:
    """Equality in which null equals null, over columns of both sides."""
    condition = F.lit(True)
    for name in columns:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def numbers(array: list[float], kind: str) -> Column:
    """A literal array of any length: parsed once, when the plan is folded."""
    return F.from_json(F.lit("[" + ",".join(repr(x) for x in array) + "]"), f"array<{kind}>")


def kind_of(df: DataFrame, column: str) -> str:
    """The SQL name of a column's type."""
    return df.schema[column].dataType.simpleString()


def batch_of(columns: dict[str, object], **types: pa.DataType) -> pa.RecordBatch:
    """An Arrow batch from lists, arrays and Arrow columns; `types` for those that can't be inferred."""
    arrays = [x if isinstance(x, pa.Array) else pa.array(x, types.get(name)) for name, x in columns.items()]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


class WordHashes(dict):
    """word bytes -> 64-bit hash, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self[w] for w in words), np.uint64, len(words))


def slices(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive slices whose texts begin within `SLICE_BYTES`."""
    sizes = pc.fill_null(pc.binary_length(whole["text"]), 0).to_numpy().astype(np.int64)
    window = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    edges = np.flatnonzero(np.diff(window, prepend=-1, append=-1)).tolist()
    for low, high in itertools.pairwise(edges):
        yield whole.slice(low, high - low)


def utf8_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where in them each text begins, with their end; null is empty."""
    column = pc.fill_null(texts.cast(pa.large_string()), "")
    edges = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy())]).astype(np.int64)
    if not edges[-1]:
        return np.zeros(0, np.uint8), edges
    at = int(np.frombuffer(column.buffers()[1], np.int64, 1, 8 * column.offset)[0])
    return np.frombuffer(column.buffers()[2], np.uint8, int(edges[-1]), at), edges


def bounds_of(text: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes begin, and which end, a stretch of `text` (true or false by byte) that crosses no edge."""
    after = np.zeros(len(text) + 1, bool)
    after[edges] = True
    begins, ends = text & after[:-1], text & after[1:]
    begins[1:] |= text[1:] & ~text[:-1]
    ends[:-1] |= text[:-1] & ~text[1:]
    return begins, ends


def words_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words (A-Z lowered), the place in them of each word in turn, and the first word of each text.

    The last number of the third is the end of the last text.
    """
    raw, edges = utf8_of(texts)
    text = ~IS_SPACE[raw]
    begins, ends = bounds_of(text, edges)
    firsts, lasts = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    places = np.concatenate([[0], np.cumsum(lasts - firsts)]).astype(np.int64)
    buffers = [None, pa.py_buffer(places), pa.py_buffer(LOWERED[raw[text]])]
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(firsts), buffers).dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    return words, coded.indices.to_numpy(), np.searchsorted(firsts, edges)
