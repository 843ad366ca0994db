"""Text to ids and back.

Encoding needs no shuffle: each task cuts its documents into units, encodes every distinct
unit of an Arrow batch once, and puts the results back in place. A line that makes up a third
of the corpus costs one encoding per batch and never meets itself in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tokenloom.operators.merge_kernel import MergeTable, merge_all, portion_for, portions
from tokenloom.operators.segments import encoding_units
from tokenloom.operators.vocabulary import Vocabulary, constant_strings
from tokenloom.operators.worker import tidy

# Fixed value: the word-end mark the decoder turns into a blank, or drops on the last token.
WORD_END = "</w>"
_UNITS = "_units"
# Text encoded into one output batch: so many portions of the merge kernel, no more than the bytes.
_BATCH_PORTIONS = 4
_BATCH_BYTES = 1 << 24


def _characters(texts: pa.Array, code_points, code_ids):
    """Ids of the characters of all texts, flat, and the texts' lengths."""
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    points = np.frombuffer(data or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    lengths = np.diff(ends)
    if not (points < 128).all():
        shown = texts.to_pylist()
        lengths = np.fromiter(map(len, shown), dtype=np.int64, count=len(shown))
        points = np.frombuffer("".join(shown).encode("utf-32-le"), dtype="<u4")
        slot = np.minimum(np.searchsorted(code_points, points), len(code_points) - 1)
        return np.where(code_points[slot] == points, code_ids[slot], 0).astype(np.int32), lengths
    by_byte = np.zeros(128, dtype=np.int32)
    by_byte[code_points[code_points < 128]] = code_ids[code_points < 128]
    return by_byte.take(points), lengths


def _encode_distinct(texts: pa.Array, code_points, code_ids, specials: dict[str, int], table: MergeTable):
    """Ids of all texts, flat, and their lengths."""
    texts = texts.cast(pa.large_string())
    tokens, lengths = _characters(texts, code_points, code_ids)
    place = pc.index_in(texts, value_set=pa.array([*specials], pa.large_string())).fill_null(-1).to_numpy()
    if (place >= 0).any():
        # A reserved token takes the place of its first character, the others go.
        reserved = np.append(np.fromiter(specials.values(), dtype=np.int32, count=len(specials)), -1)[place]
        starts = np.cumsum(lengths) - lengths
        tokens[starts[reserved >= 0]] = reserved[reserved >= 0]
        kept = np.repeat(reserved < 0, lengths)
        kept[starts] = True
        tokens, lengths = tokens[kept], np.where(reserved < 0, lengths, 1)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    flat, merged_lengths = [], []
    for first, last in portions(lengths, portion_for(table.size)):
        merged, counts = merge_all(tokens[ends[first] : ends[last]], ends[first:last] - ends[first], table)
        flat.append(merged)
        merged_lengths.append(counts)
    return np.concatenate(flat), np.concatenate(merged_lengths)


def encode_corpus(
    df: DataFrame, vocab: Vocabulary, text: str = "clean_text", split_mode: str = "literal", out: str = "ids"
) -> DataFrame:
    """Replace column `text` by `out ARRAY<INT>`; the other columns pass through."""
    singles = sorted((ord(t), i) for i, t in enumerate(vocab.tokens) if len(t) == 1)
    code_points = np.array([c for c, _ in singles], dtype=np.uint32)
    code_ids = np.array([i for _, i in singles], dtype=np.int32)
    ids = vocab.ids()
    specials = {t: ids[t] for t in vocab.specials}
    left, right, new = zip(*vocab.merges) if vocab.merges else ((), (), ())
    shipped = df.sparkSession.sparkContext.broadcast((left, right, new))
    kept = [c for c in df.columns if c != text]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.ArrayType(T.IntegerType(), False))])

    def encode(batch: pa.RecordBatch, table: MergeTable) -> pa.RecordBatch:
        lists = batch.column(_UNITS)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        cut = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        if len(cut):
            flat, lengths = _encode_distinct(
                cut.dictionary, code_points, code_ids, specials, table
            )
            ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            by_unit = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=pa.int32()))
            placed = by_unit.take(cut.indices).flatten()
            upto = np.concatenate(([0], np.cumsum(lengths[cut.indices.to_numpy()])))
        else:
            placed, upto = pa.array([], type=pa.int32()), np.zeros(1, dtype=np.int64)
        doc_ends = upto[offsets - offsets[0]].astype(np.int32)
        encoded = pa.ListArray.from_arrays(pa.array(doc_ends), placed)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), encoded], [*kept, out])

    def run(batches):
        table = MergeTable(*shipped.value)
        for batch in batches:
            lists = batch.column(_UNITS)
            text_ends = np.frombuffer(lists.values.buffers()[1] or bytes(4), dtype=np.int32)
            sizes = np.diff(text_ends[lists.offsets.to_numpy()].astype(np.int64))
            for first, last in portions(sizes, min(_BATCH_BYTES, _BATCH_PORTIONS * portion_for(table.size))):
                yield encode(batch.slice(first, last - first), table)

    cut_up = df.select(
        *kept, F.coalesce(encoding_units(F.col(text), vocab.specials, split_mode), F.array()).alias(_UNITS)
    )
    return cut_up.mapInArrow(tidy(run), schema)


def token_pieces(ids: Column, vocab: Vocabulary) -> Column:
    """The token texts of an id array."""
    table = constant_strings(vocab.tokens)
    return F.transform(ids, lambda i: F.get(table, i))


def decode_tokens(ids: Column, vocab: Vocabulary, skip_special: bool = True) -> Column:
    """Concatenated token texts; a lookup per id in one folded array, no shuffle."""
    if skip_special:
        reserved = [i for i, t in enumerate(vocab.tokens) if t in vocab.specials]
        ids = F.filter(ids, lambda i: ~i.isin(*reserved))
    pieces = token_pieces(ids, vocab)
    if any(WORD_END in t for t in vocab.tokens):
        count = F.size(ids)
        pieces = F.transform(
            pieces,
            lambda t, at: F.replace(
                t, F.lit(WORD_END), F.when(at == count - 1, F.lit("")).otherwise(F.lit(" "))
            ),
        )
    return F.array_join(pieces, "")
