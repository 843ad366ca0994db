"""Documents in compressed batches of bounded size, and a two-way exchange between them.

Operators over substrings or shingles would shuffle many bytes for each byte of text if every
position were a row. Here a batch of documents sends one packed message to each bucket, a bucket
sees the messages of all batches and answers each of them, and the answers meet the batch again.
Spark deals the messages and joins the answers; messages and answers are a few bytes for each
position that takes part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tokenloom.llm.common import batch_of, kind_of, tidy
from tokenloom.session import stage_table

BATCH_BYTES = 2 << 20


def packed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def batch_texts(docs: DataFrame) -> DataFrame:
    """Staged (batch, doc_ids, lengths, n_bytes, texts): consecutive rows of a partition.

    `texts` is the compressed UTF-8 of all its documents, `lengths` their bytes; null is empty.
    A batch holds up to `BATCH_BYTES`, or one longer document. Rows are numbered: `batch` is the
    number of its first row, and the others follow.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, row = [], [], 0, TaskContext.get().partitionId() << 33

        def close():
            lengths = [len(t) for t in texts]
            columns = {"batch": [row], "doc_ids": [ids], "lengths": [lengths], "n_bytes": [size]}
            types = {"doc_ids": pa.list_(own), "lengths": pa.list_(pa.int64()), "texts": pa.binary()}
            return batch_of(columns | {"texts": [packed(b"".join(texts))]}, n_bytes=pa.int64(), **types)

        for batch in batches:
            own = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                raw = text.encode() if text else b""
                if ids and size + len(raw) > BATCH_BYTES:
                    yield close()
                    row += len(ids)
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(raw)
                size += len(raw)
        if ids:
            yield close()

    schema = f"batch long, doc_ids array<{kind_of(docs, 'doc_id')}>, lengths array<long>, n_bytes long, texts binary"
    return stage_table(docs.select("doc_id", "text").mapInArrow(tidy(pack), schema), "batches")


def with_answers(batches: DataFrame, answers: DataFrame) -> DataFrame:
    """Each batch with `answers`: the list of (bucket, answer) sent to it, none if there are none."""
    listed = answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "answer")).alias("answers"))
    return batches.join(listed, "batch", "left")


def ask(batches: DataFrame, send, answer, reply: str = "batch long, bucket long, answer binary") -> DataFrame:
    """Messages of `send` (an Arrow map to batch, bucket, message), answered bucket by bucket."""
    sent = batches.mapInArrow(send, "batch long, bucket long, message binary")
    return sent.groupBy("bucket").applyInArrow(answer, reply)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads values over all bits, one to one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def low_bytes(x: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of each value."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def from_low_bytes(raw: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return wide.view("<u8").ravel()


def bucket_slices(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Distinct keys' order by (bucket, key): (order, remainder within the bucket, [(bucket, from, to)])."""
    bucket = (keys % np.uint64(n_buckets)).astype(np.int64)
    order = np.lexsort((keys, bucket))
    ranked = bucket[order]
    edges = np.flatnonzero(np.diff(ranked, prepend=-1, append=-1))
    slices = [(int(ranked[a]), int(a), int(b)) for a, b in zip(edges, edges[1:], strict=False)]
    return order, keys[order] // np.uint64(n_buckets), slices
