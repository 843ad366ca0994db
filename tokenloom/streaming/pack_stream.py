"""Packing a stream of encoded documents, with the open block of each lane in Spark's state store.

Documents go to their lane; a stateful operator appends a micro-batch's documents to the lane's open
block, in document order, and emits every block that is full. The state of a lane is less than one
block, kept in RocksDB and versioned with the checkpoint; the file sink's log makes each block appear
once, whatever is repeated after a failure. A lane is one task's work in a micro-batch, so a large
stream takes as many lanes as it has cores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tokenloom.operators.packing import lanes, shift_targets
from tokenloom.operators.worker import tidy

#: Ids go to the few tasks of the lanes, and leave them, as one value of little-endian 32-bit numbers:
#: an array would be converted element by element there.
_ID = np.dtype("<i4")
BLOCK_SCHEMA = "lane int, block_id long, chunk array<int>"
STATE_SCHEMA = "next_block long, ids array<int>"
#: Blocks handed over at once.
EMIT_BLOCKS = 4096
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _to_binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids").fill_null([])
        ends = (ids.offsets.to_numpy().astype(np.int64) - ids.offsets[0].as_py()) * _ID.itemsize
        values = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), _ID)
        buffers = [None, pa.py_buffer(ends), pa.py_buffer(values)]
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), buffers).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lane"), packed], ["doc_id", "lane", "ids"])


def _to_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chunks = batch.column("chunk").to_pylist()
        ends = np.cumsum([0, *map(len, chunks)]) // _ID.itemsize
        values = pa.array(np.frombuffer(b"".join(chunks), _ID))
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        yield pa.RecordBatch.from_arrays([batch.column("lane"), batch.column("block_id"), ids], ["lane", "block_id", "chunk"])


class LanePacker(StatefulProcessor):
    """Full blocks of `width` ids from the documents of one lane, micro-batch by micro-batch."""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open_block", STATE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        next_block, carried = self.open.get() if self.open.exists() else (0, [])
        docs = pd.concat([r[["doc_id", "ids"]] for r in rows]).sort_values("doc_id", kind="stable")
        stream = b"".join([np.asarray(carried, _ID).tobytes(), *docs["ids"]])
        size = self.width * _ID.itemsize
        full = len(stream) // size
        for at in range(0, full, EMIT_BLOCKS):
            some = range(at, min(full, at + EMIT_BLOCKS))
            numbers = np.arange(next_block + some.start, next_block + some.stop)
            chunks = [stream[i * size : (i + 1) * size] for i in some]
            yield pd.DataFrame({"lane": np.int32(key[0]), "block_id": numbers, "chunk": chunks})
        self.open.update((int(next_block) + full, np.frombuffer(stream[full * size :], _ID).tolist()))

    def close(self) -> None:
        pass


class PackStream:
    """Packs a stream of `doc_id, ids` into `lane, block_id, chunk` files under `path`.

    Documents must arrive in order between micro-batches; inside one they are sorted. `doc_id` is
    dense, so that lanes are dealt round robin.
    """

    def __init__(self, path: str, block_size: int, n_lanes: int):
        self.path, self.block_size, self.n_lanes = path, block_size, n_lanes

    def packed(self, encoded: DataFrame) -> DataFrame:
        """The stream of full blocks."""
        dealt = lanes(encoded.select("doc_id", "ids"), self.n_lanes)
        sent = dealt.mapInArrow(tidy(_to_binary), f"doc_id {dealt.schema['doc_id'].dataType.simpleString()}, lane int, ids binary")
        full = sent.groupBy("lane").transformWithStateInPandas(
            LanePacker(self.block_size + 1),
            outputStructType="lane int, block_id long, chunk binary",
            outputMode="Append",
            timeMode="None",
        )
        # The few tasks of the lanes only cut: all cores turn blocks into arrays and write them.
        spread = full.repartition(encoded.sparkSession.sparkContext.defaultParallelism, "block_id")
        return spread.mapInArrow(tidy(_to_ids), BLOCK_SCHEMA)

    def _state_partitions(self, spark: SparkSession) -> int:
        """As few partitions as keep the lanes apart, or nearly so: each costs a worker and a store in every micro-batch."""
        n = self.n_lanes
        places = [r[0] for r in spark.range(n).select(F.hash(F.col("id").cast("int"))).collect()]
        return min(range(n, 4 * n + 1), key=lambda p: (max(Counter(h % p for h in places).values()), p))

    def run(self, encoded: DataFrame, checkpoint: str) -> None:
        """Process all input there is, then stop."""
        spark = encoded.sparkSession
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
        before = spark.conf.get("spark.sql.shuffle.partitions")
        # Noted in the checkpoint by the first run, which later ones follow.
        spark.conf.set("spark.sql.shuffle.partitions", self._state_partitions(spark))
        try:
            query = (
                self.packed(encoded)
                .writeStream.format("parquet")
                .option("path", f"{self.path}/blocks")
                .option("checkpointLocation", checkpoint)
                .outputMode("append")
                .trigger(availableNow=True)
                .start()
            )
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        query.awaitTermination()

    def blocks(self, spark: SparkSession) -> DataFrame:
        """All blocks written so far, as input and target."""
        return shift_targets(spark.read.schema(BLOCK_SCHEMA).parquet(f"{self.path}/blocks"))
