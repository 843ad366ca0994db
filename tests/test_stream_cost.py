"""What a micro-batch of the packed stream, and the cutting before it, costs besides its documents."""

import random

import pytest
from pyspark.sql import functions as F

from tokenloom.contract import queries as q
from tokenloom.operators import segments
from tokenloom.operators.packing import shift_targets
from tokenloom.streaming.pack_stream import PackStream


def test_state_is_kept_in_few_partitions(spark, sf_dir, monkeypatch):
    """One worker and one store for each partition, in every micro-batch."""
    packers = []
    monkeypatch.setattr(q, "PackStream", lambda *a: packers.append(PackStream(*a)) or packers[0])
    paths = []
    scratch = q.scratch_path
    monkeypatch.setattr(q, "scratch_path", lambda s, name: paths.append(scratch(s, name)) or paths[-1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        q.stream_blocks(spark, sf_dir)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    checkpoint = next(p for p in paths if "stream-cp" in p)
    state = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/state/0/*")
    stores = state.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(state)
    numbered = [s.getPath().getName() for s in stores if s.getPath().getName().isdigit()]
    assert q.LANES <= len(numbered) <= 4 * q.LANES


def test_lanes_do_not_share_a_partition(spark):
    p = PackStream("", 4, 3)._state_partitions(spark)
    assert spark.range(3).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(p))).distinct().count() == 3


@pytest.mark.parametrize("gap", [1, 1000])
def test_an_arrival_has_as_many_files_as_a_micro_batch_takes(spark, tmp_path, monkeypatch, gap):
    """Also where a range of ids holds few documents, or none."""
    rng = random.Random(2)
    rows = [(i if i < 50 else i * gap, "".join(rng.choice("ab\n c") for _ in range(rng.choice([0, 5, 90])))) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(map(tuple, q.streamed_pack(spark, str(tmp_path)).collect()))
    seen = []
    stream = q.corpus_stream
    monkeypatch.setattr(q, "corpus_stream", lambda s, path, **a: seen.append((path, a)) or stream(s, path, **a))
    monkeypatch.setattr(q, "FILE_DOCS", 10)
    assert sorted(map(tuple, q.streamed_pack(spark, str(tmp_path)).collect())) == want
    ((path, asked),) = seen
    assert asked["files_per_trigger"] == 4 and q.file_count(spark, path) == 3 * 4


def test_targets_as_text_are_the_inputs_one_on(spark):
    chunks = [([1, 20, 3],), ([5, 6],), ([7],), ([],)]
    blocks = shift_targets(spark.createDataFrame(chunks, "chunk array<int>").withColumn("k", F.size("chunk")).where("k > 0"))
    want = blocks.select("k", q.as_text("x").alias("x"), q.as_text("y").alias("y"))
    assert sorted(q.shifted_text(blocks, "k").collect()) == sorted(want.collect())


def test_texts_without_reserved_tokens_are_cut_as_with_the_pattern(spark):
    rng = random.Random(1)
    parts = ["a", "\n", " ", "<", "UNK>", "<UNK>", "<SCOPE_IN>", "<SCOPE_", "OUT>", "é"]
    texts = [("".join(rng.choices(parts, k=rng.randrange(12))),) for _ in range(400)] + [("",), ("\n",), ("a\n\nb\n",), (None,)]
    df = spark.createDataFrame(texts, "t string")
    names = segments.any_of(segments.SPECIAL_TOKENS)
    pattern = rf"{names}|(?:(?!{names})[^\n])*+\n|(?:(?!{names})[^\n])++"
    both = df.select(
        "t", segments.encoding_units(F.col("t")).alias("got"), F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("want")
    ).collect()
    assert [r.got for r in both] == [r.want for r in both]
    assert any("<UNK>" in (r.got or []) for r in both)
