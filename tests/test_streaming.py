import random

import pytest
from pyspark.sql import functions as F

from tokenloom.contract.code_corpus import code_corpus
from tokenloom.functions.text import finish_text, sanitize_text
from tokenloom.operators.cleaning import clean_corpus, clean_prose, with_eos
from tokenloom.operators.encoding import encode_corpus
from tokenloom.operators.packing import pack_blocks, shift_targets
from tokenloom.operators.vocabulary import Vocabulary
from tokenloom.streaming.corpus_stream import corpus_stream, run_to_files, stream_clean, stream_encode
from tokenloom.streaming.pack_stream import PackStream

BLOCK, LANES = 31, 3


def texts(n):
    rng = random.Random(n)
    return [(i, "".join(rng.choice("ab\n é") for _ in range(rng.choice([0, 1, 20, 300])))) for i in range(n)]


def arrive(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)


def batch_form(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, content string")
    encoded = encode_corpus(with_eos(clean_prose(df)), Vocabulary())
    laned = encoded.withColumn("lane", (F.col("doc_id") % LANES).cast("int"))
    blocks = shift_targets(pack_blocks(laned, BLOCK, ("lane",)))
    return sorted((r.lane, r.block_id, r.x, r.y) for r in blocks.collect())


def stream_rows(packer, spark):
    return sorted((r.lane, r.block_id, r.x, r.y) for r in packer.blocks(spark).collect())


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_packing_equals_the_batch_form(spark, tmp_path, batches):
    rows = texts(60)
    size = len(rows) // batches
    for b in range(batches):
        arrive(spark, rows[b * size : (b + 1) * size], str(tmp_path / "in"))
    cleaned = stream_clean(corpus_stream(spark, str(tmp_path / "in"), 1), 0.0, code=False)
    packer = PackStream(str(tmp_path / "out"), BLOCK, LANES)
    packer.run(stream_encode(cleaned, Vocabulary()), str(tmp_path / "cp"))
    assert stream_rows(packer, spark) == batch_form(spark, rows)


def test_packing_goes_on_after_a_restart(spark, tmp_path):
    rows = texts(40)

    def run():
        cleaned = stream_clean(corpus_stream(spark, str(tmp_path / "in"), 1), 0.0, code=False)
        packer = PackStream(str(tmp_path / "out"), BLOCK, LANES)
        packer.run(stream_encode(cleaned, Vocabulary()), str(tmp_path / "cp"))
        return packer

    arrive(spark, rows[:15], str(tmp_path / "in"))
    run()
    arrive(spark, rows[15:], str(tmp_path / "in"))
    packer = run()
    assert stream_rows(packer, spark) == batch_form(spark, rows)


def test_a_failed_micro_batch_is_repeated_once(spark, tmp_path):
    rows = texts(40)
    arrive(spark, rows[:15], str(tmp_path / "in"))
    arrive(spark, rows[15:], str(tmp_path / "in"))

    def stream():
        cleaned = stream_clean(corpus_stream(spark, str(tmp_path / "in"), 1), 0.0, code=False)
        return stream_encode(cleaned, Vocabulary())

    packer = PackStream(str(tmp_path / "out"), BLOCK, LANES)
    broken = stream().withColumn("doc_id", F.when(F.col("doc_id") >= 30, F.raise_error(F.lit("lost"))).otherwise(F.col("doc_id")))
    with pytest.raises(Exception, match="lost"):
        packer.run(broken, str(tmp_path / "cp"))
    assert 0 < len(stream_rows(packer, spark)) < len(batch_form(spark, rows))
    packer.run(stream(), str(tmp_path / "cp"))
    assert stream_rows(packer, spark) == batch_form(spark, rows)
    packer.run(stream(), str(tmp_path / "cp"))
    assert stream_rows(packer, spark) == batch_form(spark, rows)
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"blocks"}


def test_clean_stream_equals_batch(spark, tmp_path):
    rows = texts(30)
    arrive(spark, rows[:10], str(tmp_path / "in"))
    arrive(spark, rows[10:], str(tmp_path / "in"))
    stream = stream_clean(corpus_stream(spark, str(tmp_path / "in"), 1), 0.0, code=False)
    run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.doc_id: r.clean_text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    df = spark.createDataFrame(rows, "doc_id long, content string")
    clean = finish_text(sanitize_text(F.col("content")), F.col("doc_id"), 0.0)
    want = {r.doc_id: r.c for r in df.select("doc_id", clean.alias("c")).collect()}
    assert got == {k: c + " <|endoftext|>" for k, c in want.items() if c}


def test_code_stream_equals_batch(spark, sf_dir, tmp_path):
    corpus = code_corpus(spark, sf_dir)
    corpus.withColumnRenamed("content", "text").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = stream_clean(corpus_stream(spark, str(tmp_path / "in"), 1, partitions=2), 0.5, 9)
    run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.doc_id: r.clean_text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = with_eos(clean_corpus(corpus, 0.5, 9)).collect()
    assert got == {r.doc_id: r.clean_text for r in want}
