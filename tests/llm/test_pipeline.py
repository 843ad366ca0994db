"""The pipeline against a plain-Python run of its stages, and awkward inputs for every stage."""

import zlib

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm import helpers
from tests.llm.test_copies import plain_components
from tests.llm.test_lines_and_windows import plain_hits
from tests.llm.test_mixing_and_tokens import encoded
from tokenloom.llm.contract import op1_mixing, op7_quality_rules
from tokenloom.session import scratch_path


def test_run_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    data = [tuple(r) for r in docs.orderBy("doc_id").collect()]
    kept = {r.doc_id for r in op7_quality_rules(spark, sf_dir).where("kept").collect()}
    data = [r for r in data if r[0] in kept]
    data = [r for r, (i, _, c) in zip(data, plain_components(data, 75), strict=True) if i == c]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    data = [r for r in data if not plain_hits(r[1], items, 10)[1]]
    path = scratch_path(spark, "left")
    spark.createDataFrame(data, docs.schema).write.parquet(f"{path}/documents.parquet")
    copies = {r.doc_id: r.taken // r["size"] for r in op1_mixing(spark, path).collect() if r["size"]}
    want, start = [], 0
    for r in data:
        ids = encoded(r[1])
        for _ in range(copies[r[0]]):
            want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    got = corpus_pipeline.run(spark, sf_dir).orderBy("start").collect()
    assert [tuple(r) for r in got] == want
    assert len(want) > 50


def test_stages_take_awkward_rows(spark, sf_dir, docs, empty):
    left = docs.withColumn("kept", F.lit(1)).withColumn("text_hash", F.lit(2)).withColumn("batch", F.lit(3))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, left, sf_dir)
        assert found.columns == left.columns, name
        found.count()
        assert stage(spark, empty, sf_dir).count() == 0, name
    name, last = corpus_pipeline.STAGES[-1]
    assert last(spark, left, sf_dir).count() == left.count()
    assert last(spark, empty, sf_dir).count() == 0
    assert {r[0] for r in helpers.rows()} == {r.doc_id for r in last(spark, left, sf_dir).collect()}


def test_stage_list():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID output",
    ]
    assert corpus_pipeline.ORACLE_SQL is None
