"""Physical plans: what must, and must not, be in them."""

import re

import pytest
from pyspark.sql import functions as F

from tokenloom.contract import queries as q
from tokenloom.operators.cleaning import clean_corpus, clean_prose, with_eos
from tokenloom.operators.ordering import take_docs
from tokenloom.operators.packing import doc_offsets, lanes, pack_blocks, tail_of
from tokenloom.operators.segments import segment_corpus, segment_counts
from tokenloom.session import shared_dir, stage_table
from tokenloom.sources.corpus import scan_corpus


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


NATIVE = [
    "scan_corpus",
    "take_docs",
    "skip_docs",
    "sanitize_text",
    "normalize_lines",
    "import_dropout",
    "append_eos",
    "segment_corpus",
    "segment_counts",
    "pair_counts",
    "best_pair",
    "unk_tokens",
]


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_run_no_python(spark, sf_dir, name):
    assert not re.search(r"MapInArrow|MapInPandas|ArrowEval|BatchEval", plan_of(q.QUERIES[name](spark, sf_dir)))


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_no_window_gathers_everything(spark, sf_dir, name):
    plan = plan_of(q.registered()[name](spark, sf_dir))
    windows = re.findall(r"windowspecdefinition\(([^)]*)", plan)
    assert all(not w.strip().startswith("specifiedwindowframe") for w in windows)
    for line in plan.splitlines():
        if re.search(r"\bWindow \[", line):
            # Window [functions], [partition keys], [order]
            assert re.search(r"\], \[[^\]]+\](, \[|$)", line.strip()), line
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan


def test_scan_reads_two_columns_and_takes_the_filter(spark, sf_dir):
    df = scan_corpus(spark, f"{sf_dir}/documents.parquet", language="en")
    plan = plan_of(df)
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan
    ids = plan_of(df.select("doc_id"))
    assert "text:string" not in ids


def test_taking_is_a_range_of_ids(spark, sf_dir):
    df = scan_corpus(spark, f"{sf_dir}/documents.parquet")
    plan = plan_of(take_docs(df, 50))
    assert "TakeOrderedAndProject" not in plan and "Window" not in plan
    assert "LessThanOrEqual(doc_id,49)" in plan


def test_nulls_are_dropped_before_python(spark, sf_dir):
    df = scan_corpus(spark, f"{sf_dir}/documents.parquet")
    plan = plan_of(clean_corpus(df)).splitlines()
    python = next(i for i, line in enumerate(plan) if "MapInArrow" in line)
    assert any("isnotnull" in line for line in plan[python:])


def test_texts_are_cleaned_once(spark, sf_dir):
    df = with_eos(clean_prose(scan_corpus(spark, f"{sf_dir}/documents.parquet"), 0.5))
    plan = plan_of(df)
    # Sanitising, line breaks, edges.
    assert plan.count("regexp_replace(") == 3


def test_counting_combines_before_the_shuffle(spark, sf_dir):
    plan = plan_of(segment_counts(segment_corpus(q.prose(spark, sf_dir))))
    assert "partial_count" in plan


def test_packing_moves_the_ids_once(spark, sf_dir):
    encoded = q.char_encoded(spark, sf_dir)
    blocks = pack_blocks(encoded, 64)
    for line in plan_of(blocks).splitlines():
        if re.search(r"\bWindow \[", line):
            assert "ids" not in line
    blocks.collect()
    final = plan_of(blocks).split("Initial Plan")[0]
    scans = [line for line in final.splitlines() if "FileScan" in line and "n_tokens:int" in line]
    assert scans and all("ids" not in line.split("ReadSchema")[1] for line in scans)


def test_windows_carry_no_ids(spark, sf_dir):
    """A window's input columns show in the sort below it."""
    plan = plan_of(pack_blocks(q.char_encoded(spark, sf_dir), 64)).splitlines()
    for i, line in enumerate(plan):
        if re.search(r"\bWindow \[", line):
            below = next(x for x in plan[i + 1 :] if "Project [" in x or "HashAggregate" in x or "FileScan" in x)
            assert not re.search(r"\bids#", below), below


def test_the_stream_tail_moves_no_ids_by_lane(spark, sf_dir):
    placed = stage_table(doc_offsets(lanes(q.char_encoded(spark, sf_dir), 3), ("lane",)), "placed")
    plan = plan_of(tail_of(placed, 64, ("lane",)))
    assert "BroadcastHashJoin [lane" in plan
    moved = [line for line in plan.splitlines() if re.search(r"Exchange hashpartitioning\(lane", line)]
    # Partial lists of the open blocks alone: at most one block for each task and lane.
    assert len(moved) <= 3


def test_staged_tables_live_in_the_shared_folder(spark):
    staged = stage_table(spark.range(3), "probe")
    assert all(shared_dir(spark).removeprefix("file:") in path for path in staged.inputFiles())
    assert staged.agg(F.sum("id")).first()[0] == 3


def test_shared_folder_is_required_off_local(spark, monkeypatch):
    class Remote:
        master = "spark://cluster:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Remote()

    with pytest.raises(ValueError):
        shared_dir(Session())
