"""Line dedup and decontamination against brute force."""

import collections
import itertools
import random
import re
import string

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import helpers
from tokenloom.llm import common, decontamination as windows, line_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPACES = " \t\n\x0b\x0c\r"


def plain_lines(data, min_docs, keep):
    found = collections.defaultdict(list)
    distinct = sorted({(r[0], r[1]) for r in data}, key=lambda d: (d[0] is not None, d[0] or 0))
    for doc in distinct:
        for pos, line in enumerate((doc[1] or "").split("\n")):
            key = line.strip(SPACES).translate(LOWER)
            if key:
                found[key].append((doc, pos))
    gone = set()
    for places in found.values():
        if len({d for d, _ in places}) >= min_docs:
            gone |= set(places if keep == "none" else places[1:])
    out = []
    for r in data:
        lines = (r[1] or "").split("\n")
        kept = [x for i, x in enumerate(lines) if ((r[0], r[1]), i) not in gone]
        out.append((r[0], "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def ordered(found):
    return sorted(map(tuple, found), key=str)


@pytest.mark.parametrize(("min_docs", "keep", "share"), [(10, "none", 4096), (2, "none", 4096), (2, "none", 2), (10, "none", 1)])
def test_lines(monkeypatch, docs, min_docs, keep, share):
    monkeypatch.setattr(line_dedup, "HEAVY_SHARE", share)
    got = line_dedup.dedup_lines(docs, min_docs=min_docs, keep=keep)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert ordered(got.collect()) == ordered(plain_lines(helpers.rows(), min_docs, keep))


@pytest.mark.parametrize("share", [4096, 1, 30])
def test_first_occurrences_stay(monkeypatch, docs, share):
    monkeypatch.setattr(line_dedup, "HEAVY_SHARE", share)
    got = line_dedup.dedup_lines(docs.where("doc_id IS NOT NULL"), min_docs=2, keep="first")
    data = [r for r in helpers.rows() if r[0] is not None]
    assert ordered(got.collect()) == ordered(plain_lines(data, 2, "first"))


def test_bitmaps_are_sparse(docs):
    maps = line_dedup.line_keep_bitmaps(docs, 10)
    assert maps.columns == ["doc_id", "text_hash", "keep_words"]
    assert 0 < maps.count() <= 12
    with pytest.raises(ValueError):
        line_dedup.line_keep_bitmaps(docs, keep="last")


def test_long_documents_have_several_words(spark):
    text = "\n".join(["same" if i % 3 else f"line {i}" for i in range(400)])
    found = line_dedup.dedup_lines(helpers.frame(spark, [(1, text, *[None] * 7), (2, "same", *[None] * 7)]), 2)
    got = {r.doc_id: r for r in found.collect()}
    assert got[1].text == "\n".join(f"line {i}" for i in range(0, 400, 3)) and got[2].text == ""


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_hits(text, items, n):
    w, hit, met = words(text), set(), set()
    for item, body in items:
        b = words(body)
        size = min(n, len(b))
        grams = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)} if b else set()
        for i in range(len(w) - size + 1):
            if grams and tuple(w[i : i + size]) in grams:
                hit |= set(range(i + 1, i + size + 1))
                met.add(str(item))
    return len(w), sorted(hit), sorted(met)


def items():
    data = helpers.rows()
    first, other = data[0][1].split(), data[9][1].split()
    return [
        (1, " ".join(first[3:20])), (2, ", ".join(first[10:28]).upper()), (10, " ".join(other[:12])), (3, "one two"),
        (4, ""), (5, None), (6, "!!"), (7, " ".join(first[3:20])),
    ]


@pytest.mark.parametrize("max_inline", [50_000, 0])
def test_windows(spark, docs, max_inline):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    got = windows.contamination(docs, bench, 10, max_inline).collect()
    want = [(r[0], *plain_hits(r[1], items(), 10)) for r in helpers.rows()]
    assert ordered((r.doc_id, r.n_words, list(r.covered), list(r["items"])) for r in got) == ordered(want)
    assert sum(bool(w[2]) for w in want) >= 5


def test_spans_and_documents_go(spark, docs):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    kept = windows.decontaminate(docs, bench)
    dirty = {(r[0], r[1]) for r in helpers.rows() if plain_hits(r[1], items(), 10)[1]}
    assert kept.columns == docs.columns
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(r[0], r[1]) for r in helpers.rows()} - dirty
    cut = windows.decontaminate(docs, bench, mode="spans")
    assert cut.count() == docs.count()
    for r in cut.collect():
        assert (r.doc_id, r.text) in {(x[0], x[1]) for x in helpers.rows()} - dirty or r.text is not None
    one = {r.doc_id: r.text for r in cut.collect()}
    assert one[1].split() == [w for i, w in enumerate(helpers.rows()[0][1].split()) if not 3 <= i < 28]
    with pytest.raises(ValueError):
        windows.decontaminate(docs, bench, mode="words")


def test_empty_tables(spark, docs, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert line_dedup.dedup_lines(empty).count() == 0
    assert windows.contamination(empty, spark.createDataFrame(items(), "item_id long, text string")).count() == 0
    assert windows.contamination(docs, bench).where(F.size("covered") > 0).count() == 0
    assert windows.decontaminate(docs, bench).count() == docs.count()


def test_words_of_a_column():
    rng = random.Random(4)
    chars = "abCÉé \t\n\x0b\x0c\r\x1c\x85\u00a0中\0"
    texts = [None, "", " \n", *("".join(rng.choices(chars, k=rng.randint(0, 30))) for _ in range(300)), "", " "]
    for column in (pa.array(texts), pa.array(texts).slice(2), pa.array(texts, pa.large_string()), pa.array([None, " "]), pa.array([], pa.string())):
        words, places, bounds = common.words_of(column)
        assert len(set(words)) == len(words) and len(bounds) == len(column) + 1
        got = [[words[k] for k in places[a:b]] for a, b in itertools.pairwise(bounds)]
        assert got == [(t or "").encode().lower().split() for t in column.to_pylist()]
    batch = pa.record_batch({"text": pa.array(["x" * common.SLICE_BYTES, None, "a", "b" * common.SLICE_BYTES, "c"])})
    assert [s.num_rows for s in common.slices(batch)] == [1, 3, 1]
    assert not list(common.slices(batch.slice(0, 0)))
