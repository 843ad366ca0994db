"""Mixing to target weights and the token store."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import helpers
from tokenloom.llm import mixing, token_store
from tokenloom.llm.contract import END_ID, VOCAB_SIZE, sized, tokenizer_path
from tokenloom.session import scratch_path


def sample(spark, n=400, seed=5):
    rng = random.Random(seed)
    data = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice(["a", "b", "b", "b", None, "c"])) for i in range(n)]
    return spark.createDataFrame(data, "doc_id long, text string, source string"), data


def test_targets_stop_at_the_cap():
    assert mixing.share_out([10, 100, 100], [5, 2, 1]) == [30.0, 120.0, 60.0]
    assert mixing.share_out([0, 0], [5, 2]) == [0.0, 0.0] and mixing.share_out([], []) == []
    sizes = [1, 2, 1000, 3]
    shares = mixing.share_out(sizes, [5, 2, 1, 5])
    assert math.isclose(sum(shares), 1006) and all(t <= 3 * s + 1e-9 for t, s in zip(shares, sizes, strict=True))


def test_sources_meet_their_targets(spark):
    docs, data = sample(spark)
    mixed, family, sizes = mixing.mix_sources(sized(docs, "doc_id", "source"), "source")
    assert family.keys == ["=a", "=b", "=c", "~"]
    got = mixed.collect()
    assert len(got) == len(data) and all(0 <= r.copies <= 3 for r in got)
    taken = collections.Counter()
    for r in got:
        taken["~" if r.source is None else "=" + r.source] += r.size * r.copies
    for key, target in zip(family.keys, family.targets, strict=True):
        assert abs(taken[key] - target) <= 0.01 * target
    again = {r.doc_id: r.copies for r in mixing.mix_sources(sized(docs.repartition(7), "doc_id", "source"), "source")[0].collect()}
    assert all(again[r.doc_id] == r.copies for r in got)
    assert mixing.expand_copies(mixed).count() == sum(r.copies for r in got)


def test_any_number_of_sources(spark):
    rng = random.Random(9)
    names = [None, *(f"site{i}.org" for i in range(5000))]
    data = [(i, rng.choice([0, 1, 5, 40, 300]), names[i % len(names)], rng.getrandbits(48)) for i in range(11_000)]
    docs = spark.createDataFrame(data, "doc_id long, size long, source string, h long")
    got = mixing.mix_groups(docs).collect()
    sizes = collections.Counter()
    for _, size, source, _ in data:
        sizes[source] += size
    order = [*sorted(names[1:]), None]
    shares = mixing.share_out([sizes[n] for n in order], mixing.cycled_weights(len(order)))
    want = dict(zip(order, shares, strict=True))
    assert len(got) == len(data) and all(r.group_size == sizes[r.source] for r in got)
    assert all(math.isclose(r.target, want[r.source], abs_tol=1e-6) for r in got)
    assert all(r.rate == pytest.approx(r.target / r.group_size if r.group_size else 0, rel=1e-9) and 0 <= r.copies <= 3 for r in got)


def test_one_table_or_the_dual_problem(spark):
    docs, _ = sample(spark)
    ready = sized(docs, "doc_id", "source")
    dual, family, sizes = mixing.mix_sources(ready, "source")
    table = mixing.mix_groups(ready, "source").collect()
    assert {r.doc_id: r.copies for r in dual.collect()} == {r.doc_id: r.copies for r in table}
    found = {("~" if r.source is None else "=" + r.source): (r.group_size, round(r.target, 6)) for r in table}
    assert found == {k: (n, round(t, 6)) for k, n, t in zip(family.keys, sizes, family.targets, strict=True)}
    assert mixing.mix_groups(ready.limit(0), "source").count() == 0


def test_newton_solves_two_families(spark):
    cells = [("a", "x", 100), ("a", "y", 300), ("b", "x", 200), ("b", "y", 50), ("c", "y", 70)]
    table = spark.createDataFrame(cells, "s string, l string, tokens long")
    wanted = [mixing.Family("s", ["=a", "=b", "=c"], [250.0, 370.0, 100.0]), mixing.Family("l", ["=x", "=y"], [400.0, 320.0])]
    duals = mixing.balance(table, wanted)
    by = {k: d for k, d in zip(["=a", "=b", "=c", "=x", "=y"], duals, strict=True)}
    taken = collections.Counter()
    for s, lang, n in cells:
        rate = min(3.0, math.exp(by["=" + s] + by["=" + lang]))
        taken["=" + s] += n * rate
        taken["=" + lang] += n * rate
    for family in wanted:
        for key, target in zip(family.keys, family.targets, strict=True):
            assert math.isclose(taken[key], target, rel_tol=1e-6)


def test_the_query_runs_newton_steps(spark, monkeypatch):
    steps = []
    taken_step = mixing._step
    monkeypatch.setattr(mixing, "_step", lambda *a: steps.append(1) or taken_step(*a))
    rows = [("a", 1000, 3000.0), ("b", 1000, 2900.0), ("c", 10**12, 5.0), ("d", 0, 0.0), ("e", 7, 0.0), ("f", 90, 90.0)]
    groups = spark.createDataFrame(rows, "_key0 string, tokens long, target double")
    for r in mixing.solve_duals(groups).collect():
        assert r.rate <= 3.0 and r.rate * r.tokens == pytest.approx(r.target, rel=1e-11)
    assert 20 < len(steps) < 60
    steps.clear()
    docs, _ = sample(spark)
    mixing.mix_groups(sized(docs, "doc_id", "source"), "source").count()
    assert 3 < len(steps) < 20
    assert mixing.solve_duals(groups.limit(0)).count() == 0


def test_two_families_of_many_groups(spark, monkeypatch):
    rng = random.Random(4)
    data = [(i, rng.randint(1, 60), f"s{i % 40}", rng.choice(["x", "y", None]), rng.getrandbits(48)) for i in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, size long, s string, l string, h long")
    by_s, by_l = collections.Counter(), collections.Counter()
    for _, size, s, lang, _ in data:
        # Targets that some mix meets: those of known tilts.
        rate = (0.3 + (int(s[1:]) % 5) / 4) * {"x": 0.5, "y": 1.5, None: 1.0}[lang]
        by_s["=" + s] += size * rate
        by_l["~" if lang is None else "=" + lang] += size * rate
    families = [mixing.Family("s", list(by_s), list(by_s.values())), mixing.Family("l", list(by_l), list(by_l.values()))]
    monkeypatch.setattr(mixing, "MAX_GROUPS", 10)
    got = mixing.mix_copies(docs, families).collect()
    assert len(got) == len(data) and all(0 <= r.copies <= 3 for r in got)
    for family, counts in zip(families, (by_s, by_l), strict=True):
        tilted, taken = collections.Counter(), collections.Counter()
        for r in got:
            value = r[family.column]
            key = "~" if value is None else "=" + value
            tilted[key] += r.size * r.rate
            taken[key] += r.size * r.copies
        assert all(tilted[k] == pytest.approx(n, rel=1e-4) for k, n in counts.items())
        assert all(abs(taken[k] - n) <= 0.15 * n + 60 for k, n in counts.items())


def test_zero_targets_and_joins(spark, monkeypatch):
    docs, _ = sample(spark)
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    ready = sized(docs, "doc_id", "source")
    sizes = dict(mixing.group_sizes(ready, "source"))
    family = mixing.Family("source", list(sizes), [0.0 if k == "=b" else float(n) for k, n in sizes.items()])
    got = mixing.mix_copies(ready, [family]).collect()
    assert all(r.copies == (0 if r.source == "b" else 1) for r in got if r.size)


def test_awkward_rows_mix(docs, empty):
    mixed, family, sizes = mixing.mix_sources(sized(docs, "doc_id", "source"), "source")
    assert mixed.count() == docs.count() and sum(sizes) > 0
    assert mixing.mix_sources(sized(empty, "doc_id", "source"), "source")[0].count() == 0


# --- tokens ------------------------------------------------------------------------------


def encoded(text):
    ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, END_ID], "<u4")


TOKENIZER = Tokenizer.from_file(tokenizer_path())


def test_round_trip(spark, docs):
    path = scratch_path(spark, "store")
    token_store.write_store(docs, path, tokenizer_path(), END_ID, VOCAB_SIZE)
    got = token_store.read_store(spark, path).orderBy("start").collect()
    want = sorted(
        ((r[0], encoded(r[1])) for r in helpers.rows()),
        key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32(x[1].tobytes()), len(x[1])),
    )
    start = 0
    for r, (doc_id, ids) in zip(got, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (doc_id, start, len(ids), ids.tobytes())
        start += len(ids)
    part = token_store.read_store(spark, path, first=10, last=40).collect()
    by_id = {r.doc_id: r.start for r in got}
    assert {r.doc_id for r in part} == {i for i in by_id if i is not None and 10 <= i <= 40}
    assert all(by_id[r.doc_id] == r.start for r in part if r.doc_id != 7)


def test_shards_share_one_dictionary(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_BYTES", 4000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch_path(spark, "store")
    codec = token_store.write_store(docs, path, tokenizer_path(), END_ID, VOCAB_SIZE)
    shards = spark.read.parquet(f"{path}/shards")
    assert len(codec.dictionary) > 1000 and {r.dict_hash for r in shards.select("dict_hash").collect()} == {codec.dict_hash}
    first = shards.orderBy("part", "seq").first()
    assert len(first.offsets) == first.n_docs + 1 and first.offsets[-1] == len(first.payload)
    alone = codec.reader()(bytes(first.payload[first.offsets[1] : first.offsets[2]]))
    text = docs.where(F.col("doc_id") == first.doc_ids[1]).first().text
    assert np.array_equal(alone, encoded(text))
    got = token_store.read_store(spark, path)
    assert got.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == got.agg(F.sum("n_tokens")).first()[0]
    broken = scratch_path(spark, "broken")
    spark.read.parquet(f"{path}/dictionary").withColumn("dict_hash", F.lit("0")).write.parquet(f"{broken}/dictionary")
    with pytest.raises(ValueError):
        token_store.load_codec(spark, broken)


def test_pieces_equal_whole_texts():
    encoder = token_store.PieceEncoder(tokenizer_path())
    encoder.units.most = 8000
    assert encoder.by_piece and encoder.by_run and encoder.mark is not None
    rng = random.Random(2)
    chars = "abcXYZ'stllve \n\t\r\x01\x0b12,.!<|>éÀ́ΣςİßЖ  \U0001f600中"
    texts = ["".join(rng.choices(chars, k=rng.randint(0, 60))) for _ in range(600)] + ["<|endoftext|> a<|startoftext|>b"]
    for at in range(0, len(texts), 50):
        some = texts[at : at + 50]
        assert encoder.encode(some) == [encoded(t)[:-1].tobytes() for t in some]
    # Part of a column, with nulls, blanks and texts without units at the edges; then pieces kept whole.
    some = ["x", None, "", " \n ", *texts[:40], "Été ÀB×C÷d 12Ab'S <|ENDOFTEXT|> İx", "", "\n"]
    want = [encoded(t)[:-1].tobytes() for t in some]
    assert encoder.encode(pa.array(some).slice(1)) == want[1:]
    assert encoder.encode([" ", None, "\n"]) == encoder.encode(pa.array(["", None, ""])) == [b""] * 3
    encoder.by_run = False
    encoder.units = token_store.Remembered()
    assert encoder.encode(some) == want


def test_empty_store(spark, empty):
    path = scratch_path(spark, "store")
    token_store.write_store(empty, path, tokenizer_path(), END_ID, VOCAB_SIZE)
    assert token_store.read_store(spark, path).count() == 0
