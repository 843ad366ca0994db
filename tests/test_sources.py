import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from test_plans import plan_of
from tokenizers import Tokenizer

from tokenloom.operators.ordering import with_doc_id
from tokenloom.operators.encoding import encode_corpus
from tokenloom.operators.segments import any_of, segment_corpus
from tokenloom.operators.training import train_bpe
from tokenloom.operators.vocabulary import Vocabulary, special_tokens
from tokenloom.plans.tokenizer_build import build_tokenizer
from tokenloom.plans.training_blocks import read_blocks, training_blocks, write_blocks
from tokenloom.sources.artefacts import (
    from_exchange,
    is_complete,
    load_tokenizer,
    read_clean_text,
    reuse_clean_corpus,
    save_tokenizer,
    to_exchange,
    write_clean_text,
)
from tokenloom.sources.corpus import read_source_files, scan_corpus
from tokenloom.sources.refresh import StaleCorpus, read_corpus, refresh_corpus


def test_language_folders_are_pruned(spark, tmp_path):
    rows = [(1, "a", "python"), (2, "b", "go"), (3, "c", "python")]
    df = spark.createDataFrame(rows, "doc_id long, content string, lang string")
    df.write.partitionBy("lang").parquet(str(tmp_path / "c"))
    python = scan_corpus(spark, str(tmp_path / "c"), language="python", text="content")
    assert sorted(r.content for r in python.collect()) == ["a", "c"]
    assert "PartitionFilters: [isnotnull(lang" in plan_of(python)


def test_many_splits_are_left_alone(spark, tmp_path, monkeypatch):
    spark.range(64).selectExpr("id AS doc_id", "'x' AS text").repartition(64).write.parquet(str(tmp_path / "c"))
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 1)
    assert "Exchange" not in plan_of(scan_corpus(spark, str(tmp_path / "c")))


def test_source_files_keep_their_text(spark, tmp_path):
    texts = {"a.py": "x = 1\r\ny = 2\n", "sub/b.py": "", "c.txt": "no"}
    for name, text in texts.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(text.encode())
    rows = {r.doc_id.rsplit("/", 1)[1]: r.content for r in read_source_files(spark, str(tmp_path)).collect()}
    assert rows == {"a.py": texts["a.py"], "b.py": ""}


def test_a_folder_feeds_the_packer(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"m{i:02d}.py").write_text(f"def f{i}(x):\n    return x + {i}\n" if i % 5 else "")
    files = with_doc_id(read_source_files(spark, str(tmp_path)).withColumnRenamed("doc_id", "path"), "path")
    order = [r.path[-6:] for r in files.orderBy("doc_id").collect()]
    assert order == [f"m{i:02d}.py" for i in range(30)]
    corpus = files.select("doc_id", "content")
    blocks = training_blocks(corpus, build_tokenizer(corpus, 30, 120), 16, 3, 10).collect()
    assert {r.split for r in blocks} == {"train", "val"}


def test_clean_text_keeps_order_and_empty_documents(spark, tmp_path):
    docs = [(3, "c1\nc2"), (1, "a"), (2, "")]
    df = spark.createDataFrame(docs, "doc_id long, clean_text string")
    write_clean_text(df, str(tmp_path / "t"))
    parts = sorted((tmp_path / "t").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "a\n\nc1\nc2\n"
    assert sorted(r.line for r in read_clean_text(spark, str(tmp_path / "t")).collect()) == ["", "a", "c1", "c2"]


def test_prepared_corpus_is_built_once(spark, tmp_path):
    path, calls = str(tmp_path / "p"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert not is_complete(spark, path)
    assert reuse_clean_corpus(spark, path, build).count() == 3
    assert reuse_clean_corpus(spark, path, build).count() == 3
    assert len(calls) == 1


def test_a_half_written_corpus_is_not_taken_over(spark, tmp_path):
    path = tmp_path / "p"
    spark.range(3).write.parquet(str(path))
    (path / "_SUCCESS").unlink()
    with pytest.raises(AnalysisException):
        reuse_clean_corpus(spark, str(path), lambda: spark.range(5))


def test_only_changed_texts_are_cleaned_again(spark, tmp_path):
    path, seen = str(tmp_path / "p"), []

    def table(rows):
        return spark.createDataFrame(rows, "doc_id string, content string")

    def clean(df):
        seen.append(sorted(r.doc_id for r in df.collect()))
        return df.select("doc_id", F.upper("content").alias("clean_text"))

    def rows(df):
        return sorted((r.doc_id, r.clean_text) for r in df.collect())

    with pytest.raises(StaleCorpus):
        read_corpus(spark, path)
    old = [("a", "x"), ("b", "y"), ("c", None), ("d", "")]
    assert rows(refresh_corpus(table(old), path, clean, {"seed": 1})) == sorted((i, t and t.upper()) for i, t in old)
    new = [("a", "x"), ("b", "other"), ("c", None), ("e", "z")]
    with pytest.raises(StaleCorpus):
        read_corpus(spark, path, table(new))
    for _ in range(2):
        assert rows(refresh_corpus(table(new), path, clean, {"seed": 1})) == [("a", "X"), ("b", "OTHER"), ("c", None), ("e", "Z")]
    assert seen == [["a", "b", "c", "d"], ["b", "e"]]
    assert rows(read_corpus(spark, path, table(new))) == [("a", "X"), ("b", "OTHER"), ("c", None), ("e", "Z")]
    with pytest.raises(StaleCorpus):
        refresh_corpus(table(new), path, clean, {"seed": 2})
    with pytest.raises(ValueError):
        refresh_corpus(table([("a", "x"), ("a", "y")]), path, clean, {"seed": 1})
    # Back to the first text: the row of the first refresh is not taken for the new one.
    assert rows(refresh_corpus(table(old[:2]), path, clean, {"seed": 1})) == [("a", "X"), ("b", "Y")]
    # A refresh that fails before its commit leaves the state as it was.
    with pytest.raises(RuntimeError):
        refresh_corpus(table(new), path, lambda df: (_ for _ in ()).throw(RuntimeError()), {"seed": 1})
    assert rows(read_corpus(spark, path, table(old[:2]))) == [("a", "X"), ("b", "Y")]
    assert rows(refresh_corpus(table([]), path, clean, {"seed": 1})) == []


def test_a_thousand_reserved_tokens(spark):
    names = [f"<extra_{i}>" for i in range(998)] + ["<extra_1", "{end}"]
    text = "a <extra_1><extra_17>b\n<extra_1 <extra_99x> <extra_9 {end}<SCOPE_IN>c<extra_997><extra_998>"
    vocab = train_bpe(spark.createDataFrame([("abab\n",)], "segment string"), 104)
    vocab = Vocabulary(vocab.tokens + tuple(names), vocab.merges, vocab.specials + tuple(names))
    df = spark.createDataFrame([(1, text)], "doc_id long, clean_text string")
    own = list(encode_corpus(df, vocab).first().ids)
    assert own == Tokenizer.from_str(to_exchange(vocab)).encode(text).ids
    assert own.count(vocab.id_of("<extra_1>")) == 1 and vocab.id_of("<extra_997>") in own
    assert len(any_of(names)) < 5 * len(names)


def test_tokenizer_round_trip(spark, tmp_path):
    vocab = train_bpe(spark.createDataFrame([("<a> <a> <a>",)], "segment string"), 108)
    save_tokenizer(vocab, spark, str(tmp_path / "t"))
    loaded = load_tokenizer(spark, str(tmp_path / "t"))
    assert loaded == vocab
    found = {r.token for r in special_tokens(loaded.vocab_table(spark)).collect()}
    assert {"<UNK>", "<SCOPE_IN>", "<SCOPE_OUT>", "<a>"} <= found
    with pytest.raises(AnalysisException):
        save_tokenizer(vocab, spark, str(tmp_path / "t"))


@pytest.mark.parametrize("mode", ["literal", "regex"])
def test_exchange_with_the_public_library(spark, mode):
    text = "<SCOPE_IN>for i in range(10):\n    print(i)\nfor j in range(10):\n<SCOPE_OUT> done"
    df = spark.createDataFrame([(1, text)], "doc_id long, clean_text string")
    vocab = train_bpe(segment_corpus(df, split_mode=mode), 118).with_special("<|endoftext|>")
    written = to_exchange(vocab, mode)
    library = Tokenizer.from_str(written)
    own = encode_corpus(df, vocab, split_mode=mode).first().ids
    assert list(own) == library.encode(text).ids and library.token_to_id("<|endoftext|>") == vocab.eos_id
    assert from_exchange(written) == vocab == from_exchange(library.to_str())
    with pytest.raises(ValueError):
        from_exchange(written.replace('"~": 102', '"~": 900'))


def test_both_plans_end_to_end(spark, tmp_path):
    source = "import os\n\ndef f{0}(x):\n    return x + {0}\n"
    rows = [(i, source.format(i)) for i in range(60)]
    corpus = spark.createDataFrame(rows, "doc_id long, content string")
    vocab = build_tokenizer(corpus, 40, 130, clean_path=str(tmp_path / "clean"))
    assert vocab == build_tokenizer(corpus, 40, 130, clean_path=str(tmp_path / "clean"))
    blocks = training_blocks(corpus, vocab, 16, 3, 10, encoded_path=str(tmp_path / "encoded"))
    write_blocks(blocks, str(tmp_path / "blocks"))
    back = read_blocks(spark, str(tmp_path / "blocks"))
    rows = back.collect()
    assert sorted(map(str, rows)) == sorted(map(str, blocks.select(back.columns).collect()))
    assert {r.split for r in rows} == {"train", "val"}
    assert all(len(r.x) == len(r.y) == 16 and r.x[1:] == r.y[:-1] for r in rows)
    assert all(r.batch_id == r.block_id // 3 for r in rows)
    tokens = spark.read.parquet(str(tmp_path / "encoded"))
    for side, low, high in (("val", 0, 10), ("train", 10, 60)):
        total = sum(r.n_tokens for r in tokens.where(f"doc_id >= {low} AND doc_id < {high}").collect())
        assert len([r for r in rows if r.split == side]) == total // 17


def test_source_files_by_glob_file_and_folder(spark, tmp_path):
    for name, text in {"a/x.py": "1\n", "a/empty.py": "", "b/a/x.py": "", "b/_h/y.py": "", "b/.z.py": "", "c.py": "3"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)

    def names(path):
        rows = read_source_files(spark, f"file://{tmp_path}/{path}").collect()
        return sorted((r.doc_id.split(tmp_path.name + "/")[1], r.content) for r in rows)

    everything = [("a/empty.py", ""), ("a/x.py", "1\n"), ("b/a/x.py", ""), ("c.py", "3")]
    assert names("") == everything
    assert names("[ab]") == everything[:3]
    assert names("a") == everything[:2]
    assert names("c.py") == everything[3:]
    assert names("a/*.py") == everything[:2]
