import random
import string

import numpy as np
import pytest
from textbook_bpe import priority_encode, serial_training
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers, trainers

from tokenloom.contract.code_corpus import code_corpus
from tokenloom.operators.cleaning import clean_corpus, clean_prose
from tokenloom.operators.encoding import decode_tokens, encode_corpus, token_pieces
from tokenloom.operators.merge_kernel import MergeTable, pair_keys, portions, replay, split_runs
from tokenloom.operators.segments import segment_corpus
from tokenloom.operators.training import plan_batch, train_bpe
from tokenloom.operators.vocabulary import ALPHABET, SPECIAL_TOKENS, Vocabulary
from tokenloom.sources.corpus import scan_corpus


def flat(seqs):
    lengths = np.array([len(s) for s in seqs])
    return np.array([i for s in seqs for i in s], dtype=np.int32), np.cumsum(lengths) - lengths


def unflat(tokens, lengths):
    return [part.tolist() for part in np.split(tokens, np.cumsum(lengths)[:-1])]


def random_words(rng):
    letters = rng.choice(["ab", "abc", "abcd\n", "a"])
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 12))]


def rounds_in_memory(words, vocab_size, size, tokens=None):
    """The training rounds over plain lists, with a frontier of `size` pairs."""
    tokens = list(tokens or SPECIAL_TOKENS + ALPHABET)
    ids = {t: i for i, t in enumerate(tokens)}
    bodies = [[ids[c] for c in w] for w in words]
    merges = []
    while len(tokens) < vocab_size:
        counts = {}
        for body in bodies:
            for p in zip(body, body[1:]):
                counts[p] = counts.get(p, 0) + 1
        ranked = sorted(((-n, *p) for p, n in counts.items()))[:size]
        if not ranked:
            break
        keys = np.sort(pair_keys(np.array([r[1] for r in ranked]), np.array([r[2] for r in ranked])))
        arr, starts = flat(bodies)
        runs, lengths, _ = split_runs(arr, starts, keys)
        pieces = [(r, 1) for r in unflat(runs, lengths)] if len(lengths) else []
        batch = plan_batch(pieces, ranked[-1], tokens, ids, vocab_size - len(tokens))
        assert batch
        merges += batch
        bodies = unflat(*replay(arr, starts, MergeTable(*zip(*batch)), revisit=False))
    return tokens, merges


@pytest.mark.parametrize("size", [1, 2, 5, 40])
def test_batched_rounds_equal_serial_training(size):
    rng = random.Random(size)
    for _ in range(60):
        words = random_words(rng)
        assert rounds_in_memory(words, 140, size) == serial_training(words, 140)


def test_batched_rounds_with_known_texts():
    """A merge onto an existing token ends a batch and keeps its id."""
    base = list(SPECIAL_TOKENS + ALPHABET) + ["ab", "bc", "abc", "aa"]
    rng = random.Random(5)
    for _ in range(60):
        words = random_words(rng)
        for size in (3, 30):
            assert rounds_in_memory(words, 130, size, base) == serial_training(words, 130, base)


def test_replay_equals_priority_encoding():
    rng = random.Random(3)
    for trial in range(150):
        base = list(SPECIAL_TOKENS + ALPHABET) + (["ab", "abc", "bab"] if trial % 2 else [])
        tokens, merges = serial_training(random_words(rng), len(base) + 12, base)
        if not merges:
            continue
        seqs = [[base.index(c) for c in w] for w in random_words(rng)]
        out = unflat(*replay(*flat(seqs), MergeTable(*zip(*merges)), revisit=True))
        last = {}
        for m in merges:
            last[m[:2]] = m
        kept = [m if last[m[:2]] is m else (-1, -1, -1) for m in merges]
        assert out == [priority_encode(s, kept) for s in seqs]


def library_tokenizer(path, vocab_size, mode):
    tokenizer = Tokenizer(models.BPE(unk_token="<UNK>"))
    pattern = r"(<SCOPE_IN>|<SCOPE_OUT>|\n)"
    tokenizer.pre_tokenizer = pre_tokenizers.Split(
        pattern if mode == "literal" else Regex(pattern), behavior="isolated"
    )
    trainer = trainers.BpeTrainer(
        vocab_size=vocab_size,
        special_tokens=list(SPECIAL_TOKENS),
        initial_alphabet=sorted(set(string.printable)),
        show_progress=False,
    )
    tokenizer.train([path], trainer)
    return tokenizer


def corpora(spark, sf_dir):
    bench = scan_corpus(spark, f"{sf_dir}/benchmark.parquet", doc_id="item_id")
    return {
        "benchmark": clean_prose(bench),
        "code": clean_corpus(code_corpus(spark, sf_dir), 0.5, 3).select("doc_id", "clean_text"),
    }


@pytest.mark.parametrize("mode", ["literal", "regex"])
@pytest.mark.parametrize("name", ["benchmark", "code"])
def test_same_vocabulary_and_ids_as_the_library(spark, sf_dir, tmp_path, name, mode):
    cleaned = corpora(spark, sf_dir)[name].persist()
    texts = {r.doc_id: r.clean_text for r in cleaned.collect()}
    path = tmp_path / "clean.txt"
    path.write_text("".join(texts[k] + "\n" for k in sorted(texts)))
    size = 350
    library = library_tokenizer(str(path), size, mode)
    vocab = train_bpe(segment_corpus(cleaned, split_mode=mode), size, run_budget=3000, checkpoint_every=2)
    assert vocab.rounds > 2
    assert vocab.ids() == library.get_vocab()

    marked = cleaned.withColumn("clean_text", F.concat("clean_text", F.lit(" <|endoftext|>é<UNK>\n\nx")))
    encoded = encode_corpus(marked, vocab, split_mode=mode)
    out = encoded.select(
        "doc_id",
        "ids",
        token_pieces(F.col("ids"), vocab).alias("pieces"),
        decode_tokens(F.col("ids"), vocab).alias("plain"),
        decode_tokens(F.col("ids"), vocab, skip_special=False).alias("full"),
    )
    for row in out.collect():
        want = library.encode(texts[row.doc_id] + " <|endoftext|>é<UNK>\n\nx")
        assert row.ids == want.ids
        assert row.pieces == want.tokens
        from tokenizers import decoders

        library.decoder = decoders.BPEDecoder()
        assert row.plain == library.decode(want.ids)
        assert row.full == library.decode(want.ids, skip_special_tokens=False)
    cleaned.unpersist()


def test_training_stops_when_no_pair_is_left(spark):
    df = spark.createDataFrame([("abab",), ("ab",), ("",)], "segment string")
    vocab = train_bpe(df, 500)
    assert vocab.tokens[103:] == ("ab", "abab")


def test_characters_outside_the_alphabet_join_it(spark):
    df = spark.createDataFrame([("éab",), ("éab",)], "segment string")
    vocab = train_bpe(df, 106)
    assert sorted(vocab.tokens[3:104]) == sorted(ALPHABET + ("é",))
    assert vocab.size == 106


def test_word_end_marks_decode_to_blanks(spark):
    tokens = Vocabulary().tokens + ("a</w>",)
    df = spark.createDataFrame([([103, 103, 103],)], "ids array<int>")
    assert df.select(decode_tokens(F.col("ids"), Vocabulary(tokens)).alias("t")).first().t == "a a a"


def test_added_special_token_encodes_as_one_id(spark):
    vocab = Vocabulary().with_special("<|endoftext|>")
    df = spark.createDataFrame([(1, "a <|endoftext|>")], "doc_id long, clean_text string")
    ids = encode_corpus(df, vocab).first().ids
    assert ids == [vocab.ids()["a"], vocab.ids()[" "], 103]


def test_null_and_empty_texts_encode_to_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "doc_id long, clean_text string")
    assert {r.doc_id: len(r.ids) for r in encode_corpus(df, Vocabulary()).collect()} == {1: 0, 2: 0, 3: 1}


def test_portions_cover_all_rows_in_order():
    lengths = np.array([3, 3, 3, 3, 25, 1, 10, 0, 4])
    assert list(portions(lengths, 10)) == [(0, 3), (3, 4), (4, 5), (5, 6), (6, 8), (8, 9)]
    assert list(portions(np.array([], dtype=int))) == []


def test_encoding_in_small_portions(spark, monkeypatch):
    rows = [(i, None if i % 7 == 0 else "ab\nabc" * (i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, clean_text string").coalesce(1)
    vocab = train_bpe(df.select(F.col("clean_text").alias("segment")).where("segment IS NOT NULL"), 106)
    want = {r.doc_id: r.ids for r in encode_corpus(df, vocab).collect()}
    monkeypatch.setattr("tokenloom.operators.encoding._BATCH_BYTES", 9)
    assert {r.doc_id: r.ids for r in encode_corpus(df, vocab).collect()} == want


def test_vocabulary_lookups():
    vocab = Vocabulary()
    assert (vocab.size, vocab.id_of("\n"), vocab.id_of("nope"), vocab.eos_id) == (103, 4, None, None)
    assert vocab.with_special("<|endoftext|>").eos_id == 103
