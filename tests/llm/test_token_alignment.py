"""Cross-tokenizer alignment against a version without dictionaries, pieces or Spark."""

import collections
import hashlib
import json

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import helpers
from tokenloom.llm import token_alignment as ta
from tokenloom.llm.contract import QUERIES, tokenizer_path

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def plain(texts):
    """[(ids of A, ids of B, groups, links)] by walking both token lists byte by byte."""
    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    spell = {t: i for i, t in json.load(open(PATHS[0]))["model"]["vocab"].items()}
    alphabet = ta.byte_alphabet()
    found = []
    for text in texts:
        if not text:
            found.append(([], [], [], []))
            continue
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        ours = [bytes(alphabet[c] for c in spell[i]) for i in a]
        theirs = []
        for i in b:
            piece = second.id_to_piece(i)
            theirs.append(bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode())
        if b"".join(ours) != (" " + text).encode() or b"".join(theirs) != (" " + text).encode():
            found.append(([], [], [], []))
            continue
        groups, links, x, y, left, right = [], [], 0, 0, [], []
        i = j = 0
        while i < len(a) or j < len(b):
            if x <= y:
                left.append(a[i])
                x += len(ours[i])
                i += 1
            else:
                right.append(b[j])
                y += len(theirs[j])
                j += 1
            if x == y:
                groups.append((left, right))
                links.append((left[-1], right[-1]))
                left, right = [], []
        found.append((a, b, groups, links))
    return found


AWKWARD = [
    "plain words, and more words",
    "  leading and  double   spaces ",
    "tabs\tand\nlines \n\n end\n",
    "it's we'll 123 4567 !!! <|endoftext|> <s> </s> <unk> <0x41>",
    "café 中文字 \U0001f600 жу ​ 　 x",
    "mark ▁ inside",
    "nul \x00 and \x1c \x1d \x85 controls",
    "a" * 3000,
    " ",
    "\n",
]


def test_pieces_give_what_whole_texts_give():
    aligner = ta.aligner_of(*PATHS)
    assert aligner.by_piece
    got = aligner.align([*AWKWARD, None, ""])
    for text, (n_a, n_b, groups, links) in zip([*AWKWARD, None, ""], got, strict=True):
        whole = (aligner._whole(" " + text) if text else None) or (0, 0, "", b"")
        assert (n_a, n_b, groups, links) == whole, text
    assert got[AWKWARD.index("mark ▁ inside")] == (0, 0, "", b"")


def test_no_more_pairs_than_the_vocabularies_allow():
    aligner, bound = ta.aligner_of(*PATHS), ta.most_pairs(*PATHS)
    assert 0 < bound < 1_000_000
    assert all(len(x) > 0 for x in aligner.b_bytes)


def check(spark, df, data):
    """`data`: (doc_id, text) of every row."""
    expected = plain([t for _, t in data])
    count = collections.Counter(link for _, _, _, links in expected for link in links)
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    want = []
    for (doc_id, _), (a, b, groups, links) in zip(data, expected, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        best = sum(count[p] == most[p[1]] for p in links)
        want.append((doc_id, len(a), len(b), len(groups), len(links), best, sum(count[p] for p in links), digest))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def run(spark, df):
    staged = ta.align_documents(df, *PATHS).withColumn(
        "groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    )
    return ta.with_link_counts(staged, *PATHS)


@pytest.mark.parametrize("parts", [1, 5])
def test_awkward_rows_against_brute_force(spark, parts):
    data = [(r[0], r[1]) for r in helpers.rows()] + [(1000 + i, t) for i, t in enumerate(AWKWARD)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in data], "doc_id long, text string, n_a string, pair int")
    check(spark, run(spark, df.repartition(parts)), data)


def test_empty_table(spark, empty):
    assert run(spark, empty).collect() == []


def test_query_against_brute_force(spark, sf_dir):
    data = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, QUERIES["op11_token_alignment"](spark, sf_dir), data)
