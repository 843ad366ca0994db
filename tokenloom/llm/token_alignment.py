"""Cross-tokenizer alignment: the groups of ids in which two tokenizers cover the same bytes.

Each tokenizer's ids of a text are cut at cumulative byte ends. The ends of a document that both
have, found by intersecting the keys of two end-to-index dictionaries, in order, slice both id lists
into groups; of each group the tokens that end together are linked.

Of a linked pair one token's bytes are a suffix of the other's, so the vocabularies alone bound the
number of different pairs (`most_pairs`), however large the corpus. The corpus-wide counts are
therefore a small table: summed by Spark, then sent to all tasks.

Results for awkward input: a null or empty text, and one whose tokens do not spell it (such as a
text with U+2581, which tokenizer B can't tell from a space), has no tokens: zeros and no groups.
Every input row has its row in the result, whatever its id; other columns are left behind.
"""

from __future__ import annotations

import itertools
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tokenloom.llm.common import batch_of, kind_of, tidy
from tokenloom.session import ship_package

#: Pieces of text remembered by a worker, twice over at most, and the longest of them.
CACHED_PIECES = 150_000
CACHED_CHARS = 48
#: New pieces in one text; texts encoded and documents handled at once.
JOINED_PIECES = 100
ENCODE_TEXTS = 64
BATCH_DOCS = 64
#: Fixed value: the mark that stands for a space in the pieces of tokenizer B.
SPACE_MARK = "▁"
#: Before a single space between two characters that aren't white space.
CUT = re.compile(r"(?<=\S)(?= \S)")


def byte_alphabet() -> dict[str, int]:
    """The characters of byte-level vocabularies: printable Latin-1 as itself, other bytes from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Ids of both tokenizers for a text, cut into groups at common byte ends."""

    def __init__(self, byte_path: str, piece_path: str):
        # Spark's tasks are the parallelism; the libraries' own threads would only compete with them.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        alphabet = byte_alphabet()
        special = {i for i, token in self.a.get_added_tokens_decoder().items() if token.special}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = token.encode() if i in special else bytes(alphabet[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.n_b = len(pieces)
        self.a_length, self.b_length = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.decimal = list(map(str, range(max(len(self.a_bytes), self.n_b))))
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}
        # No token of either may reach over a cut; A's pattern is tried on a probe, B's pieces are looked through.
        crossing = any(re.search(rf"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces)
        probe = " A b\n\nc d's 12 3! x<|endoftext|> é中 it's\t q"
        whole = self._both([probe])[0]
        parts = self._both(CUT.split(probe))
        self.by_piece = not crossing and whole == tuple(list(itertools.chain.from_iterable(x)) for x in zip(*parts, strict=True))

    def _both(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of texts that begin with a space: A sees it, B adds it itself."""
        found = []
        for at in range(0, len(texts), ENCODE_TEXTS):
            some = texts[at : at + ENCODE_TEXTS]
            ours = self.a.encode_batch_fast(some, add_special_tokens=False)
            # One text at a time: a list would start a pool of threads.
            found += [(x.ids, self.b.encode(t[1:])) for x, t in zip(ours, some, strict=True)]
        return found

    def _groups(self, text: str, a: list[int], b: list[int], parts: list[int]) -> list[tuple[int, int, str, bytes]] | None:
        """(ids of A, ids of B, groups as text, linked pairs) of each part of a text; None if the tokens do not spell it.

        `parts` are the byte ends of the parts, which both tokenizers must have.
        """
        spelled = text.encode()
        if b"".join([self.a_bytes[i] for i in a]) != spelled or b"".join([self.b_bytes[i] for i in b]) != spelled:
            return None
        ends_a = dict(zip(itertools.accumulate([self.a_length[i] for i in a]), itertools.count(1)))
        ends_b = dict(zip(itertools.accumulate([self.b_length[i] for i in b]), itertools.count(1)))
        names_a, names_b = [self.decimal[i] for i in a], [self.decimal[i] for i in b]
        at_a = at_b = 0
        found, groups, links, before = [], [], array("Q"), (0, 0)
        part = iter(parts)
        part_end = next(part, None)
        for end in sorted(ends_a.keys() & ends_b.keys()):
            to_a, to_b = ends_a[end], ends_b[end]
            groups.append(",".join(names_a[at_a:to_a]) + "|" + ",".join(names_b[at_b:to_b]))
            links.append(a[to_a - 1] * self.n_b + b[to_b - 1])
            at_a, at_b = to_a, to_b
            if end == part_end:
                found.append((to_a - before[0], to_b - before[1], ";".join(groups), links.tobytes()))
                groups, links, before = [], array("Q"), (to_a, to_b)
                part_end = next(part, None)
        return found if len(found) == len(parts) else None

    def _learn(self, pieces: list[str]) -> None:
        """Put the groups of new pieces into `known`.

        Pieces with a single space before and none behind stand side by side in one text, which is cut
        between them again.
        """
        plain = [p for p in pieces if not (p[1:2].isspace() or p[-1].isspace())]
        texts = [plain[at : at + JOINED_PIECES] for at in range(0, len(plain), JOINED_PIECES)]
        alone = [p for p in pieces if p[1:2].isspace() or p[-1].isspace()]
        for some, joined in zip(texts, map("".join, texts), strict=True):
            ends = list(itertools.accumulate(len(p.encode()) for p in some))
            found = self._groups(joined, *self._both([joined])[0], ends)
            if found is None:
                alone += some
            else:
                self.known.update(zip(some, found, strict=True))
        for p in alone:
            self.known[p] = self._whole(p)

    def _whole(self, text: str) -> tuple[int, int, str, bytes] | None:
        found = self._groups(text, *self._both([text])[0], [len(text.encode())])
        return found and found[0]

    def align(self, texts: list[str | None]) -> list[tuple[int, int, str, bytes]]:
        """For each text what `_groups` has; zeros where it has nothing.

        Groups never reach over a cut, so each distinct piece between cuts is aligned once.
        """
        nothing = (0, 0, "", b"")
        spaced = [" " + t if t else None for t in texts]
        if not self.by_piece:
            return [(t and self._whole(t)) or nothing for t in spaced]
        cut = [CUT.split(t) if t else [] for t in spaced]
        distinct = set(itertools.chain.from_iterable(cut))
        if len(self.known) + len(distinct) > CACHED_PIECES:
            # What was asked for since the last change survives the next one.
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        missing = [p for p in distinct if p not in known]
        known.update((p, older[p]) for p in missing if p in older)
        new = [p for p in missing if p not in known]
        self._learn(new)
        found = []
        for text, pieces in zip(spaced, cut, strict=True):
            parts = [known[p] for p in pieces]
            if None in parts:
                found.append(self._whole(text) or nothing)
            elif not parts:
                found.append(nothing)
            else:
                n_a, n_b, groups, links = zip(*parts, strict=True)
                found.append((sum(n_a), sum(n_b), ";".join(groups), b"".join(links)))
        for p in new:
            if len(p) > CACHED_CHARS:
                del known[p]
        return found


@cache
def aligner_of(byte_path: str, piece_path: str) -> Aligner:
    """One for all tasks of a Python worker."""
    return Aligner(byte_path, piece_path)


def most_pairs(byte_path: str, piece_path: str) -> int:
    """How many pairs of the two vocabularies can end together: one is a suffix of the other."""
    aligner = aligner_of(byte_path, piece_path)
    n = 0
    for ours, theirs, first in (
        (aligner.a_bytes, aligner.b_bytes, 0),
        (aligner.b_bytes, aligner.a_bytes, 1),
    ):
        times: dict[bytes, int] = {}
        for token in theirs:
            times[token] = times.get(token, 0) + 1
        n += sum(times.get(token[at:], 0) for token in ours for at in range(first, len(token)))
    return n


def align_documents(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, pairs, times) of each row of `docs` (doc_id, text).

    A is a byte-level `tokenizers` file and sees a space before the text; B is a sentencepiece model
    that adds that space itself. `groups` is the alignment, `a1,a2|b1;a3|b2,b3` in decimal ids;
    `pairs` (distinct linked pairs, each A * size of B + B, little-endian unsigned 64-bit) and
    `times` (how often, little-endian unsigned 32-bit) are its links.
    """
    ship_package(docs.sparkSession)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(byte_path, piece_path)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_DOCS):
                batch = whole.slice(at, BATCH_DOCS)
                n_a, n_b, groups, links = zip(*aligner.align(batch["text"].to_pylist()), strict=True)
                counted = [np.unique(np.frombuffer(x, "<u8"), return_counts=True) for x in links]
                columns = {"doc_id": batch["doc_id"], "n_a": n_a, "n_b": n_b}
                columns |= {"n_groups": [len(x) // 8 for x in links], "groups": groups}
                columns |= {"pairs": [p.tobytes() for p, _ in counted], "times": [n.astype("<u4").tobytes() for _, n in counted]}
                kinds = dict.fromkeys(("n_a", "n_b", "n_groups"), pa.int64()) | dict.fromkeys(("pairs", "times"), pa.binary())
                yield batch_of(columns, groups=pa.string(), **kinds)

    schema = f"doc_id {kind_of(docs, 'doc_id')}, n_a long, n_b long, n_groups long, groups string, pairs binary, times binary"
    return docs.select("doc_id", "text").mapInArrow(tidy(align), schema)


def link_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): how many links of all documents hold the pair; best if no pair of its B id has more."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # As many entries as there are pairs, at most.
        pairs, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            seen = [np.frombuffer(x, "<u8") for x in batch["pairs"].to_pylist()]
            times = [np.frombuffer(x, "<u4") for x in batch["times"].to_pylist()]
            pairs, place = np.unique(np.concatenate([pairs, *seen]), return_inverse=True)
            weights, n = np.concatenate([n, *times]).astype(np.int64), np.zeros(len(pairs), np.int64)
            np.add.at(n, place, weights)
        yield batch_of({"pair": pairs.astype(np.int64), "n": n})

    counted = aligned.select("pairs", "times").mapInArrow(total, "pair long, n long")
    summed = counted.groupBy("pair").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.col("pair") % n_b))
    return summed.select("pair", "n", (F.col("n") == most).alias("best"))


def with_link_counts(aligned: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """`aligned` with n_links, n_best (links whose count is the highest of their B id) and count_sum (over links).

    `aligned` is read twice, so it should be a staged table.
    """
    spark, bound = aligned.sparkSession, most_pairs(byte_path, piece_path)
    rows = link_counts(aligned, aligner_of(byte_path, piece_path).n_b).toArrow().sort_by("pair")
    if rows.num_rows > bound:
        raise ValueError(f"{rows.num_rows} linked pairs, but the vocabularies allow {bound}")
    model = spark.sparkContext.broadcast(
        tuple(rows[c].to_numpy() for c in ("pair", "n")) + (rows["best"].to_numpy().astype(np.int64),)
    )
    names = [c for c in aligned.columns if c not in ("pairs", "times")]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = model.value
        for batch in batches:
            n_links, n_best, total = [], [], []
            for pairs, times in zip(batch["pairs"].to_pylist(), batch["times"].to_pylist(), strict=True):
                at = np.searchsorted(pair, np.frombuffer(pairs, "<u8").astype(np.int64))
                n = np.frombuffer(times, "<u4").astype(np.int64)
                n_links.append(int(n.sum()))
                n_best.append(int(n @ best[at]))
                total.append(int(n @ count[at]))
            columns = {c: batch[c] for c in names} | {"n_links": n_links, "n_best": n_best, "count_sum": total}
            yield batch_of(columns, n_links=pa.int64(), n_best=pa.int64(), count_sum=pa.int64())

    kinds = ", ".join(f"`{c}` {kind_of(aligned, c)}" for c in names)
    return aligned.mapInArrow(look_up, f"{kinds}, n_links long, n_best long, count_sum long")
