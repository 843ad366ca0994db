"""Suffix-array dedup: bytes covered by a string that starts in an earlier document too.

Sorting all suffixes of a corpus in one order moves every position several times. Two substrings of
`span` bytes can only be equal if they contain the same minimiser (the least hash of their k-byte
substrings), so suffixes are dealt out by it: neighbouring starts with one minimiser travel as one
fragment of text, and equal strings meet in one bucket.

1. Batches of documents send their minimisers; those of one document only are done with.
2. The fragments of shared minimisers go to their buckets. Equal fragments in a batch go once: the
   later documents' copies are known to be repeats, so a group of copies never fills a bucket.
3. A bucket sorts its suffixes to the depth of `span`, eight bytes at a time. Suffixes that differ from
   all others so far, or meet only those of their own document, need no further bytes.
4. Starts of a hot minimiser (a phrase that many documents surround with their own text) would fill
   one bucket. They go by the digest of their `span` bytes instead: a batch sends each digest once
   with its smallest id, so no bucket grows with the number of documents that share a string.
5. The repeats found go back to their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tokenloom.llm.batches import (
    ask,
    batch_texts,
    bucket_slices,
    from_low_bytes,
    low_bytes,
    mixed,
    packed,
    unpacked,
    with_answers,
)
from tokenloom.llm.common import batch_of
from tokenloom.session import ship_package

#: Bytes of a hashed substring; a span of 50 has 31 of them.
GRAM = 20
#: Bytes of a key on the way; the bucket is the rest of it. A false match costs time only.
KEY_BYTES = 5
#: Text per bucket, as if all of it were shared.
BUCKET_BYTES = 2 << 20
#: Fragments of a minimiser above so many bytes are hot.
HOT_BYTES = BUCKET_BYTES // 4
#: A batch names the bytes of a minimiser's fragments only above this; below, they count as this many.
NAMED_BYTES = 256
DIGEST_BYTES = 16
#: Buckets of digests begin here; the places of a batch's digests pass below the negative.
HOT_BUCKET = 1 << 62
#: Null ids come before all others.
NO_ID = np.iinfo(np.int64).min


# --- suffix arrays -----------------------------------------------------------------------


def _names(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks of the pairs, from 1; equal pairs share one."""
    _, name = np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)
    return name.astype(np.int64) + 1


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of `s` (integers from 1, below 2^31) in sorted order."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    # One more position at the end completes the last triple class; it sorts first and is dropped.
    extra = int(n % 3 == 1)
    padded = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    at = np.concatenate([np.arange(1, n + extra, 3), np.arange(2, n + extra, 3)])
    name = _names(_names(padded[at], padded[at + 1]), padded[at + 2])
    if name.max() < len(at):
        order = suffix_array(name)
        name = np.empty(len(at), np.int64)
        name[order] = np.arange(1, len(at) + 1)
    else:
        order = np.argsort(name)
    rank = np.zeros(n + 5, np.int64)
    rank[at] = name
    top = len(at) + 1
    sampled = at[order]
    zero = np.arange(0, n, 3)
    zero_key = padded[zero] * top + rank[zero + 1]
    by_key = np.argsort(zero_key)
    zero, zero_key = zero[by_key], zero_key[by_key]
    one, two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    below = np.searchsorted(padded[one] * top + rank[one + 1], zero_key)
    pair = _names(
        np.concatenate([padded[zero], padded[two]]), np.concatenate([padded[zero + 1], padded[two + 1]])
    )
    below += np.searchsorted(pair[len(zero) :] * top + rank[two + 2], pair[: len(zero)] * top + rank[zero + 2])
    result = np.empty(len(zero) + len(sampled), np.int64)
    place = np.arange(len(zero)) + below
    free = np.ones(len(result), bool)
    free[place] = False
    result[place], result[free] = zero, sampled
    return result[result < n]


def equal_prefixes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, span: int) -> np.ndarray:
    """Whether the `span` bytes from a[i] and from b[i] are equal, for each i."""
    wide = np.zeros(len(raw) + 8, np.uint64)
    wide[: len(raw)] = raw
    word = wide[: len(raw)].copy()
    for i in range(1, 8):
        word |= wide[i : i + len(raw)] << np.uint64(8 * i)
    same = np.ones(len(a), bool)
    for offset in [*range(0, span - 7, 8), span - 8] if span >= 8 else []:
        same &= word[a + offset] == word[b + offset]
    for offset in range(span if span < 8 else 0):
        same &= raw[a + offset] == raw[b + offset]
    return same


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number that sorts as they do; past the end they are 0."""
    wide = np.zeros(len(raw) + 8, np.uint64)
    wide[: len(raw)] = raw
    word = np.zeros(len(raw), np.uint64)
    for i in range(8):
        word |= wide[i : i + len(raw)] << np.uint64(8 * (7 - i))
    return word


def later_starts(raw: np.ndarray, starts: np.ndarray, docs: np.ndarray, span: int) -> np.ndarray:
    """For each start: whether its `span` bytes also start in a document with a smaller id.

    The suffixes are sorted to the depth of `span`, eight bytes at a time. A suffix goes on to the next
    eight only beside others with the same bytes so far, in documents of different ids.
    """
    word, later = _words(raw), np.zeros(len(starts), bool)
    some, group, least = np.arange(len(starts)), np.zeros(len(starts), np.int64), docs[:0]
    unused = np.uint64(8 * max(0, 8 - span))
    for offset in sorted({*range(0, span - 7, 8), max(0, span - 8)}):
        if not len(some):
            break
        key = word[starts[some] + offset] >> unused
        order = np.argsort(key)
        new = np.diff(key[order], prepend=~key[order[:1]]) != 0
        if offset:
            rank = np.empty(len(some), np.int64)
            rank[order] = np.cumsum(new)
            key = group << 32 | rank
            order = np.argsort(key)
            new = np.diff(key[order], prepend=-1) != 0
        some, first = some[order], np.flatnonzero(new)
        owner, size = docs[some], np.diff(np.append(first, len(order)))
        least = np.minimum.reduceat(owner, first)
        several = least < np.maximum.reduceat(owner, first)
        some, least = some[np.repeat(several, size)], least[several]
        group = np.repeat(np.arange(len(least)), size[several])
    later[some] = docs[some] > least[group]
    return later


# --- fragments ---------------------------------------------------------------------------


def _gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from each position on."""
    base, found, width = np.uint64(0x100000001B3), None, 0
    part, have = raw.astype(np.uint64) + np.uint64(1), 1
    bit = 1
    while bit <= size:
        if size & bit:
            if found is None:
                found, width = part, have
            else:
                n = len(raw) - width - have + 1
                found = found[:n] * np.uint64(pow(int(base), have, 1 << 64)) + part[width : width + n]
                width += have
        bit <<= 1
        if bit <= size:
            n = len(part) - have
            part = part[:n] * np.uint64(pow(int(base), have, 1 << 64)) + part[have : have + n]
            have *= 2
    return mixed(found)


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def fragments(raw: np.ndarray, lengths: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, starts covered, key) of the runs of `span`-byte starts with one minimiser.

    Starts are positions in `raw`, the documents' bytes one after another.
    """
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if len(raw) < span:
        return none
    gram = min(GRAM, span)
    least = _window_min(_gram_hashes(raw, gram), span - gram + 1)
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)[: len(least)]
    inside = np.arange(len(least)) + span <= ends[doc]
    at = np.flatnonzero(inside)
    if not len(at):
        return none
    least, doc = least[at], doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], at[first], np.diff(np.append(first, len(at))), mixed(least[first])


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(unpacked(row["texts"]), np.uint8)
    ids = np.array([NO_ID if i is None else i for i in row["doc_ids"]], np.int64)
    return raw, np.array(row["lengths"], np.int64), ids


def _shared_keys(keys: np.ndarray, answers, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys whose bucket answered that another document has them, and the hot ones of these."""
    distinct = np.unique(keys)
    order, _, slices = bucket_slices(distinct, n_buckets)
    shared, hot = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
    by_bucket = {a["bucket"]: a["answer"] for a in answers or ()}
    for bucket, low, high in slices:
        answer, n = by_bucket[bucket], high - low
        bits = np.frombuffer(answer, np.uint8, (n + 7) // 8)
        shared[order[low:high]] = np.unpackbits(bits, count=n).astype(bool)
        hot[order[low:high][np.frombuffer(answer, "<i4", offset=(n + 7) // 8)]] = True
    return distinct[shared], distinct[hot]


def _distinct_bytes(raw: np.ndarray, start: np.ndarray, covered: np.ndarray, place: np.ndarray, span: int) -> np.ndarray:
    """About the bytes of different fragments for each place: equal ends and lengths count once."""
    windows = _gram_hashes(raw, span)
    ends = mixed(windows[start]) + windows[start + covered - 1] + covered.astype(np.uint64)
    order = np.lexsort((ends, place))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(place[order]) != 0) | (ends[order][1:] != ends[order][:-1])
    one = order[new]
    return np.bincount(place[one], covered[one] + span - 1).astype(np.int64)


def _send_keys(span: int, n_buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw, lengths, ids = _open(row)
                doc, start, covered, key = fragments(raw, lengths, span)
                distinct, place = np.unique(key, return_inverse=True)
                size = _distinct_bytes(raw, start, covered, place, span) if len(key) else place
                owner = ids[doc]
                low, high = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), NO_ID)
                np.minimum.at(low, place, owner)
                np.maximum.at(high, place, owner)
                several = low < high
                order, rest, slices = bucket_slices(distinct, n_buckets)
                several, size = several[order], size[order]
                messages = [
                    np.int64(b - a).tobytes()
                    + low_bytes(rest[a:b], KEY_BYTES)
                    + np.packbits(several[a:b]).tobytes()
                    + _named_sizes(size[a:b])
                    for _, a, b in slices
                ]
                # A key seen once in two batches may be of one document id; that costs time, not results.
                yield batch_of(
                    {"batch": [row["batch"]] * len(slices), "bucket": [s[0] for s in slices], "message": messages},
                    batch=pa.int64(), bucket=pa.int64(), message=pa.binary(),
                )

    return send


def _named_sizes(size: np.ndarray) -> bytes:
    """(place, bytes) of the places with more than `NAMED_BYTES`."""
    at = np.flatnonzero(size > NAMED_BYTES)
    return np.stack([at, size[at]], 1).astype("<i8").tobytes()


def _answer_keys(hot_bytes: int):
    """Bits of the shared keys, then the places of the hot ones."""

    def answer(table: pa.Table) -> pa.Table:
        values, several, bytes_of, sizes = [], [], [], []
        for message in table["message"].to_pylist():
            n = int(np.frombuffer(message[:8], np.int64)[0])
            flags = 8 + KEY_BYTES * n
            named = flags + (n + 7) // 8
            values.append(from_low_bytes(message[8:flags], KEY_BYTES))
            several.append(np.unpackbits(np.frombuffer(message[flags:named], np.uint8), count=n))
            size, found = np.full(n, NAMED_BYTES), np.frombuffer(message[named:], "<i8").reshape(-1, 2)
            size[found[:, 0]] = found[:, 1]
            bytes_of.append(size)
            sizes.append(n)
        _, place = np.unique(np.concatenate(values), return_inverse=True)
        weight = np.bincount(place, 1 + np.concatenate(several).astype(float))
        total = np.bincount(place, np.concatenate(bytes_of).astype(float))
        edges = np.cumsum(sizes)[:-1]
        shared, hot = weight[place] >= 2, (weight[place] >= 2) & (total[place] > hot_bytes)
        answers = [
            np.packbits(x).tobytes() + np.flatnonzero(y).astype("<i4").tobytes()
            for x, y in zip(np.split(shared, edges), np.split(hot, edges), strict=True)
        ]
        return pa.table({"batch": table["batch"], "bucket": table["bucket"], "answer": pa.array(answers, pa.binary())})

    return answer


def _triples(*columns: np.ndarray) -> bytes:
    return np.stack([np.asarray(c, np.int64) for c in columns], 1).astype("<i8").tobytes()


def _copies(pieces: Iterator[bytes], owners: list[int]) -> list[bool]:
    """For pieces in the order of their documents: whether an earlier document has the same piece."""
    first: dict[bytes, int] = {}
    return [first.setdefault(p, owner) < owner for p, owner in zip(pieces, owners, strict=True)]


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, starts) of the runs of single starts."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(start) != 1)
    first = np.flatnonzero(new)
    return doc[first], start[first], np.diff(np.append(first, len(doc)))


def _single_starts(start: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fragment, start) of each start that the fragments cover."""
    fragment = np.repeat(np.arange(len(start)), covered)
    inside = np.arange(len(fragment)) - np.repeat(np.cumsum(covered) - covered, covered)
    return fragment, start[fragment] + inside


def _digests(whole: bytes, at: np.ndarray, span: int) -> tuple[np.ndarray, list[bytes]]:
    """(number of each start's string, digests of the strings by number)."""
    seen: dict[bytes, int] = {}
    found = (xxhash.xxh3_128_digest(whole[i : i + span]) for i in at.tolist())
    place = np.fromiter((seen.setdefault(d, len(seen)) for d in found), np.int64, len(at))
    return place, list(seen)


def _digest_messages(digests: list[bytes], owner: np.ndarray, n_buckets: int) -> tuple[list[tuple[int, bytes]], np.ndarray, np.ndarray]:
    """(messages, bucket and place in its message of each digest)."""
    if not digests:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    bucket = (wide[:, 0] % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    place, messages = np.zeros(len(order), np.int64), []
    for a, b in zip(edges, edges[1:], strict=False):
        some = order[a:b]
        place[some] = np.arange(b - a)
        text = wide[some].tobytes() + owner[some].astype("<i8").tobytes()
        messages.append((HOT_BUCKET + int(bucket[some[0]]), packed(text)))
    return messages, bucket, place


def _answer_digests(table: pa.Table) -> pa.Table:
    """For each digest of each batch: whether another batch has it with a smaller id."""
    digests, owners = [], []
    for message in table["message"].to_pylist():
        raw = unpacked(message)
        n = len(raw) // (DIGEST_BYTES + 8)
        digests.append(np.frombuffer(raw[: DIGEST_BYTES * n], "<u8").reshape(-1, 2))
        owners.append(np.frombuffer(raw[DIGEST_BYTES * n :], "<i8"))
    sizes, digest, owner = [len(o) for o in owners], np.concatenate(digests), np.concatenate(owners)
    order = np.lexsort((owner, digest[:, 1], digest[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(digest[order].view(np.int64), axis=0) != 0).any(1)
    later = np.zeros(len(order), bool)
    later[order] = owner[order] > owner[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    answers = [np.packbits(x).tobytes() for x in np.split(later, np.cumsum(sizes)[:-1])]
    return pa.table({"batch": table["batch"], "bucket": table["bucket"], "answer": pa.array(answers, pa.binary())})


def _message(owner: np.ndarray, doc: np.ndarray, start: np.ndarray, covered: np.ndarray, text: bytes) -> bytes:
    """Fragments column by column, which compresses better than row by row."""
    columns = (owner.astype("<i8"), doc.astype("<i4"), start.astype("<i4"), covered.astype("<i4"))
    return packed(b"".join([np.int64(len(owner)).tobytes(), *(c.tobytes() for c in columns), text]))


def _read_message(message: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = unpacked(message)
    n, at, columns = int(np.frombuffer(raw[:8], np.int64)[0]), 8, []
    for kind in ("<i8", "<i4", "<i4", "<i4"):
        size = n * np.dtype(kind).itemsize
        columns.append(np.frombuffer(raw[at : at + size], kind).astype(np.int64))
        at += size
    return columns, raw[at:]


def _send_fragments(span: int, key_buckets: int, n_buckets: int):
    """Fragments of shared keys to their buckets, digests of hot ones to theirs.

    To buckets of the batch's own: the repeats known already, and the places of the digests sent.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw, lengths, ids = _open(row)
                doc, start, covered, key = fragments(raw, lengths, span)
                shared, hot = _shared_keys(key, row["answers"], key_buckets)
                chosen = np.flatnonzero(np.isin(key, shared))
                chosen = chosen[np.argsort(ids[doc[chosen]], kind="stable")]
                is_hot = np.isin(key[chosen], hot)
                crowded, chosen = chosen[is_hot], chosen[~is_hot]
                whole, end = raw.tobytes(), start + covered + span - 1
                pieces = (whole[start[i] : end[i]] for i in chosen.tolist())
                known = np.array(_copies(pieces, ids[doc[chosen]].tolist()), bool)
                gone, sent = chosen[known], chosen[~known]
                first = np.cumsum(lengths) - lengths
                fragment, at = _single_starts(start[crowded], covered[crowded])
                number, digests = _digests(whole, at, span)
                at_doc = doc[crowded][fragment]
                # Starts are in the order of their ids: the first of a string has its smallest.
                least = ids[at_doc][np.unique(number, return_index=True)[1]]
                inside, later = at - first[at_doc], ids[at_doc] > least[number]
                known_runs = _triples(*_runs(at_doc[later], inside[later]))
                repeats = _triples(doc[gone], start[gone] - first[doc[gone]], covered[gone]) + known_runs
                rows, to, place = _digest_messages(digests, least, n_buckets)
                if len(digests):
                    open_ = ~later
                    where = (at_doc[open_], inside[open_], to[number[open_]], place[number[open_]])
                    rows.append((-HOT_BUCKET - row["batch"], packed(_triples(*where))))
                rows.append((-1 - row["batch"], repeats))
                bucket = (key[sent] % np.uint64(n_buckets)).astype(np.int64)
                by_bucket = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(bucket[by_bucket], prepend=-1, append=-1))
                for a, b in zip(edges, edges[1:], strict=False):
                    some = sent[by_bucket[a:b]]
                    text = b"".join(whole[start[i] : end[i]] for i in some.tolist())
                    inside = start[some] - first[doc[some]]
                    message = _message(ids[doc[some]], doc[some], inside, covered[some], text)
                    rows.append((int(bucket[by_bucket[a]]), message))
                yield batch_of(
                    {"batch": [row["batch"]] * len(rows), "bucket": [r[0] for r in rows], "message": [r[1] for r in rows]},
                    batch=pa.int64(), bucket=pa.int64(), message=pa.binary(),
                )

    return send


def _answer_fragments(span: int):
    def answer(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            return table.rename_columns(["batch", "bucket", "answer"])
        if table["bucket"][0].as_py() >= HOT_BUCKET:
            return _answer_digests(table)
        heads, texts = zip(*map(_read_message, table["message"].to_pylist()), strict=True)
        owner, doc, start, covered = (np.concatenate(c) for c in zip(*heads, strict=True))
        sender = np.repeat(np.arange(len(heads)), [len(h[0]) for h in heads])
        text = b"".join(texts)
        size = covered + span - 1
        first = np.cumsum(size) - size
        # Copies of a whole fragment are known without sorting; one of each goes on.
        order = np.argsort(owner, kind="stable")
        pieces = (text[first[i] : first[i] + size[i]] for i in order.tolist())
        copy = np.zeros(len(owner), bool)
        copy[order] = _copies(pieces, owner[order].tolist())
        kept = np.flatnonzero(~copy)
        raw = np.frombuffer(b"".join(text[first[i] : first[i] + size[i]] for i in kept.tolist()), np.uint8)
        at = np.cumsum(size[kept]) - size[kept]
        fragment = np.repeat(np.arange(len(kept)), covered[kept])
        inside = np.arange(len(fragment)) - np.repeat(np.cumsum(covered[kept]) - covered[kept], covered[kept])
        later = np.flatnonzero(later_starts(raw, at[fragment] + inside, owner[kept][fragment], span))
        # Runs of repeated starts inside one fragment.
        new = np.ones(len(later), bool)
        new[1:] = (np.diff(later) > 1) | (np.diff(fragment[later]) > 0)
        run = np.flatnonzero(new)
        begin = later[run]
        own = kept[fragment[begin]]
        gone = np.flatnonzero(copy)
        whose = np.concatenate([own, gone])
        begins = np.concatenate([start[own] + inside[begin], start[gone]])
        lengths = np.concatenate([np.diff(np.append(run, len(later))), covered[gone]])
        found = np.stack([doc[whose], begins, lengths], 1).astype("<i8")
        by_sender = np.argsort(sender[whose], kind="stable")
        parts = np.split(found[by_sender], np.cumsum(np.bincount(sender[whose], minlength=len(heads)))[:-1])
        answers = pa.array([p.tobytes() for p in parts], pa.binary())
        return pa.table({"batch": table["batch"], "bucket": table["bucket"], "answer": answers})

    return answer


def _found(answers) -> np.ndarray:
    """(document, start, starts) of the repeats that a batch was told of."""
    runs, later, places = [], {}, []
    for a in answers or ():
        if a["bucket"] >= HOT_BUCKET:
            later[a["bucket"] - HOT_BUCKET] = np.unpackbits(np.frombuffer(a["answer"], np.uint8))
        elif a["bucket"] <= -HOT_BUCKET:
            places.append(np.frombuffer(unpacked(a["answer"]), "<i8").reshape(-1, 4))
        else:
            runs.append(np.frombuffer(a["answer"], "<i8").reshape(-1, 3))
    for rows in places:
        rows = rows[np.argsort(rows[:, 2], kind="stable")]
        edges = np.flatnonzero(np.diff(rows[:, 2], prepend=-1, append=-1))
        bits = [later[int(rows[a, 2])][rows[a:b, 3]] for a, b in zip(edges, edges[1:], strict=False)]
        own = rows[np.concatenate(bits) == 1] if bits else rows
        runs.append(np.stack(_runs(own[:, 0], own[:, 1]), 1))
    return np.concatenate([np.zeros((0, 3), np.int64), *runs])


def repeated_spans(docs: DataFrame, span: int = 50, hot_bytes: int = HOT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(batches, answers): the staged batches, and for each what `_found` reads.

    The known repeats of a batch pass through a bucket of their own, so nothing is computed twice.
    """
    ship_package(docs.sparkSession)
    batches = batch_texts(docs)
    total = batches.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    n_buckets = max(1, total // BUCKET_BYTES)
    keys = ask(batches, _send_keys(span, n_buckets), _answer_keys(hot_bytes))
    with_keys = with_answers(batches, keys)
    return batches, ask(with_keys, _send_fragments(span, n_buckets, n_buckets), _answer_fragments(span))


def drop_repeats(docs: DataFrame, span: int = 50, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    A byte goes if a `span`-byte string that covers it also starts in a document with a smaller id.
    Null and empty texts have no bytes. Rows with one id are not earlier than each other; null ids
    come first. `kept` may cut a character, so it is binary. `hot_bytes` moves work only.
    """
    batches, answers = repeated_spans(docs, span, hot_bytes)

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            own = batch.schema.field("doc_ids").type.value_type
            for row in batch.to_pylist():
                raw, lengths, _ = _open(row)
                found = _found(row["answers"])
                first = np.cumsum(lengths) - lengths
                edges = np.zeros(len(raw) + 1, np.int32)
                begin = first[found[:, 0]] + found[:, 1]
                np.add.at(edges, begin, 1)
                np.add.at(edges, begin + found[:, 2] + span - 1, -1)
                gone = np.cumsum(edges[:-1]) > 0
                out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")}
                for doc_id, low, n in zip(row["doc_ids"], first.tolist(), lengths.tolist(), strict=True):
                    lost, text = gone[low : low + n], raw[low : low + n]
                    out["doc_id"].append(doc_id)
                    out["n_bytes"].append(n)
                    out["n_removed"].append(int(lost.sum()))
                    out["n_spans"].append(int((np.diff(lost.astype(np.int8), prepend=0) == 1).sum()))
                    out["kept"].append(text[~lost].tobytes())
                yield batch_of(out, doc_id=own, kept=pa.binary())

    kind = batches.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    return with_answers(batches, answers).mapInArrow(cut, schema)
