"""Textbook BPE, one merge at a time, for comparison."""

from collections import Counter

from tokenloom.operators.vocabulary import ALPHABET, SPECIAL_TOKENS


def replace(seq, left, right, new):
    out, i = [], 0
    while i < len(seq):
        if i + 1 < len(seq) and (seq[i], seq[i + 1]) == (left, right):
            out.append(new)
            i += 2
        else:
            out.append(seq[i])
            i += 1
    return out


def serial_training(units, vocab_size, tokens=None):
    tokens = list(tokens or SPECIAL_TOKENS + ALPHABET)
    ids = {t: i for i, t in enumerate(tokens)}
    words = Counter(units)
    bodies = {w: [ids[c] for c in w] for w in words}
    merges = []
    while len(tokens) < vocab_size:
        counts = Counter()
        for w, n in words.items():
            for pair in zip(bodies[w], bodies[w][1:]):
                counts[pair] += n
        if not counts:
            break
        (a, b), _ = min(counts.items(), key=lambda item: (-item[1], item[0]))
        text = tokens[a] + tokens[b]
        if text not in ids:
            ids[text] = len(tokens)
            tokens.append(text)
        merges.append((a, b, ids[text]))
        bodies = {w: replace(body, a, b, ids[text]) for w, body in bodies.items()}
    return tokens, merges


def priority_encode(seq, merges):
    """Lowest rank first, leftmost place first, one place at a time."""
    rank = {(a, b): (r, new) for r, (a, b, new) in enumerate(merges)}
    seq = list(seq)
    while True:
        found = [(rank[p][0], i) for i, p in enumerate(zip(seq, seq[1:])) if p in rank]
        if not found:
            return seq
        _, i = min(found)
        seq[i : i + 2] = [rank[(seq[i], seq[i + 1])][1]]
