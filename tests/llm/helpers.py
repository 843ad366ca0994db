"""A small documents table with every awkward case, and plain-Python counterparts."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, pos int, size long, h long"


def rows(seed: int = 3) -> list[tuple]:
    """Prose with copies, near copies, repeated lines, nulls, blanks, ties and repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choices(words, k=n))

    base = [prose(rng.randint(30, 90)) for _ in range(12)]
    texts = list(base)
    texts += [base[0], base[0], base[1].upper(), base[2] + " one more", base[3].replace(" ", "\n", 4)]
    edited = base[4].split()
    for k in (5, 20):
        texts.append(" ".join(w if i != k else "edited" for i, w in enumerate(edited)))
    texts += [base[5] + "\n" + base[6], f"{prose(10)}\n{base[7][40:160]}\n{prose(12)}"]
    footer = "All rights reserved."
    texts += [f"{prose(25)}\n{footer}\n \n{footer.upper()}  \n" for _ in range(11)]
    texts += ["x" * 200, "ab" * 100, "", None, " \t\n\x0b ", "\n\n", "one", "one two three four", "one two three four"]
    texts += ["éß \U0001f600 ЖУ    café\r\nline", prose(5000)]
    langs, sources = ["en", "de", None], ["src0", "src0", "src1", "src10", None, "é"]
    out = []
    for i, text in enumerate(texts):
        n = None if text is None else len(text)
        out.append((i * 3 + 1, text, langs[i % 3], sources[i % 6], n, "k", 1, 5, 7))
    out.append(out[2])
    out.append((None, base[8], "en", "src1", 1, "k", 1, 5, 7))
    out.append((None, None, None, None, None, None, None, None, None))
    return out


def frame(spark, data, parts: int = 3):
    return spark.createDataFrame(data, SCHEMA).repartition(parts)
