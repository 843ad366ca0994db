"""Cutting text into the units BPE works on."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# The three reserved tokens, ids 0, 1, 2 in this order.
UNKNOWN = "<UNK>"
SPECIAL_TOKENS = (UNKNOWN, "<SCOPE_IN>", "<SCOPE_OUT>")

LINE_UNITS = r"[^\n]*\n|[^\n]+"
_SCOPES = "|".join(re.escape(t) for t in SPECIAL_TOKENS[1:])
# Scope markers and newlines alone; everything between them in one piece.
# Possessive, here and below: nothing is ever given back, so long lines need no stack.
ISOLATED_UNITS = rf"{_SCOPES}|\n|(?:(?!{_SCOPES})[^\n])++"


def unit_pattern(split_mode: str) -> str:
    """`literal`: whole lines with their newline. `regex`: markers and newlines isolated."""
    if split_mode == "literal":
        return LINE_UNITS
    if split_mode == "regex":
        return ISOLATED_UNITS
    raise ValueError(f"split_mode must be 'literal' or 'regex', not {split_mode!r}")


def units(text: Column, split_mode: str = "literal") -> Column:
    return F.regexp_extract_all(text, F.lit(unit_pattern(split_mode)), F.lit(0))


def any_of(names) -> str:
    """A pattern for the longest of `names` at a place, as a tree of their prefixes.

    A place is ruled out by its first characters, however many names there are.
    """
    tree: dict = {}
    for name in names:
        at = tree
        for c in name:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(node: dict) -> str:
        ways = []
        for c, below in sorted(node.items()):
            run = c
            # Characters without a choice stay together: the depth is that of the choices.
            while c and len(below) == 1 and "" not in below:
                ((c, below),) = below.items()
                run += c
            if c:
                ways.append(re.escape(run) + pattern(below))
        if not ways:
            return ""
        whole = "(?:" + "|".join(ways) + ")"
        return whole + "?" if "" in node else whole

    return pattern(tree)


def encoding_units(text: Column, specials=SPECIAL_TOKENS, split_mode: str = "literal") -> Column:
    """Reserved tokens found in the text stand alone; the rest is cut as for training."""
    # Of two reserved tokens starting at one place the longer wins.
    names = any_of(specials)
    between = {
        "literal": rf"(?:(?!{names})[^\n])*+\n|(?:(?!{names})[^\n])++",
        "regex": rf"\n|(?:(?!{names})[^\n])++",
    }[split_mode]
    cut = F.regexp_extract_all(text, F.lit(f"{names}|{between}"), F.lit(0))
    if split_mode != "literal" or not specials:
        return cut
    # Texts without a reserved token, nearly all, are lines: the pattern looks for one at every character.
    lines = F.array_remove(F.split(text, r"(?<=\n)"), "")
    return F.when(text.rlike(names), cut).otherwise(lines)


def segment_corpus(df: DataFrame, text: str = "clean_text", split_mode: str = "literal") -> DataFrame:
    """One row per unit of the training file, in which every document ends with a newline."""
    if split_mode == "literal":
        # What the pattern finds, without one: the lines, each with its newline.
        lines = df.select(F.explode(F.split(text, "\n")).alias("line"))
        return lines.select(F.concat("line", F.lit("\n")).alias("segment"))
    with_end = F.concat(F.col(text), F.lit("\n"))
    return df.select(F.explode(units(with_end, split_mode)).alias("segment"))


def segment_counts(segments: DataFrame) -> DataFrame:
    """Multiplicity of each distinct unit; partial sums before the shuffle absorb hot lines."""
    return segments.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
