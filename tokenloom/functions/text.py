"""Column expressions for document text. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The printable ASCII set is tab, newline, vertical tab, form feed, carriage
# return and 0x20-0x7e; anything else becomes the replacement mark.
NOT_PRINTABLE = r"[^\x09-\x0d\x20-\x7e]"
REPLACEMENT = "?"
IMPORT_PREFIXES = ("import ", "from ")
END_OF_TEXT = "<|endoftext|>"

# A break with all blanks after it; blanks before a break, from the first of their run, which keeps long
# runs linear. Each begins with what it looks for, so most characters are ruled out at once.
_BREAKS = r"[\n\x0b\x0c\r][\x09-\x0d\x20]*+"
_TRAILING = r"[\t ](?<![\t ]{2})[\t ]*+\n"
_BLANKS = "\t\n\x0b\x0c\r "


def sanitize_text(text: Column) -> Column:
    """Every character outside printable ASCII becomes one `?`."""
    return F.regexp_replace(text, NOT_PRINTABLE, REPLACEMENT)


def tidy_lines(text: Column) -> Column:
    """Strip every line, drop the empty ones, join the rest by one newline."""
    lines = F.regexp_replace(F.regexp_replace(text, _BREAKS, "\n"), _TRAILING, "\n")
    return F.btrim(lines, F.lit(_BLANKS))


def line_list(tidied: Column) -> Column:
    """The lines of a tidied text; no lines for the empty text."""
    return F.filter(F.split(tidied, "\n"), lambda line: line != "")


def normalize_lines(text: Column) -> Column:
    return line_list(tidy_lines(text))


def is_import(line: Column) -> Column:
    first, *rest = (F.startswith(line, F.lit(p)) for p in IMPORT_PREFIXES)
    for cond in rest:
        first = first | cond
    return first


def draw(seed: int, doc_id: Column, line_no: Column) -> Column:
    """A repeatable number in [0, 1) for one line of one document."""
    text = F.concat_ws("|", F.lit(str(seed)), doc_id.cast("string"), line_no.cast("string"))
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")
    return head / F.lit(float(2**32))


def import_dropout(lines: Column, doc_id: Column, chance: float, seed: int = 0) -> Column:
    """Drop each import line with probability `chance`; `line_no` counts from 0."""
    if chance <= 0:
        return lines
    if chance >= 1:
        return F.filter(lines, lambda line: ~is_import(line))
    return F.filter(
        lines,
        lambda line, i: F.when(is_import(line), draw(seed, doc_id, i) >= F.lit(chance)).otherwise(True),
    )


def finish_text(text: Column, doc_id: Column, chance: float, seed: int = 0) -> Column:
    """Line normalisation plus import dropout, as one text again."""
    tidied = tidy_lines(text)
    if chance <= 0:
        return tidied
    return F.array_join(import_dropout(line_list(tidied), doc_id, chance, seed), "\n")


def append_eos(text: Column) -> Column:
    return F.concat(text, F.lit(" " + END_OF_TEXT))
