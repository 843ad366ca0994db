"""Rules over a document's lexeme array.

A lexeme is a struct (kind, src, line). Neighbours are array neighbours, so none of these
rules shuffles. `insert_pass` reads the untouched array and therefore runs first.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The markers that stand for indentation, and the filler statement.
SCOPE_IN = "<SCOPE_IN>"
SCOPE_OUT = "<SCOPE_OUT>"
FILLER = "pass"


def _lexeme(kind: str, src: Column | str, line: Column) -> Column:
    src = F.lit(src) if isinstance(src, str) else src
    return F.struct(F.lit(kind).alias("kind"), src.alias("src"), line.alias("line"))


def _on_doc_line(t: Column, doc_lines: Column) -> Column:
    return (t["kind"] == "STRING") & F.array_contains(doc_lines, t["line"])


def insert_pass(lex: Column, doc_lines: Column) -> Column:
    """A docstring that opens a block and is followed by more than its end becomes `pass`."""

    def rule(t: Column, i: Column) -> Column:
        one_on = F.get(lex, i + 1)["kind"]
        two_on = F.coalesce(F.get(lex, i + 2)["kind"], F.lit(""))
        opens = (
            _on_doc_line(t, doc_lines)
            & one_on.isin("NL", "NEWLINE")
            & ~two_on.isin("DEDENT", "ENDMARKER")
            & (F.get(lex, i - 1)["kind"] == "INDENT")
        )
        return F.when(opens, _lexeme("NAME", FILLER, t["line"])).otherwise(t)

    return F.transform(lex, rule)


def strip_docstrings(lex: Column, doc_lines: Column) -> Column:
    return F.filter(lex, lambda t: ~_on_doc_line(t, doc_lines))


def strip_comments(lex: Column) -> Column:
    return F.filter(lex, lambda t: t["kind"] != "COMMENT")


def mark_scopes(lex: Column) -> Column:
    return F.transform(
        lex,
        lambda t: F.when(t["kind"] == "INDENT", _lexeme("NAME", SCOPE_IN, t["line"]))
        .when(t["kind"] == "DEDENT", _lexeme("NAME", SCOPE_OUT, t["line"]))
        .otherwise(t),
    )


def join_lexemes(lex: Column) -> Column:
    return F.array_join(F.transform(lex, lambda t: t["src"]), "")


def clean_lexemes(lex: Column, doc_lines: Column) -> Column:
    """All lexeme rules in order, back to one text."""
    kept = strip_comments(strip_docstrings(insert_pass(lex, doc_lines), doc_lines))
    return join_lexemes(mark_scopes(kept))
