"""Python lexemes of each document: the one cleaning step that leaves the JVM."""

from __future__ import annotations

import ast
import io
import itertools
import tokenize
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

LEXEME = T.StructType().add("kind", "string").add("src", "string").add("line", "integer")
LEX_FIELDS = (
    T.StructType()
    .add("lex", T.ArrayType(LEXEME))
    .add("doc_lines", T.ArrayType(T.IntegerType()))
    .add("lex_ok", "boolean")
)
# The statements whose first body statement can be a docstring.
DOCSTRING_OWNERS = (ast.Module, ast.ClassDef, ast.FunctionDef)
_STATEMENT_LISTS = ("body", "orelse", "finalbody", "handlers", "cases")
# Lexeme kinds the rules tell apart, by the standard lexer's numbers.
_ASKED = ("COMMENT", "STRING", "NL", "NEWLINE", "INDENT", "DEDENT", "ENDMARKER")
KINDS = {getattr(tokenize, name): name for name in _ASKED}
CODE = "CODE"
# Source characters per output batch; lexemes take several times the room of their text.
_BATCH_CHARS = 1 << 20


def docstring_lines(source: str) -> list[int]:
    """Start lines of constants that open a body; none if the source does not parse.

    The parser reports text too deep for it as a memory or recursion error.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return []
    found, pending = set(), [tree]
    while pending:
        node = pending.pop()
        # Owners nest in statement lists only; expressions need no visit.
        for name in _STATEMENT_LISTS:
            pending += getattr(node, name, ())
        if isinstance(node, DOCSTRING_OWNERS) and node.body:
            opener = node.body[0]
            if isinstance(opener, ast.Expr) and isinstance(opener.value, ast.Constant):
                found.add(opener.lineno)
    return sorted(found)


def lexemes(source: str):
    """Yield (kind, text, line) so that the texts add up to the source.

    Kinds no rule asks about, and the blanks between tokens, come as stretches of `CODE`:
    they act on their neighbours like any single lexeme would, at a fraction of the rows.
    """
    # Without newline translation a lone carriage return ends a line, as for the parser.
    begins = list(itertools.accumulate(map(len, io.StringIO(source, newline="")), initial=0))
    last, size = len(begins) - 1, len(source)
    done, line = 0, 1
    for kind, _, (row, col), (end_row, end_col), _ in tokenize.generate_tokens(io.StringIO(source, newline="").readline):
        if kind not in KINDS:
            continue
        start = min(begins[min(row - 1, last)] + col, size)
        stop = min(begins[min(end_row - 1, last)] + end_col, size)
        if start > done:
            yield CODE, source[done:start], line
            done = start
        yield KINDS[kind], source[done : max(done, stop)], row
        done, line = max(done, stop), end_row
    if done < size:
        yield CODE, source[done:], line


def _lex_all(texts):
    """Columns (lex, doc_lines, lex_ok) for one slice of documents."""
    kinds, srcs, rows, ends, docs, ok = [], [], [], [0], [], []
    for text in texts:
        found, fine = [], text is not None
        if fine:
            try:
                found = list(lexemes(text))
                # Docstrings are strings: without one there is nothing to parse for.
                has_string = any(kind == "STRING" for kind, _, _ in found)
                docs_here = docstring_lines(text) if has_string else []
            except Exception:  # any lexer error empties the document
                fine, found, docs_here = False, [], []
        docs.append(docs_here if fine else [])
        ok.append(fine)
        if found:
            k, s, r = zip(*found)
            kinds += k
            srcs += s
            rows += r
        ends.append(len(kinds))
    struct = pa.StructArray.from_arrays(
        [pa.array(kinds, pa.string()), pa.array(srcs, pa.string()), pa.array(rows, pa.int32())],
        ["kind", "src", "line"],
    )
    lex = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)
    return [lex, pa.array(docs, pa.list_(pa.int32())), pa.array(ok, pa.bool_())]


def lex_documents(df: DataFrame, text: str = "content") -> DataFrame:
    """Replace column `text` by `lex`, `doc_lines` and `lex_ok`; other columns pass through.

    Project and filter before this step: the optimizer cannot move anything past it.
    """
    kept = [c for c in df.columns if c != text]
    schema = T.StructType([*(df.schema[c] for c in kept), *LEX_FIELDS.fields])
    names = [*kept, *LEX_FIELDS.names]

    def run(batches):
        warnings.simplefilter("ignore")
        for batch in batches:
            texts = batch.column(text).to_pylist()
            first, size = 0, 0
            for at, value in enumerate(texts):
                size += len(value or "")
                if size >= _BATCH_CHARS or at == len(texts) - 1:
                    part = batch.slice(first, at + 1 - first)
                    columns = [part.column(c) for c in kept]
                    yield pa.RecordBatch.from_arrays([*columns, *_lex_all(texts[first : at + 1])], names)
                    first, size = at + 1, 0

    return df.select(*kept, F.col(text)).mapInArrow(run, schema)
