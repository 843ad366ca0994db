import ast
import io
import os
import re
import tokenize

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tokenloom.functions.text import import_dropout, normalize_lines, sanitize_text, tidy_lines
from tokenloom.operators.cleaning import clean_audit, clean_corpus, with_eos
from tokenloom.operators.lexing import KINDS, lexemes
from tokenloom.operators.segments import encoding_units, segment_corpus
from tokenloom.sources.corpus import read_source_files

# (source, dropout, cleaned)
GOLDENS = [
    (
        '# c\nimport os\nfrom a import b\n\ndef f(x):\n    """doc"""\n    return x  # t\n',
        0,
        "import os\nfrom a import b\ndef f(x):\n<SCOPE_IN>pass\nreturn x\n<SCOPE_OUT>",
    ),
    ('def f():\n    """d"""\n', 0, "def f():\n<SCOPE_IN>\n<SCOPE_OUT>"),
    ('"""m"""\nx = 1\n', 0, "x = 1"),
    (
        "def f():\n    import os\n    import sys\n    return 1\n",
        1,
        "def f():\n<SCOPE_IN>import os\nreturn 1\n<SCOPE_OUT>",
    ),
    ('def f(x="a"): ...\n', 0, "def f(x=): ..."),
    (
        'async def g():\n    """d"""\n    return 1\n',
        0,
        'async def g():\n<SCOPE_IN>"""d"""\nreturn 1\n<SCOPE_OUT>',
    ),
    ("x = 'é😀'\n", 0, "x = '??'"),
    ("it's a test\n", 0, ""),
    ("x = '''a\n\n   b'''\n", 0, "x = '''a\nb'''"),
    (
        'class A:\n    def h(self):\n        """d"""\n    def k(self):\n        return 1\n',
        0,
        "class A:\n<SCOPE_IN>def h(self):\n<SCOPE_IN>pass\n<SCOPE_OUT>def k(self):\n"
        "<SCOPE_IN>return 1\n<SCOPE_OUT><SCOPE_OUT>",
    ),
    # Beyond the fixture list.
    ("", 0, ""),
    ("x = (1,\n     2)\n", 0, "x = (1,\n2)"),
    ("x = 1 + \\\n    2\n", 0, "x = 1 + \\\n2"),
    ('x = f"a{{b}}{1!r}"\n', 0, 'x = f"a{{b}}{1!r}"'),
    ("if x:\n\ty = 1\r\n\tz = 2\r\n", 0, "if x:\n<SCOPE_IN>y = 1\nz = 2\n<SCOPE_OUT>"),
    ("def f(:\n    'd'\n", 0, ""),
    ("print 'a'\nx = 1\n", 0, "print 'a'\nx = 1"),
    ("class A:\n    'd' 'e'\n    x = 1\n", 0, "class A:\n<SCOPE_IN>\nx = 1\n<SCOPE_OUT>"),
    ("class A:\n    'd'; x = 1\n", 0, "class A:\n<SCOPE_IN>; x = 1\n<SCOPE_OUT>"),
    ("class A:\n    'd'  # c\n    x = 1\n", 0, "class A:\n<SCOPE_IN>\nx = 1\n<SCOPE_OUT>"),
    ("x = [1\n", 0, ""),
    ("  x = 1\n y = 2\n", 0, ""),
    ("importx = 1\nimport a\nfrom\tb import c\nfrom b import c\n", 1, "importx = 1\nfrom\tb import c"),
]


def test_goldens(spark):
    for chance in (0, 1):
        rows = [(i, s) for i, (s, p, _) in enumerate(GOLDENS) if p == chance]
        df = spark.createDataFrame(rows, "doc_id long, content string")
        got = {r.doc_id: r.clean_text for r in clean_corpus(df, chance).collect()}
        assert got == {i: GOLDENS[i][2] for i, _ in rows}


@pytest.mark.parametrize("source", [s for s, _, _ in GOLDENS])
def test_lexemes_add_up_to_the_source(source):
    try:
        texts = [text for _, text, _ in lexemes(source)]
    except (tokenize.TokenError, SyntaxError):
        return
    assert "".join(texts) == source


def test_lexemes_keep_the_standard_kinds():
    source = GOLDENS[0][0]
    standard = [tokenize.tok_name[t.type] for t in tokenize.generate_tokens(io.StringIO(source).readline)]
    got = [kind for kind, _, _ in lexemes(source) if kind != "CODE"]
    assert got == [kind for kind in standard if kind in KINDS.values()]


def strip_and_join(text):
    lines = (line.strip() for line in text.splitlines())
    return "\n".join(line for line in lines if line)


def test_line_rules_match_python(spark):
    texts = []

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet="ab \t\n\r\v\fé😀", max_size=30))
    def gather(text):
        texts.append(text)

    gather()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, content string")
    safe = sanitize_text(F.col("content"))
    out = df.select(
        "doc_id", safe.alias("safe"), tidy_lines(safe).alias("tidy"), normalize_lines(safe).alias("lines")
    )
    for row in out.collect():
        want = re.sub(r"[^\t\n\v\f\r -~]", "?", texts[row.doc_id])
        assert row.safe == want
        assert row.tidy == strip_and_join(want)
        assert row.lines == [line for line in strip_and_join(want).split("\n") if line]


def test_long_blank_runs_stay_linear(spark):
    text = ("a" + " " * 200_000) * 3 + "b" + "\n" * 200_000 + "c" + " " * 200_000
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tidy_lines(F.col("t")).alias("t")).first().t == strip_and_join(text)


def test_dropout_is_seeded_and_near_its_rate(spark):
    lines = [f"import m{i}" for i in range(4000)] + ["x = 1"]
    df = spark.createDataFrame([(1, lines), (2, lines)], "doc_id long, lines array<string>")

    def kept(seed, chance):
        out = df.select("doc_id", import_dropout(F.col("lines"), F.col("doc_id"), chance, seed).alias("k"))
        return {r.doc_id: r.k for r in out.collect()}

    first = kept(1, 0.3)
    assert first == kept(1, 0.3)
    assert first != kept(2, 0.3)
    assert first[1] != first[2]
    assert abs(len(first[1]) / 4001 - 0.7) < 0.03
    assert first[1][-1] == "x = 1"
    assert kept(1, 0)[1] == lines
    assert kept(1, 1)[1] == ["x = 1"]


def test_audit_and_end_mark(spark):
    df = spark.createDataFrame(
        [(0, "x = 1\n"), (1, None), (2, ""), (3, "it's\n"), (4, "# only\n")], "doc_id long, content string"
    )
    cleaned = clean_corpus(df, 0.0)
    got = {(r.status, r.docs, r.chars) for r in clean_audit(df, cleaned).collect()}
    assert got == {("ok", 1, 5), ("null", 1, 0), ("empty", 2, 0), ("lexer_failed", 1, 0)}
    assert [r.clean_text for r in with_eos(cleaned).collect()] == ["x = 1 <|endoftext|>"]


def test_many_slices_per_batch(spark, monkeypatch):
    monkeypatch.setattr("tokenloom.operators.lexing._BATCH_CHARS", 10)
    df = spark.createDataFrame([(i, f"x{i} = {i}\n") for i in range(50)], "doc_id long, content string")
    got = {r.doc_id: r.clean_text for r in clean_corpus(df.coalesce(1), 0.0).collect()}
    assert got == {i: f"x{i} = {i}" for i in range(50)}


class Shape(ast.NodeTransformer):
    """The program without docstrings, `pass` and the content of strings."""

    def visit(self, node):
        self.generic_visit(node)
        if isinstance(node, ast.Constant) and isinstance(node.value, (str, bytes)):
            node.value = ""
        if isinstance(getattr(node, "body", None), list):
            owner = isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef))
            first = node.body[0] if node.body else None
            if owner and isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant):
                if isinstance(first.value.value, str):
                    node.body = node.body[1:]
        for field in ("body", "orelse", "finalbody"):
            if isinstance(getattr(node, field, None), list):
                setattr(node, field, [s for s in getattr(node, field) if not isinstance(s, ast.Pass)])
        return node


def indented(cleaned):
    """Cleaned text with real indentation in place of the markers."""
    depth, out = 0, []
    for line in cleaned.split("\n"):
        while line.startswith("<SCOPE_"):
            marker = "<SCOPE_IN>" if line.startswith("<SCOPE_IN>") else "<SCOPE_OUT>"
            depth += 1 if marker == "<SCOPE_IN>" else -1
            line = line.removeprefix(marker)
            if marker == "<SCOPE_IN>":
                out.append(" " * depth + "pass")
        out.append(" " * depth + line)
    return "\n".join(out)


def test_standard_library_keeps_its_programs(spark):
    """Real files: cleaned at no dropout and indented again, they are the same programs."""
    folder = os.path.dirname(ast.__file__)
    files = read_source_files(spark, f"file://{folder}/[a-m]*.py").persist()
    sources = {r.doc_id: r.content for r in files.collect()}
    assert len(sources) > 50
    off = {}
    for row in clean_corpus(files, 0.0).collect():
        source = re.sub(r"[^\t\n\v\f\r -~]", "?", sources[row.doc_id])
        want = ast.dump(Shape().visit(ast.parse(source)))
        try:
            got = ast.dump(Shape().visit(ast.parse(indented(row.clean_text))))
        except SyntaxError as error:
            got = repr(error)
        if got != want:
            off[row.doc_id] = got
    # The rest: a docstring whose line holds other strings, which go with it.
    assert len(off) <= 0.05 * len(sources), off


@pytest.mark.parametrize(
    ("source", "kinds"),
    [
        ("def f():\r    'd'\r    return 1\r", ["NEWLINE", "INDENT", "STRING", "NEWLINE", "NEWLINE", "DEDENT", "ENDMARKER"]),
        ("# c\rx = 1", ["COMMENT", "NL", "NEWLINE", "ENDMARKER"]),
        ("if a:\r\n  b\rc\n", ["NEWLINE", "INDENT", "NEWLINE", "DEDENT", "NEWLINE", "ENDMARKER"]),
    ],
)
def test_every_line_end_counts(source, kinds):
    found = list(lexemes(source))
    assert "".join(text for _, text, _ in found) == source
    assert [kind for kind, _, _ in found if kind != "CODE"] == kinds


def test_docstrings_after_lone_carriage_returns_go(spark):
    df = spark.createDataFrame([(1, "def f():\r    'd'\r    return 1\r")], "doc_id long, content string")
    assert clean_corpus(df, 0.0).first().clean_text == "def f():\n<SCOPE_IN>pass\nreturn 1\n<SCOPE_OUT>"


@pytest.mark.parametrize("mode", ["literal", "regex"])
def test_long_mixed_lines_need_no_stack(spark, mode):
    line = "a\U0001f600" * 40_000
    df = spark.createDataFrame([(f"{line}\n<SCOPE_IN>{line}",)], "t string")
    found = df.select(encoding_units(F.col("t"), split_mode=mode).alias("u")).first().u
    assert found == ([line + "\n", "<SCOPE_IN>", line] if mode == "literal" else [line, "\n", "<SCOPE_IN>", line])
    own = segment_corpus(df, "t", mode).count()
    assert own == (2 if mode == "literal" else 5)
