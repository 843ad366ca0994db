"""A corpus of Python files derived from the `part` table, with known results of every rule.

Each row of `part` fills one of ten templates, chosen by its key, so the corpus grows with the
table. The templates are plain SQL expressions that Spark and DuckDB read alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tokenloom.sources.corpus import default_spread, spread


@dataclass(frozen=True)
class Template:
    """Source and results; `{n}` is the part key, `{name}` its name. None: no such document."""

    source: str | None
    clean: str | None
    no_comments: str | None = None
    scoped: str | None = None
    no_docstrings: str | None = None
    passed: str | None = None
    lexed: bool = True
    comments: int = 0
    indents: int = 0
    strings: int = 0
    doc_lines: str = ""


def _same(text: str, **over) -> Template:
    """Rules not named in `over` leave the text as it is."""
    rules = dict.fromkeys(("no_comments", "scoped", "no_docstrings", "passed"), text)
    return Template(source=text, **{**rules, **over})


TEMPLATES = (
    # Comments, imports, a docstring followed by more body.
    _same(
        '# part {n}\nimport os\nfrom lib{n} import a\n\ndef f{n}(x):\n    """{name}"""\n    return x  # note\n',
        clean="import os\nfrom lib{n} import a\ndef f{n}(x):\n<SCOPE_IN>pass\nreturn x\n<SCOPE_OUT>",
        no_comments='\nimport os\nfrom lib{n} import a\n\ndef f{n}(x):\n    """{name}"""\n    return x  \n',
        scoped='# part {n}\nimport os\nfrom lib{n} import a\n\ndef f{n}(x):\n<SCOPE_IN>"""{name}"""\n'
        "    return x  # note\n<SCOPE_OUT>",
        no_docstrings="# part {n}\nimport os\nfrom lib{n} import a\n\ndef f{n}(x):\n    \n    return x  # note\n",
        passed="# part {n}\nimport os\nfrom lib{n} import a\n\ndef f{n}(x):\n    pass\n    return x  # note\n",
        comments=2,
        indents=1,
        strings=1,
        doc_lines="6",
    ),
    # Imports inside a block.
    _same(
        "def f{n}():\n    import os\n    import sys\n    return {n}\n",
        clean="def f{n}():\n<SCOPE_IN>import os\nimport sys\nreturn {n}\n<SCOPE_OUT>",
        scoped="def f{n}():\n<SCOPE_IN>import os\n    import sys\n    return {n}\n<SCOPE_OUT>",
        indents=1,
    ),
    # A string that opens an async function stays.
    _same(
        'async def g{n}():\n    """{name}"""\n    return {n}\n',
        clean='async def g{n}():\n<SCOPE_IN>"""{name}"""\nreturn {n}\n<SCOPE_OUT>',
        scoped='async def g{n}():\n<SCOPE_IN>"""{name}"""\n    return {n}\n<SCOPE_OUT>',
        indents=1,
        strings=1,
    ),
    # Does not lex.
    Template("it's {name}\n", "", "", "", "", "", lexed=False),
    # No content.
    Template(None, None),
    _same("", clean=""),
    # Module docstring; a block with nothing but a docstring up to the end of the file.
    _same(
        '"""{name}"""\nx{n} = 1\ndef f{n}():\n    """d"""\n',
        clean="x{n} = 1\ndef f{n}():\n<SCOPE_IN>\n<SCOPE_OUT>",
        scoped='"""{name}"""\nx{n} = 1\ndef f{n}():\n<SCOPE_IN>"""d"""\n<SCOPE_OUT>',
        no_docstrings="\nx{n} = 1\ndef f{n}():\n    \n",
        indents=1,
        strings=2,
        doc_lines="1,4",
    ),
    # A block with nothing but a docstring, closed by an inner dedent.
    _same(
        'class A{n}:\n    def h(self):\n        """{name}"""\n    def k(self):\n        return {n}\n',
        clean="class A{n}:\n<SCOPE_IN>def h(self):\n<SCOPE_IN>pass\n<SCOPE_OUT>def k(self):\n"
        "<SCOPE_IN>return {n}\n<SCOPE_OUT><SCOPE_OUT>",
        scoped='class A{n}:\n<SCOPE_IN>def h(self):\n<SCOPE_IN>"""{name}"""\n    <SCOPE_OUT>def k(self):\n'
        "<SCOPE_IN>return {n}\n<SCOPE_OUT><SCOPE_OUT>",
        no_docstrings="class A{n}:\n    def h(self):\n        \n    def k(self):\n        return {n}\n",
        passed="class A{n}:\n    def h(self):\n        pass\n    def k(self):\n        return {n}\n",
        indents=3,
        strings=1,
        doc_lines="3",
    ),
    # Any string on the line of an opening constant goes; characters outside ASCII.
    Template(
        source="def f{n}(x=\"a\"): ...\ny = 'é😀{name}'\n",
        clean="def f{n}(x=): ...\ny = '??{name}'",
        no_comments="def f{n}(x=\"a\"): ...\ny = '??{name}'\n",
        scoped="def f{n}(x=\"a\"): ...\ny = '??{name}'\n",
        no_docstrings="def f{n}(x=): ...\ny = '??{name}'\n",
        passed="def f{n}(x=\"a\"): ...\ny = '??{name}'\n",
        strings=2,
        doc_lines="1",
    ),
    # Lines inside a string are stripped too.
    _same(
        "x{n} = '''{name}\n\n   b'''\nfrom m{n} import q\n",
        clean="x{n} = '''{name}\nb'''\nfrom m{n} import q",
        strings=1,
    ),
)


def text_sql(template: str | None) -> str:
    """A template as an SQL string expression over `part`."""
    if template is None:
        return "CAST(NULL AS STRING)"
    lines = template.replace("'", "''").split("\n")
    joined = "' || chr(10) || '".join(lines)
    filled = joined.replace("{n}", "' || CAST(p_partkey AS STRING) || '").replace("{name}", "' || p_name || '")
    return f"('{filled}')"


def case_sql(values: list[str]) -> str:
    """One SQL expression per template, picked by the part key."""
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE p_partkey % {len(values)} {arms} END"


def column_sql(field: str) -> str:
    return case_sql([text_sql(getattr(t, field)) for t in TEMPLATES])


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return spread(part.selectExpr("p_partkey AS doc_id", f"{column_sql('source')} AS content"), "doc_id", default_spread(spark))
