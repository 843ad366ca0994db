"""A prepared corpus that knows what it was made from: only new or changed texts are cleaned again.

Below the corpus path:
- `clean/<part>`: what one refresh cleaned; never rewritten;
- `manifest/<n>`: the state after refresh n: id, bytes and md5 of each text, the part that holds its
  cleaned row, and the cleaning options. Writing it is the commit: a refresh that fails leaves the
  state before;
- `replaced/<n>`: the rows of parts that changed or removed texts left behind.

One job refreshes a corpus at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tokenloom.session import stage_table
from tokenloom.sources.artefacts import is_complete


class StaleCorpus(ValueError):
    """The prepared corpus was made from other texts or with other options."""


def text_state(corpus: DataFrame) -> DataFrame:
    """doc_id, n_bytes and md5 of each text; null for a null text."""
    return corpus.select("doc_id", F.octet_length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest"))


def _latest(spark: SparkSession, path: str) -> int:
    """The number of the last complete refresh, 0 before the first."""
    n = 0
    while is_complete(spark, f"{path}/manifest/{n + 1}"):
        n += 1
    return n


def _changes(now: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_bytes, digest) of new or changed texts; manifest rows that no longer hold."""
    same = (now["doc_id"] == manifest["doc_id"]) & now["digest"].eqNullSafe(manifest["digest"])
    same = same & now["n_bytes"].eqNullSafe(manifest["n_bytes"])
    return now.join(manifest, same, "left_anti"), manifest.join(now, same, "left_anti")


def _options_of(manifest: DataFrame) -> str | None:
    row = manifest.select("options").first()
    return row and row["options"]


def refresh_corpus(
    corpus: DataFrame, path: str, clean: Callable[[DataFrame], DataFrame], options: dict | None = None
) -> DataFrame:
    """The cleaned rows of `corpus` (doc_id, content), prepared at `path`; see `read_corpus` for the columns.

    `clean` gets the texts that are new or changed since the last refresh, and returns doc_id and
    further columns. `options` are those `clean` uses: a corpus made with others is refused. Ids must
    not be null or repeat.
    """
    spark, wanted = corpus.sparkSession, json.dumps(options or {}, sort_keys=True)
    now = stage_table(text_state(corpus), "text-state")
    rows, ids = now.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    if rows != ids or not now.groupBy("doc_id").count().where("count > 1").isEmpty():
        raise ValueError("document ids must not be null or repeat")
    n, part = _latest(spark, path), uuid.uuid4().hex
    if n:
        manifest = spark.read.parquet(f"{path}/manifest/{n}")
        if (_options_of(manifest) or wanted) != wanted:
            raise StaleCorpus(f"{path} was made with {_options_of(manifest)}, not {wanted}")
        fresh, gone = _changes(now, manifest)
        fresh, gone = stage_table(fresh, "fresh"), stage_table(gone.select("doc_id", "part"), "gone")
        if fresh.isEmpty() and gone.isEmpty():
            return read_corpus(spark, path)
        changed = corpus.join(fresh.select("doc_id"), "doc_id", "left_semi")
        kept = manifest.join(gone, ["doc_id", "part"], "left_anti")
        replaced = spark.read.parquet(f"{path}/replaced/{n}").unionByName(gone)
    else:
        fresh, changed, kept = now, corpus, None
        replaced = spark.createDataFrame([], now.select("doc_id", F.lit("").alias("part")).schema)
    clean(changed).withColumn("part", F.lit(part)).write.mode("errorifexists").parquet(f"{path}/clean/{part}")
    # Left by a refresh that did not reach its commit, these two are written anew.
    replaced.write.mode("overwrite").parquet(f"{path}/replaced/{n + 1}")
    added = fresh.withColumns({"part": F.lit(part), "options": F.lit(wanted)})
    state = added if kept is None else kept.unionByName(added)
    state.write.mode("overwrite").parquet(f"{path}/manifest/{n + 1}")
    return read_corpus(spark, path)


def read_corpus(spark: SparkSession, path: str, corpus: DataFrame | None = None) -> DataFrame:
    """The prepared rows with `part`, the refresh that cleaned them. With `corpus`, refuses a stale state."""
    n = _latest(spark, path)
    if not n:
        raise StaleCorpus(f"nothing is prepared at {path}")
    manifest = spark.read.parquet(f"{path}/manifest/{n}")
    if corpus is not None and not all(d.isEmpty() for d in _changes(text_state(corpus), manifest)):
        raise StaleCorpus(f"the texts behind {path} have changed")
    # One name for each refresh that still has rows.
    parts = sorted(r["part"] for r in manifest.select("part").distinct().collect())
    if not parts:
        return spark.read.parquet(f"{path}/clean/*").limit(0)
    rows = spark.read.parquet(*(f"{path}/clean/{p}" for p in parts))
    replaced = spark.read.parquet(f"{path}/replaced/{n}")
    # Replaced rows alone are looked up; where they are few, no text moves.
    return rows if replaced.isEmpty() else rows.join(replaced, ["doc_id", "part"], "left_anti")
