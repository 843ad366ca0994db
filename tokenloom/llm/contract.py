"""The registered queries of the operators, with their SQL twins.

Each query runs its operator over the whole `documents` or `embeddings` table with the operator's own parameters
and derives the digest columns from its outputs.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, functions as F

from tokenloom.llm.adaptive_scan import nearest_neighbours
from tokenloom.llm.common import WORD, bucket_of
from tokenloom.llm.decontamination import contamination
from tokenloom.llm.hard_negatives import hard_negatives
from tokenloom.llm.hmm_language_model import lm_scores
from tokenloom.llm.language_id import identify_languages, train_languages
from tokenloom.llm.line_dedup import kept_lines, line_keep_bitmaps
from tokenloom.llm.mixing import id_hash, mix_groups
from tokenloom.llm.pii import replace_pii
from tokenloom.llm.quality_rules import quality_rules
from tokenloom.llm.shingle_join import shingle_components
from tokenloom.llm.suffix_dedup import drop_repeats
from tokenloom.llm.token_alignment import align_documents, with_link_counts
from tokenloom.llm.token_store import read_store, write_store
from tokenloom.llm.vector_grid import finite
from tokenloom.session import scratch_path, ship_package, stage_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def sized(docs: DataFrame, *columns: str | F.Column) -> DataFrame:
    """Words of each document (size) and the hash of its id (h), next to `columns`; staged."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return stage_table(docs.select(*columns, size.alias("size"), id_hash("doc_id").alias("h")), "sized")


def op1_mixing(spark, sf_dir):
    docs = sized(table(spark, sf_dir, "documents"), "doc_id", "source")
    return mix_groups(docs, "source", cap=3.0).select(
        "doc_id",
        "size",
        F.col("group_size").alias("source_size"),
        F.round("target", 6).alias("target"),
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train_languages(docs.where(bucket_of("doc_id", 5) != 0))
    found = identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "mixture")


def op3_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = kept_lines(docs, line_keep_bitmaps(docs, min_docs=10, min_chars=1))
    return kept.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        sha256(F.array_join("kept", "\n")).alias("kept_sha256"),
    )


def op4_suffix_dedup(spark, sf_dir):
    found = drop_repeats(table(spark, sf_dir, "documents"), span=50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", sha256(F.col("kept")).alias("kept_sha256"))


def op5_lm_scoring(spark, sf_dir):
    found = lm_scores(table(spark, sf_dir, "documents"), bucket_of("doc_id", 7) != 2)
    return found.withColumn("held_out", bucket_of("doc_id", 7) == 2)


def op6_decontamination(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    n_hit = F.size("covered").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        sha256(F.array_join("items", ",")).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op7_quality_rules(spark, sf_dir):
    found = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.drop("text_hash", "threshold")


def op9_jaccard_join(spark, sf_dir):
    return shingle_components(table(spark, sf_dir, "documents"), size=5, percent=75).drop("text_hash")


#: The query's key. A real run passes its own; who knows the key can undo the permutations.
PII_KEY = b"surrogates of the registered query"


def op10_pii(spark, sf_dir):
    return replace_pii(table(spark, sf_dir, "documents"), PII_KEY)


#: Fixed values of the output contract.
TOKENIZER_FILE = "word_bpe_49k.json"
VOCAB_SIZE = 49_408
END_ID = 1


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_token_output(spark, sf_dir):
    path = scratch_path(spark, "tokens")
    write_store(table(spark, sf_dir, "documents"), path, tokenizer_path(), END_ID, VOCAB_SIZE)
    found = read_store(spark, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_token_alignment(spark, sf_dir):
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    aligned = align_documents(table(spark, sf_dir, "documents"), *paths)
    hashed = F.when(F.col("groups") == "", "").otherwise(sha256(F.col("groups")))
    staged = stage_table(aligned.withColumn("groups_sha256", hashed).drop("groups"), "aligned")
    return with_link_counts(staged, *paths)


def op12_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where(finite("embedding"))
    label = F.col("label").cast("long")
    vectors = rows.select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vector"),
    )
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90)


def op13_adaptive_scan(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return nearest_neighbours(vectors, F.col("vec_id") % 20 == 0, k=20)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_language_id": op2_language_id,
    "op3_line_dedup": op3_line_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_decontamination": op6_decontamination,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_output": op8_token_output,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_pii": op10_pii,
    "op11_token_alignment": op11_token_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_adaptive_scan": op13_adaptive_scan,
}

_LOWER = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"

_END = 1 << 48


def _take(k: int) -> str:
    """SQL of one rounding pass: by hash, documents that fit into what the pass before left."""
    mine = "NOT taken AND h >= start AND size <= rest AND size > 0 AND rest > 0"
    return f"""
        c{k} AS (
            SELECT source, h, rest, sum(size) OVER (PARTITION BY source ORDER BY h) AS c FROM p{k - 1} WHERE {mine}
        ),
        e{k} AS (
            SELECT source, coalesce(max(c) FILTER (c <= rest), 0) AS got,
                   coalesce(min(h) FILTER (c > rest), {_END}) AS edge
            FROM c{k} GROUP BY source
        ),
        p{k} AS (
            SELECT doc_id, p.source, size, h, base, taken OR ({mine} AND h < edge) AS taken,
                   coalesce(edge, start) AS start, rest - coalesce(got, 0) AS rest
            FROM p{k - 1} p LEFT JOIN e{k} e ON p.source IS NOT DISTINCT FROM e.source
        ),"""


ORACLE = {
    "op1_mixing": rf"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                   CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS h
            FROM documents
        ),
        s AS (
            SELECT source, sum(size) AS n,
                   [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
            FROM d GROUP BY source
        ),
        m AS (
            SELECT *, 3.0 * n / w AS ratio,
                   (sum(n) OVER () - coalesce(sum(3.0 * n) OVER (
                       ORDER BY 3.0 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(w) OVER (ORDER BY 3.0 * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mu
            FROM s WHERE n > 0
        ),
        level AS (SELECT mu FROM m WHERE mu <= ratio ORDER BY ratio, source LIMIT 1),
        t AS (
            SELECT source, CAST(n AS BIGINT) AS n, CAST(least(3.0 * n, w * coalesce(mu, 0)) AS DOUBLE) AS target
            FROM s LEFT JOIN level ON true
        ),
        r AS (SELECT *, CAST(CASE WHEN n > 0 THEN least(floor(target / n + 1e-9), 3) ELSE 0 END AS BIGINT) AS base FROM t),
        p0 AS (
            SELECT doc_id, d.source, size, h, base, false AS taken, 0::BIGINT AS start,
                   greatest(CAST(round(target) AS BIGINT) - base * n, 0) AS rest
            FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
        ),{_take(1)}{_take(2)}{_take(3)}
        f AS (SELECT * FROM p3)
        SELECT doc_id, size, n AS source_size, round(target, 6) AS target, size * (f.base + CAST(taken AS INT)) AS taken
        FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
    """,
    "op3_line_dedup": f"""
        WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        line AS (SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM cut),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_LOWER}) AS key
            FROM line
        ),
        common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN common c USING (key) GROUP BY doc_id
    """,
    "op6_decontamination": rf"""
        WITH pattern AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS p),
        doc AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), p) AS w FROM documents, pattern
        ),
        item AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), p) AS w FROM benchmark, pattern
        ),
        part AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)
        ),
        hit AS (
            SELECT d.doc_id, d.i, s.size, array_to_string(d.w[d.i:d.i + s.size - 1], ' ') AS gram
            FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc) d,
                 (SELECT DISTINCT size FROM part) s
            WHERE d.i + s.size - 1 <= len(d.w)
              AND array_to_string(d.w[d.i:d.i + s.size - 1], ' ') IN (SELECT gram FROM part)
        ),
        covered AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id
        ),
        matched AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit JOIN part USING (gram)) GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN matched USING (doc_id)
    """,
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        pair AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike,
                   CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
        ),
        positive AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score,
                   row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS positive_rank
            FROM pair WHERE alike
        ),
        negative AS (
            SELECT p.*, n.other_id AS negative_id, n.score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS rank
            FROM positive p JOIN pair n ON n.anchor_id = p.anchor_id AND NOT n.alike
             AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
            WHERE positive_rank <= 5
        )
        SELECT anchor_id, positive_id, CAST(positive_rank AS INT) AS positive_rank, CAST(rank AS INT) AS rank,
               negative_id, positive_score, negative_score
        FROM negative WHERE rank <= 10
    """,
}
