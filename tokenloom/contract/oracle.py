"""The registered queries as plain SQL, for an independent engine to check.

Each statement is written from the rule's definition, not from the Spark expression.
"""

from __future__ import annotations

from tokenloom.contract import queries as q
from tokenloom.contract.code_corpus import TEMPLATES, case_sql, column_sql, text_sql

IDS = 131072  # one supplementary character per id keeps replacement exact


def sanitized(text: str) -> str:
    return rf"regexp_replace({text}, '[^\x09-\x0d\x20-\x7e]', '?', 'g')"


def lines(text: str) -> str:
    """Split at line breaks, strip, drop the empty lines."""
    split = rf"regexp_split_to_array({text}, '\r\n|[\n\r\x0b\x0c]')"
    strip = r"regexp_replace(l, '^[\x09-\x0d\x20]+|[\x09-\x0d\x20]+$', '', 'g')"
    return f"list_filter(list_transform({split}, lambda l: {strip}), lambda l: l <> '')"


def joined(line_list: str) -> str:
    return f"array_to_string({line_list}, chr(10))"


def kept_lines(line_list: str, doc_id: str, chance: float) -> str:
    draw = (
        f"('0x' || substr(md5(concat_ws('|', '{q.SEED}', CAST({doc_id} AS VARCHAR), "
        "CAST(i - 1 AS VARCHAR))), 1, 8))::BIGINT / 4294967296.0"
    )
    is_import = "(starts_with(l, 'import ') OR starts_with(l, 'from '))"
    return f"list_filter({line_list}, lambda l, i: NOT {is_import} OR {draw} >= {chance})"


def id_of(char: str) -> str:
    """Base id of a printable character."""
    return f"(CASE WHEN ascii({char}) < 14 THEN ascii({char}) - 6 ELSE ascii({char}) - 24 END)"


def id_text(coded: str) -> str:
    # Splitting the empty text yields one empty piece, which is no id.
    chars = f"list_filter(string_split({coded}, ''), lambda c: c <> '')"
    return f"array_to_string(list_transform({chars}, lambda c: unicode(c) - {IDS}), ',')"


def coded(text: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({text}, ''), "
        f"lambda c: CASE WHEN c = '' THEN '' WHEN c IN (chr(1), chr(2)) THEN chr({IDS} + ascii(c)) "
        f"ELSE chr(CAST({IDS} + {id_of('c')} AS INTEGER)) END), '')"
    )


def one_char_markers(text: str) -> str:
    """Scope markers as the control characters 1 and 2, which no clean text holds."""
    return f"replace(replace({text}, '<SCOPE_IN>', chr(1)), '<SCOPE_OUT>', chr(2))"


PROSE = f"clean AS (SELECT doc_id, {joined(lines(sanitized('text')))} AS clean_text FROM documents)"
ENDED = f"{PROSE}, ended AS (SELECT doc_id, clean_text || ' <|endoftext|>' AS clean_text FROM clean WHERE clean_text <> '')"
UNITS = r"'[^\n]*\n|[^\n]+'"
SEGMENTS = f"{PROSE}, seg AS (SELECT unnest(regexp_extract_all(clean_text || chr(10), {UNITS})) AS segment FROM clean)"
COUNTED = f"{SEGMENTS}, cnt AS (SELECT segment, count(*) AS n FROM seg GROUP BY segment)"
CODE = (
    f"code AS (SELECT p_partkey AS doc_id, {column_sql('source')} AS content, "
    f"{column_sql('clean')} AS clean_text, {case_sql([str(t.lexed).lower() for t in TEMPLATES])} AS lex_ok FROM part)"
)
BASE = (
    "base AS (SELECT * FROM (VALUES (0, '<UNK>'), (1, '<SCOPE_IN>'), (2, '<SCOPE_OUT>')) v(id, token) "
    "UNION ALL SELECT CASE WHEN c < 14 THEN c - 6 ELSE c - 24 END, chr(CAST(c AS INTEGER)) "
    "FROM range(9, 127) r(c) WHERE c < 14 OR c >= 32)"
)


def training(n_merges: int, docs: str = "documents") -> str:
    """Serial training: count pairs, take the best, replace it, again."""
    parts = [
        COUNTED.replace("FROM documents)", f"FROM {docs})"),
        BASE,
        f"s0 AS (SELECT {coded('segment')} AS coded, n FROM cnt)",
        "v0 AS (SELECT id, token FROM base)",
    ]
    for k in range(n_merges):
        new = 103 + k
        parts += [
            f"p{k} AS (SELECT l, r, sum(n) AS n FROM (SELECT unnest(c[1:len(c)-1]) AS l, unnest(c[2:len(c)]) AS r, n "
            f"FROM (SELECT string_split(coded, '') AS c, n FROM s{k})) GROUP BY l, r)",
            f"b{k} AS MATERIALIZED (SELECT l, r, unicode(l) - {IDS} AS left_id, unicode(r) - {IDS} AS right_id "
            f"FROM p{k} ORDER BY n DESC, left_id, right_id LIMIT 1)",
            f"s{k + 1} AS MATERIALIZED (SELECT replace(coded, (SELECT l || r FROM b{k}), chr({IDS + new})) AS coded, n "
            f"FROM s{k})",
            f"v{k + 1} AS (SELECT id, token FROM v{k} UNION ALL SELECT {new}, "
            f"(SELECT token FROM v{k} WHERE id = left_id) || (SELECT token FROM v{k} WHERE id = right_id) FROM b{k})",
        ]
    return ", ".join(parts)


def merge_rows(n_merges: int) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({k} AS INTEGER) AS rank, CAST(left_id AS INTEGER) AS left_id, "
        f"CAST(right_id AS INTEGER) AS right_id, CAST({103 + k} AS INTEGER) AS new_id FROM b{k}"
        for k in range(n_merges)
    )


def vocab_rows(n_merges: int) -> str:
    return (
        f"SELECT token, CAST(id AS INTEGER) AS id, id < 3 AS is_special FROM v{n_merges}"
    )


M = q.SMALL_MERGES
BENCHMARK = "(SELECT item_id AS doc_id, text FROM benchmark)"
TRAINED = training(M)


def with_merges(text: str) -> str:
    out = coded(text)
    for k in range(M):
        out = f"replace({out}, (SELECT l || r FROM b{k}), chr({IDS + 103 + k}))"
    return out


def stream_sql(width: int, group: str = "", text: str = "clean_text", token: str | None = None) -> str:
    """Blocks of the ids of `docs`, one id per character of `text`, in document order per group."""
    token = token or id_of("c")
    part = f"PARTITION BY {group} " if group else ""
    lead = f"{group}, " if group else ""
    return (
        f"flat AS (SELECT {lead}doc_id, unnest(string_split({text}, '')) AS c, "
        f"unnest(range(len({text}))) AS place FROM docs), "
        f"pos AS (SELECT {lead}CAST({token} AS INTEGER) AS id, "
        f"row_number() OVER ({part}ORDER BY doc_id, place) - 1 AS p FROM flat), "
        f"blocks AS (SELECT {lead}p // {width} AS block_id, list(id ORDER BY p) AS chunk FROM pos "
        f"GROUP BY {lead}p // {width} HAVING count(*) = {width})"
    )


def ids_out(expr: str, name: str) -> str:
    return f"array_to_string({expr}, ',') AS {name}"


X_Y = f"{ids_out('chunk[1:len(chunk)-1]', 'x')}, {ids_out('chunk[2:len(chunk)]', 'y')}"
ALL_DOCS = f"{ENDED}, docs AS (SELECT * FROM ended)"
PACKED = f"{ALL_DOCS}, {stream_sql(q.BLOCK + 1)}"
INDEXED = "idx AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_idx FROM documents)"
LANED = (
    f"{ENDED}, {INDEXED}, docs AS (SELECT ended.*, CAST(doc_idx % {q.LANES} AS INTEGER) AS lane "
    f"FROM ended JOIN idx USING (doc_id)), {stream_sql(q.BLOCK + 1, 'lane')}"
)
SIDED = (
    f"{ENDED}, {INDEXED}, docs AS (SELECT ended.*, CASE WHEN doc_idx < {q.TAKE} THEN 'val' ELSE 'train' END AS split "
    "FROM ended JOIN idx USING (doc_id))"
)


def eval_sql() -> str:
    """Adjacent ids within blocks, and the add-one smoothed scores of the train side."""
    return (
        f"{SIDED}, {stream_sql(q.EVAL_BLOCK + 1, 'split')}, "
        f"pairs AS (SELECT split, block_id // {q.BATCH} AS batch_id, unnest(chunk[1:len(chunk)-1]) AS ctx, "
        "unnest(chunk[2:len(chunk)]) AS next_id FROM blocks), "
        "c AS (SELECT ctx, next_id, count(*) AS c FROM pairs WHERE split = 'train' GROUP BY ctx, next_id), "
        "t AS (SELECT ctx, sum(c) AS t FROM c GROUP BY ctx), "
        "scores AS (SELECT ctx, next_id, ln((c + 1) / (t + 103)) AS score FROM c JOIN t USING (ctx))"
    )


def one_rule(field: str) -> str:
    return f"SELECT p_partkey AS doc_id, {column_sql(field)} AS text FROM part WHERE p_partkey % {len(TEMPLATES)} <> 4"


def _numbers(field: str) -> str:
    return f"CAST({case_sql([str(getattr(t, field)) for t in TEMPLATES])} AS INTEGER)"


def _restored() -> str:
    return case_sql(
        ["''" if not t.lexed else text_sql(t.source and t.source.replace("é", "?").replace("😀", "?")) for t in TEMPLATES]
    )


NOT_NULL = f"p_partkey % {len(TEMPLATES)} <> 4"
CLEAN_CODE = f"WITH {CODE} SELECT doc_id, clean_text FROM code WHERE content IS NOT NULL"
MARKED = r"replace(replace(clean_text, '<SCOPE_IN>', chr(1) || '<SCOPE_IN>' || chr(1)), '<SCOPE_OUT>', chr(1) || '<SCOPE_OUT>' || chr(1))"
BARE = "replace(replace(clean_text, '<SCOPE_IN>', ''), '<SCOPE_OUT>', '')"


def code_dropped(chance: float) -> str:
    split = "list_filter(string_split(clean_text, chr(10)), lambda l: l <> '')"
    return (
        f"WITH {CODE} SELECT doc_id, {joined(kept_lines(split, 'doc_id', chance))} AS clean_text "
        "FROM code WHERE content IS NOT NULL"
    )


def oracle() -> dict[str, str]:
    prose_rows = f"WITH {PROSE} SELECT doc_id, clean_text FROM clean"
    ended_rows = f"WITH {ENDED} SELECT doc_id, clean_text FROM ended"
    vocab = f"WITH {TRAINED} {vocab_rows(M)}"
    encoded = f"WITH {TRAINED}, {ENDED.removeprefix(PROSE + ', ')} SELECT doc_id, {id_text(with_merges('clean_text'))} AS ids FROM ended"
    laned = f"WITH {LANED} SELECT lane, block_id, {X_Y} FROM blocks"
    marker_or_char = f"CASE WHEN c IN (chr(1), chr(2)) THEN ascii(c) ELSE {id_of('c')} END"
    small_first = training(M, f"(SELECT * FROM documents ORDER BY doc_id LIMIT {q.TAKE})")
    return {
        "scan_corpus": "SELECT doc_id, text AS content FROM documents",
        "scan_language": "SELECT doc_id, text AS content FROM documents WHERE lang = 'en'",
        "take_docs": f"SELECT doc_id, text AS content FROM documents ORDER BY doc_id LIMIT {q.TAKE}",
        "skip_docs": f"SELECT doc_id, text AS content FROM documents ORDER BY doc_id OFFSET {q.TAKE}",
        "write_clean_text": f"WITH {PROSE} SELECT unnest(string_split(clean_text, chr(10))) AS line FROM clean",
        "write_clean_code": f"WITH {CODE} SELECT unnest(string_split(clean_text, chr(10))) AS line FROM code "
        "WHERE content IS NOT NULL",
        "read_source_files": CLEAN_CODE,
        "save_tokenizer": f"WITH {TRAINED} {merge_rows(M)}",
        "load_tokenizer": vocab,
        "reuse_clean_corpus": prose_rows,
        "refresh_corpus": f"SELECT p.*, d.lang IS NOT DISTINCT FROM 'de' OR (d.lang = 'fr') IS TRUE AS fresh "
        f"FROM ({prose_rows}) p JOIN documents d USING (doc_id)",
        "sanitize_text": f"SELECT doc_id, {sanitized('text')} AS content FROM documents",
        "sanitize_pages": f"SELECT page_id AS doc_id, {sanitized('html')} AS content FROM pages",
        "lex_documents": "SELECT p_partkey AS doc_id, "
        f"{case_sql([str(t.lexed).lower() for t in TEMPLATES])} AS lex_ok, "
        f"{_numbers('comments')} AS n_comment, {_numbers('indents')} AS n_indent, {_numbers('indents')} AS n_dedent, "
        f"{_numbers('strings')} AS n_string, {case_sql([repr(t.doc_lines) for t in TEMPLATES])} AS doc_lines, "
        f"{_restored()} AS restored FROM part WHERE {NOT_NULL}",
        "strip_comments": one_rule("no_comments"),
        "mark_scopes": one_rule("scoped"),
        "strip_docstrings": one_rule("no_docstrings"),
        "insert_pass": one_rule("passed"),
        "join_lexemes": one_rule("clean"),
        "normalize_lines": f"WITH l AS (SELECT doc_id, {lines(sanitized('text'))} AS ls FROM documents) "
        "SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS line_no, unnest(ls) AS line FROM l",
        "import_dropout": f"WITH {CODE} SELECT doc_id, "
        f"{joined(kept_lines(lines(sanitized('content')), 'doc_id', 0.5))} AS text FROM code WHERE content IS NOT NULL",
        "clean_corpus": CLEAN_CODE,
        "clean_corpus_dropout": code_dropped(0.5),
        "clean_corpus_no_imports": code_dropped(1.0),
        "clean_documents": "SELECT doc_id, "
        + joined(lines(rf"regexp_replace({sanitized('text')}, '#[^\n]*', '', 'g')"))
        + " AS clean_text FROM documents",
        "drop_empty_docs": f"{CLEAN_CODE} AND clean_text <> ''",
        "append_eos": ended_rows,
        "clean_audit": f"WITH {CODE} SELECT CASE WHEN content IS NULL THEN 'null' WHEN NOT lex_ok THEN 'lexer_failed' "
        "WHEN clean_text = '' THEN 'empty' ELSE 'ok' END AS status, count(*) AS docs, "
        "CAST(sum(coalesce(length(clean_text), 0)) AS BIGINT) AS chars FROM code GROUP BY 1",
        "segment_corpus": f"WITH {SEGMENTS} SELECT segment FROM seg",
        "segment_isolated": f"WITH {CODE}, piece AS (SELECT unnest(string_split({MARKED} || chr(10), chr(1))) AS piece "
        "FROM code WHERE content IS NOT NULL), cut AS (SELECT unnest(regexp_extract_all(piece, '\\n|[^\\n]+')) AS segment "
        "FROM piece) SELECT segment FROM cut",
        "segment_counts": f"WITH {COUNTED} SELECT segment, n FROM cnt",
        "base_vocab": f"WITH {PROSE}, {BASE}, used AS (SELECT c AS token, count(*) AS n FROM "
        "(SELECT unnest(string_split(clean_text, '')) AS c FROM clean) WHERE c <> '' GROUP BY c) "
        "SELECT token, CAST(id AS INTEGER) AS id, id < 3 AS is_special, coalesce(n, 0) AS n "
        "FROM base LEFT JOIN used USING (token)",
        "pair_counts": f"WITH {training(1)} SELECT CAST(unicode(l) - {IDS} AS INTEGER) AS left_id, "
        f"CAST(unicode(r) - {IDS} AS INTEGER) AS right_id, CAST(n AS BIGINT) AS n FROM p0",
        "best_pair": f"WITH {training(1)} SELECT CAST(unicode(l) - {IDS} AS INTEGER) AS left_id, "
        f"CAST(unicode(r) - {IDS} AS INTEGER) AS right_id, CAST(n AS BIGINT) AS n FROM p0 "
        "ORDER BY n DESC, left_id, right_id LIMIT 20",
        "apply_merge": f"WITH {training(1)} SELECT coded, n FROM s1",
        "train_bpe": vocab,
        "train_bpe_merges": f"WITH {TRAINED} {merge_rows(M)}",
        "train_bpe_benchmark": f"WITH {training(q.BENCHMARK_MERGES, BENCHMARK)} {merge_rows(q.BENCHMARK_MERGES)}",
        "build_tokenizer": f"WITH {small_first} {merge_rows(M)}",
        "vocab_lookup": f"WITH {TRAINED}, {ENDED.removeprefix(PROSE + ', ')}, seen AS (SELECT DISTINCT c AS token FROM "
        "(SELECT unnest(string_split(clean_text, '')) AS c FROM ended) UNION ALL SELECT "
        "(SELECT token FROM base WHERE id = left_id) || (SELECT token FROM base WHERE id = right_id) FROM "
        f"(SELECT unicode(l) - {IDS} AS left_id, unicode(r) - {IDS} AS right_id FROM p0 "
        "ORDER BY n DESC, left_id, right_id LIMIT 20)) "
        f"SELECT token, CAST(id AS INTEGER) AS id FROM seen LEFT JOIN v{M} USING (token)",
        "special_tokens": f"WITH {TRAINED} SELECT token, CAST(id AS INTEGER) AS id, id < 3 AS is_special "
        f"FROM v{M} WHERE starts_with(token, '<') AND ends_with(token, '>')",
        "split_specials": f"WITH {CODE}, cut AS (SELECT doc_id, list_filter(flatten(list_transform("
        f"string_split({MARKED}, chr(1)), lambda s: regexp_extract_all(s, {UNITS}))), lambda s: s <> '') AS units "
        "FROM code WHERE content IS NOT NULL) SELECT doc_id, CAST(unnest(range(len(units))) AS INTEGER) AS pos, "
        "unnest(units) AS unit FROM cut",
        "encode_chars": f"WITH {ENDED} SELECT doc_id, {id_text(coded('clean_text'))} AS ids FROM ended",
        "encode_corpus": encoded,
        "encode_pieces": f"WITH {TRAINED}, {ENDED.removeprefix(PROSE + ', ')}, "
        f"c AS (SELECT doc_id, string_split({with_merges('clean_text')}, '') AS c FROM ended), "
        f"flat AS (SELECT doc_id, unnest(range(len(c))) AS place, unicode(unnest(c)) - {IDS} AS id FROM c) "
        f"SELECT doc_id, string_agg(token, '|' ORDER BY place) AS pieces FROM flat JOIN v{M} USING (id) GROUP BY doc_id",
        "encode_markers": f"WITH {TRAINED}, {CODE} SELECT doc_id, {id_text(with_merges(one_char_markers('clean_text')))} "
        "AS ids FROM code WHERE content IS NOT NULL",
        "unk_tokens": f"WITH {BASE}, used AS (SELECT c AS ch, count(*) AS n FROM "
        "(SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c) "
        "SELECT ch, n, CAST(coalesce(id, 0) AS INTEGER) AS id FROM used LEFT JOIN base ON ch = token",
        "decode_tokens": f"WITH {ENDED} SELECT doc_id, clean_text AS text FROM ended",
        "decode_code": f"WITH {CODE} SELECT doc_id, {BARE} AS text FROM code WHERE content IS NOT NULL",
        "doc_index": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_idx FROM documents",
        "doc_offsets": f"WITH {ENDED} SELECT doc_id, CAST(length(clean_text) AS INTEGER) AS n_tokens, "
        "CAST(coalesce(sum(length(clean_text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
        "AS BIGINT) AS \"offset\" FROM ended",
        "pack_blocks": f"WITH {PACKED} SELECT block_id, {ids_out('chunk', 'chunk')} FROM blocks",
        "doc_offsets_sparse": f"WITH {ENDED} SELECT doc_id * doc_id * 1000003 - 5000000 AS doc_id, "
        "CAST(length(clean_text) AS INTEGER) AS n_tokens, "
        "CAST(coalesce(sum(length(clean_text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
        "AS BIGINT) AS \"offset\" FROM ended",
        "pack_blocks_sparse": f"WITH {PACKED} SELECT block_id, {ids_out('chunk', 'chunk')} FROM blocks",
        "pack_conversations": f"WITH docs AS (SELECT doc_id, clean_text || ' <|endoftext|>' AS clean_text FROM "
        f"(SELECT row_number() OVER (ORDER BY conv_id, turn) AS doc_id, {joined(lines(sanitized('text')))} AS clean_text "
        f"FROM conversations) WHERE clean_text <> ''), {stream_sql(q.EVAL_BLOCK + 1)} "
        f"SELECT block_id, {ids_out('chunk', 'chunk')} FROM blocks",
        "pack_lanes_code": f"WITH {CODE}, docs AS (SELECT doc_id, lane, {one_char_markers('clean_text')} || "
        f"' <|endoftext|>' AS clean_text FROM (SELECT *, CAST((row_number() OVER (ORDER BY doc_id) - 1) % {q.LANES} "
        "AS INTEGER) AS lane FROM code) WHERE content IS NOT NULL AND clean_text <> ''), "
        f"{stream_sql(q.EVAL_BLOCK + 1, 'lane', token=marker_or_char)} SELECT lane, block_id, {X_Y} FROM blocks",
        "encode_eos_special": f"WITH {ENDED} SELECT doc_id, "
        f"{id_text(coded('left(clean_text, length(clean_text) - 13)'))} || ',103' AS ids FROM ended",
        "shift_targets": f"WITH {PACKED} SELECT block_id, {X_Y} FROM blocks",
        "batch_blocks": f"WITH {PACKED} SELECT block_id // {q.BATCH} AS batch_id, count(*) AS examples, "
        "CAST(sum(list_sum(chunk)) AS BIGINT) AS id_sum FROM blocks GROUP BY 1",
        "pack_lanes": laned,
        "split_train_val": f"WITH {SIDED}, {stream_sql(q.BLOCK + 1, 'split')} SELECT split, "
        f"block_id // {q.BATCH} AS batch_id, block_id, {X_Y} FROM blocks",
        "training_blocks": f"WITH {TRAINED}, {ENDED.removeprefix(PROSE + ', ')}, {INDEXED}, docs AS (SELECT doc_id, "
        f"{with_merges('clean_text')} AS coded, CASE WHEN doc_idx < {q.TAKE} THEN 'val' ELSE 'train' END AS split "
        f"FROM ended JOIN idx USING (doc_id)), {stream_sql(q.BLOCK + 1, 'split', 'coded', f'unicode(c) - {IDS}')} "
        f"SELECT split, block_id // {q.BATCH} AS batch_id, block_id, {X_Y} FROM blocks",
        "stream_clean": ended_rows,
        "stream_encode": encoded,
        "stream_pack": laned,
        "topk_renormalize": f"WITH {eval_sql()}, kept AS (SELECT * FROM scores QUALIFY rank() OVER "
        "(PARTITION BY ctx ORDER BY score DESC) <= 10), w AS (SELECT *, exp(score / 0.8) AS w FROM kept) "
        "SELECT ctx, next_id, round(score, 6) AS score, round(w / sum(w) OVER (PARTITION BY ctx), 6) AS prob FROM w",
        "sample_next": f"WITH {eval_sql()}, kept AS (SELECT * FROM scores QUALIFY rank() OVER "
        "(PARTITION BY ctx ORDER BY score DESC) <= 10), w AS (SELECT *, exp(score / 0.8) AS w FROM kept), "
        "p AS (SELECT ctx, next_id, score, w / sum(w) OVER (PARTITION BY ctx) AS prob, unnest(range(3)) AS draw FROM w), "
        "u AS (SELECT *, (CAST('0x' || substr(md5(concat_ws('|', '0', CAST(ctx AS VARCHAR), CAST(draw AS VARCHAR), "
        "CAST(next_id AS VARCHAR))), 1, 8) AS BIGINT) + 0.5) / 4294967296.0 AS u FROM p) "
        "SELECT ctx, CAST(draw AS INTEGER) AS draw, next_id, round(prob, 6) AS prob FROM u "
        "QUALIFY row_number() OVER (PARTITION BY ctx, draw ORDER BY score / 0.8 - ln(-ln(u)) DESC, next_id) = 1",
        "heal_prompts": r"WITH l AS (SELECT doc_id, text, least(length(text), length(regexp_extract(text, "
        r"'^[\x09-\x0d\x20-\x7e]*')), "
        + ", ".join(
            f"CASE WHEN instr(text, '{s}') > 0 THEN instr(text, '{s}') + {len(s) - 2} ELSE length(text) END"
            for s in ("<UNK>", "<SCOPE_IN>", "<SCOPE_OUT>")
        )
        + r") AS k FROM documents WHERE text IS NOT NULL), c AS (SELECT *, CASE WHEN regexp_full_match(substr(text, k + 1), "
        r"'[\x09-\x0d\x20-\x7e]') THEN k - 1 ELSE k END AS cut FROM l) "
        "SELECT doc_id, CAST(cut AS INTEGER) AS n_healed, md5(substr(text, cut + 1)) AS tail_md5 FROM c",
        "topk_exact": f"WITH {eval_sql()} SELECT ctx, next_id, round(score, 6) AS score, "
        "CAST(row_number() OVER (PARTITION BY ctx ORDER BY score DESC, next_id) AS INTEGER) AS place FROM scores "
        "QUALIFY place <= 5",
        "prune_beams": f"WITH {eval_sql()}, top AS (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY score DESC, "
        "next_id) AS place FROM scores QUALIFY place <= 5), two AS (SELECT a.ctx AS prompt, a.next_id AS beam, b.next_id, "
        "round(a.score + b.score, 6) AS logp FROM top a JOIN top b ON a.next_id = b.ctx) SELECT *, CAST(row_number() OVER "
        "(PARTITION BY prompt ORDER BY logp DESC, beam, next_id) AS INTEGER) AS place FROM two QUALIFY place <= 5",
        "heldout_loss": f"WITH {eval_sql()}, scored AS (SELECT batch_id, coalesce(score, ln(1 / (coalesce(t, 0) + 103))) AS logp "
        "FROM pairs LEFT JOIN scores USING (ctx, next_id) LEFT JOIN t USING (ctx) WHERE split = 'val'), "
        f"per AS (SELECT batch_id, avg(-logp) AS loss FROM scored WHERE batch_id < {q.EVAL_BATCHES} GROUP BY batch_id) "
        "SELECT round(avg(loss), 6) AS loss, count(*) AS batches FROM per",
    }
