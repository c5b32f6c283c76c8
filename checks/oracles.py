"""The same results stated in SQL for DuckDB, sharing fixed tables of values with the library
but no logic.

Chunking is a recursive walk over lines, vectors are word counts by hash bucket,
search is a comparison of every pair, and path rules test one path segment at a
time.
"""

from checks.tables import DIM, FOLDERS, NAMES
from shelfmark.functions.globs import DEFAULT_EXCLUDES
from shelfmark.functions.paths import LANGUAGES
from shelfmark.functions.text import WHITESPACE

ORACLES = {}

SPACE = "(" + " || ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"


def _quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# -- shared pieces -------------------------------------------------------------

_KIND = f"(doc_id % {len(NAMES)})::BIGINT"
_FOLDER = f"((doc_id // {len(NAMES)}) % {len(FOLDERS)})::BIGINT"
PATH = (
    f"({_quoted(FOLDERS)}[{_FOLDER} + 1] || {_quoted(a for a, _ in NAMES)}[{_KIND} + 1] || doc_id "
    f"|| {_quoted(b for _, b in NAMES)}[{_KIND} + 1])"
)
FILES = f"""files AS (
  SELECT doc_id, source AS codebase_name, {PATH} AS file_path, text,
         strlen(text)::BIGINT AS size_bytes
  FROM documents)"""
PAGE_PATHS = (
    "page_paths AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1) AS path FROM pages)"
)
BYTES = f"""raw AS (
  SELECT doc_id, source, {PATH} AS file_path, text,
    CASE doc_id % 7
      WHEN 0 THEN '\\x00'::BLOB || encode(text)
      WHEN 1 THEN encode(text) || '\\xE9\\x0D\\x0A\\x0D'::BLOB
      WHEN 2 THEN ''::BLOB
      WHEN 3 THEN encode(replace(text, chr(10), chr(13) || chr(10)))
      WHEN 4 THEN encode(repeat('a', 1023) || 'é' || text)
      ELSE encode(text) END AS content
  FROM documents)"""


def _name(path: str) -> str:
    return f"string_split({path}, '/')[-1]"


def _extension(path: str) -> str:
    """Suffix by string functions: what follows the last dot, if both sides are non-empty."""
    name = _name(path)
    after = f"string_split({name}, '.')[-1]"
    return (
        f"(CASE WHEN contains({name}, '.') AND {after} <> '' "
        f"AND length({name}) > length({after}) + 1 THEN '.' || {after} ELSE '' END)"
    )


def _language(ext: str) -> str:
    cases = " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in LANGUAGES.items())
    return f"(CASE lower({ext}) {cases} ELSE 'unknown' END)"


def _row_id(name: str, path: str) -> str:
    return f"left(sha256({name} || ':' || {path}), 16)"


def _chunk_ctes(source: str, keys: str, text: str, budget: int) -> str:
    """CTEs ending in ``chunks(keys, content, start_line, end_line, chunk_index, total_chunks)``."""
    on = " AND ".join(f"p.{k.strip()} = w.{k.strip()}" for k in keys.split(","))
    pk = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    return f"""
src AS MATERIALIZED (SELECT {keys}, {text} AS t FROM {source}),
lines AS MATERIALIZED (
  SELECT {keys}, ln, line || chr(10) AS t FROM (
    SELECT {keys}, unnest(string_split(t, chr(10))) AS line,
           generate_subscripts(string_split(t, chr(10)), 1)::INT AS ln
    FROM src WHERE length(t) > {budget})),
cuts AS (
  SELECT {keys}, ln, 0 AS pno, '' AS piece, t AS rest FROM lines WHERE length(t) > {budget}
  UNION ALL
  SELECT {keys}, ln, pno + 1, left(rest, n), substr(rest, n + 1) FROM (
    SELECT *, CASE
        WHEN length(rest) <= {budget} THEN length(rest)
        WHEN length(regexp_extract(left(rest, {budget}), '(?s)^(.*) ', 1)) > {budget} * 0.5
          THEN length(regexp_extract(left(rest, {budget}), '(?s)^(.*) ', 1)) + 1
        ELSE {budget} END AS n
    FROM cuts WHERE rest <> '')),
pieces AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ln, pno) AS seq FROM (
    SELECT {keys}, ln, 1 AS pno, t, false AS cut FROM lines WHERE length(t) <= {budget}
    UNION ALL
    SELECT {keys}, ln, pno, piece, true FROM cuts WHERE pno > 0)),
walk AS (
  SELECT {keys}, seq, 0 AS chunk, length(t) AS filled, cut FROM pieces WHERE seq = 1
  UNION ALL
  SELECT {pk}, p.seq,
         w.chunk + CASE WHEN p.cut OR w.cut OR w.filled + length(p.t) > {budget} THEN 1 ELSE 0 END,
         CASE WHEN p.cut OR w.cut OR w.filled + length(p.t) > {budget}
              THEN length(p.t) ELSE w.filled + length(p.t) END,
         p.cut
  FROM walk w JOIN pieces p ON {on} AND p.seq = w.seq + 1),
joined AS (
  SELECT {pk}, w.chunk, trim(string_agg(p.t, '' ORDER BY p.seq), {SPACE}) AS content,
         min(p.ln) AS start_line, max(p.ln) AS end_line
  FROM walk w JOIN pieces p ON {on} AND p.seq = w.seq GROUP BY ALL),
chunks AS MATERIALIZED (
  SELECT {keys}, content, start_line::INT AS start_line, end_line::INT AS end_line,
         chunk::INT AS chunk_index, (count(*) OVER (PARTITION BY {keys}))::INT AS total_chunks
  FROM joined
  UNION ALL
  SELECT {keys}, t, 1, len(string_split(t, chr(10)))::INT, 0, 1
  FROM src WHERE length(t) <= {budget})"""


def _vector_ctes(name: str, source: str, keys: str, text: str, dim: int = DIM) -> str:
    """CTEs ``<name>_sparse(keys, bucket, weight)`` and ``<name>(keys, v)``, zero vectors included."""
    cut = f"CASE WHEN length({text}) / 1.5 > 409.6 THEN left({text}, 537) ELSE {text} END"
    return f"""
{name}_words AS (
  SELECT {keys}, unnest(regexp_extract_all(lower({cut}), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {source}),
{name}_sums AS (
  SELECT {keys}, ('0x' || substr(md5(w), 1, 7))::BIGINT % {dim} AS bucket,
         sum(1 - 2 * (('0x' || substr(md5(w), 8, 1))::BIGINT % 2)) AS s
  FROM {name}_words GROUP BY ALL),
{name}_norms AS (SELECT {keys}, sqrt(sum(s * s)::DOUBLE) AS n FROM {name}_sums GROUP BY ALL),
{name}_sparse AS MATERIALIZED (
  SELECT {keys}, bucket::INT AS bucket, (s / n)::FLOAT AS weight
  FROM {name}_sums JOIN {name}_norms USING ({keys}) WHERE s <> 0),
{name} AS MATERIALIZED (
  SELECT {keys}, list(coalesce(weight, 0)::DOUBLE ORDER BY bucket) AS v
  FROM (SELECT {keys} FROM {source}) CROSS JOIN (SELECT unnest(range({dim}))::INT AS bucket)
  LEFT JOIN {name}_sparse USING ({keys}, bucket) GROUP BY {keys})"""


def _sum(expression: str, a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: {expression}))"


def _distance(a: str, b: str, metric: str = "l2") -> str:
    x, y = "p[1]::DOUBLE", "p[2]::DOUBLE"
    if metric == "l2":
        return f"({_sum(f'({x} - {y}) * ({x} - {y})', a, b)})::FLOAT::DOUBLE"
    inner = _sum(f"{x} * {y}", a, b)
    if metric == "cosine":
        sizes = f"(sqrt({_sum(f'{x} * {y}', a, a)}) * sqrt({_sum(f'{x} * {y}', b, b)}))"
        inner = f"coalesce({inner} / nullif({sizes}, 0), 0)"
    return f"(1 - ({inner})::FLOAT::DOUBLE)"


_SCORES = "round(d, 6) AS distance, round(1 / (1 + d), 6) AS similarity"


# -- vector search -------------------------------------------------------------

_FIRST = "(SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)"
_FROM_FIRST = (
    f"SELECT vec_id, label, {_distance('embedding', 'q')} AS d FROM embeddings CROSS JOIN {_FIRST}"
)

ORACLES["knn_single"] = (
    f"SELECT vec_id, label, {_SCORES} FROM ({_FROM_FIRST} ORDER BY d, vec_id LIMIT 5)"
)
ORACLES["knn_filtered"] = (
    f"SELECT vec_id, label, {_SCORES} FROM ({_FROM_FIRST} WHERE label = 1 ORDER BY d, vec_id LIMIT 5)"
)
ORACLES["threshold_nan"] = (
    f"SELECT vec_id, label, {_SCORES} FROM ({_FROM_FIRST}) WHERE vec_id % 7 > 3 AND 1 / (1 + d) >= 0.38"
)
ORACLES["knn_dot_scaled"] = f"""WITH scaled AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: (x * (vec_id % 5)::FLOAT)::FLOAT) AS e,
    (SELECT list_transform(q, lambda x: 3 * x::DOUBLE) FROM {_FIRST}) AS q FROM embeddings),
nearest AS (SELECT vec_id, label, {_distance('e', 'q', 'dot')} AS d FROM scaled ORDER BY d, vec_id LIMIT 40),
graded AS (SELECT *, CASE WHEN d < 0 THEN 1 - d ELSE 1 / (1 + d) END AS s FROM nearest)
SELECT vec_id, label, round(d, 6) AS distance, round(s, 6) AS similarity FROM graded WHERE s >= 0.5"""
ORACLES["degenerate_vectors"] = """WITH made AS (
  SELECT label, CASE vec_id % 10 WHEN 0 THEN list_transform(embedding, lambda x: 0::FLOAT)
    WHEN 1 THEN list_transform(embedding, lambda x: 0.25::FLOAT)
    WHEN 2 THEN list_transform(range(len(embedding)), lambda i: i::FLOAT) ELSE embedding END AS v FROM embeddings)
SELECT label, count(v) AS vectors, count(*) FILTER (list_min(v) = 0 AND list_max(v) = 0) AS zero,
  count(*) FILTER (list_max(v) - list_min(v) <= 1e-6 AND list_max(v) <> 0) AS near_constant,
  count(v) - count(DISTINCT v) AS repeated
FROM made GROUP BY label"""
ORACLES["knn_post_filter"] = (
    f"SELECT vec_id, label, {_SCORES} FROM ({_FROM_FIRST} ORDER BY d, vec_id LIMIT 40) WHERE label = 1"
)
ORACLES["knn_threshold"] = (
    f"SELECT vec_id, label, {_SCORES} FROM ({_FROM_FIRST} WHERE label = 1 ORDER BY d, vec_id LIMIT 5) "
    "WHERE 1 / (1 + d) >= 0.38"
)


def _all_pairs(metric: str = "l2", where: str = "true") -> str:
    return f"""SELECT q.vec_id AS query_id, e.vec_id, e.label, d,
  (row_number() OVER (PARTITION BY q.vec_id ORDER BY d, e.vec_id))::INT AS rank
FROM (SELECT q.vec_id, e.vec_id AS other, {_distance('e.embedding', 'q.embedding', metric)} AS d
      FROM embeddings q CROSS JOIN embeddings e WHERE {where}) AS q
JOIN embeddings e ON e.vec_id = q.other QUALIFY rank <= 5"""


ORACLES["knn_metrics"] = " UNION ALL ".join(
    f"SELECT query_id, rank, vec_id, {_SCORES}, '{m}' AS metric FROM ({_all_pairs(m)})"
    for m in ("l2", "cosine", "dot")
)
ORACLES["knn_batch"] = f"SELECT query_id, rank, vec_id, label, {_SCORES} FROM ({_all_pairs()})"
ORACLES["knn_batch_blocks"] = ORACLES["knn_batch"]
ORACLES["knn_batch_many"] = ORACLES["knn_batch"]
ORACLES["knn_batch_filtered"] = (
    f"SELECT query_id, rank, vec_id, label, {_SCORES} FROM ({_all_pairs(where='e.label < 3')})"
)

# -- chunking ------------------------------------------------------------------

_DOC_CHUNKS = _chunk_ctes("documents", "doc_id", "text", 537)
ORACLES["chunk_documents"] = f"WITH RECURSIVE {_DOC_CHUNKS} SELECT * FROM chunks"
ORACLES["chunk_documents_small"] = (
    f"WITH RECURSIVE {_chunk_ctes('documents', 'doc_id', 'text', 67)} SELECT * FROM chunks"
)
ORACLES["chunk_pages"] = (
    f"WITH RECURSIVE {_chunk_ctes('pages', 'page_id', 'html', 537)} SELECT * FROM chunks"
)
ORACLES["chunk_conversations"] = (
    f"WITH RECURSIVE {_chunk_ctes('conversations', 'conv_id, turn', 'text', 537)} SELECT * FROM chunks"
)
ORACLES["chunk_unsplit"] = """SELECT doc_id, text AS content, 1 AS start_line,
  (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS end_line,
  0 AS chunk_index, 1 AS total_chunks FROM documents"""
ORACLES["chunk_totals"] = f"""WITH RECURSIVE {_DOC_CHUNKS}
SELECT doc_id, count(*) AS chunks, count(*)::INT AS total_chunks,
  (count(*) - 1)::INT AS last_index, max(end_line) AS last_line FROM chunks GROUP BY doc_id"""

# -- embedding -----------------------------------------------------------------

ORACLES["embed_hash"] = f"""WITH RECURSIVE {_DOC_CHUNKS},
{_vector_ctes('vec', 'chunks', 'doc_id, chunk_index', 'content')}
SELECT doc_id, chunk_index, bucket, round(weight::DOUBLE, 6) AS weight FROM vec_sparse"""
ORACLES["embed_whole_text"] = f"""WITH
texts AS (SELECT doc_id, 'search_document: ' || text AS t FROM documents),
{_vector_ctes('vec', 'texts', 'doc_id', 't')}
SELECT doc_id, bucket, round(weight::DOUBLE, 6) AS weight FROM vec_sparse"""
ORACLES["embed_with_metadata"] = f"""WITH
texts AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 <> 1 THEN text ELSE '' END AS t FROM conversations),
{_vector_ctes('vec', 'texts', 'conv_id, turn', 't')}
SELECT conv_id, turn, role, true AS embed_ok, {DIM} AS dim,
  round(list_sum(list_transform(v, lambda x: x * x)), 4) AS squared_norm,
  len(list_filter(v, lambda x: x <> 0))::INT AS nonzero
FROM vec JOIN texts USING (conv_id, turn)"""
ORACLES["embed_placeholder"] = f"""SELECT vec_id, vec_id % 7 <> 0 AS embed_ok, {DIM} AS dim,
  round(CASE WHEN vec_id % 7 <> 0 THEN embedding[1]::DOUBLE ELSE 0 END, 6) AS first_entry
FROM embeddings"""

_BROKEN = """broken AS (
  SELECT vec_id, label, CASE vec_id % 7
    WHEN 0 THEN list_concat(['nan'::FLOAT], embedding[2:])
    WHEN 1 THEN list_concat(['-inf'::FLOAT], embedding[2:])
    WHEN 2 THEN embedding[2:]
    WHEN 3 THEN NULL
    ELSE embedding END AS v FROM embeddings)"""
ORACLES["vector_checks"] = f"""WITH {_BROKEN}
SELECT vec_id, len(v)::INT AS vector_length,
  len(list_filter(v, lambda x: isinf(x)))::INT AS inf_count,
  len(list_filter(v, lambda x: isnan(x)))::INT AS nan_count,
  v IS NULL OR len(v) <> {DIM} AS wrong_length,
  vec_id % 7 > 3 AS vector_ok,
  round(list_min(v)::DOUBLE, 6) AS vector_min, round(list_max(v)::DOUBLE, 6) AS vector_max
FROM broken"""
ORACLES["vector_quality"] = f"""WITH {_BROKEN} SELECT label, count(*) AS vectors,
  count(*) FILTER (vec_id % 7 > 3) AS valid,
  count(*) FILTER (vec_id % 7 IN (2, 3)) AS wrong_length,
  count(*) FILTER (vec_id % 7 = 1) AS with_inf,
  count(*) FILTER (vec_id % 7 = 0) AS with_nan,
  round(min(list_min(v))::DOUBLE, 6) AS smallest, round(max(list_max(v))::DOUBLE, 6) AS largest
FROM broken GROUP BY label"""
ORACLES["vector_repair"] = """SELECT label, 'drop' AS mode, count(*) FILTER (vec_id % 7 > 3) AS vectors,
  0::BIGINT AS zero_vectors FROM embeddings GROUP BY label HAVING vectors > 0
UNION ALL
SELECT label, 'zero', count(*), count(*) FILTER (vec_id % 7 <= 3) FROM embeddings GROUP BY label"""

# -- scalar functions ----------------------------------------------------------

ORACLES["path_parts"] = f"""WITH {FILES}, {PAGE_PATHS},
p AS (SELECT page_id AS row, path FROM page_paths
      UNION ALL SELECT (-1)::BIGINT, file_path FROM files)
SELECT row, path, {_extension('path')} AS extension,
  CASE WHEN {_extension('path')} = '' THEN 'no_extension' ELSE {_extension('path')} END AS extension_label,
  CASE WHEN starts_with(path, 'web/node_modules/') THEN right(path, -17) ELSE path END AS below_modules,
  '/srv/' || path AS absolute FROM p"""
ORACLES["language"] = (
    f"WITH {FILES} SELECT file_path, {_language(_extension('file_path'))} AS language FROM files"
)


def _iso(ts: str) -> str:
    return (
        f"CASE WHEN microsecond({ts}) % 1000000 = 0 THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') END"
    )


ORACLES["modified_iso"] = f"""SELECT event_id AS row, {_iso('ts')} AS iso FROM events
UNION ALL SELECT -o_orderkey, {_iso('o_orderdate')} FROM orders"""
ORACLES["row_id"] = f"""WITH {FILES}
SELECT codebase_name, file_path, {_row_id('codebase_name', 'file_path')} AS id,
  {_row_id('codebase_name', 'file_path')} || '-3' AS chunk_id FROM files"""


def _sanitized(name: str) -> str:
    """Runs of word characters and dashes, joined by one underscore."""
    return (
        "trim(array_to_string(list_filter(regexp_extract_all("
        f"lower({name}), '[\\p{{L}}\\p{{N}}\\-]+'), lambda s: s <> ''), '_'), '_')"
    )


ORACLES["sanitize_name"] = f"""WITH n AS (
  SELECT p_name || ' - ' || p_brand || ' - ' || p_type || '!' AS name FROM part
  UNION ALL SELECT text FROM documents)
SELECT {_sanitized('name')} AS sanitized, {_sanitized('name')} || '_rag' AS table_name FROM n"""
ORACLES["list_corpora"] = """SELECT DISTINCT 'my_rag_rag_' || lower(source) || '_rag' AS table_name,
  'my_rag_rag_' || lower(source) AS corpus FROM documents"""
ORACLES["truncate_context"] = """SELECT doc_id, round(length(text) / 1.5, 4) AS tokens,
  CASE WHEN length(text) > 614 THEN left(text, 537) ELSE text END AS cut_512,
  CASE WHEN length(text) > 1228 THEN 1075 ELSE length(text) END::INT AS length_1024,
  537 AS budget FROM documents"""
ORACLES["prefix_text"] = """SELECT item_id, 'search_query: ' || text AS as_query,
  'search_document: ' || text AS as_document, text AS as_is FROM benchmark"""
ORACLES["strip_text"] = f"""SELECT doc_id, trim(text, {SPACE}) AS stripped, true AS pad_is_blank,
  trim(text, {SPACE}) = '' AS text_is_blank FROM documents"""


def _label(path: str, start: str, end: str, index: str, total: str) -> str:
    return (
        f"({path} || ' (lines ' || {start} || '-' || {end} || CASE WHEN {total} > 1 "
        f"THEN ', chunk ' || ({index} + 1) || '/' || {total} ELSE '' END || ')')"
    )


def _blurred(name: str, default: int) -> str:
    return f"(CASE WHEN doc_id % 5 < 2 OR {name} = 0 THEN {default} ELSE {name} END)"


ORACLES["label_hits"] = f"""WITH RECURSIVE {_DOC_CHUNKS}
SELECT doc_id, chunk_index,
  {_label(PATH, 'start_line', 'end_line', 'chunk_index', 'total_chunks')} AS label,
  {_label(PATH, _blurred('start_line', 1), _blurred('end_line', 1), _blurred('chunk_index', 0), _blurred('total_chunks', 1))}
    AS blurred_label
FROM chunks"""
ORACLES["preview"] = """SELECT doc_id,
  CASE WHEN length(text) > 200 THEN left(text, 200) || chr(10) || '... (truncated)' ELSE text END AS cut,
  true AS zero_keeps, true AS none_keeps FROM documents"""
ORACLES["score_format"] = """SELECT l_orderkey, l_linenumber,
  printf('%.3f', l_discount + l_tax / 16) AS score,
  printf('%.2f', (l_discount + l_tax / 16) * 100) || '%' AS percent FROM lineitem"""

# -- filters -------------------------------------------------------------------

def _segment(path: str, *patterns: str) -> str:
    tests = " OR ".join(f"s GLOB '{p}'" for p in patterns)
    return f"(len(list_filter(string_split({path}, '/'), lambda s: {tests})) > 0)"


def _below(path: str, folder: str) -> str:
    return f"(starts_with({path}, '{folder}/') AND length({path}) > {len(folder) + 1})"


_BY_DEFAULT = _segment("file_path", *DEFAULT_EXCLUDES)
_BY_RULES = f"""(CASE
  WHEN {_segment('file_path', '*.un[!x]')} THEN true
  WHEN {_segment('file_path', '?[0-4]*.py')} THEN true
  WHEN {_below('file_path', 'docs')} THEN true
  WHEN {_below('file_path', 'a/b')} THEN false
  WHEN {_below('file_path', 'a')} THEN true
  WHEN file_path = 'src' OR {_below('file_path', 'src')} THEN true
  WHEN {_segment('file_path', 'keep*.log')} THEN false
  WHEN {_segment('file_path', '*.log')} THEN true
  ELSE false END)"""
_BY_EXTRA = f"({_segment('file_path', '*.vue')} OR {_below('file_path', 'web')})"

ORACLES["exclude_default"] = f"""WITH {FILES}, {PAGE_PATHS}
SELECT file_path FROM (SELECT file_path FROM files UNION ALL SELECT path FROM page_paths)
WHERE NOT {_BY_DEFAULT}"""
ORACLES["exclude_rules"] = f"WITH {FILES} SELECT file_path, {_BY_RULES} AS excluded FROM files"
ORACLES["exclude_additional"] = f"WITH {FILES} SELECT file_path, {_BY_EXTRA} AS excluded FROM files"
ORACLES["exclude_reason"] = f"""WITH {FILES} SELECT file_path,
  CASE WHEN {_BY_RULES} THEN 'gitignore' WHEN {_BY_DEFAULT} THEN 'default'
       WHEN {_BY_EXTRA} THEN 'additional' END AS reason FROM files"""
ORACLES["size_filter"] = f"""WITH {BYTES}, sized AS (SELECT doc_id, octet_length(content) AS n FROM raw)
SELECT doc_id, n BETWEEN 1 AND 3000 AS kept,
  CASE WHEN n = 0 THEN 'empty' WHEN n > 3000 THEN 'too_large' END AS size_status,
  n BETWEEN 1 AND 1000000 AS kept_by_default FROM sized"""

_TEXT_NAMES = _quoted("py html txt".split())
_TEXT_BY_NAME = (
    "list_contains(" + _TEXT_NAMES + ", lower(string_split(regexp_replace("
    f"{_name('file_path')}, '\\.gz$', ''), '.')[-1]))"
)
_HEAD_BINARY = "list_contains(regexp_extract_all(left(hex(content), 2048), '..'), '00')"
ORACLES["binary_sniff"] = f"""WITH {BYTES}
SELECT doc_id, NOT {_TEXT_BY_NAME} AND {_HEAD_BINARY} AS is_binary,
  {_HEAD_BINARY} AS head_is_binary, {_TEXT_BY_NAME} AS text_by_name FROM raw"""
_LATIN1 = (
    "array_to_string(list_transform(regexp_extract_all(hex(content), '..'), "
    "lambda h: chr(('0x' || h)::INT)), '')"
)
ORACLES["decode_text"] = f"""WITH {BYTES}
SELECT doc_id, CASE doc_id % 7
    WHEN 1 THEN regexp_replace({_LATIN1}, '\\r\\n?', chr(10), 'g')
    ELSE regexp_replace(decode(CASE WHEN doc_id % 7 = 1 THEN ''::BLOB ELSE content END), '\\r\\n?', chr(10), 'g')
  END AS text FROM raw"""
ORACLES["decode_marked"] = """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE chr(65279) END
  || regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM documents"""
ORACLES["decode_wide"] = """SELECT doc_id, text IS NULL OR doc_id % 4 = 3 AS is_binary,
  CASE WHEN doc_id % 4 < 3 THEN regexp_replace(text, '\\r\\n?', chr(10), 'g') END AS text FROM documents"""
ORACLES["extension_filter"] = f"""WITH {FILES}
SELECT file_path, '.py' AS extension, size_bytes FROM files
WHERE ends_with(file_path, '.py') AND size_bytes > 500"""
ORACLES["blank_queries"] = "SELECT item_id AS query_id, text AS query_text FROM benchmark"

# -- statistics ----------------------------------------------------------------

_FILE_CHUNKS = f"{FILES}, {_chunk_ctes('files', 'codebase_name, file_path', 'text', 537)}"
_EXT_CHUNKS = f"""ext_chunks AS (
  SELECT codebase_name, file_path, {_extension('file_path')} AS extension FROM chunks)"""

ORACLES["ext_counts"] = f"""WITH {FILES}
SELECT coalesce(nullif({_extension('file_path')}, ''), 'no_extension') AS extension, count(*) AS files
FROM files GROUP BY 1"""


def _corpus_stats(where: str = "true") -> str:
    return f"""WITH RECURSIVE {_FILE_CHUNKS}, {_EXT_CHUNKS},
by_ext AS (SELECT codebase_name, extension, count(*) AS n FROM ext_chunks GROUP BY ALL),
by_corpus AS (SELECT codebase_name, count(DISTINCT file_path) AS total_files, count(*) AS total_chunks
              FROM ext_chunks GROUP BY ALL)
SELECT codebase_name, codebase_name || '_rag' AS table_name, total_files, total_chunks,
  extension_distribution
FROM by_corpus JOIN (
  SELECT codebase_name, string_agg(extension || '=' || n, ',' ORDER BY extension) AS extension_distribution
  FROM by_ext GROUP BY ALL) USING (codebase_name) WHERE {where}"""


ORACLES["corpus_stats"] = _corpus_stats()
ORACLES["corpus_stats_store"] = f"""SELECT 'My App' AS codebase_name, 'my_app_rag' AS table_name,
  sum(total_files)::BIGINT AS total_files, sum(total_chunks)::BIGINT AS total_chunks, (
    SELECT string_agg(e || '=' || n, ',' ORDER BY e) FROM (
      SELECT split_part(x, '=', 1) AS e, sum(split_part(x, '=', 2)::BIGINT)::BIGINT AS n
      FROM (SELECT unnest(string_split(extension_distribution, ',')) AS x FROM ({_corpus_stats()})) GROUP BY e)
  ) AS extension_distribution FROM ({_corpus_stats()})
UNION ALL SELECT 'nothing_here', 'nothing_here_rag', 0, 0, ''"""
ORACLES["corpus_roundtrip"] = _corpus_stats("codebase_name <> 'src2'")
ORACLES["extension_counts"] = f"""WITH RECURSIVE {_FILE_CHUNKS}, {_EXT_CHUNKS}
SELECT codebase_name, extension, count(*) AS chunks FROM ext_chunks GROUP BY ALL"""
ORACLES["distinct_files"] = f"WITH {FILES} SELECT DISTINCT file_path FROM files"
ORACLES["row_count"] = f"WITH RECURSIVE {_FILE_CHUNKS} SELECT count(*) AS rows FROM chunks"
_DECODED = f"""CASE WHEN doc_id % 7 = 1 THEN regexp_replace({_LATIN1}, '\\r\\n?', chr(10), 'g')
    ELSE regexp_replace(decode(CASE WHEN doc_id % 7 = 1 THEN ''::BLOB ELSE content END),
                        '\\r\\n?', chr(10), 'g') END"""


def _statuses(largest: int, extra: str) -> str:
    """CTEs ``statuses`` (one row per file) and ``decoded`` (the texts of those kept)."""
    return f"""{BYTES},
statuses AS (
  SELECT doc_id, file_path, content, CASE
      WHEN {_BY_DEFAULT} OR {extra} THEN 'excluded'
      WHEN octet_length(content) = 0 THEN 'empty'
      WHEN octet_length(content) > {largest} THEN 'too_large'
      WHEN NOT {_TEXT_BY_NAME} AND {_HEAD_BINARY} THEN 'binary' ELSE 'ok' END AS status
  FROM raw),
decoded AS (
  SELECT doc_id, file_path, octet_length(content)::BIGINT AS size_bytes, {_DECODED} AS text
  FROM statuses WHERE status = 'ok')"""


ORACLES["run_stats"] = f"""WITH RECURSIVE {_statuses(3000, _segment('file_path', '*.vue'))},
{_chunk_ctes('decoded', 'doc_id', 'text', 537)}
SELECT count(*) FILTER (status <> 'excluded') AS total_files_found,
  count(*) FILTER (status = 'ok') AS files_processed,
  count(*) FILTER (status IN ('empty', 'too_large', 'binary')) AS files_skipped,
  0::BIGINT AS files_failed,
  (SELECT count(*) FROM chunks) AS chunks_created
FROM statuses"""

_REFUSED = "(length(content) % 5 = 0 AND regexp_matches(content, '\\S'))"
ORACLES["run_stats_failures"] = f"""WITH RECURSIVE {_FILE_CHUNKS},
counted AS (
  SELECT count(*) FILTER (chunk_index = 0 AND NOT {_REFUSED}) AS files_processed,
    count(*) FILTER (chunk_index = 0 AND {_REFUSED}) AS files_failed, count(*) AS chunks_created,
    count(*) FILTER ({_REFUSED}) AS chunks_failed, count(*) AS stored,
    count(*) FILTER ({_REFUSED} OR (regexp_matches(content, '\\S') AND NOT regexp_matches(content, '[\\p{{L}}\\p{{N}}_]'))) AS without_vector
  FROM chunks)
SELECT *, (SELECT count(*) FROM files) AS total_files_found,
  (SELECT count(*) FROM files) - files_processed - files_failed AS files_skipped FROM counted"""

# -- trees of files ------------------------------------------------------------

ORACLES["scan_tree"] = f"""WITH {BYTES}
SELECT file_path, octet_length(content)::BIGINT AS length, md5(content) AS digest FROM raw"""
ORACLES["walk_tree"] = f"""WITH {BYTES}
SELECT file_path, octet_length(content)::BIGINT AS length, true AS below_root FROM raw
WHERE NOT {_BY_DEFAULT} AND NOT {_BY_EXTRA}"""
ORACLES["walk_ignored"] = f"""WITH {BYTES}
SELECT file_path, octet_length(content)::BIGINT AS length FROM raw WHERE NOT {_BY_RULES} AND NOT {_BY_DEFAULT}"""
ORACLES["index_tree"] = f"""WITH RECURSIVE {_statuses(1000000, _BY_EXTRA)},
{_chunk_ctes('decoded', 'doc_id', 'text', 537)}
SELECT {_row_id("'The Tree'", 'file_path')} AS id, 'The Tree' AS codebase_name,
  'the_tree_rag' AS table_name, file_path, content, {_extension('file_path')} AS extension,
  size_bytes, {_language(_extension('file_path'))} AS language, start_line, end_line, chunk_index,
  total_chunks, {DIM} AS dim
FROM chunks JOIN (SELECT doc_id, file_path, size_bytes FROM decoded) USING (doc_id)"""

# -- store ---------------------------------------------------------------------

ORACLES["defaults_append"] = f"""SELECT
  CASE WHEN vec_id % 3 = 0 THEN 'given'
       ELSE {_row_id("'Vec Store'", "('v/' || vec_id || '.bin')")} END AS id,
  'Vec Store' AS codebase_name, 'v/' || vec_id || '.bin' AS file_path, '' AS absolute_path,
  CASE WHEN vec_id % 2 = 0 THEN 'body' ELSE '' END AS content, '' AS extension,
  0::BIGINT AS size_bytes, '' AS language,
  CASE WHEN vec_id % 5 = 0 THEN label ELSE 1 END::INT AS start_line, 1 AS end_line,
  0 AS chunk_index, 1 AS total_chunks, {DIM} AS dim, true AS has_time
FROM embeddings"""

ORACLES["corpus_catalog"] = f"""WITH RECURSIVE {_FILE_CHUNKS}
SELECT codebase_name AS corpus, true AS found, count(*) AS chunks, {DIM} AS dim
FROM chunks WHERE codebase_name <> 'src3' GROUP BY codebase_name
UNION ALL SELECT 'an_empty_one', true, 0, NULL"""

ORACLES["guarded_open"] = f"""WITH RECURSIVE {_FILE_CHUNKS},
sizes AS (SELECT codebase_name AS c, count(*) AS n FROM chunks GROUP BY 1)
SELECT name, found, NOT found AS refused, NOT found AS no_stats, CASE WHEN found THEN n ELSE 0 END AS chunks,
  0::BIGINT AS hits_of_missing
FROM (SELECT c AS name, true AS found, n FROM sizes UNION ALL SELECT upper(c), true, n FROM sizes
      UNION ALL SELECT c || ' missing', false, n FROM sizes)"""

_CORPUS = f"""{_FILE_CHUNKS},
corpus AS MATERIALIZED (
  SELECT {_row_id('codebase_name', 'file_path')} AS id, codebase_name, file_path, content,
    {_extension('file_path')} AS extension, size_bytes, start_line, end_line, chunk_index, total_chunks
  FROM chunks JOIN (SELECT codebase_name, file_path, size_bytes FROM files)
    USING (codebase_name, file_path))"""


def _corpus_vectors(text: str = "content") -> str:
    return f"""{_CORPUS},
texts AS (SELECT id, chunk_index, {text} AS t FROM corpus),
{_vector_ctes('vec', 'texts', 'id, chunk_index', 't')}"""


_DIGEST = "round(list_sum(list_transform(v, lambda x, i: x::DOUBLE * i)), 4) AS digest"
ORACLES["index_documents_rows"] = f"""WITH RECURSIVE {_corpus_vectors()}
SELECT id, codebase_name, file_path, file_path AS absolute_path, content, extension, size_bytes,
  {_language('extension')} AS language, start_line, end_line, chunk_index, total_chunks,
  {_DIGEST}
FROM corpus JOIN vec USING (id, chunk_index)"""
ORACLES["index_stream_rows"] = ORACLES["index_documents_rows"]

# -- questions to texts --------------------------------------------------------


def _hits(
    k: int, where: str = "true", metric: str = "l2", min_similarity: float = 0.001, prefix: bool = False
) -> str:
    """CTEs ending in ``hits``."""
    document = "CASE WHEN false THEN '' ELSE content END" if not prefix else "content"
    question = "'search_query: ' || text" if prefix else "text"
    return f"""{_corpus_vectors(document)},
asked AS (SELECT item_id AS query_id, {question} AS t FROM benchmark),
{_vector_ctes('qvec', 'asked', 'query_id', 't')},
pairs AS (
  SELECT query_id, id, chunk_index, {_distance('vec.v', 'qvec.v', metric)} AS d
  FROM qvec CROSS JOIN (SELECT id, chunk_index, v FROM vec JOIN corpus USING (id, chunk_index) WHERE {where}) AS vec),
hits AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY d, id, chunk_index))::INT AS rank
    FROM pairs QUALIFY rank <= {k}) JOIN corpus USING (id, chunk_index)
  WHERE 1 / (1 + d) >= {min_similarity})"""


_HIT_COLUMNS = f"""query_id, rank, id, file_path, extension, start_line, end_line, chunk_index,
  total_chunks, {_SCORES}"""
ORACLES["rag_query"] = f"WITH RECURSIVE {_hits(5)} SELECT {_HIT_COLUMNS} FROM hits"
ORACLES["rag_query_stored"] = ORACLES["rag_query"]
ORACLES["rag_query_failed"] = f"""WITH RECURSIVE {_hits(5)} SELECT {_HIT_COLUMNS} FROM hits JOIN benchmark ON item_id = query_id
WHERE (CASE WHEN length(text) / 1.5 > 409.6 THEN 537 ELSE length(text) END) % 5 <> 0"""


def _keyword_ctes(table: str, keys: str, text: str, k: int) -> str:
    """CTEs ending in ``bm25(query_id, keys, keyword_score, rank)``."""
    words = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
    return f"""
worded AS MATERIALIZED (SELECT {keys}, {words.format(text)} AS w FROM {table}),
sizes AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM worded),
counts AS MATERIALIZED (
  SELECT {keys}, term, any_value(size) AS size, count(*) AS c
  FROM (SELECT {keys}, len(w) AS size, unnest(w) AS term FROM worded) GROUP BY {keys}, term),
spread AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
wanted AS (SELECT DISTINCT item_id AS query_id, unnest({words.format("text")}) AS term FROM benchmark),
bm25 AS MATERIALIZED (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC, {keys}))::INT AS rank FROM (
    SELECT query_id, {keys}, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * c * 2.2
             / (c + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS keyword_score
    FROM counts JOIN spread USING (term) JOIN wanted USING (term) CROSS JOIN sizes GROUP BY query_id, {keys})
  QUALIFY rank <= {k})"""


ORACLES["keyword_search"] = f"WITH {_keyword_ctes('documents', 'doc_id', 'text', 10)} SELECT * FROM bm25"
ORACLES["keyword_indexed"] = ORACLES["keyword_search"]
ORACLES["hybrid_search"] = f"""WITH RECURSIVE {_hits(20)},
{_keyword_ctes('corpus', 'id, chunk_index', 'content', 20)},
both_ranks AS (
  SELECT query_id, id, chunk_index, h.rank AS vector_rank, b.rank AS keyword_rank,
    coalesce(1.0::DOUBLE / (60 + h.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS s
  FROM hits h FULL JOIN bm25 b USING (query_id, id, chunk_index))
SELECT query_id, id, chunk_index, vector_rank, keyword_rank, round(s, 9) AS score,
  (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id, chunk_index))::INT AS rank
FROM both_ranks QUALIFY rank <= 5"""

_PAGE_TEXT = "html"
for _pattern in ("(?is)<script\\b[^>]*>.*?(</script\\s*>|\\z)", "(?is)<style\\b[^>]*>.*?(</style\\s*>|\\z)",
                 "(?s)<!--.*?(-->|\\z)", "<[^>]*>"):
    _PAGE_TEXT = f"regexp_replace({_PAGE_TEXT}, '{_pattern}', ' ', 'g')"
for _entity, _code in (("&lt;", 60), ("&gt;", 62), ("&quot;", 34), ("&#39;", 39), ("&amp;", 38)):
    _PAGE_TEXT = f"replace({_PAGE_TEXT}, '{_entity}', chr({_code}))"
_PAGE_TEXT = f"regexp_replace({_PAGE_TEXT}, '[ \\t]+', ' ', 'g')"
_PAGE_TEXT = f"replace(replace({_PAGE_TEXT}, chr(10) || ' ', chr(10)), ' ' || chr(10), chr(10))"
ORACLES["page_index"] = f"""WITH RECURSIVE
shown AS (SELECT page_id, split_part(split_part(split_part(split_part(string_split(url, '://')[2], '/', 1), '?', 1),
  '#', 1), ':', 1) AS host, {_PAGE_TEXT} AS text FROM pages),
{_chunk_ctes('shown', 'page_id', 'text', 537)},
{_vector_ctes('vec', 'chunks', 'page_id, chunk_index', 'content')}
SELECT host AS codebase_name, page_id::VARCHAR AS file_path, chunk_index, content,
  {_DIGEST}
FROM chunks JOIN shown USING (page_id) JOIN vec USING (page_id, chunk_index)"""
ORACLES["incremental_delta"] = f"""WITH RECURSIVE {FILES}, {_DOC_CHUNKS},
made AS (SELECT doc_id, count(*) AS chunks, sum(length(content))::BIGINT AS characters FROM chunks GROUP BY doc_id)
SELECT codebase_name, file_path,
  CASE doc_id % 10 WHEN 0 THEN 'added' WHEN 1 THEN 'changed' WHEN 2 THEN 'deleted' ELSE 'same' END AS status,
  CASE WHEN doc_id % 10 = 2 THEN 0 ELSE coalesce(chunks, 0) END::BIGINT AS chunks,
  CASE WHEN doc_id % 10 = 2 THEN 0 ELSE coalesce(characters, 0) END::BIGINT AS characters
FROM files LEFT JOIN made USING (doc_id)"""
ORACLES["incremental_apply"] = f"""WITH RECURSIVE {FILES}, {_DOC_CHUNKS}
SELECT codebase_name, file_path, (doc_id // 7) % 10 IN (0, 1) AS rewritten, count(*) AS chunks, sum(length(content))::BIGINT AS characters
FROM chunks JOIN files USING (doc_id) WHERE (doc_id // 7) % 10 <> 2 GROUP BY ALL"""
ORACLES["rag_query_filtered"] = (
    f"WITH RECURSIVE {_hits(3, where="extension = '.py'", min_similarity=0.55)} "
    f"SELECT {_HIT_COLUMNS} FROM hits"
)
ORACLES["rag_query_prefixed"] = (
    f"WITH RECURSIVE {_hits(4, metric='cosine', prefix=True)} SELECT {_HIT_COLUMNS} FROM hits"
)

_HIT_LABEL = _label("file_path", "start_line", "end_line", "chunk_index", "total_chunks")
_ALL_QUESTIONS = (
    "(SELECT item_id AS query_id FROM benchmark UNION ALL SELECT -item_id - 1 FROM benchmark)"
)
_NL = "chr(10)"


def _texts(text: str) -> str:
    return f"""SELECT query_id, coalesce(text, 'No results found.') AS text
FROM {_ALL_QUESTIONS} LEFT JOIN (SELECT query_id, {text} AS text FROM hits GROUP BY query_id) USING (query_id)"""


ORACLES["render_human"] = f"""WITH RECURSIVE {_hits(5, min_similarity=0.55)} {_texts(f'''
'Found ' || count(*) || ' relevant files:' || {_NL} || {_NL}
|| string_agg(rank || '. ' || {_HIT_LABEL} || {_NL} || '   Similarity: ' || printf('%.3f', 1 / (1 + d))
              || ' | Size: ' || size_bytes || ' bytes', {_NL} ORDER BY rank)
|| {_NL} || {_NL} || repeat('=', 60) || {_NL} || {_NL}
|| string_agg('## ' || rank || '. ' || {_HIT_LABEL} || {_NL} || {_NL}
              || CASE WHEN length(content) > 200
                      THEN left(content, 200) || {_NL} || '... (truncated)' ELSE content END
              || {_NL} || {_NL} || repeat('-', 60) || {_NL}, {_NL} ORDER BY rank)''')}"""
ORACLES["render_machine"] = f"""WITH RECURSIVE {_hits(5)} {_texts(f'''
'Found ' || count(*) || ' relevant files:' || {_NL} || {_NL}
|| string_agg({_NL} || '## ' || rank || '. ' || {_HIT_LABEL} || {_NL} || '**Relevance:** '
              || printf('%.2f', 1 / (1 + d) * 100) || '% | **Type:** ' || extension || {_NL}
              || {_NL} || '```' || {_NL} || content || {_NL} || '```' || {_NL}, {_NL} ORDER BY rank)''')}"""
