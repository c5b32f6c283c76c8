"""The results of the operators in DuckDB SQL, written from their contracts, not from the operators."""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"

#: Smallest node reachable over ``links`` (x, y, both directions), for the nodes of ``nodes`` (id).
_REACH = """
reach(id, other) AS (
  SELECT x, y FROM links
  UNION
  SELECT r.id, l.y FROM reach r JOIN links l ON r.other = l.x
),
component AS (
  SELECT n.id, least(n.id, coalesce(min(r.other), n.id)) AS component_id
  FROM nodes n LEFT JOIN reach r ON r.id = n.id GROUP BY n.id
)"""

SUPERMINHASH = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
  SELECT doc_id, list_distinct(CASE
    WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [[w[1]]]
    ELSE list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]]) END) AS s FROM split
),
nodes AS (SELECT doc_id AS id, len(s) AS n FROM sets),
element AS (SELECT doc_id, unnest(s) AS e FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM element a JOIN element b ON a.e = b.e AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
  SELECT x, y FROM common JOIN nodes p ON p.id = x JOIN nodes q ON q.id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
),{_REACH}
SELECT id AS doc_id, n AS n_shingles, component_id, id = component_id AS kept FROM nodes JOIN component USING (id)
"""

PHRASE_INDEX = rf"""
WITH word AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
item AS (
  SELECT item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
),
win AS (
  SELECT DISTINCT item_id, w[i:i + least(10, len(w)) - 1] AS g
  FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
),
size AS (SELECT DISTINCT len(g) AS n FROM win),
place AS (
  SELECT doc_id, i, w[i:i + n - 1] AS g FROM word, size, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n
),
hit AS (SELECT doc_id, i, len(g) AS n, item_id FROM place JOIN win USING (g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hit GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM word LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

INT8_TILES = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
good AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
),{_REACH},
degree AS (SELECT x AS id, count(*) AS n FROM links GROUP BY x)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept
FROM nodes JOIN component USING (id) LEFT JOIN degree USING (id)
"""

#: The 40 hex digits of a SHA-1 as 32 base32 digits: five hex digits are 20 bits, four base32 digits.
ARC_TO_WARC = """
WITH page AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
hashed AS (
  SELECT page_id, octet_length(encode(p)) AS payload_bytes, sha1(p) AS h FROM page
),
digest AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest
  FROM hashed
),
kept AS (SELECT payload_digest, max(page_id) AS largest FROM digest GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = largest THEN NULL ELSE largest END AS refers_to
FROM digest JOIN kept USING (payload_digest)
"""


def _secret(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{kind}' AS kind, {rank} AS rank, "end" - size AS start, "end" FROM (
    SELECT doc_id, size, counted, sum(gap + size) OVER (PARTITION BY doc_id ORDER BY i) AS "end" FROM (
      SELECT doc_id, i, length(gaps[i]) AS gap, length(found[i]) AS size, length(part[i]) AS counted FROM (
        SELECT doc_id, string_split_regex(t, '{quoted}') AS gaps, regexp_extract_all(t, '{quoted}') AS found,
          regexp_extract_all(t, '{quoted}', {group}) AS part FROM body), unnest(range(1, len(found) + 1)) AS u(i)))
  WHERE counted >= {least}"""


BLOB_LEDGER = f"""
WITH body AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
span AS (
  {_secret("assign", 0, '((?i:password|passwd|secret|token|api_?key))["' + "'" + ']?\\x20*[:=]\\x20*["' + "'" + ']?([A-Za-z0-9+/_.=-]+)', 2, 6)}
  UNION ALL {_secret("access", 1, "AKIA[A-Z0-9]+", 0, 20)}
  UNION ALL {_secret("hex", 2, "[0-9a-f]+", 0, 24)}
),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
    string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) AS s
  FROM span GROUP BY doc_id
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(s, '')) AS base_sha256, coalesce(s, '') AS spans
FROM body LEFT JOIN listed USING (doc_id)
"""

_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in _RULES)

PATH_TEMPLATES = rf"""
WITH rules(v, h, p) AS (VALUES {_RULE_ROWS}),
cut AS (
  SELECT page_id, row_number() OVER () AS id,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
url AS (
  SELECT page_id, id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_UPPER.lower()}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
),
fit AS (
  SELECT id, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(v, length(h) + length(p)) AS v
  FROM url JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY id
),
page AS (
  SELECT page_id, host, path, rule, v,
    list_filter(string_split(regexp_replace(path, '[0-9]+', '0', 'g'), '/'), lambda s: s <> '') AS parts
  FROM url LEFT JOIN fit USING (id)
),
paths AS (
  SELECT host, parts, count(*) AS n, count(*) FILTER (v = 'block') AS b, count(v) AS m FROM page GROUP BY ALL
),
held AS (
  SELECT *, CASE WHEN len(parts) > 12 THEN list_append(parts[1:12], array_to_string(parts[13:], '/')) ELSE parts END AS segs FROM paths
),
kinds AS (
  SELECT *, list_transform(segs, lambda s:
    (CASE WHEN s = '0' THEN 'n' WHEN contains(s, '0') THEN 'm' ELSE 'w' END) || regexp_extract(s, '\.[A-Za-z]{{1,5}}$')) AS ks FROM held
),
place AS (
  SELECT host, parts, n, b, m, i, segs[i] AS seg, i || '/' || array_to_string(ks[1:i - 1], '/') AS node,
    array_to_string(ks[i + 1:], '/') AS tail
  FROM kinds, unnest(range(1, len(segs) + 1)) AS t(i)
),
child AS (SELECT host, node, seg, sum(n) AS n, sum(b) AS b, sum(m) AS m FROM place GROUP BY ALL),
frequent AS (
  SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY host, node) AS total FROM child) WHERE n >= 5 AND 100 * n >= 2 * total
),
profile AS (
  SELECT host, node, seg, tail, sum(place.n) AS n FROM place SEMI JOIN frequent USING (host, node, seg) GROUP BY ALL
),
pool AS (SELECT host, node, tail, sum(n) AS pool FROM profile GROUP BY ALL),
node AS (
  SELECT host, node, sum(n) AS everything, count(DISTINCT tail) AS tails, any_value(fb) AS nb, any_value(fm) AS nm
  FROM profile JOIN (SELECT host, node, sum(b) AS fb, sum(m) AS fm FROM frequent GROUP BY ALL) USING (host, node) GROUP BY ALL
),
share AS (
  SELECT f.host, f.node, f.seg, f.n, f.b, f.m, any_value(tails) AS tails, any_value(nb) AS nb, any_value(nm) AS nm,
    round((sum(abs(p.n::DOUBLE / f.n::DOUBLE - pool::DOUBLE / everything::DOUBLE)) + 1 - sum(pool::DOUBLE / everything::DOUBLE)) / 2, 6) AS distance
  FROM frequent f JOIN profile p USING (host, node, seg) JOIN pool USING (host, node, tail) JOIN node USING (host, node)
  GROUP BY ALL
),
alike AS (
  SELECT *, distance <= round(0.05 + sqrt(tails::DOUBLE / n::DOUBLE), 6)
    AND (m = 0 OR round(abs(b::DOUBLE / m::DOUBLE - nb::DOUBLE / nm::DOUBLE), 6) <= round(0.05 + sqrt(1::DOUBLE / m::DOUBLE), 6)) AS alike
  FROM share
),
token AS (
  SELECT host, node, seg, CASE WHEN alike AND count(*) FILTER (alike) OVER (PARTITION BY host, node) > 1 THEN '~' ELSE seg END AS token
  FROM alike
),
template AS (
  SELECT host, parts, '/' || string_agg(coalesce(token, CASE WHEN seg = '0' THEN '0' ELSE '*' END), '/' ORDER BY i) AS template
  FROM place LEFT JOIN token USING (host, node, seg) GROUP BY ALL
  UNION ALL SELECT host, parts, '/' FROM paths WHERE len(parts) = 0
),
prior AS (SELECT (sum(b) + 1)::DOUBLE / (sum(m) + 2)::DOUBLE AS p FROM paths),
by_host AS (SELECT host, sum(m) AS hm, (sum(b)::DOUBLE + 5 * any_value(p)) / (sum(m)::DOUBLE + 5) AS hp FROM paths, prior GROUP BY host),
rejected AS (
  SELECT host, template, any_value(hm) > 0 AND round((sum(b)::DOUBLE + 5 * any_value(hp)) / (sum(m)::DOUBLE + 5), 6) >= 0.6 AS rejected
  FROM template JOIN paths USING (host, parts) JOIN by_host USING (host) GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict, template
FROM page JOIN template USING (host, parts) JOIN rejected USING (host, template)
"""


def _lloyd(rounds: int) -> str:
    """Rounds of assignment and floored means, one pair of common table expressions each."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
near{i} AS (
  SELECT row, min((d, c)) AS best FROM (
    SELECT row, c, list_sum(list_transform(list_zip(x, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM point, mean{i}
  ) GROUP BY row
)""")
        if i < rounds:
            steps.append(f"""
total{i} AS (
  SELECT c, j, sum(x[j]) AS s, count(*) AS n
  FROM (SELECT best[2] AS c, x FROM near{i} JOIN point USING (row)), unnest(range(1, 65)) AS t(j) GROUP BY ALL
),
mean{i + 1} AS (
  SELECT mean{i}.c, coalesce(v, m) AS m FROM mean{i} LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM total{i} GROUP BY c
  ) USING (c)
)""")
    return ",".join(steps)


CENTROIDS = f"""
WITH point AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
),
mean0 AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x AS m FROM point ORDER BY sha256('2:' || vec_id), x LIMIT 40
),{_lloyd(5)}
SELECT vec_id, best[2]::INTEGER AS cluster, best[1] AS distance, sum(best[1]) OVER (PARTITION BY best[2])::BIGINT AS cluster_inertia,
  (sum(best[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM near5 JOIN point USING (row) JOIN mean5 ON c = best[2]
"""

COLLOCATIONS = rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents
),
word AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
counted AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM word, unnest(range(1, 4)) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k GROUP BY ALL
),
total AS (SELECT lang, sum(f) AS n FROM counted WHERE k = 1 GROUP BY lang),
candidate AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND f >= 10),
half AS (
  SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidate)
),
part AS (SELECT lang, phrase, f FROM counted WHERE f >= 10),
cut AS (
  SELECT h.lang, h.phrase, a, j, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM half h JOIN part l ON l.lang = h.lang AND l.phrase = h.head JOIN part r ON r.lang = h.lang AND r.phrase = h.tail
),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS around
  FROM (SELECT *, unnest([1, 2]) AS i FROM candidate WHERE k = 3) GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n::BIGINT AS n, score
FROM best LEFT JOIN inside USING (lang, phrase) JOIN total USING (lang)
WHERE around IS NULL OR 100 * around < 50 * a
QUALIFY rank <= 2000
"""

ORACLES = {
    "op3_superminhash": SUPERMINHASH,
    "op4_phrase_index": PHRASE_INDEX,
    "op6_int8_tiles": INT8_TILES,
    "op7_arc_to_warc": ARC_TO_WARC,
    "op8_blob_ledger": BLOB_LEDGER,
    "op11_path_templates": PATH_TEMPLATES,
    "op12_centroids": CENTROIDS,
    "op13_rollup_collocations": COLLOCATIONS,
}
