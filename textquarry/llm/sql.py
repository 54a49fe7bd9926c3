"""DuckDB SQL for the results of the queries in ``queries``, where SQL can express them."""

from __future__ import annotations

from . import line_dedup, secrets


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sharding_sql(shards: int = 16, seed: str = "mixture-1") -> str:
    # the checksum is computed from its definition: SQL has no such function
    return f"""
WITH bits AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::UINTEGER, range(8)::UINTEGER[]), LAMBDA a, b: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384::UINTEGER) ELSE a >> 1 END) AS v FROM range(256) r(i))),
base AS (SELECT doc_id, source, coalesce(octet_length(encode(text)), 0) + 1 AS size, hex(encode(coalesce(text, ''))) AS h,
  ('0x' || substr(md5({_q(seed + ":")} || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS random FROM documents),
summed AS (SELECT doc_id, source, size, random, xor(4294967295::UINTEGER, list_reduce(list_prepend(4294967295::UINTEGER, list_transform(range(1, length(h) // 2 + 1), LAMBDA i: ('0x' || h[2 * i - 1 : 2 * i])::UINTEGER)), LAMBDA a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])))::BIGINT AS text_crc32 FROM base, bits),
ranks AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY random, doc_id NULLS FIRST, size, text_crc32) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM summed),
placed AS (SELECT *, row_number() OVER (ORDER BY (2 * r + 1)::DOUBLE / (2 * n)::DOUBLE, random, doc_id NULLS FIRST, size, text_crc32, source) - 1 AS p, count(*) OVER () AS c FROM ranks)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (p * {shards} // c)::INTEGER AS shard,
  (p - ((p * {shards} // c) * c + {shards - 1}) // {shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM placed"""


def secrets_sql() -> str:
    parts = []
    for no, (kind, pattern, group, least) in enumerate(secrets.BASE):
        parts.append((no, kind, pattern, group, f"length(part) >= {least}"))
    allowed = " OR ".join(f"regexp_matches(whole, {_q(r)})" for r in secrets.ALLOW)
    for no, (kind, pattern, bits) in enumerate(secrets.CLASSES, len(parts)):
        parts.append((no, kind, pattern, 0, f"NOT ({allowed}) AND least <= {secrets.most_weight(bits)}"))
    found = " UNION ALL ".join(
        f"SELECT doc_id, {no} AS no, {_q(kind)} AS kind, string_split_regex(text, {_q(p)}) AS gaps, regexp_extract_all(text, {_q(p)}, 0) AS wholes, regexp_extract_all(text, {_q(p)}, {g}) AS parts FROM docs WHERE regexp_matches(text, {_q(p)})"
        for no, kind, p, g, _ in parts
    )
    keep = " ".join(f"WHEN {no} THEN {cond}" for no, *_, cond in parts)
    w = secrets.WINDOW
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), found AS ({found}),
each AS (SELECT doc_id, no, kind, unnest(range(1, len(wholes) + 1)) AS i, gaps, wholes, parts FROM found),
placed AS (SELECT doc_id, no, kind, wholes[i] AS whole, parts[i] AS part,
  list_sum(list_transform(gaps[1:i], LAMBDA x: length(x))) + coalesce(list_sum(list_transform(wholes[1:i - 1], LAMBDA x: length(x))), 0) AS s FROM each),
wide AS (SELECT DISTINCT whole FROM placed WHERE no >= {len(secrets.BASE)} AND NOT ({allowed})),
windows AS (SELECT whole, i, unnest(string_split(substr(whole, i, {w}), '')) AS ch FROM (SELECT whole, unnest(range(1, length(whole) - {w - 2})) AS i FROM wide)),
weights AS (SELECT whole, i, sum(v) AS v FROM (SELECT whole, i, ch, round(count(*) * log2(count(*)) * {secrets.UNIT})::BIGINT AS v FROM windows WHERE ch <> '' GROUP BY ALL) GROUP BY ALL),
best AS (SELECT whole, min(v) AS least FROM weights GROUP BY ALL),
kept AS (SELECT doc_id, no, kind, s::BIGINT AS s, (s + length(whole))::BIGINT AS e FROM placed LEFT JOIN best USING (whole) WHERE CASE no {keep} END),
texts AS (SELECT doc_id, count(*) FILTER (no = 0) AS a, count(*) FILTER (no = 1) AS b, count(*) FILTER (no = 2) AS c,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) FILTER (no < {len(secrets.BASE)}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no, e) AS spans FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN texts t ON d.doc_id = t.doc_id"""


def line_dedup_sql(max_ratio: float = line_dedup.MAX_RATIO, min_pages: int = line_dedup.MIN_PAGES) -> str:
    bare = "trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12))"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, text, coalesce('h' || source, 'n') AS host FROM documents),
lines AS (SELECT row, host, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM docs WHERE text IS NOT NULL),
named AS (SELECT row, host, pos, line, {bare} AS bare FROM lines),
totals AS (SELECT host, count(*) AS n FROM docs GROUP BY host),
common AS (SELECT host, bare FROM (SELECT host, bare, count(DISTINCT row) AS c FROM named WHERE bare <> '' GROUP BY ALL) JOIN totals USING (host) WHERE c >= {min_pages} AND c > n * {max_ratio}::DOUBLE),
marked AS (SELECT row, pos, line, c.bare IS NULL AS stays FROM named n LEFT JOIN common c ON n.host = c.host AND n.bare = c.bare),
texts AS (SELECT row, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '') AS kept FROM marked GROUP BY row)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, kept AS text FROM docs LEFT JOIN texts USING (row)"""


def warc_sql(least: int = 1000) -> str:
    return f"""
WITH rows AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
kept AS (SELECT digest, max(page_id) AS keeper FROM rows WHERE n >= {least} GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < keeper THEN keeper END AS refers_to FROM rows LEFT JOIN kept USING (digest)"""


def embedding_sql(cosine: float = 0.93) -> str:
    """Every pair of rows of a label; for small tables."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
ok AS (SELECT vec_id, label, x, sqrt(list_sum(list_transform(x, LAMBDA a: a * a))) AS norm FROM v WHERE len(list_filter(x, LAMBDA a: a IS NULL OR NOT isfinite(a))) = 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= {cosine}::DOUBLE),
reach AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT w, c FROM reach JOIN links ON u = id),
least AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, component_id = vec_id AS kept
FROM embeddings e JOIN least ON id = vec_id LEFT JOIN (SELECT u, count(*) AS n FROM links GROUP BY u) ON u = vec_id"""
