"""DuckDB SQL for the rows of ``queries``, written from the definitions rather than from the Spark plans."""

from __future__ import annotations

from .schema import OverlapPolicy
from .scorers.rule import PATTERNS

PII = ["email", "ip_address", "phone_number", "api_key", "password"]

# Cue words of the tasks that the queries ask about, and choices.
CUES = {
    "language": {"english": ["the", "of", "and", "to", "in", "that", "is", "was"], "german": ["der", "die", "und", "den", "von", "zu", "mit", "ist"], "french": ["le", "les", "et", "un", "une", "pour", "que", "dans"], "spanish": ["el", "la", "que", "en", "los", "del", "las", "una"]},
    "topic": {"number": ["1", "2", "3", "10", "555", "2024"], "licence": ["licensed", "license", "cc", "gnu", "mit", "version"], "article": ["the", "der", "le", "el", "la", "die"], "link": ["with", "for", "mit", "para", "pour", "con"]},
}
CHOICES = ["the", "of", "this", "der", "le", "el"]


def guard_cues(label: str) -> list[str]:
    """A few common words for each moderation label, by its length: a stand-in for a model."""
    common = ["the", "of", "and", "to", "in", "that", "is", "was", "he", "for", "it", "with"]
    return [common[(len(label) + k * 5) % len(common)] for k in range(3)]


WORDS = r"(?i)(?:https?://[^\s]+|www\.[^\s]+)|[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}|@[a-z0-9_]+|[\p{L}\p{N}_]+(?:[-_][\p{L}\p{N}_]+)*|\S"
CHARS = r"[A-Za-z0-9@._\-+]+|\S"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(source: str, keys: str, patterns: list[tuple[str, str]]) -> str:
    """CTEs ending in ``spans`` (keys, label, s, e, text, score) of the matches of (label, pattern) in ``source`` (keys, body)."""
    found = " UNION ALL ".join(f"SELECT {keys}, {q(label)} AS label, string_split_regex(body, {q(p)}) AS gaps, regexp_extract_all(body, {q(p)}, 0) AS wholes FROM {source} WHERE regexp_matches(body, {q(p)})" for label, p in patterns)
    return f"""found AS ({found}),
each AS (SELECT {keys}, label, unnest(range(1, len(wholes) + 1)) AS i, gaps, wholes FROM found),
placed AS (SELECT {keys}, label, wholes[i] AS text, list_sum(list_transform(gaps[1:i], LAMBDA x: length(x))) + coalesce(list_sum(list_transform(wholes[1:i - 1], LAMBDA x: length(x))), 0) AS s FROM each),
spans AS (SELECT {keys}, label, s::INTEGER AS s, (s + length(text))::INTEGER AS e, text, ((24 + (length(text) * 7) % 40) / 64)::FLOAT AS score FROM placed)"""


DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)"


def labelled(labels: list[str]) -> str:
    return matches("docs", "doc_id", [(x, p) for x in labels for p in PATTERNS[x]])


RESULT = 'doc_id, label, s AS span_start, e AS span_end, score::DOUBLE AS score, text'


def components(source: str = "spans") -> str:
    """CTEs ending in ``comps``: distinct spans with the number of their overlap component."""
    return f"""best AS (SELECT doc_id, label, s, e, max(score) AS score, min(text) AS text FROM {source} GROUP BY doc_id, label, s, e),
reach AS (SELECT *, max(e) OVER (PARTITION BY doc_id, label ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM best),
comps AS (SELECT doc_id, label, s, e, score, text, sum(CASE WHEN r IS NULL OR s >= r THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, label ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS comp FROM reach)"""


def greedy(clash: str) -> str:
    return f"""items AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label, comp ORDER BY score DESC, s, e) AS k, count(*) OVER (PARTITION BY doc_id, label, comp) AS n FROM comps),
walk AS (SELECT doc_id, label, comp, 0::BIGINT AS k, n, []::STRUCT(s INTEGER, e INTEGER)[] AS kept FROM items WHERE k = 1
 UNION ALL SELECT w.doc_id, w.label, w.comp, i.k, w.n, CASE WHEN len(list_filter(w.kept, LAMBDA y: i.s < y.e AND y.s < i.e AND {clash})) > 0 THEN w.kept ELSE list_append(w.kept, {{'s': i.s, 'e': i.e}}) END
 FROM walk w JOIN items i ON w.doc_id = i.doc_id AND w.label = i.label AND w.comp = i.comp AND i.k = w.k + 1),
chosen AS (SELECT doc_id, label, comp, unnest(kept) AS x FROM walk WHERE k = n),
kept AS (SELECT c.* FROM comps c JOIN chosen h ON c.doc_id = h.doc_id AND c.label = h.label AND c.comp = h.comp AND c.s = h.x.s AND c.e = h.x.e)"""


FLAT = """items AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label, comp ORDER BY e, s) AS k, count(*) OVER (PARTITION BY doc_id, label, comp) AS n FROM comps),
ends AS (SELECT a.doc_id, a.label, a.comp, a.k, a.n, a.s, a.e, a.score, (SELECT count(*) FROM items b WHERE b.doc_id = a.doc_id AND b.label = a.label AND b.comp = a.comp AND b.k < a.k AND b.e <= a.s) AS p FROM items a),
walk AS (SELECT doc_id, label, comp, 0::BIGINT AS k, n, [{'t': 0.0::DOUBLE, 'c': 0, 'keys': []::STRUCT(n DOUBLE, s INTEGER, e INTEGER)[]}] AS best FROM items WHERE k = 1
 UNION ALL SELECT w.doc_id, w.label, w.comp, i.k, w.n, list_append(w.best, CASE WHEN
  {'t': w.best[i.p + 1].t - i.score::DOUBLE, 'c': w.best[i.p + 1].c - 1, 'keys': list_sort(list_append(w.best[i.p + 1].keys, {'n': -i.score::DOUBLE, 's': i.s, 'e': i.e}))} < w.best[i.k]
  THEN {'t': w.best[i.p + 1].t - i.score::DOUBLE, 'c': w.best[i.p + 1].c - 1, 'keys': list_sort(list_append(w.best[i.p + 1].keys, {'n': -i.score::DOUBLE, 's': i.s, 'e': i.e}))} ELSE w.best[i.k] END)
 FROM walk w JOIN ends i ON w.doc_id = i.doc_id AND w.label = i.label AND w.comp = i.comp AND i.k = w.k + 1),
chosen AS (SELECT doc_id, label, comp, unnest(best[n + 1].keys) AS x FROM walk WHERE k = n),
kept AS (SELECT c.* FROM comps c JOIN chosen h ON c.doc_id = h.doc_id AND c.label = h.label AND c.comp = h.comp AND c.s = h.x.s AND c.e = h.x.e)"""
DISJOINT = greedy("TRUE")
NESTED = greedy("NOT (i.s <= y.s AND i.e >= y.e) AND NOT (y.s <= i.s AND y.e >= i.e)")
LONGEST = "kept AS (SELECT c.* FROM comps c WHERE NOT EXISTS (SELECT 1 FROM comps o WHERE o.doc_id = c.doc_id AND o.label = c.label AND o.s <= c.s AND o.e >= c.e AND o.e - o.s > c.e - c.s))"
RESOLVED = {"allow": "kept AS (SELECT * FROM comps)", "nested": NESTED, "flat": FLAT, "longest": LONGEST, "greedy": DISJOINT}


def resolved(ctes: str, policy: str, rest: str = "", source: str = "spans") -> str:
    return f"WITH RECURSIVE {ctes}, {components(source)}, {RESOLVED[policy]}{rest}"


def overlap_sql(policy: str) -> str:
    return resolved(f"{DOCS}, {labelled(['name'])}", policy) + f" SELECT {RESULT} FROM kept"


def entities_sql(labels: list[str], limit: str, check: str = "TRUE", single: bool = False, by_text: bool = False) -> str:
    same = "doc_id, label, lower(text)" + ("" if by_text else ", s, e")
    tail = f""", passed AS (SELECT * FROM kept WHERE {check}), values_ AS (SELECT * FROM passed WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY {same} ORDER BY score DESC, s, e) = 1)"""
    pick = " QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY score DESC, s, e) = 1" if single else ""
    return resolved(f"{DOCS}, {labelled(labels)}, enough AS (SELECT * FROM spans WHERE score >= ({limit})::FLOAT)", "flat", tail, "enough") + f" SELECT {RESULT} FROM values_{pick}"


def words_sql(pattern: str) -> str:
    return f"""WITH {DOCS}, w AS (SELECT doc_id, regexp_extract_all(body, {q(pattern)}, 0) AS words, string_split_regex(body, {q(pattern)}) AS gaps FROM docs WHERE regexp_matches(body, {q(pattern)})),
each AS (SELECT doc_id, unnest(range(0, len(words))) AS ix, unnest(words) AS word, unnest(gaps[1:len(words)]) AS gap FROM w),
placed AS (SELECT doc_id, ix, word, sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY ix) AS e FROM each)
SELECT doc_id, count(*)::BIGINT AS n_words, sum((e - length(word)) * (ix % 1000 + 1) + e)::BIGINT AS offsets, md5(string_agg(word, chr(31) ORDER BY ix)) AS words_md5 FROM placed GROUP BY doc_id"""


def chunk_ctes(size: int = 200, overlap: int = 40) -> str:
    return f"""{DOCS}, w AS (SELECT doc_id, body, regexp_extract_all(body, {q(WORDS)}, 0) AS words, string_split_regex(body, {q(WORDS)}) AS gaps FROM docs),
each AS (SELECT doc_id, unnest(range(0, len(words))) AS ix, unnest(words) AS word, unnest(gaps[1:len(words)]) AS gap FROM w WHERE len(words) > 0),
placed_words AS (SELECT doc_id, ix, word, sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY ix) AS e FROM each),
counts AS (SELECT doc_id, body, len(words) AS n FROM w),
chunk_no AS (SELECT doc_id, body, n, unnest(range(0, 1 + ceil(greatest(n - {size}, 0) / {size - overlap})::BIGINT)) AS c FROM counts),
chunks AS (SELECT k.doc_id, c AS chunk_ix, CASE WHEN n = 0 THEN 0 ELSE a.e - length(a.word) END AS chunk_start, CASE WHEN n = 0 THEN body ELSE body[(a.e - length(a.word) + 1):b.e] END AS body
 FROM chunk_no k LEFT JOIN placed_words a ON a.doc_id = k.doc_id AND a.ix = c * {size - overlap} LEFT JOIN placed_words b ON b.doc_id = k.doc_id AND b.ix = least(c * {size - overlap} + {size}, n) - 1)"""


def label_rows(source: str, keys: str, cues: dict[str, list[str]]) -> str:
    """(keys, label, ix, score) of every label, from the cue words held."""
    parts = []
    for ix, (label, words) in enumerate(cues.items()):
        listed = ", ".join(q(w) for w in dict.fromkeys(words))
        parts.append(f"SELECT {keys}, {q(label)} AS label, {ix} AS ix, ((1 + 62 * least(len(list_intersect(list_distinct(string_split_regex(lower(body), '[^\\p{{L}}\\p{{N}}_]+')), [{listed}])), 8) / 8) / 64)::FLOAT AS score FROM {source}")
    return " UNION ALL ".join(parts)


def decided(rows: str, keys: str, multi: float | None) -> str:
    extra = f" OR score >= {multi}::FLOAT" if multi is not None else ""
    return f"SELECT * FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, ix) = 1{extra}"


def classify_sql(task: str, multi: float | None) -> str:
    return f"WITH {DOCS} SELECT doc_id, {q(task)} AS task, label, round(score::DOUBLE, 6) AS score FROM ({decided(label_rows('docs', 'doc_id', CUES[task]), 'doc_id', multi)})"


def guard_sql(role: str, tasks: list[tuple[str, list[str], bool]]) -> str:
    parts = [f"SELECT doc_id, {q(t)} AS task, label, round(score::DOUBLE, 6) AS score FROM ({decided(label_rows('docs', 'doc_id', {x: guard_cues(x) for x in labels}), 'doc_id', 0.2 if multi else None)})" for t, labels, multi in tasks]
    return f"WITH docs AS (SELECT conv_id * 1000 + turn AS doc_id, coalesce(text, '') AS body FROM conversations WHERE role = {q(role)}) " + " UNION ALL ".join(parts)


REDACT = resolved(
    f"{DOCS}, {labelled(PII)}", "flat",
    f""", ordered AS (SELECT doc_id, s, e, label, row_number() OVER (PARTITION BY doc_id ORDER BY s, list_position([{', '.join(q(x) for x in PII)}], label), e) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM kept),
cut AS (SELECT doc_id, 0::BIGINT AS k, n, 0 AS pos, '' AS out, 0 AS marks, 0 AS plains FROM ordered WHERE k = 1
 UNION ALL SELECT c.doc_id, o.k, c.n, CASE WHEN o.s >= c.pos THEN o.e ELSE c.pos END, CASE WHEN o.s >= c.pos THEN c.out || d.body[(c.pos + 1):o.s] || '[' || upper(o.label) || ']' ELSE c.out END,
  c.marks + CASE WHEN o.s >= c.pos THEN 1 ELSE 0 END, c.plains + CASE WHEN o.s > c.pos THEN 1 ELSE 0 END
 FROM cut c JOIN ordered o ON o.doc_id = c.doc_id AND o.k = c.k + 1 JOIN docs d ON d.doc_id = c.doc_id)""",
)


def pair_ctes() -> str:
    """CTEs ending in ``pairs``: (doc_id, relation, hs, he, ht, ts, te, tt, score, place)."""
    return f"""{DOCS}, {labelled(['name', 'email', 'phone_number'])},
roles AS (SELECT * FROM (VALUES ('contact_mail', 'head', 'name'), ('contact_mail', 'tail', 'email'), ('contact_phone', 'head', 'name'), ('contact_phone', 'tail', 'phone_number'), ('beside', 'head', 'name'), ('beside', 'tail', 'name')) r(relation, role, label)),
args AS (SELECT doc_id, relation, role, s, e, text, score, row_number() OVER (PARTITION BY doc_id, relation, role ORDER BY score DESC, s, e, label) AS place FROM spans JOIN roles USING (label) WHERE score >= 0.6::FLOAT QUALIFY place <= 16),
pairs AS (SELECT h.doc_id, h.relation, h.s AS hs, h.e AS he, h.text AS ht, t.s AS ts, t.e AS te, t.text AS tt, (h.score * t.score)::FLOAT AS score,
  row_number() OVER (PARTITION BY h.doc_id, h.relation ORDER BY (h.score * t.score)::FLOAT DESC, h.place, t.place) AS place_
 FROM args h JOIN args t ON h.doc_id = t.doc_id AND h.relation = t.relation AND h.role = 'head' AND t.role = 'tail' AND (h.s <> t.s OR h.e <> t.e) QUALIFY place_ <= 64)"""


def canonical_ctes(source: str) -> str:
    side = lambda p: f"""{p}m AS (SELECT DISTINCT doc_id, relation, {p}s AS s, {p}e AS e, {p}t AS text FROM {source}),
{p}c AS (SELECT a.doc_id, a.relation, a.s, a.e, b.s AS s2, b.e AS e2, b.text AS t2 FROM {p}m a JOIN {p}m b ON a.doc_id = b.doc_id AND a.relation = b.relation AND b.s <= a.s AND b.e >= a.e QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.relation, a.s, a.e ORDER BY b.e - b.s DESC, b.s) = 1)"""  # noqa: E731
    return f"""{side('h')}, {side('t')},
canon AS (SELECT p.doc_id, p.relation, h.s2 AS hs, h.e2 AS he, h.t2 AS ht, t.s2 AS ts, t.e2 AS te, t.t2 AS tt, p.score, min(p.place_) OVER (PARTITION BY p.doc_id, p.relation, h.s2, h.e2, t.s2, t.e2) AS place
 FROM {source} p JOIN hc h ON p.doc_id = h.doc_id AND p.relation = h.relation AND p.hs = h.s AND p.he = h.e JOIN tc t ON p.doc_id = t.doc_id AND p.relation = t.relation AND p.ts = t.s AND p.te = t.e
 QUALIFY row_number() OVER (PARTITION BY p.doc_id, p.relation, h.s2, h.e2, t.s2, t.e2 ORDER BY p.score DESC, p.place_) = 1)"""


EDGE = "doc_id, relation, hs AS h_start, he AS h_end, ht AS h_text, ts AS t_start, te AS t_end, tt AS t_text, score::DOUBLE AS score"
SEMANTIC = """keyed AS (SELECT *, trim(regexp_replace(lower(ht), '\\s+', ' ', 'g')) AS hk, trim(regexp_replace(lower(tt), '\\s+', ' ', 'g')) AS tk FROM canon),
near AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY doc_id, relation, hk, tk ORDER BY greatest(hs - te, ts - he, 0), score DESC, hs, ts, place) = 1),
sets AS (SELECT *, list_sort(list_distinct(string_split(hk, ' '))) AS hw, list_sort(list_distinct(string_split(tk, ' '))) AS tw FROM near),
edges AS (SELECT * FROM sets a WHERE NOT EXISTS (SELECT 1 FROM sets b WHERE a.doc_id = b.doc_id AND a.relation = b.relation AND
 ((len(a.hw) < len(b.hw) AND list_has_all(b.hw, a.hw) AND a.tw = b.tw) OR (len(a.tw) < len(b.tw) AND list_has_all(b.tw, a.tw) AND a.hw = b.hw))))"""


def attribute_sql(multi: bool) -> str:
    where = "" if multi else "WHERE label IN ('email', 'phone_number')"
    score = "1 / (1 + exp(-logit))" if multi else "exp(logit - max(logit) OVER k) / sum(exp(logit)) OVER k * exp(max(logit) OVER k)"
    pick = "WHERE score::FLOAT >= 0.6::FLOAT" if multi else "WHERE r = 1"
    return f"""WITH {DOCS}, {labelled(PII)}, asked AS (SELECT doc_id, label, s, e, text, attribute, ix, ((length(text) * (ix + 3)) % 17 - 8) / 4 AS logit FROM spans, (VALUES ('low', 0), ('middle', 1), ('high', 2)) v(attribute, ix) {where}),
scored AS (SELECT *, {score} AS score, row_number() OVER (PARTITION BY doc_id, label, s, e ORDER BY logit DESC, ix) AS r FROM asked WINDOW k AS (PARTITION BY doc_id, label, s, e))
SELECT doc_id, label, s AS span_start, e AS span_end, attribute, round(score, 6) AS score FROM scored {pick}"""


def choice_ctes() -> str:
    """CTEs ending in ``mentions`` (doc_id, choice, ix, s, e) and ``anchors``. Boundaries are tested on the neighbouring characters, for want of look-around."""
    word = r"[\p{L}\p{N}_]+"
    return f"""{DOCS}, runs AS (SELECT doc_id, regexp_extract_all(body, {q(word)}, 0) AS wholes, string_split_regex(body, {q(word)}) AS gaps FROM docs),
run AS (SELECT doc_id, unnest(range(0, len(wholes))) AS i, unnest(wholes) AS word, unnest(gaps[1:len(wholes)]) AS gap FROM runs WHERE len(wholes) > 0),
word_at AS (SELECT doc_id, word, (sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i))::INTEGER AS e FROM run),
listed AS (SELECT * FROM (VALUES {', '.join(f'({q(c)}, {i})' for i, c in enumerate(CHOICES))}) c(choice, ix)),
mentions AS (SELECT doc_id, choice, ix, (e - length(word))::INTEGER AS s, e FROM word_at JOIN listed ON lower(word) = choice),
{labelled(['amount'])},
anchors AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INTEGER AS owner, s AS a_s, e AS a_e FROM spans WHERE length(text) >= 3)"""


BOUND = """owned AS (SELECT m.*, coalesce(
  (SELECT arg_max(a.owner, a.a_s) FROM anchors a WHERE a.doc_id = m.doc_id AND a.a_s <= m.s), (SELECT arg_min(a.owner, a.a_s) FROM anchors a WHERE a.doc_id = m.doc_id)) AS owner FROM mentions m),
bound AS (SELECT * FROM owned WHERE owner IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, owner, choice ORDER BY s, ix) = 1)"""

RECORDS = """lines AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL),
seeds AS (SELECT l_orderkey AS doc_id, l_linenumber AS inst, l_suppkey AS a, (1 / (1 + exp(-((l_partkey % 17 - 6) / 8)))) AS p FROM lines),
chosen AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, inst) AS place FROM seeds WHERE p::FLOAT >= 0.5::FLOAT),
cells AS (SELECT c.doc_id, c.inst, c.a, c.place, l.l_linenumber AS cand, l.l_partkey AS b FROM chosen c JOIN lines l ON l.l_orderkey = c.doc_id UNION ALL SELECT doc_id, inst, a, place, -1, 5 FROM chosen),
assign AS (SELECT doc_id, inst, place, cand, field, ((a * k + b * 3 + inst * cand) % 33 - 16) / 8 AS logit FROM cells, (VALUES ('shared', 5), ('owned', 7), ('single', 11)) f(field, k)),
lists AS (SELECT doc_id, inst, field, cand, 1 / (1 + exp(-logit)) AS score FROM assign WHERE field = 'shared' AND cand <> -1),
owners AS (SELECT doc_id, inst, field, cand, 1 / (1 + exp(-logit)) AS score FROM assign WHERE field = 'owned' AND cand <> -1 QUALIFY row_number() OVER (PARTITION BY doc_id, cand ORDER BY logit DESC, place) = 1),
shares AS (SELECT doc_id, inst, field, cand, logit, exp(logit) / sum(exp(logit)) OVER (PARTITION BY doc_id, inst) AS score FROM assign WHERE field = 'single'),
picked AS (SELECT doc_id, inst, field, cand, score FROM shares QUALIFY row_number() OVER (PARTITION BY doc_id, inst ORDER BY logit DESC, cand) = 1)"""
FIELDS = """(SELECT * FROM lists WHERE score::FLOAT >= 0.5::FLOAT UNION ALL SELECT * FROM owners WHERE score::FLOAT >= 0.5::FLOAT UNION ALL SELECT * FROM picked WHERE cand <> -1 AND score::FLOAT >= 0.5::FLOAT)"""
RECORD_ROW = "doc_id, inst, round(p, 6) AS record_score, field, cand, round(score, 6) AS score"

BOUNDARIES = """comp AS (SELECT vec_id, unnest(range(0, len(embedding)))::INTEGER AS pos, unnest(embedding) AS x FROM embeddings),
starts AS (SELECT vec_id, pos, round(x::DOUBLE, 4) AS score FROM comp), ends AS (SELECT vec_id, pos, round(-score, 4) AS score FROM starts),
general AS (SELECT a.vec_id, a.pos AS s, b.pos AS e, a.score + b.score AS score FROM (SELECT * FROM starts QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, pos) <= 6) a JOIN (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, pos) <= 6) b ON a.vec_id = b.vec_id AND b.pos > a.pos)"""


def pool_sql(own: bool, capacity: int) -> str:
    rows = "SELECT * FROM general"
    if own:
        rows += """ UNION ALL SELECT vec_id, s, e, (5000 + 3 - r)::DOUBLE FROM (SELECT vec_id, pos AS s, pos + pos % 4 + 1 AS e, row_number() OVER (PARTITION BY vec_id, pos % 2 ORDER BY round(abs(x)::DOUBLE, 4) DESC, pos, pos + pos % 4 + 1) - 1 AS r FROM comp) WHERE r < 3"""
    return f"""WITH {BOUNDARIES}, rows AS ({rows}), best AS (SELECT vec_id, s, e, max(score) AS score FROM rows GROUP BY ALL)
SELECT vec_id, s AS span_start, e AS span_end, round(score, 4) AS score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, s, e) - 1 AS slot FROM best QUALIFY slot < {capacity}"""


def long_labels(multi: float | None) -> str:
    return decided(label_rows("chunks", "doc_id, chunk_ix", CUES["topic"]), "doc_id, chunk_ix", multi)


def _attributes_request() -> str:
    logit = "((length(text) * (ix + 3)) % 17 - 8) / 4"
    return resolved(f"{DOCS}, {labelled(['email', 'phone_number', 'ip_address'])}, enough AS (SELECT * FROM spans WHERE score >= 0.4::FLOAT)", "flat", f""", asked AS (SELECT doc_id, label, s, e, text, risk, flag, ix, {logit} AS logit FROM kept, (VALUES ('low', 'old', 0), ('middle', 'odd', 1), ('high', 'public', 2)) v(risk, flag, ix)),
decided_spans AS (SELECT doc_id, label, s, e, any_value(text) AS text, arg_max(risk, {{'l': logit, 'i': -ix}}) AS risk, max(exp(logit)) / sum(exp(logit)) AS share, string_agg(flag, '+' ORDER BY (1 / (1 + exp(-logit)))::FLOAT DESC, flag) FILTER ((1 / (1 + exp(-logit)))::FLOAT >= 0.6::FLOAT) AS flags FROM asked GROUP BY doc_id, label, s, e),
lines AS (SELECT doc_id, label, string_agg(concat_ws('|', text, s::VARCHAR, risk, printf('%.6f', share::FLOAT::DOUBLE), coalesce(flags, '')), chr(10) ORDER BY s) AS line, count(*) AS n FROM decided_spans GROUP BY doc_id, label)""", "enough") + """
SELECT d.doc_id, coalesce(max(line) FILTER (label = 'email'), '') AS email, coalesce(max(line) FILTER (label = 'phone_number'), '') AS phone_number, coalesce(max(n) FILTER (label = 'ip_address'), 0)::BIGINT AS ip_addresses
FROM docs d LEFT JOIN lines l ON d.doc_id = l.doc_id GROUP BY d.doc_id"""


def _record_ctes(labels: list[str], anchor: str, threshold: float) -> str:
    """CTEs ending in ``cells`` (doc_id, inst, field, cand, s, e, text, own, logit): seeds that became records, with every candidate."""
    return f"""{DOCS}, {labelled(labels)},
distinct_spans AS (SELECT DISTINCT doc_id, s, e, text, score FROM spans), pool AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e) - 1 AS cand FROM (SELECT * FROM distinct_spans QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, s, e) <= 64)),
named AS (SELECT DISTINCT doc_id, label AS field, s, e FROM spans),
seeds AS (SELECT p.*, 1 / (1 + exp(-((length(p.text) % 8 - 2) / 8))) AS p FROM pool p JOIN named n ON p.doc_id = n.doc_id AND p.s = n.s AND p.e = n.e AND n.field = {q(anchor)}),
begun AS (SELECT doc_id, cand AS inst, s AS first, e AS last, p, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, cand) - 1 AS record_ix FROM seeds WHERE p::FLOAT >= {threshold}::FLOAT),
cells AS (SELECT c.doc_id, c.inst, f.field, o.cand, o.s, o.e, o.text, CASE WHEN n.field IS NULL THEN 0 ELSE o.score END AS own, CASE WHEN n.field IS NULL THEN -6 ELSE (16 - least(floor(greatest(c.first - o.e, o.s - c.last, 0) / 8), 40)) / 8 END AS logit
 FROM begun c JOIN pool o ON o.doc_id = c.doc_id CROSS JOIN (VALUES {', '.join(f'({q(x)})' for x in labels)}) f(field) LEFT JOIN named n ON n.doc_id = o.doc_id AND n.s = o.s AND n.e = o.e AND n.field = f.field)"""


def _records_request() -> str:
    ctes = _record_ctes(["email", "phone_number", "ip_address"], "email", 0.4)
    rows = """likely AS (SELECT doc_id, inst, field, cand, s, e, text, own, 1 / (1 + exp(-logit)) AS score FROM cells WHERE field = 'phone_number'),
shares AS (SELECT *, exp(logit) / (1 + sum(exp(logit)) OVER (PARTITION BY doc_id, inst)) AS score FROM cells WHERE field = 'ip_address'),
single AS (SELECT doc_id, inst, field, cand, s, e, text, own, score FROM shares WHERE logit > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, inst ORDER BY logit DESC, cand) = 1),
assigned AS (SELECT * FROM likely WHERE score::FLOAT >= 0.4::FLOAT UNION ALL SELECT * FROM single WHERE score::FLOAT >= 0.4::FLOAT),
values_ AS (SELECT c.doc_id, c.inst, 'email' AS field, p.s, p.e, p.text, least(p.score, c.p::FLOAT) AS score FROM begun c JOIN pool p ON p.doc_id = c.doc_id AND p.cand = c.inst
 UNION ALL SELECT doc_id, inst, field, s, e, text, least(own, score::FLOAT) FROM assigned WHERE own >= 0.4::FLOAT AND (field <> 'phone_number' OR least(own, score::FLOAT) >= 0.6::FLOAT)),
slots AS (SELECT doc_id, inst || ':' || field AS label, s, e, text, score::FLOAT AS score FROM values_)"""
    tail = """, firsts AS (SELECT *, split_part(label, ':', 1)::INTEGER AS inst, split_part(label, ':', 2) AS field FROM kept QUALIFY row_number() OVER (PARTITION BY doc_id, label, lower(text) ORDER BY score DESC, s, e) = 1),
shown AS (SELECT *, text || '|' || printf('%.6f', score::DOUBLE) AS line, row_number() OVER (PARTITION BY doc_id, label ORDER BY score DESC, s, e) AS r FROM firsts)"""
    return resolved(f"{ctes}, {rows}", "flat", tail, "slots") + """ SELECT c.doc_id, c.record_ix::INTEGER AS record_ix, max(line) FILTER (field = 'email' AND r = 1) AS email, coalesce(string_agg(line, ';' ORDER BY r) FILTER (field = 'phone_number'), '') AS phone_numbers, max(line) FILTER (field = 'ip_address' AND r = 1) AS ip_address
FROM begun c JOIN shown s ON s.doc_id = c.doc_id AND s.inst = c.inst GROUP BY c.doc_id, c.record_ix"""


def _choices_request() -> str:
    words = ["the", "der", "le", "none"]
    score = "((24 + (length(choice) * 7) % 40) / 64)::FLOAT"
    listed = ", ".join(f"({q(c)}, {i})" for i, c in enumerate(words))
    run = r"[\p{L}\p{N}_]+"
    return f"""WITH {_record_ctes(['amount'], 'amount', 0.5)},
runs AS (SELECT doc_id, regexp_extract_all(body, {q(run)}, 0) AS wholes, string_split_regex(body, {q(run)}) AS gaps FROM docs),
run AS (SELECT doc_id, unnest(range(0, len(wholes))) AS i, unnest(wholes) AS word, unnest(gaps[1:len(wholes)]) AS gap FROM runs WHERE len(wholes) > 0),
word_at AS (SELECT doc_id, word, (sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i))::INTEGER AS e FROM run),
listed AS (SELECT * FROM (VALUES {listed}) c(choice, ix)), mentions AS (SELECT doc_id, choice, ix, (e - length(word))::INTEGER AS s, e FROM word_at JOIN listed ON lower(word) = choice),
owned AS (SELECT m.*, coalesce((SELECT arg_max(c.inst, {{'s': c.first, 'i': c.inst}}) FROM begun c WHERE c.doc_id = m.doc_id AND c.first <= m.s), (SELECT arg_min(c.inst, {{'s': c.first, 'i': c.inst}}) FROM begun c WHERE c.doc_id = m.doc_id)) AS inst FROM mentions m),
bound AS (SELECT * FROM owned WHERE inst IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, inst, choice ORDER BY s, ix) = 1),
near AS (SELECT b.doc_id, b.inst, choice, s FROM bound b JOIN begun c ON c.doc_id = b.doc_id AND c.inst = b.inst QUALIFY row_number() OVER (PARTITION BY b.doc_id, b.inst ORDER BY greatest(first - e, s - last, 0), s, ix) = 1),
guess AS (SELECT choice FROM listed WHERE {score} >= 0.4::FLOAT ORDER BY {score} DESC, ix LIMIT 1),
word AS (SELECT c.doc_id, c.inst, coalesce(n.choice, CASE WHEN m.doc_id IS NULL THEN (SELECT choice FROM guess) END) AS choice, n.s FROM begun c LEFT JOIN near n ON n.doc_id = c.doc_id AND n.inst = c.inst LEFT JOIN (SELECT DISTINCT doc_id FROM mentions) m ON m.doc_id = c.doc_id)
SELECT c.doc_id, c.record_ix::INTEGER AS record_ix, p.text AS amount, w.choice AS word, w.s AS word_start, round({score}::DOUBLE, 5) AS confidence FROM begun c JOIN pool p ON p.doc_id = c.doc_id AND p.cand = c.inst JOIN word w ON w.doc_id = c.doc_id AND w.inst = c.inst"""


JSON = "application/json"
#: Requests around a document's text (TEXT is its field): body, content type, and the parameter that the service names, or None where it accepts.
REQUESTS = [
    ('{TEXT, "entities": ["name"]}', JSON, None),
    ('{"text": "  ", "entities": ["name"]}', JSON, "text"),
    ('{TEXT, "entities": ["name"], "threshold": 1.5}', JSON, "threshold"),
    ('{TEXT, "entities": ["name"], "overlap": "sideways"}', JSON, "overlap"),
    ('{TEXT}', JSON, "schema"),
    ('{TEXT, "classify": ["oops"]}', JSON, "schema"),
    ('{TEXT, "relations": ["r"]}', JSON, "schema"),
    ('{TEXT, "entities": ["name"], "bogus": 1}', JSON, "body"),
    ("{nope", JSON, "body"),
    ('{TEXT, "entities": ["name"]}', "text/plain", "Content-Type"),
    ('{TEXT, "entities": ["name"], "model": "other"}', JSON, "model"),
    ('{TEXT, "entities": ["name"], "model": "multi", "overlap": "Keep-Longest", "threshold": 1, "max_words": 5}', JSON, None),
    ('{TEXT, "entities": ["name"]}', "application/vnd.api+json; charset=utf-8", None),
    ('{TEXT, "entities": ["name"]}', "application/jsonfoo", "Content-Type"),
    ('{TEXT, "entities": ["name"]}', None, None),
    ('{"text": 5, "entities": ["name"]}', JSON, "body"),
    ('{"entities": ["name"]}', JSON, "body"),
    ('{TEXT, "entities": ["name"], "threshold": "high"}', JSON, "body"),
    ('{TEXT, "entities": ["name", 1]}', JSON, "body"),
    ('{TEXT, "entities": null}', JSON, "body"),
    ('{TEXT, "entities": ["name"], "max_words": -1}', JSON, "body"),
    ('{TEXT, "entities": ["name"], "spans": 1}', JSON, "body"),
    ('{TEXT, "entities": ["name"], "overlap": null, "model": null, "max_words": null}', JSON, None),
    ('[1, 2]', JSON, "body"),
    ('{TEXT, "json": ["oops"], "classify": []}', JSON, "schema"),
    ('{TEXT, "entities": ["name"], "threshold": 2, "overlap": "sideways"}', JSON, "threshold"),
]


def _request_sql() -> str:
    """The expected answers as a table; a blank text is named unless something before it is wrong."""
    rows = ", ".join(f"({i}, {q(param) if param else 'NULL'})" for i, (_, _, param) in enumerate(REQUESTS))
    return f"""WITH answers(k, param) AS (VALUES {rows}), named AS (SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '^\\s*$') AND coalesce(param, '') NOT IN ('body', 'Content-Type', 'model') THEN 'text' ELSE param END AS param
 FROM documents JOIN answers ON doc_id % {len(REQUESTS)} = k) SELECT doc_id, CASE WHEN param IS NULL THEN 200 ELSE 422 END AS status, param FROM named"""


_ALLOWED = "e IS NOT NULL"
_QUESTION = f"""WITH {DOCS}, rows AS ({label_rows('docs', 'doc_id', CUES['topic'])}), shares AS (SELECT doc_id, label, ix, score::DOUBLE / sum(score::DOUBLE) OVER (PARTITION BY doc_id) AS p FROM rows)
SELECT doc_id, round(sum(ix * p), 6) AS level, round(max(p), 6) AS level_confidence, arg_max(label, {{'p': p, 'i': -ix}}) AS choice, round(max(p) FILTER (ix = 0), 6) AS yes FROM shares GROUP BY doc_id"""

ORACLE_SQL: dict[str, str] = {
    "tokenize_words": words_sql(WORDS),
    "tokenize_chars": words_sql(CHARS),
    "text_prepare": f"""WITH {DOCS}, w AS (SELECT doc_id, regexp_extract_all(CASE WHEN body = '' THEN '.' WHEN regexp_matches(body, '[.!?]$') THEN body ELSE body || '.' END, {q(WORDS)}, 0) AS words FROM docs)
SELECT doc_id, array_to_string(list_transform(words, LAMBDA x: lower(x)), ' ') AS model_words, len(words)::BIGINT AS n_words FROM w""",
    "text_first_words": f"""WITH {DOCS}, w AS (SELECT doc_id, body, regexp_extract_all(body, {q(WORDS)}, 0) AS words, string_split_regex(body, {q(WORDS)}) AS gaps FROM docs JOIN documents USING (doc_id) WHERE text IS NOT NULL),
cut AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN '' ELSE array_to_string(list_transform(range(1, least(len(words), 12) + 1), LAMBDA i: gaps[i] || words[i]), '') END AS cut FROM w) SELECT doc_id, length(cut)::INTEGER AS n_chars, md5(cut) AS cut_md5 FROM cut""",
    "chunk_documents": f"WITH {chunk_ctes()} SELECT doc_id, chunk_ix::INTEGER AS chunk_ix, chunk_start::INTEGER AS start_char, length(body)::BIGINT AS n_chars, md5(body) AS text_md5 FROM chunks",
    "span_enumerate": f"""WITH {DOCS}, n AS (SELECT doc_id, len(regexp_extract_all(body, {q(WORDS)}, 0)) AS n FROM docs), starts AS (SELECT doc_id, n, unnest(range(0, n)) AS s FROM n), spans AS (SELECT doc_id, s, unnest(range(s + 1, least(s + 8, n) + 1)) AS e FROM starts)
SELECT doc_id, count(*)::BIGINT AS n_spans, sum(s * 41 + e)::BIGINT AS checksum FROM spans GROUP BY doc_id""",
    "entities_threshold": entities_sql(PII, "CASE label WHEN 'email' THEN 0.4 WHEN 'phone_number' THEN 0.7 ELSE 0.5 END"),
    "entities_abstained": f"WITH {DOCS}, {labelled(PII)} , counted AS (SELECT doc_id FROM spans GROUP BY doc_id HAVING count(*) // 2 > 0) SELECT {RESULT} FROM spans JOIN counted USING (doc_id) JOIN docs USING (doc_id) WHERE NOT 1 / (1 + exp(-(length(body) % 7 - 3)::DOUBLE)) > 0.75",
    "entities_validated": entities_sql(PII[:3] + PII[4:], "0.3", "CASE label WHEN 'email' THEN regexp_matches(text, '(?i)^(?:[a-z0-9.]+@mail[0-9]\\.example\\.(com|net|org))$') WHEN 'ip_address' THEN NOT regexp_matches(text, '^10\\.') WHEN 'phone_number' THEN contains(text, '555') ELSE TRUE END"),
    **{f"overlap_{p.value}": overlap_sql(p.value) for p in OverlapPolicy},
    "overlap_greedy": overlap_sql("greedy"),
    "overlap_longest_join": overlap_sql("longest"),
    "entities_str": entities_sql(["name", "email"], "0.5", single=True, by_text=True),
    "entities_dedup_text": f"WITH {DOCS}, {labelled(['name'])} SELECT {RESULT} FROM spans QUALIFY row_number() OVER (PARTITION BY doc_id, label, lower(text) ORDER BY score DESC, s, e) = 1",
    "pii_redact": REDACT + " SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_spans, CASE WHEN c.doc_id IS NULL THEN d.body ELSE c.out || d.body[(c.pos + 1):] END AS redacted FROM docs d LEFT JOIN (SELECT * FROM cut WHERE k = n) c ON c.doc_id = d.doc_id",
    "highlight": REDACT + " SELECT d.doc_id, (marks + plains + CASE WHEN pos < length(body) THEN 1 ELSE 0 END)::BIGINT AS segments, marks::BIGINT AS marked, length(body)::BIGINT AS chars FROM docs d JOIN cut c ON c.doc_id = d.doc_id WHERE k = n",
    "classify_single": classify_sql("language", None),
    "classify_multi": classify_sql("topic", 0.25),
    "classify_topk": f"WITH {DOCS} SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ix) AS rank FROM ({label_rows('docs', 'doc_id', CUES['topic'])}) QUALIFY rank <= 2",
    "classify_vector": """WITH rows AS (SELECT vec_id AS doc_id, 'axis' || (i - 1) AS label, embedding[i]::DOUBLE * 4 / 0.5 AS logit FROM embeddings, range(1, 5) r(i))
SELECT doc_id, 'axis' AS task, label, round(exp(logit) / sum(exp(logit)) OVER (PARTITION BY doc_id), 6) AS score FROM rows""",
    "classify_sharded_rank": """WITH rows AS (SELECT vec_id AS doc_id, label AS own, (i - 1)::VARCHAR AS label, round(embedding[i]::DOUBLE, 9) AS score FROM embeddings, range(1, 11) r(i)),
ranks AS (SELECT doc_id, own, label, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS rank, count(*) OVER (PARTITION BY doc_id) AS labels FROM rows)
SELECT doc_id, label, rank, labels FROM ranks WHERE label = own::VARCHAR""",
    "classify_vs_labels": f"""WITH {DOCS}, rows AS (SELECT doc_id, score, quality FROM ({label_rows('docs', 'doc_id', {'number': CUES['topic']['number']})}) JOIN labels USING (doc_id)), steps AS (SELECT *, unnest(range(1, 8))::INTEGER AS step FROM rows)
SELECT step, count(*) FILTER (score >= (step / 8)::FLOAT AND quality = 1) AS good_above, count(*) FILTER (score >= (step / 8)::FLOAT AND quality = 0) AS bad_above, count(*) AS n FROM steps GROUP BY step""",
    "question_answers": _QUESTION,
    "relation_pairs": f"WITH {pair_ctes()} SELECT {EDGE} FROM pairs",
    "relation_canonical": f"WITH {pair_ctes()}, {canonical_ctes('pairs')} SELECT {EDGE} FROM canon",
    "relation_edges": f"WITH {pair_ctes()}, enough AS (SELECT * FROM pairs WHERE score >= 0.5::FLOAT), {canonical_ctes('enough')}, {SEMANTIC} SELECT {EDGE} FROM edges",
    "attributes_single": attribute_sql(False),
    "attributes_multi": attribute_sql(True),
    "choice_mentions": f"WITH {choice_ctes()} SELECT doc_id, choice, s AS span_start, e AS span_end FROM mentions",
    "choice_bind_anchor": f"WITH {choice_ctes()}, {BOUND} SELECT doc_id, owner, choice, s AS span_start, e AS span_end FROM bound",
    "choice_nearest": f"WITH {choice_ctes()}, {BOUND} SELECT doc_id, owner, choice, s AS span_start FROM bound JOIN anchors USING (doc_id, owner) QUALIFY row_number() OVER (PARTITION BY doc_id, owner ORDER BY greatest(a_s - e, s - a_e, 0), s, ix) = 1",
    "legacy_structure": resolved(f"{DOCS}, {labelled(['email', 'phone_number', 'ip_address'])}, enough AS (SELECT * FROM spans WHERE score >= 0.4::FLOAT)", "flat", """, firsts AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY doc_id, label, lower(text) ORDER BY score DESC, s, e) = 1)""", "enough")
    + """ SELECT doc_id, arg_min(text, {'a': -score, 's': s, 'e': e}) FILTER (label = 'email') AS email, coalesce(string_agg(text, '|' ORDER BY score DESC, s, e) FILTER (label = 'phone_number'), '') AS phone_numbers, coalesce(string_agg(text, '|' ORDER BY score DESC, s, e) FILTER (label = 'ip_address'), '') AS ip_addresses FROM firsts GROUP BY doc_id""",
    "records_natural": f"WITH {RECORDS}, rows AS (SELECT doc_id, inst, 'key' AS field, inst AS cand, p AS score FROM chosen UNION ALL SELECT * FROM {FIELDS}) SELECT {RECORD_ROW} FROM rows JOIN chosen USING (doc_id, inst)",
    "records_latent": f"""WITH {RECORDS}, rows AS (SELECT * FROM {FIELDS} JOIN chosen USING (doc_id, inst)), keys AS (SELECT doc_id, inst, p, list_sort(list({{'f': field, 'c': cand}})) AS key FROM rows GROUP BY doc_id, inst, p),
firsts AS (SELECT doc_id, inst FROM keys QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY p DESC, inst) = 1) SELECT {RECORD_ROW} FROM rows SEMI JOIN firsts USING (doc_id, inst)""",
    "extract_attributes": _attributes_request(),
    "extract_records": _records_request(),
    "choice_values": _choices_request(),
    "long_entities": resolved(
        f"{chunk_ctes()}, {matches('chunks', 'doc_id, chunk_ix, chunk_start', [(x, p) for x in PII for p in PATTERNS[x]]).replace('each AS', 'each_match AS').replace('FROM each)', 'FROM each_match)')}, moved AS (SELECT doc_id, label, (s + chunk_start)::INTEGER AS s, (e + chunk_start)::INTEGER AS e, text, score FROM spans)",
        "flat", "", "moved",
    ) + f" SELECT {RESULT} FROM kept QUALIFY label <> 'api_key' OR row_number() OVER (PARTITION BY doc_id, label ORDER BY s, e, text) = 1",
    "long_classify": f"""WITH {chunk_ctes()}, single AS ({long_labels(None)}), multi AS ({long_labels(0.15)})
SELECT doc_id, 'single' AS task, arg_max(label, {{'p': score, 'i': chunk_ix}}) AS label, round(max(score)::DOUBLE, 6) AS score FROM single GROUP BY doc_id
UNION ALL SELECT doc_id, 'multi', label, round(max(score)::DOUBLE, 6) FROM multi GROUP BY doc_id, label
UNION ALL SELECT doc_id, 'vote', arg_max(label, {{'n': n, 'f': -f}}), 0.0 FROM (SELECT doc_id, label, count(*) AS n, min(chunk_ix) AS f FROM single GROUP BY doc_id, label) GROUP BY doc_id""",
    "long_relations": f"""WITH {chunk_ctes()}, {matches('chunks', 'doc_id, chunk_ix, chunk_start', [(x, p) for x in ('email', 'phone_number') for p in PATTERNS[x]]).replace('each AS', 'each_match AS').replace('FROM each)', 'FROM each_match)')},
edges AS (SELECT h.doc_id, 'mail_phone' AS relation, h.chunk_ix, h.s + h.chunk_start AS hs, h.e + h.chunk_start AS he, h.text AS ht, t.s + t.chunk_start AS ts, t.e + t.chunk_start AS te, t.text AS tt, (h.score * t.score)::FLOAT AS score FROM spans h JOIN spans t ON h.doc_id = t.doc_id AND h.chunk_ix = t.chunk_ix AND h.label = 'email' AND t.label = 'phone_number')
SELECT {EDGE} FROM edges QUALIFY row_number() OVER (PARTITION BY doc_id, hs, he, ts, te ORDER BY score DESC, chunk_ix) = 1""",
    "pool_topk_pairs": pool_sql(False, 10),
    "pool_quota_union": pool_sql(True, 12),
    "interval_mean": """WITH rows AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ix, round(value * 100) AS cents FROM events)
SELECT user_id, (ix // 5) * 5 AS first_ix, round(avg(cents), 4) AS mean FROM rows GROUP BY user_id, ix // 5""",
    "score_functions": """WITH rows AS (SELECT vec_id, list_transform(embedding, LAMBDA x: round(x::DOUBLE, 5)) AS v FROM embeddings), p AS (SELECT *, list_transform(v, LAMBDA x: exp(x)) AS r FROM rows), d AS (SELECT *, (vec_id % 200 - 100) AS g FROM p)
SELECT vec_id, round(list_max(r) / list_sum(r), 6) AS top, (list_position(v, list_max(v)) - 1)::INTEGER AS best, round(list_sum(list_transform(range(1, len(r) + 1), LAMBDA i: (i - 1) * r[i])) / list_sum(r), 6) AS level, round(list_sum(list_transform(v, LAMBDA x: x * x)), 6) AS norm2,
 round(ln(1 + (vec_id % 50 + 1)), 6) AS log_length, round(1 / sqrt(vec_id % 50 + 1), 6) AS inverse_root,
 (CASE WHEN abs(g) <= 16 THEN g ELSE sign(g) * (ceil(ln(abs(g) / 16) / ln(127 / 16) * 15) + 16) END)::INTEGER AS bucket,
 round(list_sum(list_transform(range(1, len(v) + 1), LAMBDA i: v[i] * 0.8::DOUBLE ** (len(v) - i) * CASE WHEN i = 1 THEN 1 ELSE 0.2::DOUBLE END)), 6) AS smoothed FROM d""",
    "events_last6": "SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS last FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 6) GROUP BY user_id",
    "events_action_stats": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 4) AS mean_value FROM events GROUP BY event_type",
    "events_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
    "page_links": "SELECT page_id, len(x)::BIGINT AS n_links, md5(array_to_string(x, chr(10))) AS links_md5 FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS x FROM pages)",
    "text_lines": "SELECT doc_id, ix::INTEGER AS ix, md5(line) AS line_md5 FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS ix, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE NOT regexp_matches(line, '^\\s*$')",
    "request_validation": _request_sql(),
    "render_classification": f"""WITH {DOCS}, rows AS ({label_rows('docs', 'doc_id', CUES['topic'])}), marked AS (SELECT *, score >= 0.25::FLOAT OR row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ix) = 1 AS yes FROM rows)
SELECT doc_id, replace(replace(replace(any_value(body), chr(9), ' '), chr(13), ' '), chr(10), ' ') || chr(9) || 'topic: ' || string_agg(CASE WHEN yes THEN '*' ELSE '' END || label || printf(' (%.3f)', score::DOUBLE), ', ' ORDER BY ix) AS line FROM marked JOIN docs USING (doc_id) GROUP BY doc_id""",
}


def _guards() -> None:
    from .operators.guardrails import tasks

    for side, role in (("prompt", "user"), ("response", "assistant")):
        ORACLE_SQL[f"guardrails_{side}"] = guard_sql(role, [(t.task, list(t.labels), t.multi_label) for t in tasks(side)])


_guards()
