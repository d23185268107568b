"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

import re

from tidemark.llm.decontaminate import WINDOW
from tidemark.llm.license_scan import COVER, GAP, PHRASES, TEMPLATES, K

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(column: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}')"


def _values(rows: list[tuple]) -> str:
    return ", ".join(f"({', '.join(repr(x) for x in r)})" for r in rows)


def _plain(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


OP1 = f"""WITH d AS (SELECT doc_id, {words_of('text')} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words_of('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
bk AS (SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM bk),
dk AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM dk),
h AS (SELECT dw.doc_id, dw.n, dw.k, bw.item FROM dw JOIN bw USING (n, g)),
places AS (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM h),
hits AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""

_PHRASES = _values([(p, label, len(p.split())) for p, label in PHRASES.items()])
_TRIPLES = _values([(t, q, " ".join(w[q : q + K])) for t, (_, notice) in enumerate(TEMPLATES) for w in [_plain(notice)] for q in range(len(w) - K + 1)])
_LENGTHS = _values([(t, label, len(_plain(notice))) for t, (label, notice) in enumerate(TEMPLATES)])

OP4 = f"""WITH d AS (SELECT doc_id, {words_of('text')} AS w FROM documents),
phrases(phrase, label, m) AS (VALUES {_PHRASES}), triples(t, q, g) AS (VALUES {_TRIPLES}), lengths(t, label, size) AS (VALUES {_LENGTHS}),
pk AS (SELECT doc_id, w, phrase, label, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, phrases WHERE len(w) >= m),
base AS (SELECT doc_id, k - 1 AS place, label FROM pk WHERE w[k] = split_part(phrase, ' ', 1) AND array_to_string(w[k:k + m - 1], ' ') = phrase),
told AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
gk AS (SELECT doc_id, w, unnest(range(1, len(w) - {K} + 2)) AS k FROM d WHERE len(w) >= {K}),
v AS (SELECT doc_id, t, k - 1 - q AS diagonal, q FROM gk JOIN triples ON array_to_string(w[k:k + {K - 1}], ' ') = g),
edges AS (SELECT doc_id, t, diagonal, CASE WHEN diagonal - lag(diagonal) OVER w > {GAP} THEN 1 ELSE 0 END AS far FROM (SELECT DISTINCT doc_id, t, diagonal FROM v) WINDOW w AS (PARTITION BY doc_id, t ORDER BY diagonal)),
islands AS (SELECT *, sum(far) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS island FROM edges),
covered AS (SELECT DISTINCT v.doc_id, v.t, i.island, unnest(range(v.q, v.q + {K})) AS word FROM v JOIN islands i USING (doc_id, t, diagonal)),
cover AS (SELECT c.doc_id, l.label, count(*) / l.size AS cover FROM covered c JOIN lengths l USING (t) GROUP BY c.doc_id, c.t, c.island, l.label, l.size),
top AS (SELECT doc_id, max(cover) AS cover FROM cover GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM cover WHERE cover >= {COVER}) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE least(coalesce(cover, 0), 1)::DOUBLE END AS score
FROM d LEFT JOIN told USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN every USING (doc_id)"""

OP11 = """WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, r.id, r.label = a.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM r a JOIN r ON a.id <> r.id WHERE a.id % 100 = 0),
p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
w AS (SELECT p.anchor, p.id AS positive, n.id AS negative, p.score AS top, n.score FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(row_number() OVER (PARTITION BY anchor, positive ORDER BY score DESC, negative) AS INTEGER) AS rank, negative AS negative_id, top AS positive_score, score AS negative_score
FROM w QUALIFY rank <= 5"""

OP12 = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, {words_of('text')} AS w FROM documents),
c AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({words_of('text')}) AS t FROM benchmark WHERE item_id IS NOT NULL),
e AS (SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM d),
tf AS (SELECT row, doc_id, n, t, count(*) AS tf FROM e GROUP BY row, doc_id, n, t),
df AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY t, docs),
s AS (SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // total))))) AS BIGINT) AS score FROM q JOIN tf USING (t) JOIN df USING (t), c GROUP BY item_id, row, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10"""

#: Base32 from the hash's bits, five at a time.
OP13 = """WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, coalesce(html, '') AS html, CAST(unhex(sha1(coalesce(html, ''))) AS BIT)::VARCHAR AS bits FROM pages),
g AS (SELECT html, max(page_id) AS largest FROM p GROUP BY html)
SELECT page_id, payload_bytes,
list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda k: CAST(substr(bits, CAST(5 * i + k + 1 AS INTEGER), 1) AS INTEGER) * CAST(pow(2, 4 - k) AS INTEGER)))::INTEGER, 1)), 'string_agg', '') AS payload_digest,
CASE WHEN page_id IS DISTINCT FROM largest AND largest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM p JOIN g USING (html)"""

ORACLE_SQL = {"op1_decontaminate": OP1, "op4_licenses": OP4, "op11_hard_negatives": OP11, "op12_search": OP12, "op13_warc": OP13}
