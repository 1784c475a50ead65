"""DuckDB SQL with the same rows as the queries that SQL can express on whole tables."""

from basketry.llm.license_scan import CONTAINMENT, NOTICES, PHRASES, template_table

_OP3 = """
WITH digests AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), named AS (
  SELECT page_id, payload_bytes, hex, max(page_id) OVER (PARTITION BY hex) AS keeper FROM digests
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM named
"""

_OP5 = """
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT vec_id AS u, vec_id AS r FROM embeddings
  UNION
  SELECT links.u, reach.r FROM links JOIN reach ON links.v = reach.u
), roots AS (SELECT u, min(r) AS component_id FROM reach GROUP BY u),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN roots r ON e.vec_id = r.u LEFT JOIN counts c ON e.vec_id = c.u
"""

_OP6 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM shared JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v
  WHERE 100 * n_both >= 75 * (a.n + b.n - n_both)
), reach AS (
  SELECT doc_id AS u, doc_id AS r FROM documents
  UNION
  SELECT links.u, reach.r FROM links JOIN reach ON links.v = reach.u
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT u, min(r) AS component_id FROM reach GROUP BY u) r ON r.u = d.doc_id
"""

_OP7 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.*, s.keeper IS NOT NULL AND k.doc_id < s.keeper AS lost FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""



def _listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TEMPLATES = template_table(NOTICES, PHRASES, CONTAINMENT)
_OP11 = r"""
WITH words AS (
  SELECT row_number() OVER () AS line, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), phrases(label, p) AS (VALUES %s
), notices(label, t, step, needed) AS (VALUES %s
), starts AS (SELECT line, w, unnest(range(len(w))) AS spot FROM words
), places AS (SELECT line, label, spot FROM starts, phrases WHERE w[spot + 1:spot + len(p)] = p
), blocks AS (
  SELECT line, w, label, t, step, needed, unnest(range((len(w) + step - 1) // step)) AS b FROM words, notices
), held AS (
  SELECT line, label, len(t) AS size, needed, len(list_intersect(list_distinct(w[b * step + 1:(b + 2) * step]), t)) AS n FROM blocks
), matches AS (
  SELECT line, 'phrase' AS kind, label, spot, CAST(1 AS DOUBLE) AS score FROM places
  UNION ALL SELECT line, 'notice', label, NULL, CAST(n AS DOUBLE) / size FROM held WHERE n >= needed
), found AS (
  SELECT line, count(*) FILTER (WHERE kind = 'phrase') AS n_base, min(spot) AS first_word, max(spot) AS last_word, max(score) AS score,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE kind = 'phrase') AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM matches GROUP BY line
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM words LEFT JOIN found USING (line)
""" % (", ".join(f"('{t['label']}', {_listed(t['words'])})" for t in _TEMPLATES if t["kind"] == "phrase"),
       ", ".join(f"('{t['label']}', {_listed(t['tokens'])}, {len(t['words'])}, {t['needed']})"
                 for t in _TEMPLATES if t["kind"] == "notice"))

_OP13 = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), ranked AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS place,
    other AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE place <= 10
"""

ORACLE_SQL = {"op3_warc_bundles": _OP3, "op5_vector_join": _OP5, "op6_jaccard_join": _OP6, "op7_line_dedup": _OP7,
              "op11_license_scan": _OP11, "op13_hard_negatives": _OP13}
