"""DuckDB SQL for the queries of this subpackage that SQL can express at whole-table size.

op2 (a trained network), op5 (a trained random field) and op6 (a tokenizer) have none.
"""

from __future__ import annotations

from headmint.llm.secrets import RULES

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)
), r(x, y) AS (
  SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
), m AS (SELECT x, min(y) AS y FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.x = d.doc_id
"""

OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s) WHERE k <= 5
"""

OP4 = f"""
WITH d AS (
  SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATOR}'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATOR}'), lambda x: x <> '') AS w FROM benchmark
  ) WHERE len(w) > 0
), g AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)
), o AS (
  SELECT id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)
), h AS (SELECT id, i, n, item_id FROM o JOIN g USING (n, gram)
), c AS (
  SELECT id, count(DISTINCT k) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS k FROM h) GROUP BY 1
), t AS (
  SELECT id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT id, item_id FROM h) GROUP BY 1
)
SELECT d.id AS doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (id) LEFT JOIN t USING (id)
"""

OP7 = f"""
WITH d AS (SELECT doc_id AS id, {WORDS.format("coalesce(text, '')")} AS w FROM documents
), o AS (
  SELECT id, i, array_to_string(w[i:i + 12], ' ') AS gram FROM (SELECT id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), f AS (SELECT gram, min(id) AS low FROM o GROUP BY 1
), g AS (
  SELECT DISTINCT id, k FROM (SELECT id, unnest(range(i, i + 13)) AS k FROM o JOIN f USING (gram) WHERE id > low)
), u AS (SELECT id, k, w[k] AS word FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS k FROM d)
), s AS (
  SELECT u.id, count(*) AS n_words, count(g.k) AS n_removed, string_agg(word, ' ' ORDER BY u.k) FILTER (WHERE g.k IS NULL) AS kept
  FROM u LEFT JOIN g ON g.id = u.id AND g.k = u.k GROUP BY 1
)
SELECT d.id AS doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (id)
"""

OP8 = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), l AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '### Assistant:|### System:|### Role \[|### User:|### Tool:|</turn>|\]:|\\')) +
    CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 WHEN 'tool' THEN 10
    ELSE 13 + length(role) + len(regexp_extract_all(role, '### Assistant:|### System:|### Role \[|### User:|### Tool:|</turn>|\]:|\\')) END + 8 AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(CAST(sum(length(text)) FILTER (WHERE role = 'assistant') AS BIGINT), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id
"""

OP10 = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS low FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN low < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN low < page_id THEN low END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


def _secret_scan() -> str:
    parts = []
    for rank, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, '{r.kind}' AS kind, {rank} AS rank, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {r.group}) AS part, regexp_split_to_array(text, '{p}') AS gap, {r.min_length} AS least, {r.min_group} AS least_part FROM d WHERE regexp_matches(text, '{p}')")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), f AS ({" UNION ALL ".join(parts)}
), x AS (
  SELECT doc_id, kind, rank, least, least_part, unnest(m) AS m, unnest(part) AS part, unnest(gap[:len(m)]) AS gap, unnest(range(len(m))) AS k FROM f
), s AS (
  SELECT doc_id, kind, rank, least, least_part, length(m) AS size, length(part) AS part,
    CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY k) AS BIGINT) AS stop FROM x
), g AS (
  SELECT doc_id, rank, stop - size AS start, stop, kind || ':' || (stop - size) || ':' || stop AS span FROM s WHERE size >= least AND part >= least_part
), a AS (
  SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM g GROUP BY 1
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


#: Patterns and checks of the base kinds of personal data, spelled out here and not taken from the operator.
PII_BASE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), f AS (
  SELECT doc_id, 'email' AS kind, 0 AS rank, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS m, regexp_split_to_array(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS gap FROM d
  UNION ALL SELECT doc_id, 'ip', 1, regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), regexp_split_to_array(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') FROM d
  UNION ALL SELECT doc_id, 'card', 2, regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), regexp_split_to_array(text, '[0-9]([\x20-]?[0-9])+') FROM d
  UNION ALL SELECT doc_id, 'phone', 3, regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), regexp_split_to_array(text, '\+[0-9][\x20().0-9-]+[0-9]') FROM d
), x AS (SELECT doc_id, kind, rank, unnest(m) AS m, unnest(gap[:len(m)]) AS gap, unnest(range(len(m))) AS k FROM f
), s AS (
  SELECT doc_id, kind, rank, m, reverse(regexp_replace(m, '[^0-9]', '', 'g')) AS digits,
    CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY k) AS BIGINT) AS stop FROM x
), g AS (
  SELECT doc_id, rank, stop - length(m) AS start, kind || ':' || (stop - length(m)) || ':' || stop AS span FROM s WHERE CASE kind
    WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda p: coalesce(TRY_CAST(p AS BIGINT), 999) > 255)) = 0
    WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(digits, i, 1) AS INTEGER) ELSE 2 * CAST(substr(digits, i, 1) AS INTEGER) - CASE WHEN substr(digits, i, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15 ELSE TRUE END
), a AS (
  SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS e, count(*) FILTER (WHERE rank = 1) AS i, count(*) FILTER (WHERE rank = 2) AS c, count(*) FILTER (WHERE rank = 3) AS p, string_agg(span, ',' ORDER BY rank, start) AS base FROM g GROUP BY 1
)
SELECT doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256
FROM d LEFT JOIN a USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1,
    "op3_kd_topk": OP3,
    "op4_decontaminate": OP4,
    "op7_substring_dedup": OP7,
    "op8_chat_format": OP8,
    "op9_secret_scan": _secret_scan(),
    "op10_warc": OP10,
    "pii_base": PII_BASE,
}
