"""DuckDB SQL for those text queries that SQL can express."""

from __future__ import annotations

_OP1 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), good AS (
  SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1 AND coalesce(max(toxic), 0) = 0
), p AS (
  SELECT u.doc_id, u.w, CASE WHEN i = 1 THEN ' ' ELSE l[i - 1] END AS h, good.doc_id IS NOT NULL AS g
  FROM (SELECT doc_id, w AS l, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM w) u LEFT JOIN good ON good.doc_id = u.doc_id
), pair AS (SELECT h, w, count(*) AS c, count(*) FILTER (g) AS t FROM p GROUP BY ALL
), word AS (SELECT w, count(*) AS c, count(*) FILTER (g) AS t FROM p GROUP BY ALL
), head AS (SELECT h, count(*) AS c, count(*) FILTER (g) AS t FROM p GROUP BY ALL
), size AS (SELECT count(*) AS n, count(*) FILTER (g) AS tn, count(DISTINCT w) + 2 AS width FROM p
), own_pair AS (SELECT doc_id, h, w, count(*) AS o FROM p GROUP BY ALL
), own_word AS (SELECT doc_id, w, count(*) AS o FROM p GROUP BY ALL
), own_head AS (SELECT doc_id, h, count(*) AS o FROM p GROUP BY ALL
), own AS (SELECT doc_id, bool_or(g) AS g, count(*) AS o FROM p GROUP BY ALL
), loss AS (
  SELECT op.doc_id, op.o AS times,
    ln(head.c - oh.o + 50.0) - ln(pair.c - op.o + 50.0 * (word.c - ow.o + 1) / (size.n - own.o + size.width)) AS b,
    ln(head.t - oh.o * CAST(own.g AS INT) + 50.0) - ln(pair.t - op.o * CAST(own.g AS INT)
      + 50.0 * (word.t - ow.o * CAST(own.g AS INT) + 1) / (size.tn - own.o * CAST(own.g AS INT) + size.width)) AS t
  FROM own_pair op JOIN pair USING (h, w) JOIN word USING (w) JOIN head USING (h) JOIN own_word ow USING (doc_id, w)
  JOIN own_head oh USING (doc_id, h) JOIN own USING (doc_id), size
), mean AS (
  SELECT doc_id, sum(t * times) / sum(times) AS t, sum(b * times) / sum(times) AS b FROM loss GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_tokens, round(t, 6) AS target_loss, round(b, 6) AS background_loss, round(b - t, 6) AS score
FROM w LEFT JOIN mean ON mean.doc_id = w.doc_id
"""

_OP3 = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM g
"""

_OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM w
), e AS (
  SELECT doc_id, unnest(s) AS x FROM s
), n AS (
  SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), linked AS (
  SELECT a, b FROM links JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= 75 * (x.n_shingles + y.n_shingles - shared)
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM n
  UNION
  SELECT reach.node, linked.b FROM reach JOIN linked ON reach.seen = linked.a
)
SELECT n.doc_id, n.n_shingles, min(seen) AS component_id, n.doc_id = min(seen) AS kept
FROM n JOIN reach ON reach.node = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""

_OP7 = r"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), n AS (
  SELECT doc_id, b, CAST(octet_length(b) AS BIGINT) AS n FROM d
), w AS (
  SELECT doc_id, i, md5_number(b[i:i + 199]) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 198)) AS i FROM n WHERE n >= 200)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1
), e AS (
  SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS new FROM r
), g AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM e
), s AS (
  SELECT doc_id, min(i) AS a, max(i) + 199 AS z FROM g GROUP BY doc_id, g
), k AS (
  SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p FROM s
), t AS (
  SELECT k.doc_id, count(*) AS n_spans, CAST(sum(z - a + 1) AS BIGINT) AS n_removed, list(b[p + 1:a - 1] ORDER BY a) AS parts, max(z) AS last FROM k JOIN n ON n.doc_id = k.doc_id GROUP BY k.doc_id
)
SELECT n.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN t.doc_id IS NULL THEN b ELSE list_reduce(parts, lambda x, y: x || y) || b[last + 1:n] END) AS kept_sha256
FROM n LEFT JOIN t ON t.doc_id = n.doc_id
"""

_OP8 = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x
  FROM w WHERE len(w) > 2
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CAST(100 * n_symbols > 10 * n_words AS INT) + CAST(100 * n_dup_lines > 30 * lines AS INT)
      + CAST(word_chars < 3 * n_words OR word_chars > 12 * n_words AS INT) AS soft
  FROM m
), h AS (
  SELECT source, count(*) AS docs, CAST(count(*) FILTER (base_failed OR soft > 0) AS DOUBLE) AS failed FROM b GROUP BY source
), p AS (
  SELECT avg(failed / docs) AS m, var_samp(failed / docs) AS v FROM h
), q AS (
  SELECT m, greatest(1.0, least(1000.0, CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 100.0 END)) AS s FROM p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND soft < CASE WHEN (failed + s * m) / (docs + s) > 0.5 THEN 1 ELSE 2 END AS kept
FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source, q
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_cross_entropy": _OP1, "op3_warc": _OP3, "op6_lsh_forest": _OP6, "op7_suffix_arrays": _OP7, "op8_host_rules": _OP8}
