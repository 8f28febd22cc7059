"""DuckDB SQL for the registered queries of this package that SQL can express."""

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op2_debruijn_dedup"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 12, 0))) AS s FROM d),
windows AS (SELECT doc_id, s, array_to_string(list_slice(ws, s + 1, s + 13), ' ') AS g FROM starts),
firsts AS (SELECT g, min(doc_id) AS m FROM windows GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, s + o.o AS p FROM windows JOIN firsts USING (g), (SELECT unnest(range(0, 13)) AS o) o WHERE doc_id > m),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

# base32 of the SHA-1: the 40 hex digits as 160 bits, five at a time
ORACLE_SQL["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
hexed AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h FROM p),
bits AS (
  SELECT page_id, n, array_to_string(list_transform(range(1, 41), lambda i: substr(
    '0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', substr(h, i, 1)) - 1) + 1, 4)), '') AS b
  FROM hexed),
coded AS (
  SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(b, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(b, 5 * i + 3, 1) AS INT)
      + 2 * CAST(substr(b, 5 * i + 4, 1) AS INT) + CAST(substr(b, 5 * i + 5, 1) AS INT), 1)), '') AS c
  FROM bits),
newest AS (SELECT *, max(page_id) OVER (PARTITION BY c) AS m FROM coded)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, c AS payload_digest, CASE WHEN m > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m > page_id THEN m END AS refers_to
FROM newest"""


def _lloyd(rounds: int) -> str:
    """Codebooks b0 to b<rounds> and assignments a1 to a<rounds + 1>, each of the codebook before it."""
    out = ""
    for i in range(1, rounds + 2):
        out += f"""
a{i} AS MATERIALIZED (
  SELECT rid, p, any_value(x) AS x, arg_min(k, {{'d': d, 'k': k}}) AS k, min(d) AS d
  FROM (SELECT s.rid, s.p, s.x, b.k, list_sum(list_transform(range(1, len(s.x) + 1), lambda j: (s.x[j] - b.x[j]) * (s.x[j] - b.x[j]))) AS d
        FROM parts s JOIN b{i - 1} b ON b.p = s.p) GROUP BY rid, p),"""
        if i <= rounds:
            out += f"""
m{i} AS MATERIALIZED (
  SELECT p, k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS x
  FROM (SELECT p, k, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, k, x, unnest(range(1, len(x) + 1)) AS j FROM a{i}) GROUP BY p, k, j)
  GROUP BY p, k),
b{i} AS MATERIALIZED (SELECT p, k, coalesce(m.x, b.x) AS x FROM b{i - 1} b LEFT JOIN m{i} m USING (p, k)),"""
    return out


ORACLE_SQL["op13_vector_codes"] = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT rid, vec_id, p, list_slice(e, p * (len(e) // 8) + 1, (p + 1) * (len(e) // 8)) AS x FROM v, (SELECT unnest(range(8)) AS p)),
b0 AS MATERIALIZED (SELECT p, k, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k FROM parts) WHERE k < 16),{_lloyd(6)}
codes AS (SELECT rid, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a7 GROUP BY rid),
books AS (SELECT sha256(string_agg(CAST(x[j] AS VARCHAR), ',' ORDER BY p, k, j)) AS digest FROM (SELECT p, k, x, unnest(range(1, len(x) + 1)) AS j FROM b6))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
FROM v JOIN codes USING (rid), books"""
