"""What SQL can say of the operators' results. The others are tested against brute force."""

from __future__ import annotations

_QUALITY_RULES = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    [x FOR x IN string_split(coalesce(text, ''), chr(10))
     IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM documents
),
g AS (
  SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1)
  GROUP BY doc_id
),
m AS (
  SELECT d.doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words
    OR word_chars > 25 * n_words OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM m
"""

_WARC = """
SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
  sha1(coalesce(html, '')) AS payload_digest,
  CASE WHEN page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < newest THEN newest END AS refers_to,
  true AS intact
FROM (
  SELECT page_id, html,
    CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000
      THEN max(page_id) OVER (PARTITION BY coalesce(html, '')) END AS newest
  FROM pages
)
"""


_FILL_MIDDLE = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
  FROM documents
),
d AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM u
),
c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi, u,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90
      THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
),
p AS (
  SELECT doc_id, t, n, form, array_to_string(u[:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m,
    array_to_string(u[hi + 1:], '') AS s
  FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def _clustering(dimensions: int = 64, k: int = 40, rounds: int = 5) -> str:
    """Every vector against every centroid, a table per round."""

    def assigned(r: int) -> str:
        return f"""
a{r} AS MATERIALIZED (
  SELECT key, c, d FROM (
    SELECT v.key, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d
    FROM v JOIN c{r} AS c USING (i) GROUP BY v.key, c.c)
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY d, c) = 1)"""

    def moved(r: int) -> str:
        return f"""
c{r + 1} AS MATERIALIZED (
  SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, x) AS x
  FROM c{r} LEFT JOIN (
    SELECT c, i, sum(v.x) AS s, count(*) AS n FROM v JOIN a{r} USING (key) GROUP BY c, i) USING (c, i))"""

    steps = ",".join(assigned(r) + "," + moved(r) for r in range(rounds))
    return f"""
WITH e AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS key, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
  FROM embeddings
  WHERE len(embedding) = {dimensions}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}),
v AS MATERIALIZED (
  SELECT key, i, CAST(floor(256 * e[i]) AS HUGEINT) AS x FROM e, range(1, {dimensions + 1}) AS r(i)),
f AS MATERIALIZED (
  SELECT key, row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) - 1 AS c
  FROM e QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT c, i, x FROM f JOIN v USING (key)),{steps},{assigned(rounds)},
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
  CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  centroid_sha256
FROM a{rounds} JOIN e USING (key) JOIN h USING (c)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_warc": _WARC,
        "op6_quality_rules": _QUALITY_RULES,
        "op11_clustering": _clustering(),
        "op12_fill_middle": _FILL_MIDDLE,
    }
