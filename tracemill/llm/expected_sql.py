"""DuckDB statements with the results of the registered queries that SQL can express."""

from tracemill.llm import fill_in_middle, mixing, sharding

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

STATEMENTS = {
    "op1_source_mixing": f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, {_WORDS} AS t FROM documents),
sums AS (
  SELECT source, CAST(sum(t) AS BIGINT) AS whole, sum(t) / (SELECT sum(t) FROM rows)::DOUBLE AS share
  FROM rows GROUP BY source HAVING sum(t) > 0),
-- One decimal pair per step, as the exponent is searched on a grid of six decimals.
search AS (
  SELECT 0 AS step, 0::BIGINT AS low_e, 0::BIGINT AS low_r, false AS end_e, false AS end_r
  UNION ALL
  SELECT step + 1,
    CASE WHEN end_e THEN low_e WHEN c.e IS NULL THEN 0 WHEN step = 0 AND c.e = 100 THEN 1000000
         ELSE low_e + c.e * CAST(pow(10, 4 - 2 * step) AS BIGINT) END,
    CASE WHEN end_r THEN low_r WHEN c.r IS NULL THEN 1000000 WHEN c.r = 0 AND step = 0 THEN 0
         ELSE low_r + (c.r - CASE WHEN step = 2 THEN 0 ELSE 1 END) * CAST(pow(10, 4 - 2 * step) AS BIGINT) END,
    end_e OR c.e IS NULL OR (step = 0 AND c.e = 100), end_r OR c.r IS NULL OR (c.r = 0 AND step = 0)
  FROM search, LATERAL (
    SELECT max(i) FILTER (WHERE ln(ze) - ae * se / ze >= {mixing.ENTROPY_SHARE!r} * ln(k) - 1e-12) AS e,
           min(i) FILTER (WHERE rr / zr <= {mixing.MAX_REPEATS!r} + 1e-12) AS r
    FROM (
      SELECT i, any_value(ae) AS ae, count(*) AS k, sum(pow(share, ae)) AS ze, sum(pow(share, ae) * ln(share)) AS se,
             sum(pow(share, ar)) AS zr, max(pow(share, ar - 1)) AS rr
      FROM (SELECT share, i, (low_e + i * pow(10, 4 - 2 * step)) / 1e6 AS ae, (low_r + i * pow(10, 4 - 2 * step)) / 1e6 AS ar
            FROM sums, (SELECT unnest(range(101)) AS i)) GROUP BY i)) AS c
  WHERE step < 3),
exponent AS (SELECT greatest(low_e, low_r) / 1e6 AS a FROM search WHERE step = 3),
powers AS (SELECT source, whole, pow(share, a) AS p FROM sums, exponent),
budgets AS (
  SELECT source, whole, CAST(floor(round(p / (SELECT sum(p) FROM powers), 9) * (SELECT sum(t) FROM rows)) AS BIGINT) AS budget
  FROM powers),
passes AS (
  SELECT doc_id, source, digest, t, whole, budget, budget // whole AS n_passes, unnest(range(budget // whole + 1)) AS epoch
  FROM rows JOIN budgets USING (source)),
running AS (
  SELECT *, CAST(sum(t) OVER (PARTITION BY source, epoch ORDER BY substr(md5(epoch || ':' || coalesce(doc_id::VARCHAR, '') || ':' || digest), 1, 15),
                              doc_id NULLS FIRST, t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM passes)
SELECT doc_id, source, t AS mix_tokens, epoch AS mix_epoch,
       CAST(floor((epoch * whole + upto - t) / {mixing.BLOCK_TOKENS}) AS BIGINT) AS mix_block,
       CAST(floor((epoch * whole + upto - t) / greatest(budget, 1) * 1e6) AS BIGINT) AS mix_order
FROM running WHERE epoch < n_passes OR upto <= budget - n_passes * whole""",
    "op2_extendible_sharding": f"""
WITH rows AS (
  SELECT doc_id, strlen(text)::BIGINT AS n_bytes,
         CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS position
  FROM documents),
buckets AS (
  SELECT depth, position >> ({sharding.BITS} - depth) AS prefix, CAST(sum(coalesce(n_bytes, 0)) AS BIGINT) AS shard_bytes,
         count(*) AS shard_rows
  FROM rows, (SELECT unnest(range(32)) AS depth) GROUP BY ALL),
best AS (
  SELECT doc_id, position, any_value(n_bytes) AS n_bytes, min(depth) AS depth
  FROM rows, (SELECT unnest(range(32)) AS depth) d JOIN buckets b USING (depth)
  WHERE b.prefix = position >> ({sharding.BITS} - depth) AND shard_bytes <= {sharding.SHARD_BYTES}
  GROUP BY doc_id, position)
SELECT doc_id, n_bytes, CASE WHEN best.depth = 0 THEN '' ELSE lpad(bin(prefix), best.depth::INT, '0') END AS shard,
       best.depth AS shard_depth, shard_bytes, shard_rows
FROM best JOIN buckets ON best.depth = buckets.depth AND prefix = position >> ({sharding.BITS} - best.depth)""",
    "op9_warc": """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages),
facts AS (
  SELECT page_id, strlen(body) AS n, sha1(body) AS d FROM payloads),
latest AS (SELECT d, max(page_id) AS keep FROM facts WHERE n >= 1000 GROUP BY d)
SELECT f.page_id, n AS payload_bytes, f.d AS payload_digest,
       CASE WHEN keep IS NOT NULL AND keep <> f.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keep <> f.page_id THEN keep END AS refers_to
FROM facts f LEFT JOIN latest ON f.d = latest.d AND n >= 1000""",
    "op6_cover_tree_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v::DOUBLE[], d.v::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op11_fill_in_middle": f"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{fill_in_middle.SALT}' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
drawn AS (
  SELECT doc_id, t, length(t)::BIGINT AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1,
         CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3,
         CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM hashed),
cut AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR h3 % 100 >= {fill_in_middle.PLAIN_FROM} THEN 'plain'
              WHEN h4 % 100 < {fill_in_middle.SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM parts""",
}
