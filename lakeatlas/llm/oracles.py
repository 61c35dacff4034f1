"""DuckDB SQL of the queries that SQL can express, written from what they mean and not from how Spark gets there."""

from __future__ import annotations

from . import secret_scan

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS d, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < first THEN first END AS refers_to
FROM q
"""

def mixing(entropy: float | None, max_repeats: float, epochs: int) -> str:
    """The documents as often as a mixture under these limits takes them."""

    def good(m: str) -> str:
        power = f"list_transform(xs, lambda x: pow(x / top, {m}))"
        repeats = f"budget * list_max(list_transform(xs, lambda x: pow(x / top, {m}) / x)) / list_sum({power}) <= {max_repeats} + 1e-12"
        if entropy is None:
            return f"({repeats})"
        spread = f"(ln(list_sum({power})) - list_sum(list_transform(xs, lambda x: pow(x / top, {m}) * ln(x / top) * {m})) / list_sum({power})) / ln(len(xs))"
        return f"({spread} <= {entropy} + 1e-12 AND {repeats})"

    return f"""
WITH RECURSIVE tok AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
src AS (SELECT source, count(*) AS n_docs, sum(tokens)::BIGINT AS n_tokens FROM tok GROUP BY source),
one AS (SELECT list(n_tokens::DOUBLE) FILTER (WHERE n_tokens > 0) AS xs, max(n_tokens)::DOUBLE AS top, {epochs} * sum(n_tokens)::DOUBLE AS budget FROM src),
bisect AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.5::DOUBLE AS m UNION ALL
  SELECT i + 1, CASE WHEN good THEN lo ELSE m END, CASE WHEN good THEN m ELSE hi END, CASE WHEN good THEN (lo + m) / 2 ELSE (m + hi) / 2 END
  FROM (SELECT i, lo, hi, m, {good('m')} AS good FROM bisect, one) b WHERE i < 50),
alpha AS (SELECT hi AS a FROM bisect ORDER BY i DESC LIMIT 1),
w AS (SELECT source, n_docs, n_tokens, pow(n_tokens / top, a) / list_sum(list_transform(xs, lambda x: pow(x / top, a))) AS weight, budget, {good('a')} AS met FROM src, one, alpha WHERE n_tokens > 0),
plan AS (SELECT *, floor(weight * budget + 1e-6)::BIGINT // n_tokens AS whole, floor(weight * budget + 1e-6)::BIGINT % n_tokens AS rest FROM w),
copies AS (
  SELECT t.*, p.weight, p.met, p.rest, b AS block, b = p.whole AS is_last FROM tok t JOIN plan p ON t.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(0, p.whole + 1)) AS b)),
placed AS (SELECT *, md5(concat_ws('/', '7', block, coalesce(source, ''), coalesce(doc_id::VARCHAR, ''))) AS place FROM copies)
SELECT doc_id, source, tokens, block, place, round(weight, 6) AS weight, met FROM (
  SELECT *, sum(tokens) OVER (PARTITION BY source, block ORDER BY place, tokens, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM placed) x
WHERE NOT is_last OR rest > 0 AND running <= rest
"""


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(w.doc_id, min(r.y)) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach r ON r.x = w.doc_id GROUP BY w.doc_id
"""


def _secrets() -> str:
    def one(no: int, rule: secret_scan.Rule) -> str:
        pattern = rule.pattern.replace("'", "''")
        return f"SELECT rid, {no} AS no, '{rule.kind}' AS kind, {rule.least} AS least, string_split(regexp_replace(t, '{pattern}', concat(chr(1), '\\0', chr(2), '\\{rule.value}', chr(1)), 'g'), chr(1)) AS p FROM d"

    kinds = " UNION ALL ".join(one(i, r) for i, r in enumerate(secret_scan.RULES))
    span = "concat(kind, ':', e - n, ':', e)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), concat(chr(1), chr(2)), concat(chr(3), chr(3))) AS t FROM documents),
k AS ({kinds}),
pieces AS (SELECT rid, no, kind, least, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM k WHERE len(p) > 1),
sized AS (SELECT *, length(split_part(piece, chr(2), 1)) AS n, length(split_part(piece, chr(2), 2)) AS v FROM pieces),
ends AS (SELECT *, (sum(n) OVER (PARTITION BY rid, no ORDER BY i))::BIGINT AS e FROM sized),
found AS (SELECT * FROM ends WHERE i % 2 = 0 AND v >= least),
per AS (SELECT rid, {counts}, string_agg({span}, ',' ORDER BY e - n, no, e) FILTER (WHERE no < {len(secret_scan.BASE)}) AS base, string_agg({span}, ',' ORDER BY e - n, no, e) AS spans FROM found GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per ON per.rid = d.rid
"""


TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) r
WHERE rank <= 20
"""

ORACLES = {"op13_metric_tree_top_k": TOP_K, "op1_warc_zstd": WARC, "op3_temperature_mixing": mixing(None, 2.5, 2), "op6_ngram_jaccard_join": JACCARD, "op10_secret_scan": _secrets()}
