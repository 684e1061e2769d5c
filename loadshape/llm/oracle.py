"""DuckDB SQL for the corpus queries that SQL can express."""

# fixed values: the patterns of the secret rules, group 1 the value that a rule's least length holds for
_SECRETS = (
    ("assign", r"""[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]""", 6),
    ("access", r"AKIA[A-Z0-9]+", 20),
    ("hex", r"[0-9a-f]+", 24),
    ("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", 27),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
)


def _secrets() -> str:
    parts = []
    for rank, (kind, pattern, least) in enumerate(_SECRETS):
        if kind == "assign":
            pattern = f"""(?:{pattern})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
            value = f"regexp_extract_all(t, '{pattern}', 1)"
        else:
            value = f"regexp_extract_all(t, '{pattern}', 0)"
        parts.append(
            f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, {least} AS least, "
            f"regexp_extract_all(t, '{pattern}', 0) AS found, {value} AS vals, string_split_regex(t, '{pattern}') AS gaps "
            f"FROM d WHERE regexp_matches(t, '{pattern}')"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
s AS (
  SELECT doc_id, rank, kind, least, unnest(found) AS f, unnest(vals) AS v,
    unnest(list_transform(range(1, len(found) + 1), lambda k: list_sum(list_transform(gaps[1:k], lambda x: length(x)))
      + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0))) AS a
  FROM m WHERE len(found) > 0),
k AS (SELECT doc_id, rank, kind, CAST(a AS BIGINT) AS a, CAST(a AS BIGINT) + length(f) AS b FROM s WHERE length(v) >= least),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank < 3), '') AS base,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans
  FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""


ORACLES: dict[str, str] = {
    "op2_secret_scan": _secrets(),
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, h, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < m THEN m END AS refers_to
FROM g""",
    "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op12_hard_negatives": """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 3""",
    "op13_embedding_near_dedup": """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b
  ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT a AS node, a AS root FROM l UNION SELECT l.b, reach.root FROM reach JOIN l ON l.a = reach.node),
c AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.root, vec_id) AS component_id, coalesce(c.root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.node = vec_id""",
}
