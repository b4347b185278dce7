"""SQL of the queries that DuckDB can express: substring, vector and near-duplicate queries by brute force over whole tables."""

from __future__ import annotations

WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"

SUBSTRING_SQL = f"""
WITH texts AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM texts),
windows AS (SELECT doc_id, p, array_to_string(w[p : p + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM texts WHERE len(w) >= 20)),
repeats AS (SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
marked AS (SELECT doc_id, word, words.p, coalesce(max(repeats.p) OVER (PARTITION BY doc_id ORDER BY words.p ROWS UNBOUNDED PRECEDING) > words.p - 20, false) AS gone
  FROM words LEFT JOIN repeats USING (doc_id, p)),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') AS text FROM marked GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (doc_id)
"""

#: From links (a, b) and the ids of all rows to the least id that each reaches.
COMPONENTS = """
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), walk AS (SELECT DISTINCT a AS id, a AS seen FROM both_ways UNION SELECT id, b FROM walk
  JOIN both_ways ON seen = a),
roots AS (SELECT id, min(seen) AS root FROM walk GROUP BY 1)"""

VECTOR_SQL = f"""
WITH RECURSIVE fine AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM fine x JOIN fine y ON x.label = y.label AND len(x.v) = len(y.v) AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.v, y.v) >= 0.98), {COMPONENTS},
counts AS (SELECT a AS id, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept FROM embeddings LEFT
  JOIN counts c ON c.id = vec_id LEFT JOIN roots r ON r.id = vec_id
"""

NEAR_SQL = f"""
WITH RECURSIVE texts AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, hash(s) AS s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS s FROM texts)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)), {COMPONENTS}
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept FROM documents LEFT
  JOIN sizes USING (doc_id) LEFT JOIN roots ON id = doc_id
"""
