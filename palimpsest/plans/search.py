"""Search queries: every record whose id is divisible by 20 asks, against all records."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions.models import lexical_scorer
from palimpsest.operators import analysis, retrieval, understanding
from palimpsest.operators.scoring import PATHS, RRF_WEIGHTS, SIGNAL_WEIGHTS, SIGNALS
from palimpsest.operators.understanding import COMPOUND, COMPOUND_BONUS, INTENTS
from palimpsest.plans.base import ASKED_SQL, EDGES_SQL, MEMORIES_SQL, QUALITY_SQL, days_sql, now, query
from palimpsest.sources.staging import staged
from palimpsest.sources.tables import asked, co_retrieval_edges, memories, table

#: What a question opens with, by its number, so that every intent occurs.
OPENINGS = ("", "when ", "find ", "why ", "debug ", "opinion ")
RAW = "CASE (query_id // 20) % 6 " + " ".join(f"WHEN {k} THEN '{o}'" for k, o in enumerate(OPENINGS) if o) + " ELSE '' END || text"

KEYWORD_SQL = f"""{MEMORIES_SQL}, {ASKED_SQL},
words AS (SELECT id, project_id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS w FROM memories WHERE deleted_at IS NULL),
total AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM words),
query_terms AS (SELECT DISTINCT query_id, project, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM asked),
postings AS (SELECT id, project_id, n_words, term, count(*) AS tf FROM (SELECT id, project_id, len(w) AS n_words, unnest(w) AS term FROM words)
  WHERE term IN (SELECT term FROM query_terms) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
needed AS (SELECT query_id, count(*) AS needed FROM query_terms GROUP BY 1),
word_hits AS (SELECT query_id, id, count(*) AS n_found,
    round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * n_words / avg_len))), 6) AS score
  FROM postings JOIN dfs USING (term) JOIN query_terms USING (term), total WHERE project_id IN (project, 'global') GROUP BY 1, 2),
keyword_all AS (SELECT query_id, id, score FROM word_hits JOIN needed USING (query_id) WHERE n_found = needed),
keyword AS (SELECT * FROM keyword_all QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20),
temporal AS (SELECT query_id, id, round(exp(-ln(2) * greatest({days_sql("coalesce(valid_from, created_at)")}, 0) / 30), 6) AS score FROM memories
  JOIN asked ON project_id IN (project, 'global')
  WHERE deleted_at IS NULL AND (valid_from IS NULL OR valid_from <= as_of) AND (valid_to IS NULL OR valid_to > as_of)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY valid_from DESC NULLS LAST, id) <= 20)"""


@query(f"WITH {KEYWORD_SQL} SELECT * FROM keyword")
def bm25_topk(spark, sf_dir):
    return retrieval.bm25(memories(spark, sf_dir), asked(spark, sf_dir), 20)


@query(f"""WITH {KEYWORD_SQL}, ten AS (SELECT query_id, id, score FROM word_hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10)
SELECT query_id, id, round(1 / (1 + score), 6) AS score FROM ten""")
def bm25_any_term(spark, sf_dir):
    """One term of the query is enough, with the score that falls as records fit better."""
    return retrieval.bm25(memories(spark, sf_dir), asked(spark, sf_dir), 10, monotone=False, any_term=True)


SPARSE_SQL = KEYWORD_SQL.replace("needed AS (SELECT query_id, count(*) AS needed FROM query_terms GROUP BY 1)", "needed AS (SELECT query_id, count(*) FILTER (must = 1) AS needed FROM query_terms GROUP BY 1)").replace(
    "query_terms AS (SELECT DISTINCT query_id, project, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM asked)",
    """own_terms AS (SELECT DISTINCT query_id, project, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM asked),
query_terms AS (SELECT *, 1 AS must FROM own_terms UNION ALL SELECT query_id, project, t, 0 FROM (SELECT query_id, project, unnest(['with', 'from']) AS t
  FROM asked) WHERE (query_id, t) NOT IN (SELECT (query_id, term) FROM own_terms))""",
).replace("count(*) AS n_found", "sum(must) AS n_found")


@query(f"WITH {SPARSE_SQL} SELECT * FROM keyword")
def bm25_sparse_terms(spark, sf_dir):
    """Further terms count where they are, but none has to be there."""
    queries = asked(spark, sf_dir).withColumn("sparse", F.array(F.lit("with"), F.lit("from")))
    return retrieval.bm25(memories(spark, sf_dir), queries, 20, sparse="sparse")


@query(f"""WITH {MEMORIES_SQL} SELECT term, id, project_id, len, count(*) AS tf FROM (SELECT id, project_id, len(w) AS len, unnest(w) AS term FROM
  (SELECT id, project_id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS w FROM memories WHERE deleted_at IS NULL)) GROUP BY ALL""")
def postings_build(spark, sf_dir):
    """The inverted index of all records."""
    return retrieval.postings(memories(spark, sf_dir))


@query(f"""WITH {MEMORIES_SQL}, {ASKED_SQL}, hits AS (SELECT query_id, id, confidence, importance, len(list_filter(w, lambda x: contains(lower(content),
  x))) / greatest(len(w), 1)::DOUBLE AS score
  FROM (SELECT *, list_filter(string_split(lower(text), ' '), lambda x: strlen(x) > 1) AS w FROM asked) JOIN memories ON project_id IN (project, 'global')
  WHERE deleted_at IS NULL AND contains(lower(content), lower(text)))
SELECT query_id, id, round(score, 6) AS score FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC,
  confidence DESC NULLS LAST, importance DESC NULLS LAST, id) <= 20""")
def like_overlap(spark, sf_dir):
    return retrieval.like(memories(spark, sf_dir, "confidence", "type", "importance"), asked(spark, sf_dir), 20)


@query(f"WITH {KEYWORD_SQL} SELECT * FROM temporal")
def temporal_path(spark, sf_dir):
    return retrieval.temporal(memories(spark, sf_dir), asked(spark, sf_dir), 20, now())


_BOUNDED = """(query_id // 20) % 2 = 0 AS bounded"""


@query(f"""WITH {MEMORIES_SQL}, {ASKED_SQL}, bounds AS (SELECT *, CASE WHEN (query_id // 20) % 2 = 0 THEN TIMESTAMP '2023-12-01' END AS since,
  CASE WHEN (query_id // 20) % 3 = 0 THEN TIMESTAMP '2024-01-10' END AS until,
  CASE WHEN (query_id // 20) % 4 = 0 THEN split_part(text, ' ', 1) END AS phrase FROM asked)
SELECT query_id, id, round(exp(-ln(2) * greatest({days_sql("coalesce(valid_from, created_at)")}, 0) / 30), 6) AS score FROM memories
  JOIN bounds ON project_id IN (project, 'global')
  WHERE deleted_at IS NULL AND (valid_from IS NULL OR valid_from <= as_of) AND (valid_to IS NULL OR valid_to > as_of) AND (since IS NULL OR valid_from >= since)
  AND (until IS NULL OR valid_from < until)
    AND (phrase IS NULL OR contains(lower(content), lower(phrase)))
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY valid_from DESC NULLS LAST, id) <= 20""")
def temporal_bounds(spark, sf_dir):
    """The temporal path with after, before and a phrase in some of the queries."""
    queries = asked(spark, sf_dir).selectExpr(
        "*", "CASE WHEN (query_id div 20) % 2 = 0 THEN TIMESTAMP_NTZ '2023-12-01 00:00:00' END AS after",
        "CASE WHEN (query_id div 20) % 3 = 0 THEN TIMESTAMP_NTZ '2024-01-10 00:00:00' END AS before", "CASE WHEN (query_id div 20) % 4 = 0 THEN split_part(text, ' ', 1) END AS phrase",
    )
    return retrieval.temporal(memories(spark, sf_dir), queries, 20, now())


VECTOR_SQL = """q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0),
near AS (SELECT query_id, e.vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 6) AS score FROM q, embeddings e),
closest AS (SELECT * FROM near WHERE score > 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10)"""


@query(f"WITH {VECTOR_SQL} SELECT * FROM closest")
def semantic_topk(spark, sf_dir):
    return nearest(spark, sf_dir)


@query(f"WITH {VECTOR_SQL} SELECT query_id, id, round((1 + score) / 2, 7) AS score FROM closest")
def semantic_rescaled(spark, sf_dir):
    """The same on the scale of 0 to 1."""
    return nearest(spark, sf_dir, rescaled=True)


def nearest(spark, sf_dir, rescaled: bool = False):
    e = table(spark, sf_dir, "embeddings")
    rows = e.selectExpr("vec_id AS id", "embedding", "'global' AS project_id", "CAST(NULL AS TIMESTAMP_NTZ) AS deleted_at")
    queries = e.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS vector", "'global' AS project")
    return retrieval.semantic(rows, queries, 10, 0.2, rescaled)


NODES_SQL = """unnested AS (SELECT label AS concept, unnest(range(1, len(embedding) + 1)) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT concept, p, avg(x) AS x, count(*) AS size FROM unnested GROUP BY 1, 2),
nodes AS (SELECT concept, list(x ORDER BY p) AS centroid, max(size) AS size FROM means GROUP BY 1)"""


@query(f"""WITH {NODES_SQL}, q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, 'about group' || (vec_id % 7) AS text FROM embeddings WHERE vec_id % 20 = 0),
matched AS (SELECT query_id, concept, list_cosine_similarity(centroid, v) AS c, contains('group' || concept, 'group' || (query_id % 7))::INTEGER * 0.3::DOUBLE AS w FROM q, nodes),
best AS (SELECT query_id, concept, round(CASE WHEN c >= 0.1 THEN c ELSE 0 END + w, 6) AS score FROM matched WHERE CASE WHEN c >= 0.1 THEN c ELSE 0 END + w > 0
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(CASE WHEN c >= 0.1 THEN c ELSE 0 END + w, 6) DESC, concept) <= 5)
SELECT query_id, vec_id AS id, score FROM best JOIN embeddings ON label = concept QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""")
def concept_path(spark, sf_dir):
    """Concepts by vector and by the words of their names."""
    e = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "embedding", "label AS concept", "1.0D AS probability")
    queries = e.where("id % 20 = 0").selectExpr("id AS query_id", "embedding AS vector", "'about group' || cast(id % 7 as string) AS text")
    nodes = analysis.centroids(e).withColumn("label", F.concat(F.lit("group"), F.col("concept").cast("string")))
    return retrieval.concepts(e, nodes, queries, 10, 0.1)


_MMR_STEP = """step{n} AS (SELECT query_id, id, {n} AS place FROM (SELECT r.query_id, r.id, round(0.7::DOUBLE * rel - 0.3::DOUBLE * greatest(max(alike), 0), 9) AS value FROM rel r
  JOIN chosen{m} c ON c.query_id = r.query_id JOIN pairs p ON p.query_id = r.query_id AND p.a = r.id AND p.b = c.id
  WHERE (r.query_id, r.id) NOT IN (SELECT (query_id, id) FROM chosen{m})
  GROUP BY r.query_id, r.id, rel, ord QUALIFY row_number() OVER (PARTITION BY r.query_id ORDER BY round(0.7::DOUBLE * rel - 0.3::DOUBLE * greatest(max(alike),
  0), 9) DESC, ord) = 1)),
chosen{n} AS (SELECT * FROM chosen{m} UNION ALL SELECT * FROM step{n})"""
MMR_SQL = f"""{VECTOR_SQL}, rel AS (SELECT query_id, id, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 1) AS rel,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id::VARCHAR) AS ord, count(*) OVER w AS n FROM closest WINDOW w AS (PARTITION BY query_id)),
pairs AS (SELECT a.query_id, a.id AS a, b.id AS b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS alike FROM rel a JOIN rel b ON a.query_id = b.query_id
  JOIN embeddings x ON x.vec_id = a.id JOIN embeddings y ON y.vec_id = b.id),
chosen1 AS (SELECT query_id, id, 1 AS place FROM rel WHERE ord = 1), {", ".join(_MMR_STEP.format(n=n, m=n - 1) for n in range(2, 6))}"""


@query(f"WITH {MMR_SQL} SELECT query_id, id::VARCHAR AS id, place::BIGINT AS place FROM chosen5 WHERE (query_id) IN (SELECT query_id FROM rel WHERE n > 5) UNION ALL SELECT query_id, id::VARCHAR, ord FROM rel WHERE n <= 5")
def mmr_select(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    found = nearest(spark, sf_dir).join(e.selectExpr("vec_id AS id", "embedding"), "id").withColumn("id", F.col("id").cast("string"))
    return retrieval.diverse(found, 5)


def _weight_sql(names, values, name: str) -> str:
    k = names.index(name)
    return "CASE intent " + " ".join(f"WHEN '{i}' THEN {v[k]}::DOUBLE" for i, v in values.items()) + " END"


_TENTHS = {n: "(" + " + ".join(f"CASE WHEN regexp_matches(raw, '{p}') THEN {w} ELSE 0 END" for p, w, _ in patterns) + ")" for n, patterns in INTENTS.items()}
HYBRID_SQL = f"""{KEYWORD_SQL}, {EDGES_SQL}, {NODES_SQL},
tenths AS (SELECT query_id, {", ".join(f"{t} AS t_{n}" for n, t in _TENTHS.items())} FROM (SELECT query_id, {RAW} AS raw FROM asked)),
boosted AS (SELECT * REPLACE (t_exploratory + CASE WHEN t_exploratory >= {COMPOUND} AND t_error_debug >= {COMPOUND} THEN {COMPOUND_BONUS} ELSE 0 END AS t_exploratory) FROM tenths),
intents AS (SELECT query_id, CASE greatest({", ".join(f"t_{n}" for n in INTENTS)}) {" ".join(f"WHEN t_{n} THEN '{n}'" for n in INTENTS)} END AS intent FROM boosted),
by_word AS (SELECT query_id, id, round(score / (1 + score), 6) AS score FROM keyword),
by_vector AS (SELECT query_id, id, score FROM (SELECT query_id, m.id, round(list_cosine_similarity(m.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
  FROM asked JOIN embeddings e ON e.vec_id = query_id JOIN memories m ON project_id IN (project, 'global') WHERE deleted_at IS NULL AND m.embedding IS NOT NULL) WHERE score > 0.3
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20),
seeds AS (SELECT query_id, id FROM (SELECT query_id, id, max(score) AS score FROM (SELECT * FROM by_word UNION ALL SELECT * FROM by_vector) GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 6),
named AS (SELECT 'm' || lpad(src::VARCHAR, 8, '0') AS src, 'm' || lpad(dst::VARCHAR, 8, '0') AS dst, weight FROM strong),
reach AS (SELECT query_id, id FROM asked JOIN memories ON project_id IN (project, 'global') WHERE deleted_at IS NULL),
by_graph AS (SELECT query_id, id, round(max(score), 6) AS score FROM (SELECT query_id, dst AS id, 0.3 + 0.6 * max(weight) AS score FROM seeds JOIN named ON id = src GROUP BY 1, 2 UNION ALL SELECT query_id, id, 1.0 FROM seeds)
  SEMI JOIN reach USING (query_id, id) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(max(score), 6) DESC, id) <= 20),
concept_scores AS (SELECT query_id, concept, round(list_cosine_similarity(centroid, embedding::DOUBLE[]), 6) AS score FROM asked JOIN embeddings ON vec_id = query_id, nodes WHERE list_cosine_similarity(centroid, embedding::DOUBLE[]) >= 0.3
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(centroid, embedding::DOUBLE[]), 6) DESC, concept) <= 5),
by_concept AS (SELECT query_id, m.id, score FROM concept_scores JOIN embeddings ON label = concept JOIN memories m ON doc_id = vec_id SEMI JOIN reach r ON r.query_id = concept_scores.query_id AND r.id = m.id
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, m.id) <= 20),
targets AS (SELECT DISTINCT 'm' || lpad(x::VARCHAR, 8, '0') AS f, user_id AS t FROM folded),
firsts AS (SELECT * FROM targets QUALIFY row_number() OVER (PARTITION BY t ORDER BY f) <= 6),
met AS (SELECT DISTINCT a, b FROM (SELECT x.f AS a, y.f AS b FROM targets x JOIN firsts y ON x.t = y.t AND x.f <> y.f QUALIFY row_number() OVER (PARTITION BY x.f, x.t ORDER BY y.f) <= 5)),
around AS (SELECT src, dst, weight FROM named UNION ALL SELECT a, b, 0.3::DOUBLE FROM met),
one AS (SELECT query_id, dst AS id, max(weight * 0.6::DOUBLE) AS score FROM seeds JOIN around ON id = src WHERE weight * 0.6::DOUBLE >= 0.05 GROUP BY 1, 2),
two AS (SELECT query_id, dst AS id, max(score * weight * 0.6::DOUBLE) AS score FROM one JOIN around ON id = src WHERE score * weight * 0.6::DOUBLE >= 0.05 GROUP BY 1, 2),
by_activation AS (SELECT query_id, id, round(max(score), 6) AS score FROM (SELECT * FROM one UNION ALL SELECT * FROM two) ANTI JOIN seeds USING (query_id, id) SEMI JOIN reach USING (query_id, id) GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(max(score), 6) DESC, id) <= 20),
merged AS (SELECT query_id, id, {", ".join(f"max(CASE WHEN path = '{p}' THEN score END) AS {p}" for p in PATHS)} FROM (SELECT *, 'keyword' AS path FROM by_word UNION ALL SELECT *, 'semantic' FROM by_vector
  UNION ALL SELECT *, 'temporal' FROM temporal UNION ALL SELECT *, 'graph' FROM by_graph UNION ALL SELECT *, 'concept' FROM by_concept UNION ALL SELECT *, 'activation' FROM by_activation) GROUP BY 1, 2),
placed AS (SELECT *, count(*) OVER (PARTITION BY query_id) + 1 AS missing, {", ".join(f"row_number() OVER (PARTITION BY query_id ORDER BY {p} DESC NULLS LAST, id) AS r_{p}" for p in PATHS)} FROM merged),
fused AS (SELECT query_id, id, intent, {" + ".join(f"{_weight_sql(PATHS, RRF_WEIGHTS, p)} / (60 + CASE WHEN {p} > 0 THEN r_{p} ELSE missing END)" for p in PATHS)} AS rrf FROM placed JOIN intents USING (query_id))"""


def asked_for(spark, sf_dir):
    """The queries with vectors and the intent of what they open with."""
    rows = asked(spark, sf_dir, vectors=True).withColumn("raw", F.expr(RAW.replace("//", "div")))
    return understanding.detected(rows, "raw").drop("confidence", "signals", "raw")


def graph_tables(spark, sf_dir):
    """Edges, shared targets, concept nodes and members, all with record ids."""
    record = lambda c: F.concat(F.lit("m"), F.lpad(F.col(c).cast("string"), 8, "0"))
    edges = co_retrieval_edges(spark, sf_dir).select(record("memory_a").alias("memory_a"), record("memory_b").alias("memory_b"), "weight")
    n_docs = table(spark, sf_dir, "documents").agg(F.count("*").alias("n_docs"))
    links = table(spark, sf_dir, "events").crossJoin(F.broadcast(n_docs)).withColumn("x", F.expr("event_id % n_docs"))  # one row
    shared = analysis.shared_targets(links.select(record("x").alias("from_id"), F.col("user_id").alias("to_id")))
    e = table(spark, sf_dir, "embeddings").select(record("vec_id").alias("id"), "embedding", F.col("label").alias("concept"), F.lit(1.0).alias("probability"))
    return edges, shared, analysis.centroids(e), e.select("concept", "id", "probability")


def fused(spark, sf_dir):
    """Records without texts and vectors, questions, edges, and the fused paths."""
    m = staged(memories(spark, sf_dir, "confidence", "contradiction_count", "type", "importance").drop("content"), "records")
    queries = asked_for(spark, sf_dir)
    edges, shared, nodes, members = graph_tables(spark, sf_dir)
    edges = staged(edges, "edges")
    texts, vectors = memories(spark, sf_dir), memories(spark, sf_dir, "embedding")
    return m, queries, edges, retrieval.hybrid(m, queries, edges, shared, nodes, members, now(), texts=texts, vectors=vectors)


@query(f"WITH {HYBRID_SQL} SELECT query_id, id, round(rrf, 6) AS rrf FROM fused")
def rrf_fusion(spark, sf_dir):
    """All six paths, fused."""
    return fused(spark, sf_dir)[3].withColumn("rrf", F.round("rrf", 6))


_S = {s: _weight_sql(SIGNALS, SIGNAL_WEIGHTS, s) for s in SIGNALS}
RANKED_SQL = f"""{HYBRID_SQL},
boosts AS (SELECT a.query_id, a.id, least(sum(weight) * 0.2, 0.5) AS boost FROM fused a
  JOIN (SELECT 'm' || lpad(src::VARCHAR, 8, '0') AS src, 'm' || lpad(dst::VARCHAR, 8, '0') AS dst, weight
  FROM ways QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 20) w ON a.id = w.src JOIN fused b ON b.query_id = a.query_id AND b.id = w.dst GROUP BY 1, 2),
scored AS (SELECT query_id, id, least(1.0, greatest(0.0, {_S["recency"]} * exp(-ln(2) * greatest({days_sql("created_at")}, 0) / 30)
  + ({_S["importance"]} + 0.15 * {_S["rerank"]} + CASE WHEN processing_depth IS NULL THEN {_S["depth"]} ELSE 0 END) * importance + {_S["depth"]} * coalesce(processing_depth, 0)
  + ({_S["rrf"]} + 0.7 * {_S["rerank"]}) * least(rrf / 0.05, 1) + {_S["hebbian"]} * least(2 * coalesce(boost, 0), 1)
  + ({_S["confidence"]} + 0.15 * {_S["rerank"]} + {_S["credibility"]}) * coalesce(confidence, 0.5) + {_S["retention"]} * exp(-{days_sql("last_accessed")} * 24 * 0.05 / 24)))
  * CASE WHEN superseded_by IS NOT NULL THEN 0.5 ELSE 1 END AS base, {QUALITY_SQL} AS quality FROM fused JOIN memories USING (id) LEFT JOIN boosts USING (query_id, id)),
found AS (SELECT query_id, id, round(0.85 * base + 0.15 * quality, 6) AS score FROM scored QUALIFY row_number()
  OVER (PARTITION BY query_id ORDER BY round(0.85 * base + 0.15 * quality, 6) DESC, id) <= 10)"""


@query(f"WITH {RANKED_SQL} SELECT * FROM found")
def hybrid_search(spark, sf_dir):
    """Six paths, fused by intent, composite score with links among the results, quality."""
    m, queries, edges, rows = fused(spark, sf_dir)
    return retrieval.ranked(rows, m, queries, edges, now())


# The queries below work on the keyword path's results, so that each tests its own step.
FOUND_SQL = f"{KEYWORD_SQL}, found AS (SELECT query_id, id, round(score / (1 + score), 6) AS score FROM keyword)"


def by_keyword(spark, sf_dir, *extra):
    m = memories(spark, sf_dir, *extra)
    return m, retrieval.bm25(m, asked(spark, sf_dir), 20).withColumn("score", F.round(F.col("score") / (1 + F.col("score")), 6))


_LOGIT = """(4 * len(list_filter(w, lambda x: list_contains(list_distinct(string_split_regex(lower(content), '\\s+')), x))) / greatest(len(w), 1)::DOUBLE - 2)"""


@query(f"""WITH {FOUND_SQL}, texts AS (SELECT query_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM asked)
SELECT query_id, id, round(0.85::DOUBLE / (1 + exp(-{_LOGIT})) + 0.15::DOUBLE * score, 6) AS score FROM found JOIN texts USING (query_id) JOIN memories USING (id)""")
def rerank(spark, sf_dir):
    """The lexical stand-in of a cross-encoder, blended with the search's score."""
    m, found = by_keyword(spark, sf_dir)
    rows = found.join(m.select("id", "content"), "id").join(asked(spark, sf_dir).select("query_id", "text"), "query_id")
    return retrieval.reranked(rows, lexical_scorer)


@query(f"""WITH {FOUND_SQL}, five AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM found QUALIFY r <= 5)
SELECT query_id, first(content ORDER BY r) AS answer, round(first(coalesce(confidence, 0.5) ORDER BY r), 6) AS confidence, string_agg(id,
  ',' ORDER BY r) AS sources FROM five JOIN memories USING (id) GROUP BY 1""")
def answer(spark, sf_dir):
    m, found = by_keyword(spark, sf_dir, "confidence")
    return retrieval.answers(found, m).select("query_id", "answer", F.round("confidence", 6).alias("confidence"), F.array_join("sources", ",").alias("sources"))


@query(f"""WITH {FOUND_SQL}, five AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5)
SELECT a.id AS memory_a, b.id AS memory_b, count(*) AS n, round(least(0.1::DOUBLE * count(*), 1), 6) AS weight FROM five a
  JOIN five b ON a.query_id = b.query_id AND a.id < b.id GROUP BY 1, 2""")
def co_retrieval_learning(spark, sf_dir):
    return retrieval.co_retrieved(by_keyword(spark, sf_dir)[1])


@query(f"WITH {FOUND_SQL} SELECT id, (any_value(search_hit_count) + count(*))::BIGINT AS search_hit_count FROM found JOIN memories USING (id) GROUP BY 1")
def search_hit_counter(spark, sf_dir):
    m, found = by_keyword(spark, sf_dir)
    return retrieval.search_hits(found, m)


@query(f"""WITH {FOUND_SQL}, {EDGES_SQL}, wide AS (SELECT 'm' || lpad(src::VARCHAR, 8, '0') AS src, 'm' || lpad(dst::VARCHAR, 8, '0') AS dst, weight FROM ways
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 20)
SELECT a.query_id, a.id, round(least(sum(weight) * 0.2, 0.5), 6) AS boost FROM found a JOIN wide ON a.id = src
  JOIN found b ON b.query_id = a.query_id AND b.id = dst GROUP BY 1, 2""")
def hebbian_boost(spark, sf_dir):
    _, found = by_keyword(spark, sf_dir)
    return retrieval.hebbian_boost(found, graph_tables(spark, sf_dir)[0]).withColumn("boost", F.round("boost", 6))
