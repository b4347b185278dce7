"""Six ways to find records for many queries at once, their ranks, fusion and diversity.

A query table has query_id, text, project, as_of. Each path gives (query_id, id, score). Only the queries,
which the caller's session holds anyway, are ever broadcast, and that is left to Spark's own size check.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.predicates import active
from palimpsest.operators.scoring import PATHS, QUALITY_SHARE, RRF_K, RRF_WEIGHTS, SUPERSEDED, composite, quality, recency, retention, weights
from palimpsest.operators.substrings import first_holding
from palimpsest.operators.validity import as_of
from palimpsest.operators.vector_join import alike
from palimpsest.sources.staging import dropped, short_list, staged

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Stripped from both ends of words.
PUNCTUATION = ".,;:!?()[]{}\"'"
# Weight of a neighbour by a shared target, score of a word in a concept's name or description.
SHARED_WEIGHT, WORD_SCORE = 0.3, 0.3


def terms(text) -> F.Column:
    """Words of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def top(scored: DataFrame, k: int, key: str = "id") -> DataFrame:
    """The k best of each query; scores are rounded first, ties go by key."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("score", F.round("score", 6)).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def scoped(queries: DataFrame) -> DataFrame:
    """Each query once for its project and once for all projects, so that scope is an equal join on project_id."""
    return queries.withColumn("project_id", F.explode(F.array_distinct(F.array(F.col("project"), F.lit("global")))))


def in_scope(records: DataFrame, queries: DataFrame) -> DataFrame:
    """Active records of a query's project or of all projects, with the query's columns."""
    return records.where(active()).join(scoped(queries), "project_id")


def counted(words: F.Column) -> F.Column:
    """array<struct<term, tf>> of an array of words, which is sorted so that equal ones stand together; empty for null."""
    bound = lambda made, use: F.element_at(F.transform(F.array(made), use), 1)  # noqa: E731  # made once
    begins = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    runs = lambda s: bound(begins(s), lambda b: F.transform(b, lambda i, n: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(b, n + 1), F.size(s)) - i).cast("long").alias("tf"))))
    return F.when(F.size(words) > 0, bound(F.sort_array(words), runs)).otherwise(F.array().cast("array<struct<term: string, tf: bigint>>"))


def _exploded(records: DataFrame, *first: F.Column) -> tuple[DataFrame, bool]:
    """(id, project_id, len, term, tf) of the active records, which are counted each by itself, and whether each id is there once.

    first: structs of (term, tf) that each record has besides.
    """
    live = records.where(active())
    own = lambda w: F.struct(F.size(w).cast("long").alias("len"), F.concat(F.array(*first).cast("array<struct<term: string, tf: bigint>>"), counted(w)).alias("found"))
    docs = live.select("id", "project_id", F.element_at(F.transform(F.array(terms(F.col("content"))), own), 1).alias("d"))
    rows = docs.select("id", "project_id", "d.len", F.explode("d.found").alias("f")).select("id", "project_id", "len", "f.term", "f.tf")
    return rows, live.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _merged(rows: DataFrame) -> DataFrame:
    """Postings in which rows of one id, project and length are one record."""
    return rows.groupBy("id", "project_id", "len", "term").agg(F.sum("tf").alias("tf"))


def postings(records: DataFrame) -> DataFrame:
    """(term, id, project_id, len, tf) of the active records: the inverted index, to be written once and joined by term."""
    rows, once = _exploded(records)
    return (rows if once else _merged(rows)).select("term", "id", "project_id", "len", "tf")


def asked_terms(queries: DataFrame, sparse: str | None = None) -> DataFrame:
    """(query_id, project, term, must): the terms of each query's text, must 1, and of the column `sparse` (array), must 0."""
    wanted = F.filter(F.array_distinct(terms(F.col("text"))), lambda w: F.octet_length(w) > 1)
    asked = queries.select("query_id", "project", F.explode(wanted).alias("term")).withColumn("must", F.lit(1))
    if not sparse:
        return asked
    more = queries.select("query_id", "project", F.explode(F.array_except(F.array_distinct(sparse), wanted)).alias("term")).withColumn("must", F.lit(0))
    return asked.unionByName(more)


#: Postings of the asked terms that one slot of a project holds, about.
SLOT_POSTINGS = 500_000
#: Partitions for each slot, so that few slots meet in one, and partitions at most: up to Spark's default of
#: spark.shuffle.sort.bypassMergeThreshold a task writes its rows as they come, with more it holds them all to sort them.
PARTS_OF_SLOT, MOST_PARTS = 2, 200
#: Scores that differ by less may be one when they are rounded.
ROUNDING = 1.1e-6


def _best_of(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the scores that can be among the k best when rounded, ties by place: of equal scores the first k."""
    if len(score) <= k:
        return np.arange(len(score))
    some = np.flatnonzero(score >= np.partition(score, -k)[-k] - ROUNDING)
    if len(some) > 2 * k:
        some = some[np.lexsort((some, -score[some]))]
        own = score[some]
        first = np.concatenate([[True], own[1:] != own[:-1]])
        run = np.arange(len(own)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        some = some[run < k]
    return some


def _searched(k: int, any_term: bool):
    """The k best records of each question in one slot: a function of its postings (id, term, norm) and questions (ask, terms: term, must, idf)."""

    def searched(key, postings: pa.Table, asked: pa.Table) -> pa.Table:
        coded = postings.column("id").combine_chunks().dictionary_encode()
        ids = np.array(coded.dictionary.to_pylist(), object)
        by_id = np.argsort(ids)  # so that places order ties
        rank = np.empty(len(ids), int)
        rank[by_id] = np.arange(len(ids))
        ids, place = ids[by_id], rank[coded.indices.to_numpy()]
        words = postings.column("term").combine_chunks().dictionary_encode()
        number = {w: n for n, w in enumerate(words.dictionary.to_pylist())}
        code, norm = words.indices.to_numpy(), postings.column("norm").to_numpy()
        order = np.lexsort((place, code))
        code, place, norm = code[order], place[order], norm[order]
        ends = np.searchsorted(code, np.arange(len(number) + 1))
        whole: dict[int, np.ndarray] = {}

        def of(n: int, at: np.ndarray) -> np.ndarray:
            """The norms of a term at some records, nan where they don't have it."""
            own, value = place[ends[n] : ends[n + 1]], norm[ends[n] : ends[n + 1]]
            if 8 * len(own) < len(ids):
                found = np.minimum(np.searchsorted(own, at), len(own) - 1)
                return np.where(own[found] == at, value[found], np.nan)
            if n not in whole:  # frequent terms: at most 8 x postings numbers in all
                whole[n] = np.full(len(ids), np.nan)
                whole[n][own] = value
            return whole[n][at]

        made = {"ask": [], "id": [], "score": []}
        asks, lists = asked.column("ask").to_pylist(), asked.column("terms").to_pylist()
        for ask, terms in zip(asks, lists, strict=True):
            must = [t for t in terms if t["must"]]
            known = [(number[t["term"]], t["idf"]) for t in terms if t["term"] in number]
            if any_term or not must:
                parts = [place[ends[n] : ends[n + 1]] for n, _ in known]
                at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)) if parts else np.zeros(0, int)
            elif all(t["term"] in number for t in must):
                needed = sorted((number[t["term"]] for t in must), key=lambda n: ends[n + 1] - ends[n])
                at = place[ends[needed[0]] : ends[needed[0] + 1]]
                for n in needed[1:]:
                    at = at[~np.isnan(of(n, at))]
            else:
                continue
            score = np.zeros(len(at))
            for n, idf in known:
                score += idf * np.nan_to_num(of(n, at))
            some = _best_of(score, k)
            made["ask"] += [ask] * len(some)
            made["id"] += ids[at[some]].tolist()
            made["score"] += score[some].tolist()
        return pa.table([pa.array(made["ask"], asked.schema.field("ask").type), pa.array(made["id"], postings.schema.field("id").type), pa.array(made["score"], pa.float64())], ["ask", "id", "score"])

    return searched


def ranked_postings(found: DataFrame, total: DataFrame, asked: DataFrame, k: int, monotone: bool = True, any_term: bool = False) -> DataFrame:
    """(query_id, id, score) by BM25 from postings (term, id, project_id, len, tf) of the asked terms, a written table, and total (n, avg_len), one row.

    Questions with the same terms and project are answered once. The postings of a project are dealt to slots of about SLOT_POSTINGS by record;
    its questions and those of all projects go to each of its slots, which gives at most about k records for a question. No row is made for a question and
    a record that isn't among those. Projects that no question asks are not dealt.
    """
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    rated = asked.join(df, "term", "left").crossJoin(F.broadcast(total))  # one row
    rated = rated.select("query_id", "project", F.struct("term", "must", F.coalesce(idf, F.lit(0.0)).alias("idf")).alias("t"))
    lists = rated.groupBy("query_id", "project").agg(F.array_sort(F.collect_set("t")).alias("terms"))  # the words of one question
    lists = staged(lists.withColumn("ask", F.min("query_id").over(W.partitionBy("project", "terms"))), "asks")
    slots = staged(found.groupBy("project_id").agg(F.ceil(F.count("*") / SLOT_POSTINGS).cast("int").alias("slots")), "slots")
    # A partition is sorted in memory, so partitions are as many as slots need, whatever the session's number and Spark's joining of small ones.
    parts = min(MOST_PARTS, PARTS_OF_SLOT * max(1, slots.agg(F.sum("slots")).first()[0] or 0))
    slots = staged(slots.join(scoped(lists).select("project_id").distinct(), "project_id", "left_semi"), "slots")
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    dealt = found.join(slots, "project_id").crossJoin(F.broadcast(total))  # one row
    dealt = dealt.select("project_id", F.pmod(F.xxhash64("id"), F.col("slots")).cast("int").alias("slot"), "id", "term", norm.alias("norm"))
    once = scoped(lists.where("ask = query_id").dropDuplicates(["ask"])).join(slots, "project_id")
    once = once.select("project_id", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), "ask", "terms")
    schema = f"ask {dict(asked.dtypes)['query_id']}, id {dict(found.dtypes)['id']}, score double"
    dealt, once = (side.repartition(parts, "project_id", "slot") for side in (dealt, once))
    hits = dealt.groupBy("project_id", "slot").cogroup(once.groupBy("project_id", "slot")).applyInArrow(_searched(k, any_term), schema)
    hits = hits.repartition("ask")  # as they come: a slot's rows for all its questions aren't sorted in its task
    best = top(hits.withColumnRenamed("ask", "query_id"), k).withColumnRenamed("query_id", "ask").join(lists.select("ask", "query_id"), "ask")
    best = best.select("query_id", "id", "score")
    return best if monotone else best.withColumn("score", F.round(1 / (1 + F.col("score")), 6))


def bm25(records: DataFrame, queries: DataFrame, k: int, monotone: bool = True, any_term: bool = False, sparse: str | None = None) -> DataFrame:
    """(query_id, id, score): records by BM25 (or, not monotone, 1 / (1 + BM25), the greater the worse), best first.

    All terms of the query must be in a record, with any_term one of them. `sparse`: a column of further terms
    (array) of which none must be there but each counts. Only postings of query terms are shuffled. For an index that is
    kept between searches see `postings.Postings`.
    """
    questions = staged(queries.select("query_id", "project", "text", *([F.col(sparse)] if sparse else [])), "questions")
    asked = staged(asked_terms(questions, sparse), "asked")
    dropped(questions)
    # Each record also has the empty word, so that one pass over the texts gives the postings, the number of records and their lengths.
    wanted = short_list(asked.select("term").union(asked.sparkSession.createDataFrame([("",)], "term string")).distinct())
    every, once = _exploded(records, F.struct(F.lit("").alias("term"), F.lit(1).cast("long").alias("tf")))
    found = every.join(wanted, "term", "left_semi")
    found = staged(found if once else _merged(found), "found")
    total = found.where("term = ''").agg(F.sum("tf").alias("n"), F.try_divide(F.sum(F.col("len") * F.col("tf")), F.sum(F.when(F.col("len").isNotNull(), F.col("tf")))).alias("avg_len"))
    return ranked_postings(found.where("term <> ''"), staged(total, "total"), asked, k, monotone, any_term)


def like(records: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Records that hold the query's text as it is (any case); score: share of its words they hold; ties by confidence, importance, id where they are.

    A record that holds the text holds all its words, so the score is the query's, and the records of all queries come in one order: each
    text is looked for in that order until k records hold it. Queries with the same text and project are answered once. For an index that is kept between
    searches see `grams`.
    """
    asked = queries.select("query_id", "project", F.lower("text").alias("phrase"))
    asked = staged(asked.withColumn("ask", F.min("query_id").over(W.partitionBy("project", "phrase"))), "asks")
    by = []
    for c in ("confidence", "importance"):
        if c in records.columns:  # nulls are last, then come numbers, the greatest first; NaN is greater than all
            x = F.col(c).cast("double")
            by += [F.when(x.isNull(), 0.0).when(F.isnan(x), 2.0).otherwise(1.0), F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x)]
    rows = records.where(active()).select("id", "project_id", F.lower("content").alias("text"), F.array(*by).cast("array<double>").alias("by"))
    hits = first_holding(rows, scoped(asked.where("ask = query_id").dropDuplicates(["ask"])), k)
    order = W.partitionBy("ask").orderBy(F.desc("by"), "id")
    best = hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("ask", "id")
    words = F.size(F.filter(F.split("phrase", " "), lambda w: F.octet_length(w) > 1))
    return best.join(asked.select("ask", "query_id", F.round(words / F.greatest(words, F.lit(1)), 6).alias("score")), "ask").select("query_id", "id", "score")


def temporal(records: DataFrame, queries: DataFrame, k: int, now) -> DataFrame:
    """Records valid at the query's time, newest validity first; score: recency.

    Where the queries have them, columns after (inclusive) and before (exclusive) bound the beginning of validity
    (records without one are then out), and phrase must be in the text.
    """
    keys = [c for c in ("project", "as_of", "after", "before", "phrase") if c in queries.columns]
    asked = queries.select("query_id", *keys).withColumn("scope", F.to_json(F.struct(*keys)))
    scopes = asked.drop("query_id").dropDuplicates(["scope"])  # queries that ask the same are answered once
    live = records.where(active())
    rows = as_of(live, scoped(scopes.where("phrase IS NULL") if "phrase" in keys else scopes), ["project_id"])
    if "after" in keys:
        rows = rows.where("(after IS NULL OR valid_from >= after) AND (before IS NULL OR valid_from < before)")
    rows = rows.select("scope", "id", "valid_from", "created_at")
    if "phrase" in keys:
        rows = rows.unionByName(_valid_holding(live, scopes.where("phrase IS NOT NULL"), k))
    rows = rows.withColumn("score", F.round(recency(F.coalesce("valid_from", "created_at"), now), 6))
    order = W.partitionBy("scope").orderBy(F.desc_nulls_last("valid_from"), "id")
    best = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("scope", "id", "score")
    return best.join(asked.select("query_id", "scope"), "scope").select("query_id", "id", "score")


def _valid_holding(live: DataFrame, scopes: DataFrame, k: int) -> DataFrame:
    """(scope, id, valid_from, created_at): what can be among the k that begin last of the records that hold a scope's phrase, in its bounds.

    Phrases grow with the questions, so texts don't meet them in rows; each text is read once.
    """
    kinds = {**dict(live.dtypes), **dict(scopes.dtypes)}
    kind = "timestamp" if "timestamp" in (kinds[c] for c in ("valid_from", "valid_to", "as_of")) else "timestamp_ntz"
    at = lambda c, name: (F.col(c) if c in kinds else F.lit(None)).cast(kind).alias(name)
    texts = live.select("id", "project_id", F.lower("content").alias("text"), F.array().cast("array<double>").alias("by"), at("valid_from", "begin"), at("valid_to", "end"), "created_at")
    asked = scoped(scopes).select(F.col("scope").alias("ask"), "project_id", F.lower("phrase").alias("phrase"), at("as_of", "at"), at("after", "after"), at("before", "before"))
    found = first_holding(texts, asked, k)
    return found.select(F.col("ask").alias("scope"), "id", F.col("begin").cast(kinds["valid_from"]).alias("valid_from"), "created_at")


def cosine(a: str, b: str) -> F.Column:
    """In double precision; 0 where a vector is null, zero or of another length."""
    dot = f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, x) -> s + x)"
    norm = "sqrt(aggregate({0}, 0D, (s, x) -> s + cast(x as double) * cast(x as double)))"
    return F.expr(f"CASE WHEN size({a}) = size({b}) THEN coalesce(try_divide({dot}, {norm.format(a)} * {norm.format(b)}), 0D) ELSE 0D END")


#: Vectors that one block of records, and one of queries, holds.
RECORD_BLOCK, QUERY_BLOCK = 4096, 512
#: Queries of a block whose products are in memory at a time where bounds are compared first.
QUERY_SLICE = 64


def _blocks(rows: DataFrame, vector: str, size: int) -> DataFrame:
    """Rows (id, scope, vector) as blocks (n, ids, scopes, data): unit vectors of one length n, in double precision."""

    def packed(batches):
        held: dict[int, list] = {}

        def block(n):
            ids, scopes, x = zip(*held.pop(n), strict=True)
            x = np.array(x)
            x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            return pa.RecordBatch.from_pylist([{"n": n, "ids": list(ids), "scopes": list(scopes), "data": x.tobytes()}], schema)

        schema = pa.schema([("n", pa.int32()), ("ids", pa.list_(pa.string())), ("scopes", pa.list_(pa.string())), ("data", pa.binary())])
        for batch in batches:
            for i, s, v in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held.setdefault(len(v), []).append((i, s, [0.0 if c is None else c for c in v]))
                if len(held[len(v)]) >= size:
                    yield block(len(v))
        for n in list(held):
            yield block(n)

    return rows.select(F.col("id").cast("string"), "scope", F.col(vector).cast("array<double>")).mapInArrow(packed, "n int, ids array<string>, scopes array<string>, data binary")


def _met(blocks: DataFrame, other: DataFrame) -> DataFrame:
    """Each block beside each of the other side with vectors of its length: blocks are dealt over slots, the others go to every slot."""
    slots = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(slots)).cast("int"))
    return dealt.join(other.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))), ["n", "slot"]).drop("slot")


def two_stage(q: np.ndarray, x: np.ndarray, allowed: np.ndarray, k: int, least: float, first: int) -> tuple[np.ndarray, int]:
    """Products of unit vectors q and x of the allowed pairs that can be among a query's k best over `least`, the others -2; and how many whole products were made.

    The first `first` components are multiplied; the rest adds at most the product of both rests' lengths (Cauchy and Schwarz). A pair
    whose upper bound is under the k-th best lower bound of its query, or under `least`, is out.
    """
    if len(q) > QUERY_SLICE:
        score, made = np.empty((len(q), len(x))), 0
        for a in range(0, len(q), QUERY_SLICE):
            score[a : a + QUERY_SLICE], n = two_stage(q[a : a + QUERY_SLICE], x, allowed[a : a + QUERY_SLICE], k, least, first)
            made += n
        return score, made
    near = q[:, :first] @ x[:, :first].T
    room = np.linalg.norm(q[:, first:], axis=1)[:, None] * np.linalg.norm(x[:, first:], axis=1)[None] + 1e-6
    low = np.where(allowed, near - room, -2)
    bound = np.full(len(q), least) if x.shape[0] <= k else np.maximum(np.partition(low, -k, axis=1)[:, -k], least)
    i, j = np.nonzero(allowed & (near + room >= bound[:, None]))
    score = np.full(near.shape, -2.0)
    for a in range(0, len(i), 8192):
        m, n = i[a : a + 8192], j[a : a + 8192]
        score[m, n] = np.einsum("ij,ij->i", q[m], x[n])
    return score, len(i)


def semantic(records: DataFrame, queries: DataFrame, k: int, least: float = 0.3, rescaled: bool = False, first: int | None = None) -> DataFrame:
    """(query_id, id, score): records by cosine of their vector with the query's (column vector), over `least`.

    first: so many leading components are compared first (see `two_stage`), as fits vectors whose first components say most; the result is the same.

    Vectors are normalised once and packed into blocks; every block of records meets every block of queries in one
    product of matrices, which gives at most k rows for a query. rescaled: the score is (1 + cosine) / 2.
    """
    key = dict(records.dtypes)["id"]
    base = _blocks(records.where(active() & F.col("embedding").isNotNull()).select("id", F.col("project_id").alias("scope"), "embedding"), "embedding", RECORD_BLOCK)
    asked = _blocks(queries.where("vector IS NOT NULL").select(F.col("query_id").alias("id"), F.col("project").alias("scope"), "vector"), "vector", QUERY_BLOCK)
    asked = asked.select("n", F.col("ids").alias("query_ids"), F.col("scopes").alias("projects"), F.col("data").alias("asked"))

    def scored(batches):
        for batch in batches:
            for row in (batch.slice(n, 1).to_pylist()[0] for n in range(batch.num_rows)):  # a batch's blocks aren't copied all at once
                x, q = (np.frombuffer(row[c], np.float64).reshape(-1, row["n"]) for c in ("data", "asked"))
                scopes, projects = np.array(row["scopes"], object), np.array(row["projects"], object)
                allowed = (scopes[None] == projects[:, None]) | (scopes[None] == "global")
                score = np.round(q @ x.T if first is None else two_stage(q, x, allowed, k, least, first)[0], 6)
                score[~allowed] = -2
                ids = np.array(row["ids"], object)
                made = {"query_id": [], "id": [], "score": []}
                for j, own in enumerate(score):
                    some = np.flatnonzero(own > least)
                    if len(some) > k:
                        some = some[own[some] >= np.partition(own[some], -k)[-k]]  # ties at the border all stay
                    made["query_id"] += [row["query_ids"][j]] * len(some)
                    made["id"] += ids[some].tolist()
                    made["score"] += own[some].tolist()
                yield pa.RecordBatch.from_pydict(made, pa.schema([("query_id", pa.string()), ("id", pa.string()), ("score", pa.float64())]))

    pairs = _met(base, asked).mapInArrow(scored, "query_id string, id string, score double")
    found = pairs.select(F.col("query_id").cast(dict(queries.dtypes)["query_id"]), F.col("id").cast(key), "score")
    best = top(found, k)
    return best.withColumn("score", F.round((1 + F.col("score")) / 2, 7)) if rescaled else best


def semantic_pairs(vectors: DataFrame, least: float, tag: str | None = None, forest: bool = False, most: int | None = None) -> DataFrame:
    """(a < b, similarity) of vectors (id, embedding) with a cosine of `least` or more: an exact join of bundles; tag, forest and most: see `vector_join.alike`."""
    pairs = alike(vectors, None, least, tag=tag, forest=forest, most=most)
    turned = F.col("a") > F.col("b")
    tags = [F.when(turned, F.col(f"tag_{y}")).otherwise(F.col(f"tag_{x}")).alias(f"tag_{x}") for x, y in ("ab", "ba")] if tag else []
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity", *tags)


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected edges (memory_a, memory_b, weight) as (src, dst, weight) in both directions."""
    forth = edges.selectExpr("memory_a AS src", "memory_b AS dst", "weight")
    return forth.unionByName(edges.selectExpr("memory_b AS src", "memory_a AS dst", "weight"))


def strongest(edges: DataFrame, k: int, least: float = 0.05) -> DataFrame:
    """At most k neighbours of each vertex, by weight."""
    order = W.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return both_ways(edges).where(F.col("weight") >= least).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def graph(seeds: DataFrame, near: DataFrame, k: int, scope=None) -> DataFrame:
    """Seeds (query_id, id) score 1, their neighbours in near (src, dst, weight) 0.3 + 0.6 of the largest weight.

    near: the strongest neighbours of each vertex. scope: what may be found, as a function of (query_id, id, score).
    """
    found = seeds.join(near, F.col("id") == F.col("src")).groupBy("query_id", F.col("dst").alias("id")).agg((0.3 + 0.6 * F.max("weight")).alias("score"))
    both = found.unionByName(seeds.select("query_id", "id", F.lit(1.0).alias("score"))).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return top(scope(both) if scope else both, k)


def spreading(seeds: DataFrame, near: DataFrame, k: int, hops: int = 2, decay: float = 0.6, least: float = 0.05, shared: DataFrame | None = None, scope=None) -> DataFrame:
    """Activation from seeds over `hops` hops in near (src, dst, weight), each weight times decay; the largest counts; seeds are left out.

    near: the strongest neighbours of each vertex. shared: (a, b, target), sources of one target; they are neighbours of weight SHARED_WEIGHT.
    """
    near = near.select("src", "dst", "weight")
    if shared is not None:
        near = near.unionByName(shared.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct().withColumn("weight", F.lit(SHARED_WEIGHT)))
    front = seeds.select("query_id", "id", F.lit(1.0).alias("score"))
    levels = []
    for _ in range(hops):
        step = front.join(near, F.col("id") == F.col("src")).select("query_id", F.col("dst").alias("id"), (F.col("score") * F.col("weight") * decay).alias("score"))
        front = step.where(F.col("score") >= least).groupBy("query_id", "id").agg(F.max("score").alias("score"))
        levels.append(front)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    found = every.groupBy("query_id", "id").agg(F.max("score").alias("score")).join(seeds.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return top(scope(found) if scope else found, k)


def concepts(members: DataFrame, nodes: DataFrame, queries: DataFrame, k: int, least: float = 0.3, n_nodes: int = 50, scope=None, records: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score): members (concept, id, probability) of the 5 concepts nearest to a query.

    nodes: (concept, centroid, size) and, if there, label, a text whose words count WORD_SCORE each where the query
    has them. Only the n_nodes largest nodes are compared. A member counts once, by its greatest
    probability, among equals by the least concept. queries: query_id, vector and, with labels, text. scope, records: what may be found, see `in_reach`.
    """
    largest = nodes.orderBy(F.desc("size"), "concept").limit(n_nodes)
    cos = F.coalesce(cosine("centroid", "vector"), F.lit(0.0))
    score = F.when(cos >= least, cos).otherwise(0.0)
    if "label" in nodes.columns:
        words = F.filter(F.array_distinct(F.split(F.lower("text"), r"\s+")), lambda w: F.octet_length(w) > 2)
        score = score + WORD_SCORE * F.size(F.filter(words, lambda w: F.contains(F.lower(F.col("label")), w)))
    near = queries.crossJoin(F.broadcast(largest)).withColumn("score", score).where(F.col("score") > 0)  # n_nodes rows at most
    best = top(near.select("query_id", "concept", "score"), 5, "concept")
    found = best.join(representatives(members, k, records), "concept")
    once = found.withColumn("r", F.row_number().over(W.partitionBy("query_id", "id").orderBy(F.desc("probability"), "concept"))).where("r = 1")
    found = once.select("query_id", "id", (F.col("score") * F.col("probability")).alias("score"))
    return top(scope(found) if scope else found, k)


def representatives(members: DataFrame, k: int, records: DataFrame | None = None) -> DataFrame:
    """The members (concept, id, probability) that can be among the k best of a search by concept.

    Records with the same concepts and probabilities have the same score in every search, so of those only the k least ids can be found.
    records: what may be found; then only active ones count, and the k least ids are those of a project.
    """
    alike = members.where("concept IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("concept", "probability"))).alias("own"))  # a record's concepts
    by = ["own"]
    if records is not None:
        alike, by = alike.join(records.where(active()).select("id", "project_id"), "id"), ["own", "project_id"]
    kept = alike.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy("id"))).where(F.col("r") <= k)
    return kept.select("id", F.explode("own").alias("o")).select("o.concept", "id", "o.probability")


def in_reach(records: DataFrame, queries: DataFrame):
    """A scope for paths that go over ids alone: found records must be active and in the query's project or in all projects."""
    alive = records.where(active()).select("id", "project_id")
    asked = scoped(queries.select("query_id", "project")).select("query_id", "project_id")
    return lambda found: found.join(alive, "id").join(asked, ["query_id", "project_id"]).select("query_id", "id", "score")


def seeds_of(keyword: DataFrame, semantic: DataFrame, k: int = 6) -> DataFrame:
    """The k records of each query that are best by word or by vector."""
    both = keyword.select("query_id", "id", "score").unionByName(semantic.select("query_id", "id", "score"))
    return top(both.groupBy("query_id", "id").agg(F.max("score").alias("score")), k).select("query_id", "id")


def fuse(paths: dict[str, DataFrame], intents: str | DataFrame) -> DataFrame:
    """(query_id, id, rrf): weighted reciprocal ranks; a record that a path hasn't found has the rank after its last.

    intents: one intent, or (query_id, intent). One aggregation over all paths in long form instead of a
    chain of outer joins.
    """
    long = None
    for name, found in paths.items():
        part = found.select("query_id", "id", F.lit(name).alias("path"), "score")
        long = part if long is None else long.unionByName(part)
    merged = long.groupBy("query_id", "id").agg(*(F.max(F.when(F.col("path") == p, F.col("score"))).alias(p) for p in PATHS))
    merged = merged.withColumn("intent", F.lit(intents)) if isinstance(intents, str) else merged.join(intents.select("query_id", "intent"), "query_id")
    w = weights(F.col("intent"), RRF_WEIGHTS, PATHS)
    n = F.count("*").over(W.partitionBy("query_id"))
    total = F.lit(0.0)
    for p in PATHS:
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc_nulls_last(p), "id"))
        total = total + w[p] / (RRF_K + F.when(F.col(p) > 0, place).otherwise(n + 1))
    return merged.select("query_id", "id", total.alias("rrf"))


def hybrid(records: DataFrame, queries: DataFrame, edges: DataFrame, shared: DataFrame, nodes: DataFrame, members: DataFrame, now, k: int = 10, paths: int = 20, texts: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, id, rrf): six paths of `paths` results each, fused by each query's intent. The flagship's first half.

    queries: query_id, text, project, as_of, vector, intent; edges: (memory_a, memory_b, weight) of record ids;
    shared: (a, b, target) of record ids; nodes and members: see `concepts`. texts, vectors: the records with content and with
    embedding; where they are given, records needs neither, so that the other paths don't join what only these read.
    """
    scope = in_reach(records, queries)
    # Tables that several paths read are written once: each path's plan then begins at them.
    queries = staged(queries, "queries")
    keyword = staged(bm25(records if texts is None else texts, queries, paths).withColumn("score", F.round(F.col("score") / (1 + F.col("score")), 6)), "keyword")
    by_vector = staged(semantic(records if vectors is None else vectors, queries, paths), "semantic")
    seeds = staged(seeds_of(keyword, by_vector), "seeds")
    near = staged(strongest(edges, 10).select("src", "dst", "weight"), "near")
    found = {
        "keyword": keyword, "semantic": by_vector, "temporal": temporal(records, queries, paths, now), "graph": graph(seeds, near, paths, scope),
        "concept": concepts(members, nodes, queries, paths, scope=scope, records=records), "activation": spreading(seeds, near, paths, shared=shared, scope=scope),
    }
    fused = staged(fuse(found, queries), "fused")
    dropped(queries, keyword, by_vector, seeds, near)
    return fused


def ranked(fused: DataFrame, records: DataFrame, queries: DataFrame, edges: DataFrame, now, k: int = 10) -> DataFrame:
    """(query_id, id, score): the k best of fused (query_id, id, rrf) by composite score, links to each other, and quality.

    Where the queries have a column empty_run, the searches in a row before them that found nothing, many of them change the weights.
    """
    runs = [c for c in ("empty_run",) if c in queries.columns]
    rows = fused.join(records, "id").join(hebbian_boost(fused, edges), ["query_id", "id"], "left").join(queries.select("query_id", "intent", *runs), "query_id")
    signals = {
        "rrf": F.col("rrf"), "recency": recency(F.col("created_at"), now), "importance": F.col("importance"), "confidence": F.coalesce("confidence", F.lit(0.5)),
        "hebbian": F.coalesce("boost", F.lit(0.0)), "retention": retention(F.col("last_accessed"), F.col("strength"), now), "depth": F.col("processing_depth"),
    }
    base = composite(signals, F.col("intent"), F.coalesce("empty_run", F.lit(0)) if runs else None) * F.when(F.col("superseded_by").isNotNull(), SUPERSEDED).otherwise(1.0)
    return top(rows.select("query_id", "id", ((1 - QUALITY_SHARE) * base + QUALITY_SHARE * quality(now)).alias("score")), k)


def hebbian_boost(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, id, boost): weights to other records found for the same query, 0.2 of their sum, 0.5 at most."""
    a, b = found.select("query_id", F.col("id").alias("src")), found.select("query_id", F.col("id").alias("dst"))
    near = a.join(strongest(edges, 20, 0.0), "src").join(b, ["query_id", "dst"])
    return near.groupBy("query_id", F.col("src").alias("id")).agg(F.least(F.sum("weight") * 0.2, F.lit(0.5)).alias("boost"))


def diverse(found: DataFrame, k: int, trade: float = 0.7) -> DataFrame:
    """(query_id, id, place): greedy choice of k records of each query by relevance less likeness to those chosen.

    found: query_id, id, score, embedding and, if there, content. Two records are alike by the cosine of their vectors, or,
    if one has none, by the Jaccard similarity of the words of their contents. Relevance is the score scaled to 0 to
    1 within a query (1 if all are equal); ties go by id. A query with k records or fewer has them by score.
    A group is what the paths have found for one query, so it is small.
    """

    def word_set(text):
        return {w for w in (x.strip(PUNCTUATION) for x in (text or "").lower().split()) if len(w.encode()) > 2}

    def chosen(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        n = len(group)
        span = group.score.max() - group.score.min()
        relevance = ((group.score - group.score.min()) / span if span > 0 else pd.Series(1.0, group.index)).to_numpy()
        vectors = [None if v is None else np.asarray(v, float) for v in group.embedding]
        words = [word_set(t) for t in group.content] if "content" in group else [set()] * n

        def like(i, j):
            a, b = vectors[i], vectors[j]
            if a is not None and b is not None:
                size = np.linalg.norm(a) * np.linalg.norm(b) if len(a) == len(b) else 0
                return float(a @ b / size) if size > 0 else 0.0
            both = len(words[i] & words[j])
            return both / max(1, len(words[i]) + len(words[j]) - both)

        if n <= k:
            picked = list(range(n))
        else:
            picked, most = [0], np.zeros(n)
            while len(picked) < k:
                most = np.maximum(most, [like(i, picked[-1]) for i in range(n)])
                value = np.round(trade * relevance - (1 - trade) * most, 9)
                value[picked] = -np.inf
                picked.append(int(value.argmax()))
        return pd.DataFrame({"query_id": group.query_id.iloc[0], "id": group.id[picked], "place": range(1, len(picked) + 1)})

    return found.groupBy("query_id").applyInPandas(chosen, "query_id long, id string, place long")


def reranked(found: DataFrame, scorer, share: float = 0.85) -> DataFrame:
    """(query_id, id, score) of found (query_id, id, score, text, content): the scorer's logit as a probability, blended with the score.

    scorer: a function of the columns (text, content) that gives a logit; a null logit counts as 0.
    """
    made = 1 / (1 + F.exp(-F.coalesce(scorer(F.col("text"), F.col("content")), F.lit(0.0))))
    return found.select("query_id", "id", F.round(share * made + (1 - share) * F.col("score"), 6).alias("score"))


def fallback(records: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score) by words alone: records with all of them, else those that hold the text as it is."""
    words = staged(bm25(records, queries, k), "words")
    rest = like(records, queries.join(words.select("query_id").distinct(), "query_id", "left_anti"), k)
    return words.unionByName(rest)


def packed(found: DataFrame, records: DataFrame, questions: DataFrame, budget: int, reranked: bool, preview: int = 120) -> DataFrame:
    """(query_id, question, answer, confidence, n_sources, sources, previews, used, fallback, reranked): what is found for each question, packed into `budget` characters.

    Records come by score (ties by id) as long as the sum of their lengths stays within the budget; the first is the answer even if it is longer. A
    question for which nothing is found has no answer and is a fallback. Sources are at most as many as were found for a question.
    """
    rows = found.join(records.select("id", "content", F.coalesce("confidence", F.lit(0.5)).alias("sure")), "id").withColumn("size", F.char_length("content"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("total", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    kept = rows.where((F.col("place") == 1) | (F.col("total") <= budget))
    source = F.struct("place", "id", F.substring("content", 1, preview).alias("preview"))
    lists = kept.groupBy("query_id").agg(
        F.max(F.when(F.col("place") == 1, F.col("content"))).alias("answer"), F.round(F.max(F.when(F.col("place") == 1, F.col("sure") * F.col("score"))), 6).alias("confidence"),
        F.array_sort(F.collect_list(source)).alias("s"), F.count("*").alias("n_sources"), F.sum("size").alias("used"),
    )
    zero = F.lit(0).cast("long")
    made = questions.select("query_id", F.col("text").alias("question")).join(lists, "query_id", "left")
    return made.select(
        "query_id", "question", "answer", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("n_sources", zero).alias("n_sources"),
        F.coalesce(F.array_join(F.transform("s", lambda x: x["id"]), ","), F.lit("")).alias("sources"), F.coalesce(F.array_join(F.transform("s", lambda x: x["preview"]), " | "), F.lit("")).alias("previews"),
        F.coalesce("used", zero).alias("used"), F.col("answer").isNull().alias("fallback"), F.lit(reranked).alias("reranked"),
    )


def answers(found: DataFrame, records: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, answer, confidence, sources): the best record's content and confidence, and the ids of the k best in order."""
    best = top(found, k).join(records.select("id", "content", F.coalesce("confidence", F.lit(0.5)).alias("sure")), "id")
    lists = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "content", "sure"))).alias("b"))  # k rows
    return lists.select("query_id", F.expr("b[0].content").alias("answer"), F.expr("b[0].sure").alias("confidence"), F.expr("transform(b, x -> x.id)").alias("sources"))


def co_retrieved(found: DataFrame, k: int = 5) -> DataFrame:
    """(memory_a < memory_b, n, weight): records among the k best of the same query; a pair gains 0.1 for each query, up to 1."""
    best = top(found, k).select("query_id", "id")
    pairs = best.withColumnRenamed("id", "memory_a").join(best.withColumnRenamed("id", "memory_b"), "query_id").where("memory_a < memory_b")  # k * (k - 1) / 2 a query
    counted = pairs.groupBy("memory_a", "memory_b").agg(F.count("*").alias("n"))
    return counted.withColumn("weight", F.round(F.least(0.1 * F.col("n"), F.lit(1.0)), 6))


def search_hits(found: DataFrame, records: DataFrame) -> DataFrame:
    """(id, search_hit_count) of the records that were found: one more for each query."""
    return (
        found.groupBy("id").agg(F.count("*").alias("hits")).join(records.select("id", "search_hit_count"), "id")
        .select("id", (F.col("search_hit_count") + F.col("hits")).alias("search_hit_count"))
    )
