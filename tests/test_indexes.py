"""Kept indexes, joins by time and vectors, and hierarchies against brute force."""

import datetime as dt
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import analysis, clusters, grams, graph, retrieval, substrings, validity, vector_join
from palimpsest.operators.asof import latest
from palimpsest.operators.postings import Postings

RNG = np.random.Generator(np.random.PCG64(3))
T0 = dt.datetime(2024, 1, 1)


def planted(n=2400, dims=24, centres=30):
    """Clusters that lie apart, with vectors between them."""
    c = RNG.normal(size=(centres, dims))
    return np.concatenate([c[RNG.integers(0, centres, n)] + 0.12 * RNG.normal(size=(n, dims)), RNG.normal(size=(n // 20, dims))])


def cosines(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.round(u @ u.T, 6)


def test_vector_join_is_exact_and_prunes(spark, monkeypatch):
    monkeypatch.setattr(vector_join, "BLOCK", 32)
    x = planted()
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(-1, None), (-2, [1.0, 2.0]), (-3, [2.0, 4.0]), (-4, [0.0] * x.shape[1]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    counted = []
    got = {tuple(sorted((int(r.a), int(r.b)))) for r in vector_join.alike(df, None, 0.7, counted).collect()}
    i, j = np.nonzero(np.triu(cosines(x) >= 0.7, 1))
    assert got == set(zip(i.tolist(), j.tolist(), strict=True)) | {(-3, -2)}
    met, every = max(counted, key=lambda c: c[1])
    assert met < every / 5


def test_vector_join_of_two_tables(spark):
    x, y = planted(300), planted(80)
    frame = lambda v: spark.createDataFrame(list(enumerate(v.tolist())), "id long, embedding array<double>")
    got = {(int(r.a), int(r.b)) for r in vector_join.alike(frame(x), frame(y), 0.3).collect()}
    c = cosines(np.concatenate([x, y]))[: len(x), len(x) :]
    assert got == set(zip(*(a.tolist() for a in np.nonzero(c >= 0.3)), strict=True))
    assert vector_join.alike(frame(x), frame(y).limit(0), 0.3).count() == 0
    nodes = frame(y).selectExpr("id AS concept", "embedding AS centroid")
    best = {r.id: r.concept for r in clusters.assigned(frame(x), nodes, 0.3).collect()}
    assert best == {i: int(np.lexsort((np.arange(len(y)), -c[i]))[0]) for i in range(len(x)) if c[i].max() >= 0.3}


def test_vector_join_keeps_the_types_of_both_sides(spark):
    left = spark.createDataFrame([(1 << 40, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    right = spark.createDataFrame([(7, [2.0, 0.0]), (8, [1.0, 1.0])], "id int, embedding array<double>")
    made = vector_join.alike(left, right, 0.9)
    assert [t for _, t in made.dtypes] == ["bigint", "int", "double"]
    assert [tuple(r) for r in made.collect()] == [(1 << 40, 7, 1.0)]
    named = vector_join.alike(left, right.select(F.concat(F.lit("n"), "id").alias("id"), "embedding"), 0.9)
    assert [tuple(r) for r in named.collect()] == [(1 << 40, "n7", 1.0)]


def test_clusters_grow(spark):
    x = planted(500)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "id long, embedding array<double>")
    whole = {r.id: r.cluster for r in clusters.clusters(df, 0.7, 2).collect()}
    labels, old = None, None
    for k in range(3):
        new = df.where(F.col("id") % 3 == k)
        before, labels = labels, clusters.extended(labels, old, new, 0.7)
        old = new if old is None else old.unionByName(new)
    assert {r.id: r.cluster for r in clusters.members_of(labels, 2).collect()} == whole
    was = {r.id: r.root for r in before.collect()}
    assert {r.id for r in clusters.moved(before, labels).collect()} == {r.id for r in labels.collect() if was.get(r.id) != r.root}


def records(spark, rows):
    return spark.createDataFrame(rows, "id string, project_id string, content string, deleted_at string")


def ranks(df):
    return sorted((r.query_id, r.id, r.score) for r in df.collect())


def test_postings_are_maintained(spark, tmp_path):
    """Search after inserts, changes and deletes equals search over the records that are left, also after a repeated write and compacting."""
    words = ["red", "green", "blue", "old", "new", "tree", "house", "river"]
    text = lambda: " ".join(words[k] for k in RNG.integers(0, len(words), 12))
    first = [(f"m{i}", f"p{i % 3}" if i % 4 else "global", text(), None) for i in range(60)]
    changed = [(i, p, text(), None) for i, p, _, _ in first[:20]]
    index = Postings(spark, f"{tmp_path}/index")
    queries = spark.createDataFrame([(1, "red tree", "p1"), (2, "river", "p2"), (3, "house missing", "p0"), (4, "blue blue old", "global")], "query_id long, text string, project string")
    assert index.search(queries, 5).count() == 0
    index.write(records(spark, first), 0)
    index.write(records(spark, changed[:3] + [(first[30][0], first[30][1], "x", "now")]), 1)
    index.write(records(spark, changed), 1)  # the same version again: in place of the first try
    index.remove(records(spark, first[40:50]).select("id"), 2)
    index.write(records(spark, first[40:42] + [("new", "p1", "red red tree", None)]), 3)
    now = {r[0]: r for r in first} | {r[0]: r for r in changed}
    for r in first[42:50]:
        del now[r[0]]
    now["new"] = ("new", "p1", "red red tree", None)
    wanted = ranks(retrieval.bm25(records(spark, list(now.values())), queries, 5))
    assert ranks(index.search(queries, 5)) == wanted != []
    assert ranks(index.compacted(f"{tmp_path}/compact").search(queries, 5)) == wanted
    anyone = ranks(retrieval.bm25(records(spark, list(now.values())), queries, 5, any_term=True))
    assert ranks(index.search(queries, 5, any_term=True)) == anyone


def test_postings_follow_a_stream(spark, tmp_path):
    rows = [(f"m{i}", "global", f"word{i % 5} red", None) for i in range(12)]
    index = Postings(spark, f"{tmp_path}/index")
    queries = spark.createDataFrame([(1, "red", "p")], "query_id long, text string, project string")
    for part in (rows[:6], [(rows[0][0], "global", "nothing", None)] + rows[6:]):
        records(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(records(spark, []).schema).parquet(f"{tmp_path}/in")
        index.follow(stream, f"{tmp_path}/checkpoint").awaitTermination(120)
    assert {r.id for r in index.search(queries, 50).collect()} == {f"m{i}" for i in range(1, 12)}


def test_substrings_by_grams(spark):
    letters = "abcdefgh "
    rows = [(f"m{i}", f"p{i % 4}", "".join(letters[k] for k in RNG.integers(0, 9, 80)), None) for i in range(300)] + [("e", "p0", "", None), ("s", "p0", "AB", None), ("u", "p1", "Straße ÉTÉ", None)]
    asked = [(k, rows[k][2][10 : 10 + n], rows[k][1]) for k, n in zip(range(0, 200, 10), [4, 5, 6, 8] * 5, strict=True)] + [(900, "ab", "p0"), (901, "zzz", "p1"), (902, "été", "p1"), (903, "%_", "p0")]
    docs, queries = records(spark, rows), spark.createDataFrame(asked, "query_id long, text string, project_id string")
    index = grams.grams(docs)
    got = {(r.query_id, r.id) for r in grams.containing(docs, index, queries).collect()}
    assert got == {(q, i) for q, t, p in asked for i, own, c, _ in rows if own == p and t.lower() in c.lower()}
    pairs = grams.candidates(index, queries.where("length(text) >= 3")).count()
    assert len(got) <= pairs < sum(own == p for _, _, p in asked for _, own, _, _ in rows) / 3


def test_valid_as_of(spark):
    day = lambda d: None if d is None else T0 + dt.timedelta(days=float(d))
    spans = [(b, b + s) for b, s in zip(RNG.uniform(-900, 900, 300), RNG.choice([0.2, 3, 30, 400, 5000, -1, 0], 300), strict=True)] + [(None, 5), (5, None), (None, None), (0, 1)]
    rows = [(k, f"p{k % 3}", day(b), day(e)) for k, (b, e) in enumerate(spans)]
    asked = [(k, f"p{k % 3}", day(d)) for k, d in enumerate([*RNG.uniform(-1000, 6000, 60), 0, 1, None])]
    left = spark.createDataFrame(rows, "id long, project_id string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    right = spark.createDataFrame(asked, "query_id long, project_id string, as_of timestamp_ntz")
    got = sorted((r.query_id, r.id) for r in validity.as_of(left, right, ["project_id"]).collect())
    fits = lambda b, e, t: (b is None or (t is not None and b <= t)) and (e is None or (t is not None and e > t))
    assert got == sorted((q, i) for q, p, t in asked for i, own, b, e in rows if own == p and fits(b, e, t))
    assert validity.with_buckets(left).groupBy("id").count().where(F.col("count") > validity.SPAN + 1).count() == 0


def test_latest_row_before(spark):
    log = [(int(u), T0 + dt.timedelta(hours=float(h)), k, None if k % 7 == 0 else int(k)) for k, (u, h) in enumerate(zip(RNG.integers(0, 3, 200), RNG.integers(0, 400, 200), strict=True))]
    asked = [(k, int(u), T0 + dt.timedelta(hours=float(h))) for k, (u, h) in enumerate(zip(RNG.integers(0, 4, 80), RNG.integers(-5, 500, 80), strict=True))]
    got = {r.q: r.v for r in latest(spark.createDataFrame(asked, "q long, u long, at timestamp_ntz"), spark.createDataFrame(log, "u long, t0 timestamp_ntz, k long, v long"), "u", "at", "t0", "k", "v").collect()}
    assert got == {q: max([(t, k, v) for w, t, k, v in log if w == u and t <= at], key=lambda x: x[:2], default=(0, 0, None))[2] for q, u, at in asked}


def test_empty_runs_over_days(spark):
    rows = [(1 if RNG.random() < 0.7 else 2, k, T0 + dt.timedelta(hours=int(h)), bool(RNG.random() < 0.8)) for k, h in enumerate(RNG.integers(0, 300, 400))]
    got = {r.event_id: r.empty_run for r in analysis.empty_runs(spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz, empty boolean")).collect()}
    runs, wanted = {}, {}
    for u, k, _, empty in sorted(rows, key=lambda r: (r[2], r[1])):
        runs[u] = wanted[k] = runs.get(u, 0) + 1 if empty else 0
    assert got == wanted and max(got.values()) > 8


def test_hierarchies_of_any_depth(spark):
    chain = [(f"t{i}", f"t{i + 1}") for i in range(30)] + [("t30", None)]
    cycle = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("s", "s")]
    got = {(r.name, r.ancestor): r.steps for r in graph.ancestors(spark.createDataFrame(chain + cycle, "name string, parent string")).collect()}
    wanted = {(f"t{i}", f"t{j}"): j - i for i in range(31) for j in range(i + 1, 31)}
    wanted |= {("a", "b"): 1, ("a", "c"): 2, ("b", "c"): 1, ("b", "a"): 2, ("c", "a"): 1, ("c", "b"): 2, ("d", "a"): 1, ("d", "b"): 2, ("d", "c"): 3}
    assert got == wanted


@pytest.mark.parametrize("run, factor", [(2, False), (3, True)])
def test_many_empty_searches_change_the_order(spark, run, factor):
    """An old record with a good rank and a new one with a bad rank: after three searches that found nothing the new one gains."""
    now = F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'")
    rows = [("old", T0 - dt.timedelta(days=400)), ("new", T0 + dt.timedelta(days=30))]
    m = spark.createDataFrame(rows, "id string, created_at timestamp_ntz").selectExpr(
        "id", "created_at", "created_at AS last_accessed", "0.5D AS importance", "0.5D AS confidence", "1.0D AS strength", "0.5D AS processing_depth", "CAST(NULL AS STRING) AS superseded_by",
        "0L AS access_count", "0L AS search_hit_count", "0L AS contradiction_count", "'core' AS tier",
    )
    fused = spark.createDataFrame([(1, "old", 0.03), (1, "new", 0.02)], "query_id long, id string, rrf double")
    edges = spark.createDataFrame([], "memory_a string, memory_b string, weight double")
    plain = spark.createDataFrame([(1, "factual")], "query_id long, intent string")
    score = lambda q: {r.id: r.score for r in retrieval.ranked(fused, m, q, edges, now).collect()}
    before, after = score(plain), score(plain.withColumn("empty_run", F.lit(run)))
    assert (after["new"] > before["new"]) == factor and (factor or after == before)


def test_vector_join_over_bundles(spark, monkeypatch):
    """Several bundles: pairs with tags, the most alike ones, and forests that have the components of all links."""
    for name, value in (("GROUP", 64), ("BLOCK", 16), ("BUNDLE_BYTES", 64 * 8 * 24), ("STEP", 100)):
        monkeypatch.setattr(vector_join, name, value)
    x = planted(600)
    df = spark.createDataFrame([(i, v, f"t{i % 7}") for i, v in enumerate(x.tolist())], "id long, embedding array<double>, tag string")
    c = cosines(x)
    i, j = np.nonzero(np.triu(c >= 0.5, 1))
    got = retrieval.semantic_pairs(df, 0.5, "tag").collect()
    assert {(r.a, r.b) for r in got} == set(zip(i.tolist(), j.tolist(), strict=True)) and len(got) == len(i)
    assert all((r.tag_a, r.tag_b) == (f"t{r.a % 7}", f"t{r.b % 7}") for r in got)
    order = sorted(zip((-c[i, j]).tolist(), i.tolist(), j.tolist(), strict=True))[:9]
    assert [(r.a, r.b) for r in analysis.similar_pairs(df, 0.5, 9).collect()] == [(a, b) for _, a, b in order]
    links = retrieval.semantic_pairs(df, 0.5, forest=True).collect()
    assert len(links) < len(i) / 2
    assert len(vector_join.joined(np.arange(len(x)), np.array([r.a for r in links]), np.array([r.b for r in links]))) == len(vector_join.joined(np.arange(len(x)), i, j))


def test_search_over_slots(spark, monkeypatch):
    """Slots of a few postings, copies and equal questions give the ranks of one slot; no row is made for each question and record."""
    text = lambda n: " ".join(["red", "green", "blue", "old", "new", "tree"][k] for k in RNG.integers(0, 6, n))
    rows = [(f"m{i:03}", f"p{i % 3}" if i % 4 else "global", text(int(RNG.integers(2, 9))), None) for i in range(150)]
    rows += [(f"c{i:03}", "global", "red tree", None) for i in range(150)]
    asked = spark.createDataFrame([(i, text(2), ["p0", "p1", "global"][i % 3]) for i in range(60)] + [(99, "a", "p0")], "query_id long, text string, project string")
    asked = asked.withColumn("more", F.array(F.lit("old"), F.lit("none")))
    df = records(spark, rows)
    words = {i: t.split() for i, _, t, _ in rows}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    df_of = {t: sum(t in w for w in words.values()) for t in ("red", "green", "blue", "old", "new", "tree")}
    for any_term, sparse in ((False, None), (True, None), (False, "more")):
        with monkeypatch.context() as m:
            m.setattr(retrieval, "SLOT_POSTINGS", 40)
            got = ranks(retrieval.bm25(df, asked, 7, any_term=any_term, sparse=sparse))
        want = []
        for q in asked.collect():
            must = {t for t in q.text.split() if len(t) > 1}
            use = must | ({"old"} if sparse else set())
            found = []
            for i, p, _, _ in rows:
                own = words[i]
                if p not in (q.project, "global") or not use & set(own) or not (any_term or must <= set(own)):
                    continue
                norm = lambda t: own.count(t) * 2.2 / (own.count(t) + 1.2 * (0.25 + 0.75 * len(own) / avg))  # noqa: E731, B023
                found.append((-round(sum(max(np.log((n - df_of[t] + 0.5) / (df_of[t] + 0.5)), 1e-6) * norm(t) for t in use if t in own), 6), i))
            want += [(q.query_id, i, -s) for s, i in sorted(found)[:7]]
        assert [(q, i) for q, i, _ in got] == [(q, i) for q, i, _ in sorted(want)]
        assert np.allclose([s for *_, s in got], [s for *_, s in sorted(want)], atol=1.1e-6)


def test_search_by_concept_reads_representatives(spark):
    members = [(c, f"m{i:03}", 1.0 if i % 3 else 0.5) for i in range(300) for c in ((i % 4,) if i % 5 else (i % 4, 9))]
    df = spark.createDataFrame(members, "concept long, id string, probability double")
    kept = retrieval.representatives(df, 5).collect()
    assert len(kept) < len(members) / 2
    nodes = spark.createDataFrame([(c, [1.0, c / 9], 10) for c in (0, 1, 2, 3, 9)], "concept long, centroid array<double>, size long")
    asked = spark.createDataFrame([(i, [1.0, i / 4]) for i in range(5)], "query_id long, vector array<double>")
    got = ranks(retrieval.concepts(df, nodes, asked, 5, 0.1))
    want = []
    for i in range(5):
        cos = {c: round((1 + i / 4 * c / 9) / np.hypot(1, i / 4) / np.hypot(1, c / 9), 6) for c in (0, 1, 2, 3, 9)}
        best = {}
        for c, m, p in members:
            best[m] = max(best.get(m, (-1, 0)), (p, -c))
        scored = sorted((-round(cos[-c] * p, 6), m) for m, (p, c) in best.items())[:5]
        want += [(i, m, -s) for s, m in scored]
    assert [(q, m) for q, m, _ in got] == [(q, m) for q, m, _ in sorted(want)]


def test_terms_are_counted_record_by_record(spark, monkeypatch):
    """No aggregation over all postings where ids are there once; rows of one id still are one record; slots have their own number of partitions."""
    rows = [("a", "p", "Red red tree, red", None), ("b", "p", None, None), ("c", "global", "", None), ("d", "p", "tree", "gone"), ("e", "global", "éa ÉA 7", None)]
    made = retrieval.postings(records(spark, rows))
    want = [("7", "e", "global", 3, 1), ("red", "a", "p", 4, 3), ("tree", "a", "p", 4, 1), ("éa", "e", "global", 3, 2)]
    assert sorted(map(tuple, made.collect())) == want
    assert "Aggregate" not in made._jdf.queryExecution().executedPlan().toString()
    twice = retrieval.postings(records(spark, [*rows, ("a", "p", "red blue old new", None)]))
    assert sorted(tuple(r) for r in twice.collect() if r.id == "a") == [("blue", "a", "p", 4, 1), ("new", "a", "p", 4, 1), ("old", "a", "p", 4, 1), ("red", "a", "p", 4, 4), ("tree", "a", "p", 4, 1)]
    monkeypatch.setattr(retrieval, "SLOT_POSTINGS", 10)
    many = records(spark, [(f"m{i:03}", f"p{i % 3}", "red tree", None) for i in range(150)])
    found = retrieval.bm25(many, spark.createDataFrame([(1, "red", "p0")], "query_id long, text string, project string"), 5)
    assert "hashpartitioning(project_id" in (plan := found._jdf.queryExecution().executedPlan().toString())
    assert f"{retrieval.PARTS_OF_SLOT * 15}), REPARTITION_BY_NUM" in plan
    assert [r.id for r in found.orderBy("id").collect()] == [f"m{i:03}" for i in range(0, 15, 3)]


def test_phrases_are_looked_for_in_one_pass(spark, monkeypatch):
    """Any lengths, copies, nulls and ties give the rows of a brute search; a phrase that all records hold gives k rows of a slot, not one for each record."""
    monkeypatch.setattr(substrings, "SLOT_BYTES", 1000)
    letters = np.array(list("aBÉ "))
    text = lambda n: "".join(letters[RNG.integers(0, 4, n)])
    sure = [None, 0.5, 0.7, float("nan")]
    rows = [(f"m{i:03}", f"p{i % 3}" if i % 4 else "global", None if i % 29 == 3 else text(int(RNG.integers(0, 90))), "now" if i % 17 == 5 else None, sure[i % 4], float(i % 3)) for i in range(250)]
    rows += [("q", None, "ab", None, 0.5, 0.5), ("z", "global", "x" * 70 + "y" + "ab" * 40, None, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "id string, project_id string, content string, deleted_at string, confidence double, importance double")
    asked = [(i, text(int(RNG.integers(1, 7))), ["p0", "p1", "global", "none"][i % 4]) for i in range(60)] + [(i + 60, "aB", "p0") for i in range(5)]
    asked += [(90, "x" * 70 + "y" + "AB" * 40, "p1"), (91, "x" * 40 + "z", "p1"), (92, "", "p0"), (93, None, "p0"), (94, "a", None)]
    queries = spark.createDataFrame(asked, "query_id long, text string, project string")
    place = lambda x: (2, 0) if x is None else (0, 0) if x != x else (1, -x)
    want = []
    for q, t, p in asked:
        held = sorted((place(r[4]), place(r[5]), r[0]) for r in rows if None not in (t, r[1], r[2]) and r[3] is None and r[1] in (p, "global") and t.lower() in r[2].lower())
        score = float(any(len(w.encode()) > 1 for w in (t or "").lower().split(" ")))
        want += [(q, i, score) for *_, i in held[:7]]
    assert ranks(retrieval.like(df, queries, 7)) == sorted(want)
    live = df.where("content IS NOT NULL").selectExpr("id", "project_id", "lower(content) AS text", "array(0D) AS by")
    made = substrings.first_holding(live, spark.createDataFrame([(1, "global", "a")], "ask long, project_id string, phrase string"), 3).count()
    slots = -(-live.where("project_id = 'global'").selectExpr("sum(octet_length(text) + 1) AS n").first().n // 1000)
    assert slots > 1 and 3 <= made <= 3 * slots


def test_phrases_with_times(spark, monkeypatch):
    """Bounds, phrases and open validity give the rows of a brute search; a text doesn't meet each question's phrase in a row of its own."""
    monkeypatch.setattr(substrings, "SLOT_BYTES", 1000)
    day = lambda d: None if d is None else T0 + dt.timedelta(days=int(d))
    text = lambda n: "".join("abC "[x] for x in RNG.integers(0, 4, n))
    rows = [(f"m{i:03}", f"p{i % 2}" if i % 3 else "global", text(60), None, day(RNG.choice([None, 1, 2, 3, 9, 20])), day(RNG.choice([None, None, 4, 8, 30])), T0) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, project_id string, content string, deleted_at string, valid_from timestamp_ntz, valid_to timestamp_ntz, created_at timestamp_ntz")
    asked = [(i, f"p{i % 3}", day([3, 5, None][i % 3]), day([None, 2][i // 3 % 2]), day([None, 3, 12][i // 2 % 3]), [text(2), "ca", None, "", "zz"][i % 5]) for i in range(60)]
    queries = spark.createDataFrame(asked, "query_id long, project string, as_of timestamp_ntz, after timestamp_ntz, before timestamp_ntz, phrase string")
    want = []
    for q, p, at, after, before, phrase in asked:
        ok = lambda b, e: (b is None or (at is not None and b <= at)) and (e is None or (at is not None and e > at)) and (after is None or (b is not None and b >= after)) and (before is None or (b is not None and b < before))  # noqa: B023, E731
        held = [r for r in rows if r[1] in (p, "global") and ok(r[4], r[5]) and (phrase is None or phrase.lower() in r[2].lower())]
        want += [(q, r[0]) for r in sorted(held, key=lambda r: (r[4] is None, -(r[4] or T0).timestamp(), r[0]))[:4]]
    made = retrieval.temporal(df, queries, 4, F.lit(T0))
    assert sorted((r.query_id, r.id) for r in made.collect()) == sorted(want) != []
    assert "CoGroup" in (plan := made._jdf.queryExecution().executedPlan().toString()) and "Contains" not in plan


def test_ancestors_in_few_rounds(spark, monkeypatch):
    """Chains, cycles and several parents give the fewest steps; rounds are the logarithm of the depth."""
    parents = [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("s", "s"), ("x", "c5"), ("x", "c9"), ("o", None), ("y", "x")]
    ups = {n: [p for m, p in parents if m == n and p] for n, _ in parents}
    want = set()
    for n in ups:
        seen, front, steps = {n}, {n}, 0
        while front:
            steps += 1
            front = {p for m in front for p in ups.get(m, [])} - seen
            seen |= front
            want |= {(n, p, steps) for p in front}
    rounds, kept = [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, name: rounds.append(name) or kept(df, name))
    assert {tuple(r) for r in graph.ancestors(spark.createDataFrame(parents, "name string, parent string")).collect()} == want
    assert len(rounds) <= 8


def test_two_stages_in_slices():
    """A block's queries are compared some at a time: beside the scores little is in memory, and the result is the whole products'."""
    unit = lambda n: (x := RNG.normal(size=(n, 32))) / np.linalg.norm(x, axis=1, keepdims=True)
    q, x = unit(512), unit(4096)
    allowed = RNG.random((512, 4096)) < 0.5
    tracemalloc.start()
    score, made = retrieval.two_stage(q, x, allowed, 10, 0.2, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * score.nbytes and made >= 5120
    want = np.where(allowed, q @ x.T, -2)
    some = want >= np.maximum(np.partition(want, -10, axis=1)[:, -10:-9], 0.2)
    assert np.allclose(score[some], want[some])


def test_slots_of_asked_projects_go_to_few_partitions(spark, monkeypatch, capsys):
    rows = [(f"m{i}", f"p{i % 3}", f"red w{i % 7}") for i in range(300)]
    many = spark.createDataFrame(rows, "id string, project_id string, content string").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    one = spark.createDataFrame([(1, "red w1", "p0")], "query_id long, text string, project string")
    every = spark.createDataFrame([(q, f"red w{q}", f"p{q}") for q in range(3)], "query_id long, text string, project string")
    want = [ranks(retrieval.bm25(many, asked, 5)) for asked in (one, every)]

    def dealt(found):
        found.explain()
        return {int(n) for n in re.findall(r"hashpartitioning\(project_id#\w+, slot#\w+, (\d+)\), REPARTITION_BY_NUM", capsys.readouterr().out)}

    monkeypatch.setattr(retrieval, "SLOT_POSTINGS", 10)
    few = retrieval.bm25(many, one, 5)
    assert ranks(few) == want[0] and dealt(few) == {72}
    monkeypatch.setattr(retrieval, "SLOT_POSTINGS", 1)
    most = retrieval.bm25(many, every, 5)
    assert ranks(most) == want[1] and dealt(most) == {200}


def test_second_steps(spark, monkeypatch):
    """Groups and deals of any size give the same as brute force, also where ids of both kinds are equal; what moves are lists, not pairs."""
    rng = np.random.Generator(np.random.PCG64(5))
    pairs = {(int(a), int(b)) for a, b in zip(rng.integers(0, 60, 500), rng.integers(40, 90, 500), strict=True)} | {(20, 20)}
    both = {*pairs, *((b, a) for a, b in pairs)}
    one = {(a, b) for a, b in pairs if a % 4 == 0}
    want = {(s, d) for s, i in one for a, d in both if a == i and d != s and (s, d) not in one}
    frame = lambda rows, names: spark.createDataFrame([*rows, (None, 3), (8, None)], names)
    made = graph.second_steps(frame(one, "seed long, id long"), frame(both, "src long, dst long"))
    rows = [tuple(r) for r in made.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(seed", plan)
    monkeypatch.setattr(graph, "GROUP_PAIRS", 300)
    monkeypatch.setattr(graph, "SEED_PAIRS", 40)
    rows = [tuple(r) for r in graph.second_steps(frame(one, "seed long, id long"), frame(both, "src long, dst long")).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
