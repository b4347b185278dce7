"""Graph, cluster, drift and event operators of the background jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.scoring import act_r, days_between


def decay(records: DataFrame, now) -> DataFrame:
    """(id, strength): records of importance under 0.9 whose strength changes by more than 0.001."""
    r = act_r(days_between(now, F.col("last_accessed")), F.col("tier"))
    kept = r + (1 - r) * F.coalesce("processing_depth", F.lit(0.0)) * 0.3
    new = F.greatest(F.col("strength") * kept, F.lit(0.1))
    rows = records.where("deleted_at IS NULL AND importance < 0.9").select("id", F.col("strength").alias("was"), F.round(new, 6).alias("strength"))
    return rows.where("abs(was - strength) > 0.001").drop("was")


def strengthen(records: DataFrame) -> DataFrame:
    """(id, confidence): records read more than 3 times gain 0.05, up to 0.95."""
    c = F.coalesce("confidence", F.lit(0.5))
    return records.where((F.col("access_count") > 3) & (c < 0.95)).select("id", F.round(F.least(c + 0.05, F.lit(0.95)), 6).alias("confidence"))


def similar_pairs(vectors: DataFrame, least: float, limit: int | None = None, tag: str | None = None) -> DataFrame:
    """(a < b, similarity): pairs of vectors (id, embedding) with a cosine of `least` or more, the `limit` most alike if given; tag: see `vector_join.alike`.

    Only the hits leave the tasks that compare bundles of vectors, and of those at most `limit` each.
    """
    from palimpsest.operators.retrieval import semantic_pairs

    pairs = semantic_pairs(vectors, least, tag, most=limit)
    return pairs if limit is None else pairs.orderBy(F.desc("similarity"), "a", "b").limit(limit)


def centroids(vectors: DataFrame) -> DataFrame:
    """(concept, centroid, size): mean vectors at length 1; partial sums by component, no group is gathered."""
    long = vectors.select("concept", F.posexplode("embedding").alias("p", "x"))
    means = long.groupBy("concept", "p").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("size"))
    lists = means.groupBy("concept").agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("c"), F.max("size").alias("size"))
    raw = "transform(c, s -> s.x)"
    return lists.selectExpr("concept", f"transform({raw}, x -> x / sqrt(aggregate({raw}, 0D, (s, y) -> s + y * y))) AS centroid", "size")


def shared_targets(edges: DataFrame, k: int = 5) -> DataFrame:
    """(a, b, target): other sources of the same target, k for each source and target.

    A target's sources are ranked first, and a source meets only the first k + 1 of them: no pairs of a whole group.
    """
    links = edges.select("from_id", "to_id").distinct()
    first = links.withColumn("r", F.row_number().over(W.partitionBy("to_id").orderBy("from_id"))).where(F.col("r") <= k + 1)
    other = first.select("to_id", F.col("from_id").alias("b"))
    pairs = links.select(F.col("from_id").alias("a"), "to_id").join(other, "to_id").where("a <> b")
    order = W.partitionBy("a", "to_id").orderBy("b")
    return pairs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("a", "b", F.col("to_id").alias("target"))


def drift(members: DataFrame, window: int = 5) -> DataFrame:
    """(concept, cycle, churn, drift5) of members (concept, cycle, member): Jaccard distance to the cycle before, and its sum over `window` cycles.

    Common members are counted in a join on (concept, cycle, member): no row holds all members of a concept.
    """
    rows = members.select("concept", "cycle", "member").distinct()
    sizes = rows.groupBy("concept", "cycle").agg(F.count("*").alias("n"))
    by = W.partitionBy("concept").orderBy("cycle")
    sizes = sizes.withColumn("before", F.lag("cycle").over(by)).withColumn("m", F.lag("n").over(by))
    now = rows.join(sizes.select("concept", "cycle", "before"), ["concept", "cycle"])
    was = rows.select("concept", F.col("cycle").alias("before"), "member")
    common = now.join(was, ["concept", "before", "member"]).groupBy("concept", "cycle").agg(F.count("*").alias("both"))
    churn = F.expr("CASE WHEN m IS NULL THEN 0D ELSE 1D - coalesce(both, 0) / cast(n + m - coalesce(both, 0) as double) END")
    made = sizes.join(common, ["concept", "cycle"], "left").withColumn("churn", F.round(churn, 6))
    return made.select("concept", "cycle", "churn", F.round(F.sum("churn").over(by.rowsBetween(1 - window, 0)), 6).alias("drift5"))


def empty_runs(searches: DataFrame) -> DataFrame:
    """(user_id, event_id, empty_run): consecutive empty searches up to each one.

    Runs are counted inside a user's day. Where the day's searches up to one are all empty, those at the end of the days before are added,
    from one row for each user and day; no window holds all searches of a user.
    """
    inside = W.partitionBy("user_id", "day").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    rows = searches.select("user_id", "event_id", "ts", "empty", F.to_date("ts").alias("day")).withColumn("place", F.count("*").over(inside))
    hit = F.when(~F.col("empty"), F.col("place"))
    rows = rows.withColumn("hit", F.max(hit).over(inside))
    days = rows.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.max("hit").alias("last"))
    before = W.partitionBy("user_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    days = days.withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("mark", F.col("n_before") + F.col("last"))
    carried = days.select("user_id", "day", (F.col("n_before") - F.coalesce(F.last("mark", ignorenulls=True).over(before), F.lit(0))).alias("carried"))
    joined = rows.join(carried, ["user_id", "day"])
    run = F.col("place") - F.coalesce("hit", -F.col("carried"))
    return joined.select("user_id", "event_id", run.cast("long").alias("empty_run"))


def bursts(events: DataFrame, gap: str = "30 minutes", least: int = 3) -> DataFrame:
    """(user_id, start, n): sessions with gaps under `gap` and `least` events or more."""
    rows = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return rows.select("user_id", F.col("w.start").alias("start"), "n")


#: Mean distance of a concept's members from which it is tense.
TENSE = 0.4


def stats(records: DataFrame, edges: DataFrame, members: DataFrame, spread: DataFrame) -> DataFrame:
    """(section, name, value): the figures of a status report; each section is one aggregation, its figures are rows.

    records: (type, tier, deleted_at, confidence, processing_depth, has: whether it has a vector); edges: (weight, n); members: (concept, ...); spread: (tension) of each concept.
    """

    def section(rows: DataFrame, name: str, figures: dict) -> DataFrame:
        made = rows.agg(*(F.round(v.cast("double"), 6).alias(k) for k, v in figures.items()))
        return made.select(F.lit(name).alias("section"), F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("value")) for k in figures))).alias("f")).select("section", "f.*")

    def counted(column: str) -> DataFrame:
        return records.groupBy(F.col(column).alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit(column).alias("section"), "name", "value")

    total = F.count("*")
    out = section(records, "memories", {
        "total": total, "active": F.count_if(F.col("deleted_at").isNull()), "with_vectors": F.count_if("has"), "confidence": F.avg(F.coalesce("confidence", F.lit(0.5))),
        "maturity": F.avg(F.coalesce("processing_depth", F.lit(0.0))),
    })
    out = out.unionByName(counted("type")).unionByName(counted("tier"))
    out = out.unionByName(section(edges, "links", {"total": total, "weight": F.avg("weight"), "most": F.max("weight"), "retrievals": F.sum("n")}))
    n = F.count_distinct("concept")
    out = out.unionByName(section(members, "concepts", {"total": n, "size": F.try_divide(total, n)}))
    return out.unionByName(section(spread, "tension", {"concepts": F.count_if(F.col("tension") > TENSE), "mean": F.avg("tension"), "most": F.max("tension")}))
