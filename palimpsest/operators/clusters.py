"""Clusters of vectors as concepts: making, matching, merging and splitting them, and their history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.analysis import centroids
from palimpsest.operators.components import components, merged
from palimpsest.operators.retrieval import cosine, semantic_pairs
from palimpsest.operators.vector_join import alike

# Likeness that links two vectors, members of a cluster, likeness of a centroid that is the same concept, of two that are merged.
LINK, LEAST_MEMBERS, SAME, MERGE = 0.70, 5, 0.70, 0.90
# Members and mean distance from which a cluster is flagged for a split.
SPLIT_MEMBERS, SPLIT_DISTANCE = 10, 0.40
# Alerts by centroid drift, loss of cohesion, churn, and drift summed over five cycles.
RAPID, COHESION, EXODUS, IDENTITY, CYCLES = 0.3, -0.2, 0.5, 0.5, 5


def clusters(vectors: DataFrame, least: float = LINK, members: int = LEAST_MEMBERS) -> DataFrame:
    """(id, cluster, size) of vectors (id, embedding): connected components of likeness `least`, those of `members` or more; cluster is the least id.

    All vectors take part: a spanning forest of the links of each task, components in rounds over those, neither on the driver.
    """
    return members_of(extended(None, None, vectors, least), members)


def extended(labels: DataFrame | None, old: DataFrame | None, new: DataFrame, least: float = LINK) -> DataFrame:
    """(id, root): components after vectors new (id, embedding) are added to old ones, whose components are labels (None: there are none).

    New vectors meet each other and the old ones, old ones don't meet again; the old components that a link joins are merged.
    """
    links = semantic_pairs(new, least, forest=True).select("a", "b")
    if labels is None or old is None:
        return components(links)
    return merged(labels, links.unionByName(alike(new, old, least, forest=True).select("a", "b")))


def members_of(labels: DataFrame, members: int = LEAST_MEMBERS) -> DataFrame:
    """(id, cluster, size) of the components (id, root) with `members` or more."""
    sizes = labels.groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") >= members)
    return labels.join(sizes, "root").select("id", F.col("root").alias("cluster"), "size")


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (id, root) of after that before doesn't have: the memberships to be rewritten."""
    return after.select("id", "root").join(before.select("id", F.col("root").alias("was")), "id", "left").where("was IS NULL OR was <> root").select("id", "root")


def matched(found: DataFrame, known: DataFrame, least: float = SAME) -> DataFrame:
    """(cluster, concept) of found and known (concept, centroid) nodes: the most alike known concept of likeness `least` or more, else null (a new one)."""
    best = assigned(found.select(F.col("concept").alias("id"), F.col("centroid").alias("embedding")), known, least)
    return found.select(F.col("concept").alias("cluster")).join(best.select(F.col("id").alias("cluster"), "concept"), "cluster", "left")


def merges(nodes: DataFrame, least: float = MERGE) -> DataFrame:
    """(concept, into): a concept goes into the least one that it is alike to (`least` or more) and that stays itself.

    Chains are followed to their ends, so that no concept goes into one that is merged too.
    """
    pairs = semantic_pairs(nodes.select(F.col("concept").alias("id"), F.col("centroid").alias("embedding")), least, forest=True)
    return components(pairs.select("a", "b")).where("id <> root").select(F.col("id").alias("concept"), F.col("root").alias("into"))


def mean_distance(vectors: DataFrame) -> DataFrame:
    """(concept, n, distance): mean of 1 - cosine over all pairs of a concept's vectors.

    From the sum of unit vectors alone: of n unit vectors with the sum s, the mean cosine of pairs is (|s|^2 - n) / (n (n - 1)).
    """
    size = "sqrt(aggregate(embedding, 0D, (s, x) -> s + cast(x as double) * cast(x as double)))"
    units = vectors.where(f"embedding IS NOT NULL AND {size} > 0").selectExpr("concept", "id", f"transform(embedding, x -> cast(x as double) / {size}) AS u")
    sums = units.select("concept", F.posexplode("u").alias("p", "x")).groupBy("concept", "p").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    total = sums.groupBy("concept").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n")).where("n > 1")
    return total.select("concept", "n", (1 - (F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("distance"))


def splits(vectors: DataFrame, members: int = SPLIT_MEMBERS, distance: float = SPLIT_DISTANCE) -> DataFrame:
    """(concept, n, distance) of the concepts with more than `members` members that lie further apart than `distance`."""
    return mean_distance(vectors).where((F.col("n") > members) & (F.col("n") >= 4) & (F.col("distance") > distance))


def assigned(vectors: DataFrame, nodes: DataFrame, least: float = SAME) -> DataFrame:
    """(id, concept, likeness): the nearest concept of each vector, the least of equally near ones, if it is alike by `least` or more.

    An exact join of blocks of vectors and blocks of centroids, however many nodes there are.
    """
    near = alike(vectors.select("id", "embedding"), nodes.select(F.col("concept").alias("id"), F.col("centroid").alias("embedding")), least)
    near = near.select(F.col("a").alias("id"), F.col("b").alias("concept"), F.col("similarity").alias("likeness"))
    best = near.groupBy("id").agg(F.min_by(F.struct("concept", "likeness"), F.struct(-F.col("likeness"), "concept")).alias("b"))
    return best.select("id", "b.concept", "b.likeness")


def snapshots(vectors: DataFrame) -> DataFrame:
    """(concept, cycle, centroid, n, cohesion) of vectors (concept, cycle, id, embedding): one row for each concept and cycle."""
    keyed = vectors.withColumn("both", F.struct("concept", "cycle"))
    made = centroids(keyed.select(F.col("both").alias("concept"), "embedding"))
    apart = mean_distance(keyed.select(F.col("both").alias("concept"), "id", "embedding"))
    return made.join(apart.select("concept", (1 - F.col("distance")).alias("cohesion")), "concept", "left").select("concept.*", "centroid", F.col("size").alias("n"), "cohesion")


def history(made: DataFrame, keep: int | None = None) -> DataFrame:
    """Snapshots with drift (1 - cosine to the centroid before; 1 if lengths differ; 0 for the first) and cohesion_delta; the `keep` newest of each concept."""
    by = W.partitionBy("concept").orderBy("cycle")
    rows = made.withColumn("before", F.lag("centroid").over(by)).withColumn("was", F.lag("cohesion").over(by))
    drift = F.when(F.col("before").isNull(), 0.0).when(F.size("before") != F.size("centroid"), 1.0).otherwise(1 - cosine("centroid", "before"))
    rows = rows.select("concept", "cycle", "n", F.round("cohesion", 6).alias("cohesion"), F.round(drift, 6).alias("drift"), F.round(F.coalesce(F.col("cohesion") - F.col("was"), F.lit(0.0)), 6).alias("cohesion_delta"))
    if keep is None:
        return rows
    newest = W.partitionBy("concept").orderBy(F.desc("cycle"))
    return rows.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= keep).drop("r")


def alerts(rows: DataFrame) -> DataFrame:
    """(concept, cycle, alert, value, threshold) of history rows with churn: each rule that a cycle breaks is a row."""
    by = W.partitionBy("concept").orderBy("cycle").rowsBetween(1 - CYCLES, 0)
    rows = rows.withColumn("total", F.round(F.sum("drift").over(by), 6))
    rules = (("rapid_drift", "drift", RAPID, F.col("drift") >= RAPID), ("cohesion_loss", "cohesion_delta", COHESION, F.col("cohesion_delta") <= COHESION),
             ("member_exodus", "churn", EXODUS, F.col("churn") >= EXODUS), ("identity_shift", "total", IDENTITY, F.col("total") >= IDENTITY))
    found = F.array(*(F.when(hit, F.struct(F.lit(name).alias("alert"), F.col(value).alias("value"), F.lit(least).alias("threshold"))) for name, value, least, hit in rules))
    return rows.select("concept", "cycle", F.explode(F.array_compact(found)).alias("a")).select("concept", "cycle", "a.*")


def named(memberships: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, concepts): names and probabilities of each record's concepts, the most probable first; names are null for unknown ones."""
    rows = memberships.join(nodes.select("concept", "name"), "concept", "left")
    return (
        rows.groupBy("id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("probability")).alias("p"), "concept", "name"))), lambda s: F.struct(s["name"].alias("name"), (-s["p"]).alias("probability"))).alias("concepts"))
    )


def without_orphans(memberships: DataFrame, nodes: DataFrame) -> DataFrame:
    """Memberships whose concept is still there."""
    return memberships.join(nodes.select("concept"), "concept", "left_semi")


def phase(hours_since_deep: float | None, contradiction_ratio: float, run: int) -> str:
    """What the next cycle does: deep after a day, or never, or with many contradictions; else every third run medium; else light."""
    if hours_since_deep is None or hours_since_deep >= 24 or contradiction_ratio >= 0.05:
        return "deep"
    return "medium" if run % 3 == 0 else "light"
