"""Exact joins of vectors by cosine: bundles of blocks of near vectors, and of pairs of blocks only those that can hold a link.

1. At most PIVOTS centres of a bounded sample are the pivots. A vector belongs to its nearest pivot, and the vectors of a
   pivot are dealt to groups of at most about GROUP. In a group, shells of like distance from the pivot are halved again
   and again across their widest direction, down to blocks of BLOCK: what lies far from all pivots makes no other block wide.
2. A block keeps its centre and radius and, for each pivot, the least and the greatest distance of its vectors from it. By
   the triangle inequality two vectors lie at least as far apart as their distances from any one pivot differ, and as
   their blocks' centres less both radii. Unit vectors of cosine c lie sqrt(2 - 2c) apart: blocks further apart than that hold no link.
3. Groups are put together to about BUNDLES bundles, more if one would be over BUNDLE_BYTES. Pairs of bundles are judged by the
   limits of all their blocks; a bundle moves once for each that it meets. A task holds two bundles and multiplies
   those of their blocks that can hold a link, in single precision with room for its errors; what may be a link is computed again in double.

So a vector moves about BUNDLES times, whatever the number of links and blocks; links leave a task as they are found. No pair of blocks is missed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.staging import dropped, staged

SAMPLE, PIVOTS, GROUP, BLOCK = 4096, 64, 8192, 256
#: Vectors for a pivot, about: small tables have few.
PIVOT_ROWS = 64
#: Width of a shell.
SHELL = 0.25
#: Bundles that the vectors of a table make, about, and bytes of vectors that one may hold.
BUNDLES, BUNDLE_BYTES = 16, 1 << 25
#: Vectors of the other side in one product of matrices.
STEP = 16_384
#: Room for rounding of distances and of scores to six decimals.
SLACK = 1e-6
SCHEMA = "bundle int, part int, salt int, k int, n int, ids array<{id}>, tags array<{tag}>, data binary, near array<double>, far array<double>, centre array<double>, radius double"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, zero rows stay zero; scaled by their largest component first, so that squares neither overflow nor vanish."""
    x = x / np.maximum(np.abs(x).max(1, keepdims=True, initial=0), 1e-300)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centres(x: np.ndarray, k: int, steps: int = 5) -> np.ndarray:
    """At most k centres of the rows of x: starts drawn by their squared distance from those before, then means; the same rows give the same centres."""
    draw = np.random.Generator(np.random.PCG64(1))
    chosen, left = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)) and left.max() > 0:
        chosen.append(int(draw.choice(len(x), p=left / left.sum())))
        left = np.minimum(left, ((x - x[chosen[-1]]) ** 2).sum(1))
    out = x[chosen].copy()
    for _ in range(steps):
        near = distances(x, out).argmin(1)
        sums, n = np.zeros_like(out), np.bincount(near, minlength=len(out))
        np.add.at(sums, near, x)
        out[n > 0] = sums[n > 0] / n[n > 0, None]
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From each row of x to each pivot."""
    squares = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def halves(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of the rows of x in groups of at most `most`, halved across the direction between two far ends."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= most:
            out.append(own)
            continue
        rows = x[own]
        one = rows[((rows - rows.mean(0)) ** 2).sum(1).argmax()]
        along = rows @ (rows[((rows - one) ** 2).sum(1).argmax()] - one)
        order = np.argpartition(along, len(own) // 2)
        todo += [own[order[len(own) // 2 :]], own[order[: len(own) // 2]]]
    return out


def pivots_of(vectors: DataFrame, n: int, count: int) -> np.ndarray:
    """Pivots for `count` vectors (id, embedding) of n components: centres of the vectors whose ids hash lowest, at most SAMPLE."""
    rows = vectors.where(F.size("embedding") == n)
    sample = rows.select("embedding").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    k = min(PIVOTS, max(1, count // PIVOT_ROWS))
    return centres(unit(np.array([[c or 0.0 for c in r.embedding] for r in sample], float)), k)


def blocks(vectors: DataFrame, n: int, pivots: np.ndarray) -> DataFrame:
    """Vectors (id, embedding, tag) of n components as a written table of blocks, see SCHEMA: unit vectors, limits of their distances from each pivot."""
    kinds = dict(vectors.dtypes)
    rows = vectors.where(F.size("embedding") == n).select("id", "tag", F.transform(F.col("embedding").cast("array<double>"), lambda c: F.coalesce(c, F.lit(0.0))).alias("x"))

    @F.arrow_udf("int")
    def nearest(column: pa.Array) -> pa.Array:
        return pa.array(distances(unit(column.flatten().to_numpy().reshape(-1, n)), pivots).argmin(1), pa.int32())

    placed = staged(rows.withColumn("part", nearest("x")), "placed")
    sizes = {r.part: r["count"] for r in placed.groupBy("part").count().collect()}  # PIVOTS rows at most
    most = min(max(GROUP, sum(sizes.values()) // BUNDLES), max(1, BUNDLE_BYTES // (8 * n)))  # vectors of a bundle
    group = min(GROUP, most)
    salts, first, each, full = [], [], most // group, 0
    for k in range(len(pivots)):  # small parts share bundles, a large one has its own
        size = sizes.get(k, 0)
        salts.append(max(1, -(-size // group)))
        if not first:
            first.append(0)
        elif size <= group and full + size <= most:
            first.append(first[-1])
        else:
            first.append(first[-1] + -(-salts[k - 1] // each))
            full = 0
        full = full + size if size <= group else most
    dealt = placed.withColumn("salt", F.pmod(F.xxhash64("id"), F.get(F.lit(salts), F.col("part"))).cast("int"))
    dealt = dealt.withColumn("bundle", F.get(F.lit(first), F.col("part")) + F.floor(F.col("salt") / each).cast("int"))

    def packed(table: pa.Table) -> pa.Table:
        x = unit(table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, n))
        far = distances(x, pivots)
        shell = np.floor(far.min(1) / SHELL).astype(int)
        shells = [np.flatnonzero(shell == s) for s in np.unique(shell)]
        owns = [rows_of[part] for rows_of in shells for part in halves(x[rows_of], BLOCK)]
        order, ends = np.concatenate(owns), np.cumsum([0, *map(len, owns)])
        centre = [x[own].mean(0) for own in owns]
        made = {c: pa.array([table.column(c)[0].as_py()] * len(owns), pa.int32()) for c in ("bundle", "part", "salt")}
        made |= {"k": pa.array(range(len(owns)), pa.int32()), "n": pa.array([n] * len(owns), pa.int32())}
        made |= {to: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), table.column(c).combine_chunks().take(pa.array(order))) for to, c in (("ids", "id"), ("tags", "tag"))}
        made |= {"data": pa.array([x[own].tobytes() for own in owns], pa.binary())}
        made |= {c: pa.array([v.tolist() for v in values], pa.list_(pa.float64())) for c, values in (("near", [far[own].min(0) for own in owns]), ("far", [far[own].max(0) for own in owns]), ("centre", centre))}
        made |= {"radius": pa.array([float(np.sqrt(((x[own] - c) ** 2).sum(1).max())) for own, c in zip(owns, centre, strict=True)], pa.float64())}
        return pa.table(made)

    made = staged(dealt.groupBy("bundle", "part", "salt").applyInArrow(packed, SCHEMA.format(**kinds)), "blocks")
    dropped(placed)
    return made


def _apart(near: str, far: str, other_near: str, other_far: str, radius: float) -> F.Column:
    """Whether for some pivot the limits of two bundles differ by more than the radius."""
    gap = f"zip_with(zip_with({near}, {other_far}, (a, b) -> a - b), zip_with({other_near}, {far}, (a, b) -> a - b), (a, b) -> greatest(a, b))"
    return F.expr(f"exists({gap}, g -> g > {radius}D)")


def bundle_pairs(left: DataFrame, right: DataFrame, n_pivots: int, radius: float, same: bool) -> DataFrame:
    """(bundle, bundle_b) of the pairs of bundles that can hold vectors within the radius; same: each pair of bundles of one table once."""

    def limits(table):  # BUNDLES rows, or one for each BUNDLE_BYTES
        return table.groupBy("bundle").agg(*(F.array(*(f(F.col(c)[j]) for j in range(n_pivots))).alias(c) for c, f in (("near", F.min), ("far", F.max))))

    mine = limits(left)
    met = mine.crossJoin(limits(right).select(*(F.col(c).alias(f"{c}_b") for c in ("bundle", "near", "far")))).where(~_apart("near", "far", "near_b", "far_b", radius))
    return (met.where("bundle <= bundle_b") if same else met).select("bundle", "bundle_b")


class _Bundle:
    """The blocks of one side (a or b) of a task: their vectors, ids and tags one after the other, and their limits."""

    def __init__(self, table: pa.Table, side: str):
        column = lambda c: table.column(c).combine_chunks()
        matrix = lambda c: column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        self.ids, self.tags = column(f"ids_{side}").flatten(), column(f"tags_{side}").flatten()
        n = table.column("n")[0].as_py()
        self.x = np.frombuffer(b"".join(v.as_buffer() for v in column("data"))).reshape(-1, n)
        self.single = self.x.astype(np.float32)
        self.near, self.far, self.centre, self.radius = matrix("near"), matrix("far"), matrix("centre"), column("radius").to_numpy()
        self.sizes = column(f"ids_{side}").value_lengths().to_numpy()
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def meets(self, i: int, other: _Bundle, radius: float) -> np.ndarray:
        """Whether block i can hold vectors within the radius of vectors of each block of the other side."""
        gap = np.maximum((self.near[i] - other.far).max(1), (other.near - self.far[i]).max(1))
        between = np.sqrt(((self.centre[i] - other.centre) ** 2).sum(1)) - self.radius[i] - other.radius
        return (gap <= radius) & (between <= radius)


def linked(one: _Bundle, two: _Bundle, least: float, radius: float, same: bool):
    """Yields places (i, j) and cosines of the vectors of two bundles that are linked; same: one bundle with itself, each pair once."""
    n = one.x.shape[1]
    floor = np.float32(least - SLACK - 1e-5 - 1e-7 * n)
    for b in range(len(one.sizes)):
        alive = one.meets(b, two, radius)
        if same:
            alive[:b] = False
        at = np.flatnonzero(np.repeat(alive, two.sizes))
        rows = slice(one.starts[b], one.starts[b + 1])
        for a in range(0, len(at), STEP):
            some = at[a : a + STEP]
            whole = len(some) == some[-1] - some[0] + 1
            near = one.single[rows] @ (two.single[some[0] : some[-1] + 1] if whole else two.single[some]).T
            place = np.flatnonzero(near.ravel() >= floor)
            i, j = place // len(some) + rows.start, some[place % len(some)]
            if same:
                once = i < j
                i, j = i[once], j[once]
            for c in range(0, len(i), 65_536):
                m, k = i[c : c + 65_536], j[c : c + 65_536]
                score = np.round(np.einsum("ij,ij->i", one.x[m], two.x[k]), 6)
                hit = score >= least
                if hit.any():
                    yield m[hit], k[hit], score[hit]


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places of the links (i, j) that join trees of root, which is changed: what is linked then has one root, without a link more than that needs."""
    kept = []
    left = np.arange(len(i))
    while len(left):
        a, b = root[i[left]], root[j[left]]
        apart = a != b
        left, a, b = left[apart], a[apart], b[apart]
        high, first = np.unique(np.maximum(a, b), return_index=True)
        root[high] = np.minimum(a, b)[first]
        kept.append(left[first])
        while (root[root] != root).any():
            root[:] = root[root]
    return np.concatenate(kept) if kept else np.zeros(0, int)


def alike(left: DataFrame, right: DataFrame | None, least: float, counted: list | None = None, tag: str | None = None, forest: bool = False, most: int | None = None) -> DataFrame:
    """(a, b, similarity) of vectors (id, embedding) with a cosine of `least` or more, rounded to six decimals.

    right: None for pairs a <> b of one table, each once. Null vectors meet nothing, null components count as 0, vectors of different length
    don't meet. counted: gets (pairs of blocks compared, pairs of blocks in all) for each length. tag: a column of both
    sides that goes along with the vectors and is given as tag_a and tag_b. forest: of the links that a task finds only those
    that its components need, so that there are at most as many as vectors. most: of the pairs of a task those that can be
    among so many most alike ones, ties by the lesser id, then by the greater.

    The pairs aren't written here; the blocks that they are read from stay in the shared folder.
    """
    spark = left.sparkSession
    same = right is None
    wanted = lambda rows: rows.where("id IS NOT NULL AND embedding IS NOT NULL").select("id", "embedding", (F.col(tag) if tag else F.lit(None).cast("boolean")).alias("tag"))
    left = wanted(left)
    right = left if same else wanted(right)
    by_length = lambda rows: {r.n: r["count"] for r in rows.groupBy(F.size("embedding").alias("n")).count().collect() if r.n}
    counts = by_length(left)
    lengths = counts if same else counts.keys() & by_length(right).keys()
    radius = math.sqrt(max(0.0, 2 - 2 * (least - SLACK))) + SLACK
    kinds = [dict(rows.dtypes) for rows in (left, right)]
    schema = f"a {kinds[0]['id']}, b {kinds[1]['id']}, similarity double, tag_a {kinds[0]['tag']}, tag_b {kinds[1]['tag']}"
    columns = ["a", "b", "similarity", *(["tag_a", "tag_b"] if tag else [])]
    out = None
    for n in lengths:
        pivots = pivots_of(left, n, counts[n])
        one = blocks(left, n, pivots)
        two = one if same else blocks(right, n, pivots)
        met = staged(bundle_pairs(one, two, len(pivots), radius, same), "bundle_pairs")
        if counted is not None:
            meta = ["bundle", "part", "salt", "k", "near", "far", "centre", "radius"]
            both = met.join(one.select(*meta), "bundle").join(two.select(*(F.col(c).alias(f"{c}_b") for c in meta)), "bundle_b")
            between = F.expr("sqrt(aggregate(zip_with(centre, centre_b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))")
            both = both.where((between - F.col("radius") - F.col("radius_b") <= radius) & ~_apart("near", "far", "near_b", "far_b", radius))
            if same:
                both = both.where(F.struct("bundle", "part", "salt", "k") <= F.struct("bundle_b", "part_b", "salt_b", "k_b"))
            a, b = one.count(), two.count()
            counted.append((both.count(), a * (a + 1) // 2 if same else a * b))
        own = ["part", "salt", "k", "n", "data", "near", "far", "centre", "radius"]
        named = lambda side: [F.col(c).alias(f"{c}_{side}") for c in ("ids", "tags")]  # noqa: E731  # each side's own columns: a union would give both one type
        first = met.join(one.select("bundle", *own, *named("a")), "bundle").select("bundle", "bundle_b", F.lit(False).alias("second"), *own, "ids_a", "tags_a")
        second = met.join(two.select(F.col("bundle").alias("bundle_b"), *own, *named("b")), "bundle_b").select("bundle", "bundle_b", F.lit(True).alias("second"), *own, "ids_b", "tags_b")
        if same:  # a bundle meets itself: it moves once
            second = second.where("bundle < bundle_b")

        def compared(table: pa.Table) -> pa.Table:
            itself = same and table.column("bundle")[0].as_py() == table.column("bundle_b")[0].as_py()
            side = table.column("second").to_numpy()
            x = _Bundle(table.filter(pa.array(~side)), "a")
            y = x if itself else _Bundle(table.filter(pa.array(side)), "b")
            root = np.arange(len(x.x) + len(y.x)) if forest else None
            found = [[np.zeros(0, int), np.zeros(0, int), np.zeros(0)]]
            for i, j, score in linked(x, y, least, radius, itself):
                if forest:
                    kept = joined(root, i, j + (0 if itself else len(x.x)))
                    i, j, score = i[kept], j[kept], score[kept]
                found.append([i, j, score])
                if most is not None and sum(len(f[2]) for f in found) >= max(65_536, 4 * most):
                    found = [best(*map(np.concatenate, zip(*found, strict=True)), x, y)]
            i, j, score = map(np.concatenate, zip(*found, strict=True))
            if most is not None:
                i, j, score = best(i, j, score, x, y)
            arrays = [x.ids.take(pa.array(i)), y.ids.take(pa.array(j)), pa.array(score, pa.float64()), x.tags.take(pa.array(i)), y.tags.take(pa.array(j))]
            return pa.table(arrays, ["a", "b", "similarity", "tag_a", "tag_b"])

        def best(i, j, score, x, y):
            if len(score) > most:
                some = np.flatnonzero(score >= np.partition(score, -most)[-most])
                i, j, score = i[some], j[some], score[some]
                ids = [(min(p, q), max(p, q)) for p, q in zip(x.ids.take(pa.array(i)).to_pylist(), y.ids.take(pa.array(j)).to_pylist(), strict=True)]
                order = sorted(range(len(ids)), key=lambda k: (-score[k], ids[k]))[:most]
                i, j, score = i[order], j[order], score[order]
            return i, j, score

        found = first.unionByName(second, allowMissingColumns=True).groupBy("bundle", "bundle_b").applyInArrow(compared, schema).select(*columns)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema).select(*columns)
