"""Near-duplicate vectors by product quantisation, exact in its result.

1. Coarse centroids of unit length and, for their residuals, one codebook for each of SUBSPACES
   parts are fitted on a bounded sample (SAMPLE vectors whose ids hash lowest). All vectors are indexed.
2. A vector is in the inverted list of its nearest centroid; its residual is kept as codes with the
   length of the rounding error.
3. Two unit vectors of cosine c lie sqrt(2 - 2c) =: r apart. A list can hold such a neighbour of x
   only if x is within r of the plane that halves the way between the two centroids, so exactly
   those lists are probed: probes suffice for every link, none is lost.
4. In a list, a table of distances from the query to all codes gives the distance to each rounded
   vector; if it exceeds r by more than the rounding error, the pair is out. The rest is judged by
   the cosine in double precision.

A list of one label is cut into blocks of BLOCK rows and BLOCK queries, so no task holds a whole label. A
block gives counts and a spanning star of each of its components, not its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import dropped, staged
from palimpsest.llm.components import components

SAMPLE, SUBSPACES, CODES, STEPS = 16_384, 8, 64, 8
#: Inverted lists at least and at most (a sixteenth of the sample), and rows of a list between.
LEAST_LISTS, MOST_LISTS, LIST_ROWS = 32, 1024, 4096
BLOCK, CHUNK, AT_ONCE = 1024, 64, 1024
SLACK = 1e-5


def k_means(x: np.ndarray, k: int, unit: bool) -> np.ndarray:
    """At most k centres of the rows of x, of unit length if wanted."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(STEPS):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        some = n > 0
        centres[some] = sums[some] / n[some, None]
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (((centres**2).sum(1) / 2)[None, :] - x @ centres.T).argmin(1)


class Index:
    """Centroids and codebooks of vectors of one length."""

    def __init__(self, x: np.ndarray, lists: int = LEAST_LISTS):
        self.centres = np.unique(k_means(x, lists, True), axis=0)
        residuals = x - self.centres[_nearest(x, self.centres)]
        self.cuts = [c for c in np.array_split(np.arange(x.shape[1]), SUBSPACES) if len(c)]
        self.books = [k_means(residuals[:, c], CODES, False) for c in self.cuts]
        # Distances of the centres, from their products: lists times lists numbers, made once.
        self.gaps = np.sqrt(np.maximum(0, 2 - 2 * self.centres @ self.centres.T))

    def encode(self, x: np.ndarray, radius: float):
        """Own list, probed lists, codes and rounding error of each unit vector; AT_ONCE of them are compared with all centres at once."""
        some = [self._encoded(x[a : a + AT_ONCE], radius) for a in range(0, len(x), AT_ONCE)]
        own, probes, codes, error = zip(*some, strict=True)
        return np.concatenate(own), [p for part in probes for p in part], np.concatenate(codes), np.concatenate(error)

    def _encoded(self, x: np.ndarray, radius: float):
        dots = x @ self.centres.T
        own = _nearest(x, self.centres)
        ahead = (dots[np.arange(len(x)), own][:, None] - dots) <= (radius + SLACK) * self.gaps[own] + SLACK
        residuals = x - self.centres[own]
        codes = np.stack([_nearest(residuals[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)
        rounded = np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], axis=1)
        return own, [np.flatnonzero(a).tolist() for a in ahead], codes, np.linalg.norm(residuals - rounded, axis=1)

    def distances(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """From each query to each rounded vector of the list, by table look-up."""
        residuals = x - self.centres[cell]
        out = np.zeros((len(x), len(codes)))
        for k, (c, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            part = residuals[:, c]
            table = (part**2).sum(1)[:, None] + (book**2).sum(1)[None] - 2 * part @ book.T
            out += table[:, codes[:, k]]
        return np.sqrt(np.maximum(out, 0))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least vertex of each component of n vertices with edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_vectors(df: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of df: key, n_links, component_id, kept.

    Vectors of one label are linked if their cosine is `least` or more. Null, zero and empty vectors, those
    with null or non-finite components, null labels and null keys have no links. Vectors of different
    length are not compared. Rows that repeat a key count as one vector (the least by label and
    components). Other columns of df are not read; an empty table gives an empty result.
    """
    spark, radius = df.sparkSession, math.sqrt(max(0.0, 2 - 2 * least))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    fine = "id IS NOT NULL AND label IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)"
    valid = rows.where(fine).groupBy("id").agg(F.min(F.struct("label", "v")).alias("m")).select("id", "m.label", "m.v")
    sample = valid.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    by_length: dict[int, list] = {}
    for r in sample:
        by_length.setdefault(len(r.v), []).append(r.v)
    lists = min(MOST_LISTS, max(LEAST_LISTS, valid.count() // LIST_ROWS))
    indexes = spark.sparkContext.broadcast({n: Index(_unit(np.array(v)), lists) for n, v in by_length.items()})

    @F.arrow_udf("struct<n:int,cell:int,probes:array<int>,codes:binary,error:double,v:binary>")
    def encoded(vectors: pa.Array) -> pa.Array:
        values = [np.array(v.as_py()) for v in vectors]
        out: list = [None] * len(values)
        for n in {len(v) for v in values}:
            at = [i for i, v in enumerate(values) if len(v) == n]
            x = _unit(np.stack([values[i] for i in at]))
            index = indexes.value.get(n)
            made = index.encode(x, radius) if index else (np.zeros(len(x), int), [[0]] * len(x), np.zeros((len(x), 0), np.uint8), np.zeros(len(x)))
            for i, cell, probes, codes, error in zip(at, *made, strict=True):
                out[i] = {"n": n, "cell": int(cell), "probes": probes, "codes": codes.tobytes(), "error": float(error), "v": values[i].astype("<f8" if (values[i].astype("<f4") != values[i]).any() else "<f4").tobytes()}
        return pa.array(out, pa.struct([("n", pa.int32()), ("cell", pa.int32()), ("probes", pa.list_(pa.int32())), ("codes", pa.binary()), ("error", pa.float64()), ("v", pa.binary())]))

    codes = staged(valid.select("id", "label", encoded("v").alias("e")).select("id", "label", "e.*"), "codes")
    group = ["label", "n", "cell"]
    queries = codes.select("id", "label", "n", F.explode("probes").alias("cell"), "v")
    sizes = codes.groupBy(*group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("base_cuts"))
    asked = queries.groupBy(*group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("query_cuts"))
    cuts = staged(sizes.join(asked, group), "cuts")

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(f"{own}_cuts")).cast("int")
        return side.join(cuts, group).withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_cuts") - 1)))

    base = dealt(codes.select("id", *group, "codes", "error", "v"), "base", "query").select(*group, "base", "query", "id", "codes", "error", "v")
    asks = dealt(queries, "query", "base").select(*group, "base", "query", "id", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"), "v")

    def linked(block: pa.Table) -> pa.Table:
        n, cell = block.column("n")[0].as_py(), block.column("cell")[0].as_py()
        is_base = np.array(block.column("error").is_valid())
        ids = block.column("id").to_numpy()
        raw = block.column("v").to_pylist()
        x = np.stack([np.frombuffer(v, "<f4" if len(v) == 4 * n else "<f8").astype(np.float64) for v in raw])
        unit = _unit(x)
        at_base, at_query = np.flatnonzero(is_base), np.flatnonzero(~is_base)
        if not len(at_base) or not len(at_query):
            return pa.table([pa.array([], pa.int64())] * 3, ["id", "root", "n_links"])
        index = indexes.value.get(n)
        code = np.frombuffer(b"".join(block.column("codes").take(pa.array(at_base)).to_pylist()), np.uint8).reshape(len(at_base), -1)
        error = block.column("error").to_numpy()[at_base]
        ends: list = []
        for a in range(0, len(at_query), CHUNK):
            some = at_query[a : a + CHUNK]
            if index:
                near = index.distances(unit[some], cell, code) <= radius + error[None] + SLACK
            else:
                near = np.ones((len(some), len(at_base)), bool)
            near &= ids[some][:, None] != ids[at_base][None]
            q, b = np.nonzero(near)
            q, b = some[q], at_base[b]
            hit = np.einsum("ij,ij->i", unit[q], unit[b]) >= least
            ends.append((q[hit], b[hit]))
        q, b = (np.concatenate(e) for e in zip(*ends, strict=True))
        order = np.argsort(ids, kind="stable")  # the least id of a component is its root
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        roots = _roots(len(ids), place[q], place[b])
        met = np.unique(np.concatenate([q, b]))
        n_links = np.bincount(q, minlength=len(ids))
        return pa.table([pa.array(ids[met]), pa.array(ids[order][roots[place[met]]]), pa.array(n_links[met])], ["id", "root", "n_links"])

    stars = staged(base.unionByName(asks).groupBy(*group, "base", "query").applyInArrow(linked, "id long, root long, n_links long"), "stars")
    counts = stars.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    roots = components(stars.select(F.col("id").alias("a"), F.col("root").alias("b")))
    found = staged(counts.join(roots, "id").select("id", "n_links", "root"), "linked")
    indexes.destroy()
    dropped(codes, cuts, stars)
    out = rows.select("id").join(found, "id", "left")
    out = out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by their largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
