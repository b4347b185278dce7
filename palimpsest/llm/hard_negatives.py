"""Hard negatives by dual-tree search, exact in its result.

1. A tree over the candidates and one over the anchors are fitted on bounded samples (SAMPLE rows whose ids hash
   lowest): every node is halved across its widest direction. All rows are placed in the trees' leaves, and the rows of
   a leaf in blocks of BLOCK (GROUP for anchors), which go on halving down to LEAF (FEW) rows.
2. Of a node with centre c and radius r, and one with centre a and radius s, all inner products lie within
   |a| r + |c| s + r s of a c. An anchor wants products inside a window; a node pair whose interval misses the windows of
   all anchors of its node is pruned, first between leaves of the fitted trees, so that no data move, then inside a pair of blocks.
3. What remains at the bottom is scored exactly, in whole numbers, from the highest intervals down, and the k-th
   best score so far raises the window's lower end.
4. A search runs twice: each block of anchors first meets the leaf that promises most, whose k-th best scores then
   prune the rest. An anchor's positives are such a search with one open window, its negatives one with a window for each positive.

A pair of blocks is one task's group, whatever the sizes of labels and leaves. A block pair gives at most k rows for an anchor's window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import dropped, staged

SAMPLE, MOST_LEAVES = 16_384, 1024
#: Candidates of a block and of its last nodes; the same of anchors.
BLOCK, LEAF, GROUP, FEW = 4096, 64, 512, 16
#: Last nodes that are scored before the windows are raised.
CHUNK = 4
SCALE, OPEN = 256, 1 << 62
FINE = "id IS NOT NULL AND label IS NOT NULL AND {0} IS NOT NULL AND forall({0}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"


def direction(x: np.ndarray) -> np.ndarray:
    """From one end of a set of points to the other, about: the point farthest from the mean, and the one farthest from that."""
    one = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
    return x[((x - one) ** 2).sum(1).argmax()] - one


class Tree:
    """The upper levels of a tree, halved `depth` times on a sample: directions and cuts of nodes in heap order, centres of leaves."""

    def __init__(self, x: np.ndarray, depth: int):
        self.depth, n = depth, x.shape[1]
        self.directions, self.cuts = np.zeros((2**depth - 1, n)), np.zeros(2**depth - 1)
        nodes = [x]
        for k in range(2**depth - 1):
            own = nodes[k]
            if len(own):
                self.directions[k] = direction(own)
                along = own @ self.directions[k]
                self.cuts[k] = np.median(along)
                nodes += [own[along <= self.cuts[k]], own[along > self.cuts[k]]]
            else:
                nodes += [own, own]
        self.centres = np.array([own.mean(0) if len(own) else np.zeros(n) for own in nodes[2**depth - 1 :]])

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + ((x * self.directions[at]).sum(1) > self.cuts[at])
        return at - (2**self.depth - 1)


def halved(n: int, depth: int) -> list[np.ndarray]:
    """Limits of the nodes of each level of n rows halved `depth` times."""
    out = [np.array([0, n])]
    for _ in range(depth):
        b = out[-1]
        out.append(np.sort(np.concatenate([b, (b[1:] + b[:-1]) // 2])))
    return out


def depth_of(n: int, leaf: int) -> int:
    """Halvings until nodes have at most `leaf` rows."""
    return max(0, int(np.ceil(np.log2(max(1, n) / leaf))))


def ordered(x: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the rows in which every node of `halved` is half of its parent along its widest direction."""
    order = np.arange(len(x))
    for b in halved(len(x), depth_of(len(x), leaf))[:-1]:
        for lo, hi in zip(b, b[1:], strict=False):
            own = x[order[lo:hi]]
            half = (lo + hi) // 2 - lo
            order[lo:hi] = order[lo:hi][np.argpartition(own @ direction(own), half)]
    return order


class Nodes:
    """Centres and radii of the nodes of each level of ordered rows."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.limits = halved(len(x), depth_of(len(x), leaf))
        self.centres, self.radii = [], []
        for b in self.limits:
            c = np.add.reduceat(x, b[:-1]) / np.diff(b)[:, None]
            far = np.sqrt(((x - np.repeat(c, np.diff(b), axis=0)) ** 2).sum(1))
            self.centres.append(c)
            self.radii.append(np.maximum.reduceat(far, b[:-1]))


def interval(a: np.ndarray, s: np.ndarray, c: np.ndarray, r: np.ndarray, dots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of nodes with centres a, c, radii s, r and products `dots` of the centres, with room for rounding."""
    la, lc = np.linalg.norm(a, axis=-1), np.linalg.norm(c, axis=-1)
    room = la * r + lc * s + s * r
    room = room + 1 + 1e-9 * (room + la * lc)
    return dots - room, dots + room


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; ValueError if one could leave 62 bits."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(x).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return np.rint(a.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if most >= OPEN:
        raise ValueError("inner products could leave 64 bits")
    return a @ x.T


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties by the least id."""
    some = np.arange(len(score))
    if len(some) > k:
        some = np.flatnonzero(score >= np.partition(score, -k)[-k])
    return some[np.lexsort((ids[some], -score[some]))][:k]


def met(anchors: dict, candidates: dict, k: int, same: bool) -> tuple[list, int]:
    """(anchor, window, id, score) of a pair of blocks: the k best candidates inside each window; and how many products were made.

    A block: id, label, x, and for anchors low and up (a column for each window). same: labels are equal, else different.
    """
    a, c = Nodes(anchors["x"], FEW), Nodes(candidates["x"], LEAF)
    low, up = anchors["low"].copy(), anchors["up"]
    wanted = low <= up
    floor, ceiling = np.where(wanted, low, OPEN).min(1), np.where(wanted, up, -OPEN).max(1)
    i, j, la, lc = np.zeros(1, int), np.zeros(1, int), 0, 0
    while True:
        ca, cc = a.centres[la][i], c.centres[lc][j]
        least, most = interval(ca, a.radii[la][i], cc, c.radii[lc][j], np.einsum("ij,ij->i", ca, cc))
        b = a.limits[la]
        lows, ups = np.minimum.reduceat(floor, b[:-1]), np.maximum.reduceat(ceiling, b[:-1])
        kept = (most >= lows[i]) & (least <= ups[i])
        i, j, most = i[kept], j[kept], most[kept]
        if la < len(a.limits) - 1:
            la, i, j = la + 1, np.concatenate([2 * i, 2 * i + 1]), np.concatenate([j, j])
        if lc < len(c.limits) - 1:
            lc, i, j = lc + 1, np.concatenate([i, i]), np.concatenate([2 * j, 2 * j + 1])
        elif la == len(a.limits) - 1 and len(most) == len(i):
            break
    rows, made = [], 0
    for node in np.unique(i):
        lo, hi = a.limits[-1][node : node + 2]
        mine = np.flatnonzero(i == node)
        mine = mine[np.argsort(-most[mine], kind="stable")]
        found: dict = {}
        for at in range(0, len(mine), CHUNK):
            part = mine[at : at + CHUNK]
            part = part[most[part] >= floor[lo:hi].min()]
            if not len(part):
                break
            some = np.concatenate([np.arange(*c.limits[-1][n : n + 2]) for n in j[part]])
            score = products(anchors["x"][lo:hi], candidates["x"][some])
            made += score.size
            right = (candidates["label"][some][None] == anchors["label"][lo:hi, None]) == same
            right &= candidates["id"][some][None] != anchors["id"][lo:hi, None]
            for q, w in zip(*np.nonzero(wanted[lo:hi]), strict=True):
                own = score[q]
                hit = np.flatnonzero(right[q] & (own >= low[lo + q, w]) & (own <= up[lo + q, w]))
                if not len(hit):
                    continue
                s, d = own[hit], candidates["id"][some[hit]]
                if (q, w) in found:
                    s, d = np.concatenate([found[q, w][0], s]), np.concatenate([found[q, w][1], d])
                top = best(s, d, k)
                found[q, w] = s[top], d[top]
                if len(top) == k:
                    low[lo + q, w] = s[top[-1]]
            floor[lo:hi] = np.where(wanted[lo:hi], low[lo:hi], OPEN).min(1)
        rows += [(int(anchors["id"][lo + q]), int(w), int(d), int(s)) for (q, w), (ss, ds) in found.items() for s, d in zip(ss, ds, strict=True)]
    return rows, made


def _fitted(rows: DataFrame, size: int) -> Tree | None:
    """A tree over rows (id, x), with about one leaf for `size` rows, fitted on SAMPLE of them at most."""
    n = rows.count()
    sample = rows.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    leaves = min(MOST_LEAVES, max(1, n // size), max(1, len(sample) // 16))
    return Tree(np.array([r.x for r in sample], float), int(np.log2(leaves))) if sample else None


def _matrix(column, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), n)


BLOCKS = "node int, part int, n int, ids binary, labels binary, x binary, low binary, up binary, radius double, centre binary"


def _blocks(rows: DataFrame, tree: Tree, n: int, size: int, leaf: int) -> DataFrame:
    """Rows (id, label, x, low, up) as blocks in the order of their nodes. radius: from the centre of the block's leaf of the tree, which is `centre`."""
    sent = rows.sparkSession.sparkContext.broadcast(tree)

    @F.arrow_udf("int")
    def placed(x: pa.Array) -> pa.Array:
        return pa.array(sent.value.place(_matrix(x, n)), pa.int32())

    rows = staged(rows.withColumn("node", placed("x")), "placed")
    counts = {r.node: r.n for r in rows.groupBy("node").agg(F.count("*").alias("n")).collect()}  # MOST_LEAVES at most
    cuts = F.lit([-(-counts.get(k, 0) // size) or 1 for k in range(2**tree.depth)])
    rows_in = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.get(cuts, F.col("node"))).cast("int"))

    def packed(table: pa.Table) -> pa.Table:
        node, part = table.column("node")[0].as_py(), table.column("part")[0].as_py()
        x = _matrix(table.column("x"), n)
        order = ordered(x.astype(float), leaf)
        low, up = (np.array(table.column(c).to_pylist(), np.int64).reshape(len(x), -1)[order] for c in ("low", "up"))
        centre = sent.value.centres[node]
        row = {"node": node, "part": part, "n": len(x), "radius": float(np.sqrt(((x - centre) ** 2).sum(1).max())), "x": x[order].astype("<i8").tobytes(), "centre": centre.astype("<f8").tobytes()}
        row |= {name: table.column(c).to_numpy()[order].astype("<i8").tobytes() for name, c in (("ids", "id"), ("labels", "label"))}
        row |= {"low": low.astype("<i8").tobytes(), "up": up.astype("<i8").tobytes()}
        return pa.table({k: pa.array([v], t) for k, v, t in ((name, row[name], kind) for name, kind in KINDS)})

    made = staged(rows_in.groupBy("node", "part").applyInArrow(packed, BLOCKS), "blocks")
    dropped(rows)
    sent.destroy()
    return made


KINDS = [(name, {"int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}[kind]) for name, kind in (f.split() for f in BLOCKS.split(", "))]


def _unpacked(row: dict) -> dict:
    x, low, up = (np.frombuffer(row[c], "<i8").reshape(row["n"], -1) for c in ("x", "low", "up"))
    return {"x": x, "low": low, "up": up, "id": np.frombuffer(row["ids"], "<i8"), "label": np.frombuffer(row["labels"], "<i8")}


def _leaves(blocks: DataFrame) -> list:
    """(node, parts, radius, centre) of each leaf of the tree; MOST_LEAVES rows at most."""
    return blocks.groupBy("node").agg(F.max("part").alias("parts"), F.max("radius").alias("radius"), F.first("centre").alias("centre")).orderBy("node").collect()


def search(anchors: DataFrame, tree: Tree, candidates: DataFrame, n: int, k: int, same: bool) -> DataFrame:
    """(anchor, window, id, score): of anchors (id, label, x, low, up) the k best candidates (blocks) in each window, ties by the least id.

    low, up: the windows' ends, each a list. tree: the anchors' tree.
    """
    spark = anchors.sparkSession
    leaves = spark.sparkContext.broadcast([(r.node, r.parts, r.radius, np.frombuffer(r.centre)) for r in _leaves(candidates)])
    found, asking = None, anchors
    for first in (True, False):
        groups = _blocks(asking, tree, n, GROUP, FEW)

        @F.arrow_udf("array<struct<node:int,part:int>>")
        def reached(centre: pa.Array, radius: pa.Array, lows: pa.Array, ups: pa.Array) -> pa.Array:
            node, parts, far, at = (np.array(c) for c in zip(*leaves.value, strict=True))
            out = []
            for c, r, low, up in zip(centre, radius, lows, ups, strict=True):
                c, low, up = np.frombuffer(c.as_py()), np.frombuffer(low.as_py(), "<i8"), np.frombuffer(up.as_py(), "<i8")
                dots = at @ c
                least, most = interval(np.broadcast_to(c, at.shape), np.full(len(at), r.as_py()), at, far, dots)
                some = low <= up
                kept = np.arange(len(at)) == most.argmax()
                if not first:
                    kept = ~kept & (most >= low[some].min(initial=OPEN)) & (least <= up[some].max(initial=-OPEN))
                out.append([{"node": int(node[i]), "part": p} for i in np.flatnonzero(kept) for p in range(parts[i] + 1)])
            return pa.array(out, pa.list_(pa.struct([("node", pa.int32()), ("part", pa.int32())])))

        asked = groups.select(F.col("node").alias("anode"), F.col("part").alias("apart"), F.explode(reached("centre", "radius", "low", "up")).alias("to"))
        pairs = staged(asked.select("anode", "apart", "to.*"), "pairs")
        data = ["n", "ids", "labels", "x", "low", "up"]
        left = pairs.join(candidates.select("node", "part", *data), ["node", "part"]).select("anode", "apart", "node", "part", F.lit(False).alias("asks"), *data)
        right = pairs.join(groups.select(F.col("node").alias("anode"), F.col("part").alias("apart"), *data), ["anode", "apart"]).select("anode", "apart", "node", "part", F.lit(True).alias("asks"), *data)

        def compared(table: pa.Table) -> pa.Table:
            ends = {r["asks"]: _unpacked(r) for r in table.to_pylist()}
            rows, _ = met(ends[True], ends[False], k, same)
            return pa.table([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["anchor", "window", "id", "score"])

        made = staged(left.unionByName(right).groupBy("anode", "apart", "node", "part").applyInArrow(compared, "anchor long, window int, id long, score long"), "found")
        dropped(pairs, groups)
        found = made if found is None else found.unionByName(made)
        if first:  # the k-th best score is the least that can still count
            order = W.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
            least = made.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("least"))
            raised = F.transform("low", lambda v, w: F.greatest(v, F.coalesce(F.element_at("least", w), v)))
            asking = anchors.join(least, F.col("id") == F.col("anchor"), "left").withColumn("low", F.when(F.col("least").isNull(), F.col("low")).otherwise(raised)).select(*anchors.columns)
    order = W.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def negatives(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, up: int = 90, noisy: int = 7, classes: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the best rows of other labels between low and up per cent of a positive's score.

    Rows with a null key, label or vector, or null or non-finite components, take no part. Components become floor(256 x), scores are
    inner products of them; ties go to the smaller key. Where the key is divisible by `noisy` (0: nowhere), the label is the next of
    `classes`. Anchors are the rows whose key is divisible by `every`; an anchor's positives are its first other rows of its label.
    Only vectors of the commonest length (of equally common ones the longest) are compared, the others take no part. Rows that repeat a key count as one,
    the least by label and components. Products that could leave 64 bits raise ValueError. An empty table gives an empty result.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(FINE.format("v"))
    if noisy:
        rows = rows.withColumn("label", F.expr(f"CASE WHEN id % {noisy} = 0 THEN (label + 1) % {classes} ELSE label END"))
    whole = rows.select("id", "label", F.expr(f"transform(v, x -> floor({SCALE}D * x))").alias("x")).groupBy("id").agg(F.min(F.struct("label", "x")).alias("m"))
    whole = staged(whole.select("id", "m.label", "m.x"), "vectors")
    common = whole.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    n = common.n if common else 0
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    whole = whole.where(F.size("x") == n)
    asking = whole.where(F.col("id") % every == 0)
    open_, shut = F.array(F.lit(-OPEN)), F.array(F.lit(OPEN))
    tree = _fitted(asking, GROUP)
    if not n or tree is None:
        return df.sparkSession.createDataFrame([], out)
    nothing = F.array().cast("array<bigint>")
    candidates = _blocks(whole.select("id", "label", "x", nothing.alias("low"), nothing.alias("up")), _fitted(whole, BLOCK), n, BLOCK, LEAF)
    own = staged(search(asking.select("id", "label", "x", open_.alias("low"), shut.alias("up")), tree, candidates, n, positives, True).select("anchor", "rank", F.col("id").alias("positive"), "score"), "positives")
    # The window of each positive, in the order of its rank; whole numbers: low * p <= 100 s <= up * p.
    ends = own.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p"))
    ceil, floor = f"-((-{low} * x.score - pmod(-{low} * x.score, 100)) div 100)", f"({up} * x.score - pmod({up} * x.score, 100)) div 100"
    windows = ends.select(F.col("anchor").alias("id"), *(F.expr(f"transform(p, x -> {e})").alias(name) for name, e in (("low", ceil), ("up", floor))))
    # Anchors with fewer positives get windows that nothing fits.
    padded = [F.concat(name, F.array_repeat(F.lit(v).cast("long"), F.lit(positives) - F.size(name))).alias(name) for name, v in (("low", 1), ("up", 0))]
    asked = staged(asking.join(windows, "id").select("id", "label", "x", *padded), "asked")
    made = search(asked, tree, candidates, n, negatives, False)
    mine = own.select("anchor", (F.col("rank") - 1).alias("window"), "positive", F.col("score").alias("positive_score"))
    return made.join(mine, ["anchor", "window"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("positive_score"), F.col("score").alias("negative_score"),
    )


NEGATIVES_SQL = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other))::INTEGER AS rank, other AS negative_id,
  positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
