"""Near-duplicates of texts: one-permutation hashing, bands, star-shaped candidate edges.

1. A document's shingles are hashed once each. The hash picks one of BINS bins, every bin keeps
   its least value, an empty bin copies a filled one picked by a fixed random walk of its own
   (optimal densification), so all bins agree between two sets with the chance of their similarity.
   A byte of each bin is kept: 384 bytes a document.
2. Documents with equal shingle sets are one class; only the least document of a class goes on.
3. ROWS bins make a band, equal bands a bucket. In a bucket one member is the centre and only edges
   to it are candidates: at most one for each member. The centre is the member that comes first in
   one random order of all documents, so the buckets of a group of copies have few centres among
   them, and the group's candidates collapse to a few for each member. A task makes the stars of its
   own documents first and passes on only their centres: a bucket with a third of all documents
   costs one entry a task. Candidates are confirmed on the full sets, stored once for each member.
4. Stars connect most copies but prove nothing about the rest: a member has met only the centres. So
   at last all pairs of a bucket that are still in different components are compared, those outside
   its largest component with all its members, in blocks of bounded size. A pair is compared only
   in the first bucket it shares, if its sizes allow the similarity and its bins don't rule it out
   (DEVIATIONS standard deviations below it). First blocks of bins find the members that have
   such a pair; only their full sets are shipped. A block gives a spanning forest of its links.
   After this no pair that shares a bucket is open.

Chance that two sets of similarity 0.85 share none of the 48 bands: (1 - 0.85^8)^48 = 2e-7.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import dropped, free_name, parts_for, released, short_list, staged
from palimpsest.llm.components import components, merged
from palimpsest.llm.hashing import mix, packed, pieces, powers, unpacked, words_of

BANDS, ROWS = 48, 8
BINS = BANDS * ROWS
EMPTY = np.uint64(2**64 - 1)
#: Tries of an empty bin before it takes the first filled one.
TRIES = 64 * BINS
BLOCKS = 2
HELD = 1 << 19
BLOCK = "part int, known boolean, block binary"
#: Bucket entries that one task joins, and bytes of sets that one task compares, at about.
JOINED, COMPARED = 1 << 20, 1 << 25
#: Members outside a bucket's largest component, and members, that are compared at once; bytes of their sets.
OUTSIDE, MEMBERS, SET_BYTES = 256, 512, 1 << 23
DEVIATIONS = 7
#: Pairs whose sets are compared before what they connected is taken out.
AT_ONCE = 32


def shingle_sets(texts: pa.Array, words: int):
    """For each piece of a batch: (first text, end, owner of each shingle, distinct shingle hashes by owner).

    Texts are lower-cased (A to Z). With fewer words than a shingle the whole sequence is one.
    """
    for a, b in pieces(texts):
        w, first = words_of(texts.slice(a, b - a), lower=True)
        count = np.diff(first)
        owner = np.repeat(np.arange(b - a), count)
        left = np.repeat(first[1:], count) - np.arange(len(w))  # words from here to the end of the text
        short = np.repeat(count, count) < words
        hashes = np.zeros_like(w)
        factor = powers(np.uint64(0xD6E8FEB86659FD93), words)
        for j in range(words):
            reach = left > j
            at = np.flatnonzero(reach)
            hashes[at] += w[at + j] * factor[j]
        is_first = left == np.repeat(count, count)
        whole = (left >= words) | (short & is_first)
        hashes, owner = mix(hashes[whole]), owner[whole]
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        yield a, b, owner[new], hashes[new]


def signatures(n: int, owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """n rows of BINS values; a row without shingles has EMPTY everywhere."""
    sig = np.full((n, BINS), EMPTY, np.uint64)
    np.minimum.at(sig, (owner, (hashes % np.uint64(BINS)).astype(np.int64)), mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(1))
    some = (sig != EMPTY).any(1)
    row, bin_ = np.nonzero((sig == EMPTY) & some[:, None])
    filled = sig.copy()
    turn = 0
    while len(row):
        turn += 1
        source = (mix(bin_.astype(np.uint64) * np.uint64(1000003) + np.uint64(turn)) % np.uint64(BINS)).astype(np.int64)
        if turn > TRIES:
            source = (sig[row] != EMPTY).argmax(1)
        value = sig[row, source]
        found = value != EMPTY
        filled[row[found], bin_[found]] = value[found]
        row, bin_ = row[~found], bin_[~found]
    return filled


def band_keys(sig: np.ndarray) -> np.ndarray:
    """BANDS bucket keys for each row of bytes (BINS of them); keys of different bands differ."""
    parts = np.ascontiguousarray(sig).view("<u8")
    return mix(parts + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def sketched(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null if it is empty) and sig (a byte of each bin) of each row."""

    @F.arrow_udf("struct<n_shingles:bigint,digest:binary,sig:binary>")
    def sketch(texts: pa.Array) -> pa.Array:
        counts, digests, sigs = [], [], []
        for a, b, owner, hashes in shingle_sets(texts, words):
            n = np.bincount(owner, minlength=b - a)
            ends = np.cumsum(n)
            sig = (signatures(b - a, owner, hashes) & np.uint64(255)).astype(np.uint8)
            for i, (size, end) in enumerate(zip(n.tolist(), ends.tolist(), strict=True)):
                counts.append(size)
                digests.append(hashlib.blake2b(hashes[end - size : end].tobytes(), digest_size=16).digest() if size else None)
                sigs.append(sig[i].tobytes() if size else None)
        released()
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["n_shingles", "digest", "sig"])

    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), sketch(F.col(f"`{text}`")).alias("s")).select("doc_id", "s.*")


def set_column(words: int):
    """An Arrow function: the sorted distinct shingle hashes of a text, as bytes."""

    @F.arrow_udf("binary")
    def shingles(given: pa.Array) -> pa.Array:
        out = []
        for a, b, owner, hashes in shingle_sets(given, words):
            out += [s.tobytes() for s in np.split(hashes, np.cumsum(np.bincount(owner, minlength=b - a))[:-1])]
        released()
        return pa.array(out, pa.binary())

    return shingles


def _stars(keys: np.ndarray, ids: np.ndarray):
    """Members sorted by bucket, whether each is the first of its bucket, and the place of its bucket's centre."""
    order = np.lexsort((ids, mix(ids.astype(np.uint64)), keys))
    keys, ids = keys[order], ids[order]
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    return keys, ids, head, np.flatnonzero(head)[np.cumsum(head) - 1]


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct pairs (least, greatest) of two columns; equal ids are no pair."""
    some = a != b
    return np.unique(np.stack([np.minimum(a, b)[some], np.maximum(a, b)[some]]), axis=1)


def candidates(classes: DataFrame) -> DataFrame:
    """Edges (a, b) of the stars of all buckets of classes (id, sig)."""
    spark = classes.sparkSession
    parts = max(BLOCKS * parts_for(spark), classes.count() * BANDS // JOINED)

    def rows(where: np.ndarray, known: bool, columns: list[np.ndarray]):
        order = np.argsort(where, kind="stable")
        where, columns = where[order], [c[order] for c in columns]
        edges = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(where)]
        made = [(int(where[a]), known, packed(*(c[a:b] for c in columns))) for a, b in zip(edges, edges[1:], strict=False) if b > a]
        columns = [pa.array([r[0] for r in made], pa.int32()), pa.array([known] * len(made), pa.bool_()), pa.array([r[2] for r in made], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["part", "known", "block"])

    def sent(batches):
        held, size = [], 0

        def flush():
            nonlocal held, size
            ids, keys = (np.concatenate(c) for c in zip(*held, strict=True))
            held, size = [], 0
            keys, ids, head, centre = _stars(keys.reshape(-1), np.repeat(ids, BANDS))
            yield rows((keys[head] % np.uint64(parts)).astype(np.int64), False, [keys[head], ids[head]])
            a, b = _pairs(ids, ids[centre])
            if len(a):
                yield rows((mix(a.astype(np.uint64)) % np.uint64(parts)).astype(np.int64), True, [a, b])

        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, BINS)
            held.append((batch.column(0).to_numpy(zero_copy_only=False), band_keys(sig)))
            size += len(sig) * BANDS
            if size >= HELD:
                yield from flush()
        if held:
            yield from flush()
        released()

    def joined(table: pa.Table) -> pa.Table:
        heads, found = [], [np.zeros((2, 0), np.int64)]
        for known, block in zip(table.column("known").to_pylist(), table.column("block"), strict=True):
            if known:
                found.append(np.stack(unpacked(block.as_py(), "i8", "i8")))
            else:
                heads.append(unpacked(block.as_py(), "u8", "i8"))
        if heads:
            _, ids, _, centre = _stars(*(np.concatenate(c) for c in zip(*heads, strict=True)))
            found.append(_pairs(ids, ids[centre]))
        a, b = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.table([pa.array(a), pa.array(b)], ["a", "b"])

    blocks = classes.select("id", "sig").mapInArrow(sent, BLOCK)
    return blocks.groupBy("part").applyInArrow(joined, "a long, b long").distinct()


def common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Number of values that a sorted set has in common with each of the others (distinct values each)."""
    ends = np.cumsum([len(s) for s in others])
    values = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, values), len(one) - 1)
    return np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(one[at] == values)])[ends]]))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets (id, set) that have 100 |A and B| >= percent |A or B|."""

    @F.arrow_udf("boolean")
    def alike(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = int(common(x, [y])[0])
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    left, right = (sets.select(F.col("id").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").where(alike("set_a", "set_b")).select("a", "b").distinct()


def possible(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, band: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) in x and y, and common bins, of the pairs that `band` is the first shared one of and that may be alike.

    x, y: bytes of bins; nx, ny: sizes of the sets. The sizes rule a pair out surely, the bins almost surely.
    """
    kx, ky = np.ascontiguousarray(x).view("<u8"), np.ascontiguousarray(y).view("<u8")
    earlier = np.zeros((len(x), len(y)), bool)
    for k in range(band):
        earlier |= kx[:, k][:, None] == ky[:, k][None]
    low, high = np.minimum(nx[:, None], ny[None]), np.maximum(nx[:, None], ny[None])
    i, j = np.nonzero(~earlier & (100 * low >= percent * high))
    least = percent / 100
    bins = np.concatenate([np.zeros(0, np.int64), *((x[i[a : a + 8192]] == y[j[a : a + 8192]]).sum(1) for a in range(0, len(i), 8192))])
    # A set of n values fills BINS (1 - exp(-n / BINS)) bins; copies of filled ones say nothing new.
    samples = BINS * -np.expm1(-low[i, j] / BINS) / 2
    keep = bins / BINS >= least - DEVIATIONS * np.sqrt(least * (1 - least) / samples)
    return i[keep], j[keep], bins[keep]


def open_links(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect all that is alike among classes (id, comp, n, sig): every pair of different comp in a bucket is settled."""
    spark = classes.sparkSession
    least_parts = BLOCKS * parts_for(spark)

    def spread(batches):
        for batch in batches:
            ids, comps, n = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), BANDS) for i in range(3))
            sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, BINS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), len(sig))
            keys = band_keys(sig).reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys, band, ids, comps, n)], ["key", "band", "id", "comp", "n"])

    def blocks_of(table: pa.Table):
        """Rows of each block, those outside the main component and all."""
        key, xblock, yblock, outside = (table.column(c).to_numpy() for c in ("key", "xblock", "yblock", "outside"))
        order = np.lexsort((table.column("id").to_numpy(), outside, yblock, xblock, key))
        new = np.zeros(len(order), bool)
        for c in (key, xblock, yblock):
            new[1:] |= c[order][1:] != c[order][:-1]
        for group in np.split(order, np.flatnonzero(new)):
            x, y = group[outside[group]], group[~outside[group]]
            if len(x) and len(y):
                yield x, y

    def columns(table: pa.Table):
        ids, comps, n, band = (table.column(c).to_numpy() for c in ("id", "comp", "n", "band"))
        return ids, comps, n, band, np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, BINS)

    def needed(table: pa.Table) -> pa.Table:
        _, comps, n, band, sig = columns(table)
        rows = [np.zeros(0, np.int64)]
        for x, y in blocks_of(table):
            i, j, _ = possible(sig[x], sig[y], n[x], n[y], int(band[x[0]]), percent)
            some = comps[x[i]] != comps[y[j]]
            rows += [x[np.unique(i[some])], y[np.unique(j[some])]]
        return table.select(["key", "band", "xblock", "yblock", "outside", "id", "comp", "n"]).take(pa.array(np.concatenate(rows)))

    def compared(table: pa.Table) -> pa.Table:
        ids, comps, n, band, sig = columns(table)
        data = table.column("set")
        links = []
        for x, y in blocks_of(table):
            i, j, bins = possible(sig[x], sig[y], n[x], n[y], int(band[x[0]]), percent)
            root: dict[int, int] = {}

            def end(c, root=root):
                while c in root:
                    c = root[c]
                return c

            of_y = {k: np.frombuffer(data[int(y[k])].as_py(), np.uint64) for k in np.unique(j).tolist()}
            order = np.lexsort((-bins, i))
            i, j = i[order], j[order]
            for group in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1):
                if not len(group):
                    continue
                me = int(x[i[group[0]]])
                own = np.frombuffer(data[me].as_py(), np.uint64)
                for a in range(0, len(group), AT_ONCE):
                    some = [k for k in j[group[a : a + AT_ONCE]].tolist() if end(int(comps[y[k]])) != end(int(comps[me]))]
                    if not some:
                        continue
                    both = common(own, [of_y[k] for k in some])
                    total = len(own) + np.array([len(of_y[k]) for k in some]) - both
                    for k in np.flatnonzero(100 * both >= percent * total).tolist():
                        p, q = end(int(comps[me])), end(int(comps[y[some[k]]]))
                        if p != q:
                            root[max(p, q)] = min(p, q)
                            links.append((ids[me], ids[y[some[k]]]))
        made = np.array(links, np.int64).reshape(-1, 2)
        released()
        return pa.table([pa.array(made.min(1)), pa.array(made.max(1))], ["a", "b"])

    member = "key long, band int, id long, comp long, n long"
    members = staged(classes.select("id", "comp", "n", "sig").mapInArrow(spread, member), "members")
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    mixed = sizes.groupBy("key").agg(
        F.max(F.struct("m", "comp", "n")).alias("main"), F.sum("m").alias("m"), F.sum("n").alias("n"), F.count("*").alias("comps")
    ).where("comps > 1")

    def cuts(m, n, most):
        """Blocks of at most so many members, and of about SET_BYTES of sets."""
        return F.greatest(F.ceil(m / F.lit(most)), F.ceil(8 * n / F.lit(SET_BYTES)))

    outer = cuts(F.col("m") - F.col("main.m"), F.col("n") - F.col("main.n"), OUTSIDE)
    blocks = staged(mixed.select("key", F.col("main.comp").alias("main"), outer.alias("nx"), cuts(F.col("m"), F.col("n"), MEMBERS).alias("ny")), "mixed")
    rows = staged(members.join(blocks, "key"), "open")
    row = ["key", "band", "id", "comp", "n"]
    every = rows.select(*row, F.lit(False).alias("outside"), F.explode(F.expr("sequence(0L, nx - 1)")).alias("xblock"), F.expr("pmod(xxhash64(id), ny)").alias("yblock"))
    outside = rows.where("comp <> main").select(
        *row, F.lit(True).alias("outside"), F.expr("pmod(xxhash64(id, key), nx)").alias("xblock"), F.explode(F.expr("sequence(0L, ny - 1)")).alias("yblock")
    )
    placed = staged(every.unionByName(outside), "placed")

    def grouped(table: DataFrame, values: DataFrame, bytes_each: str):
        total = table.agg(F.expr(f"sum({bytes_each})")).first()[0] or 0
        parts = max(least_parts, total // COMPARED)
        return table.withColumn("part", F.expr(f"pmod(xxhash64(key, xblock, yblock), {parts})")).join(values, "id").groupBy("part")

    sig = classes.select("id", "sig")
    some = staged(grouped(placed, sig, f"{BINS + 64}").applyInArrow(needed, "key long, band int, xblock long, yblock long, outside boolean, id long, comp long, n long"), "needed")
    found = staged(grouped(some, sig.join(sets, "id"), f"8 * n + {BINS + 64}").applyInArrow(compared, "a long, b long").distinct(), "open_links")
    dropped(members, blocks, rows, placed, some)
    return found


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id, kept.

    Documents are linked if the sets of their `words`-word shingles have a Jaccard similarity of
    percent / 100 or more; a component is what links connect, kept its document with the least id.
    Empty and null texts have no shingles and no links. A row without a key has no links, component_id null
    and is kept. Rows that repeat a key with the same text give the same result each; rows that repeat it with
    other texts are judged each by its own text. Other columns of df are not read; an empty table gives an
    empty result.
    """
    docs = staged(sketched(df, key, text, words), "sketches")
    full = docs.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    least = full.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("m"))
    classes = staged(least.select("digest", F.col("m.doc_id").alias("id"), F.col("m.n_shingles").alias("n"), F.col("m.sig").alias("sig")), "classes")
    edges = staged(candidates(classes), "candidates")
    met = staged(edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct(), "met")
    texts = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).join(short_list(met), "id", "left_semi")
    texts = texts.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))  # the others' sets are empty
    sets = staged(texts.select("id", set_column(words)("text").alias("set")), "all_sets")
    every, sets = sets, staged(sets.withColumn("h", F.xxhash64("set")).dropDuplicates(["id", "h"]).drop("h"), "sets")
    links = staged(confirmed(edges, sets, percent), "links")
    roots = components(links)
    now = classes.join(met, "id", "left_semi").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("comp"), "n", "sig")
    apart = staged(now, "apart")
    more = open_links(apart, sets, percent)
    roots = merged(roots, more)
    by_class = staged(classes.select("digest", "id").join(roots, "id", "left").select("digest", F.coalesce("root", "id").alias("component_id")), "by_class")
    dropped(classes, edges, met, every, sets, links, apart, more)
    # A class may hold a third of all rows: both sides come from tables, so Spark can split it.
    out = docs.select("doc_id", "n_shingles", "digest").join(by_class, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(df: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df of which near_duplicates keeps the document, all columns as they were.

    Rows that repeat both key and text stay once, rows that repeat a key with another text stay each; rows
    without a key all stay.
    """
    mine = free_name(df, "_own")
    judged = near_duplicates(df, words, percent, key, text).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(mine))
    found = staged(judged.agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1"), "found")
    gone, often = (staged(found.where(w).select(mine), name) for w, name in (("NOT kept", "gone"), ("kept AND n > 1", "often")))
    rows = df.withColumn(mine, F.col(f"`{key}`").cast("long")).join(short_list(gone), mine, "left_anti")
    if not often.isEmpty():
        repeated = rows.join(short_list(often), mine, "left_semi").dropDuplicates([mine, text])
        rows = rows.join(short_list(often), mine, "left_anti").unionByName(repeated)
    return rows.drop(mine)
