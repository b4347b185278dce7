"""Vector codes by product quantisation in whole numbers; the nearest entry is found by exponion search.

1. Components become floor(256 x). A vector is cut into PARTS equal parts, each with a codebook of at most
   ENTRIES entries, which starts as that part of the vectors with the least ids.
2. A part's search starts at its entry of the round before, at squared distance d. Every entry that is as near or
   nearer lies within twice that distance of the start, so only the entries of the start's list of neighbours, sorted
   by distance, whose squared distance is 4 d or less are looked at. All distances are whole numbers: the radius is
   sufficient without any tolerance, and ties go to the lower index.
3. A task sums up its parts by entry, Spark adds the sums, and the driver gets one row for each number of a codebook.

Codes are written with the rows after each round, so that a lost executor costs one round, and the next
starts where the last ended. What the driver and every task hold is the codebooks, whose size doesn't grow with the table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import dropped, short_list, staged

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Scale of components, and squared length from which a sum of squared distances could leave 64 bits.
SCALE, MOST = 256, 1 << 61
FINE = "{0} IS NOT NULL AND forall({0}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"


class Book:
    """A codebook of whole numbers, with the sorted list of neighbours of each entry."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = ((entries[:, None] - entries[None]) ** 2).sum(2)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        self.line = np.argsort(entries[:, 0], kind="stable") if entries.shape[1] else np.arange(len(entries))

    def guess(self, x: np.ndarray) -> np.ndarray:
        """An entry to start from where none is known: one with a near first component."""
        if not x.shape[1]:
            return np.zeros(len(x), np.int64)
        return self.line[np.minimum(np.searchsorted(self.entries[self.line, 0], x[:, 0]), len(self.line) - 1)]

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of x, the least entry of equally near ones, searched from `start` on."""
        best = ((x - self.entries[start]) ** 2).sum(1)
        reach = np.empty(len(x), np.int64)
        by_start = np.argsort(start, kind="stable")
        ends = np.searchsorted(start[by_start], np.arange(len(self.entries) + 1))
        for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            rows = by_start[a:b]
            reach[rows] = np.searchsorted(self.apart[k], 4 * best[rows], side="right")
        # Rows with the longest lists first: those still looking are always a prefix.
        order = np.argsort(-reach, kind="stable")
        x, start, best, at = x[order], start[order], best[order], start[order].copy()
        looking = np.searchsorted(-reach[order], -np.arange(len(self.entries)), side="left")
        for j in range(len(self.entries)):
            m = looking[j]
            if not m:
                break
            c = self.order[start[:m], j]
            d = ((x[:m] - self.entries[c]) ** 2).sum(1)
            less = (d < best[:m]) | ((d == best[:m]) & (c < at[:m]))
            best[:m][less], at[:m][less] = d[less], c[less]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return at[back], best[back]


def _matrices(column: pa.Array):
    """(length, places, matrix) of the vectors of each length in a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    begins = column.offsets.to_numpy()[:-1] - column.offsets[0].as_py()
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield int(n), at, flat[begins[at][:, None] + np.arange(n)[None]].astype(np.int64)


def _assigned(rows: DataFrame, books, parts: int) -> DataFrame:
    """rows (id, label, x, code) with new codes and error (the sum of squared distances)."""

    def coded(batches):
        for batch in batches:
            xs, old = batch.column("x"), batch.column("code")
            codes: list = [None] * len(xs)
            errors = np.zeros(len(xs), np.int64)
            for n, at, x in _matrices(xs):
                book, d = books.value[n], n // parts
                before = np.frombuffer(b"".join(old.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), parts).astype(np.int64) if old.null_count == 0 else None
                code = np.empty((len(at), parts), np.uint8)
                for p in range(parts):
                    part = x[:, p * d : (p + 1) * d]
                    code[:, p], far = book[p].nearest(part, book[p].guess(part) if before is None else before[:, p])
                    errors[at] += far
                for i, c in zip(at.tolist(), code, strict=True):
                    codes[i] = c.tobytes()
            made = [batch.column("id"), batch.column("label"), xs, pa.array(codes, pa.binary()), pa.array(errors, pa.int64())]
            yield pa.RecordBatch.from_arrays(made, ["id", "label", "x", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.select("id", "label", "x", "code").mapInArrow(coded, f"id {kinds['id']}, label {kinds['label']}, x array<bigint>, code binary, error bigint")


def _sums(rows: DataFrame, parts: int, entries: int) -> list:
    """Rows (n, place, total, times): for vectors of n components, the sum of the numbers that meet at a place of its codebooks (part, entry, component)."""

    def summed(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, at, x in _matrices(batch.column("x")):
                code = np.frombuffer(b"".join(batch.column("code").take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), parts).astype(np.int64)
                d = n // parts
                own = totals.setdefault(n, np.zeros((2, parts, entries, d), np.int64))
                for p in range(parts):
                    np.add.at(own[0, p], code[:, p], x[:, p * d : (p + 1) * d])
                    own[1, p] += np.bincount(code[:, p], minlength=entries)[:, None]
        for n, own in totals.items():
            total, count = own.reshape(2, -1)
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), n)), pa.array(some), pa.array(total[some]), pa.array(count[some])], ["n", "place", "total", "times"])

    made = rows.select("x", "code").mapInArrow(summed, "n long, place long, total long, times long")
    return made.groupBy("n", "place").agg(F.sum("total").alias("total"), F.sum("times").alias("times")).collect()  # one row a number of the codebooks


def compressed(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of df whose vector is whole: key, code, error, label_error, codebooks_sha256.

    Rows whose vector is null, or has null or non-finite components, are left out. Vectors of another length
    have codebooks of their own. A length that doesn't divide into `parts` equal parts has null codes, errors and
    digest. Rows that repeat a key each count; the codebooks start from one row of a key, the least vector. Null keys
    count but start no codebook; a length with null keys only starts from its least vectors. Components so large that
    squared distances could leave 64 bits raise ValueError (of 64 components: those from 741,455 on). Other columns of df are not read; an empty table gives an empty result.
    """
    if entries > 256:
        raise ValueError("an index has two hexadecimal digits")
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(FINE.format("v"))
    most = rows.select(F.max(F.array_max(F.transform("v", F.abs))).alias("x"), F.max(F.size("v")).alias("n")).first()
    if SCALE * (most.x or 0) + 1 >= (MOST / max(1, most.n or 0)) ** 0.5:
        raise ValueError(f"components of up to {most.x}: squared distances could leave 64 bits")
    whole = staged(rows.select("id", "label", F.expr(f"transform(v, x -> floor({SCALE}D * x))").alias("x"), F.lit(None).cast("binary").alias("code")), "vectors")
    even = whole.where(f"size(x) % {parts} = 0")
    firsts = even.groupBy(F.size("x").alias("n"), "id").agg(F.min("x").alias("x"))
    lengths = [r.n for r in even.select(F.size("x").alias("n")).distinct().collect()]
    books: dict[int, list[np.ndarray]] = {}
    for n in lengths:
        own = firsts.where(F.col("n") == n)
        least = own.where("id IS NOT NULL").orderBy("id").limit(entries).collect() or own.collect()
        x = np.array([r.x for r in least], np.int64).reshape(len(least), n)
        books[n] = [x[:, p * (n // parts) : (p + 1) * (n // parts)].copy() for p in range(parts)]
    spark, now = df.sparkSession, even
    for turn in range(rounds + 1):
        sent = spark.sparkContext.broadcast({n: [Book(b) for b in own] for n, own in books.items()})
        coded = staged(_assigned(now, sent, parts), "codes")
        if turn:
            dropped(now)
        now = coded
        if turn < rounds:
            for r in _sums(now, parts, entries):
                p, rest = divmod(r.place, entries * (r.n // parts))
                e, j = divmod(rest, r.n // parts)
                books[r.n][p][e, j] = r.total // r.times  # rounds down
        sent.destroy()
    digests = {n: hashlib.sha256(",".join(str(c) for b in own for c in b.ravel().tolist()).encode()).hexdigest() for n, own in books.items()}
    by_label = now.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    by_label = staged(by_label, "labels")
    digest = F.lit(None).cast("string")
    for n, d in digests.items():
        digest = F.when(F.size("x") == n, d).otherwise(digest)
    out = now.join(short_list(by_label), F.col("label").eqNullSafe(F.col("_label")), "left")
    out = out.select(F.col("id").alias(key), F.lower(F.hex("code")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))
    odd = whole.where(f"size(x) % {parts} <> 0")
    nothing = F.lit(None)
    return out.unionByName(odd.select(F.col("id").alias(key), nothing.cast("string").alias("code"), nothing.cast("long").alias("error"), nothing.cast("long").alias("label_error"), nothing.cast("string").alias("codebooks_sha256")))


CODES_SQL = """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), parts AS (
  SELECT vec_id, p, j, v[p * (len(v) // 16) + j + 1] AS x FROM kept, range(16) a(p), range(1024) b(j) WHERE j < len(v) // 16
), firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 64),
book0 AS (SELECT p, e, j, x AS c FROM parts JOIN firsts USING (vec_id)),
""" + ",\n".join(
    f"""far{r} AS (SELECT vec_id, p, e, sum((x - c) * (x - c)) AS d FROM parts JOIN book{r} USING (p, j) GROUP BY 1, 2, 3),
code{r} AS (SELECT vec_id, p, e, d FROM far{r} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)"""
    + (f""",
mean{r} AS (SELECT p, e, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS c FROM code{r} JOIN parts USING (vec_id, p) GROUP BY 1, 2, 3),
book{r + 1} AS (SELECT p, e, j, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m USING (p, e, j))""" if r < ROUNDS else "")
    for r in range(ROUNDS + 1)
) + """,
digest AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM book2),
coded AS (SELECT vec_id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM code2 GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest
"""
