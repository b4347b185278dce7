"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows are put in a seeded random order within their stratum, each gets its fractional rank
(rank - 1/2) / size of the stratum, the whole table is ordered by that, and the order is cut
into equal runs: every shard then has each stratum in the mixture's proportion, and row counts
differ by one at most.

No global sort and no window over a whole stratum: ranks are counted in two steps. Rows are
dealt to cells (stratum, range of the hash), a cell's rows are ranked alone, and the number of
rows in the cells before it is added. The same holds for the order by fractional rank. A stratum
with a third of all rows is spread over all ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that one cell of a rank is meant to hold; the number of ranges follows from it.
CELL_ROWS = 20_000
#: Ranges at least, so that small tables spread over many tasks too.
LEAST_RANGES = 1024
#: Ranges whose rows are summed up before one task orders the sums: 80 million rows a sum.
RUN = 4096


def stratified_shards(df: DataFrame, n_shards: int, stratum: str = "source", key: str = "doc_id", text: str = "text", seed: int = 42) -> DataFrame:
    """One row per row of df: key, size, text_crc32, law, shard, slot, grown_shard, stratum.

    size: UTF-8 bytes of the text plus 1 (null text: 1). text_crc32: of the UTF-8 bytes, 0 for null.
    The law `rows` is about single rows: equal texts are spread over shards and slots like any others.
    Nulls are a stratum of their own, null keys sort first. Rows alike in all of key, stratum and
    text are interchangeable, so the result is the same whatever order they are read in.
    An empty table gives an empty result. Other columns of df are not read.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    ranges = max(LEAST_RANGES, df.count() // CELL_ROWS)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("doc_id"),
        F.col(stratum).cast("string").alias("stratum"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    ).withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    # The first 8 hex digits: an unsigned 32-bit number, so a range of it follows the order of h.
    rows = rows.withColumn("cell", F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * ranges, 32))

    cells = rows.groupBy("stratum", "cell").agg(F.count("*").alias("n"))
    by_stratum = W.partitionBy("stratum")
    before = by_stratum.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(
        F.col("stratum").alias("stratum_"), F.col("cell").alias("cell_"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.sum("n").over(by_stratum).alias("stratum_rows"),
    )
    in_cell = W.partitionBy("stratum", "cell").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("r", F.row_number().over(in_cell)).join(cells, F.col("stratum").eqNullSafe(F.col("stratum_")) & (F.col("cell") == F.col("cell_")))
    # (2r - 1) / 2n, exactly comparable: both sides are whole numbers below 2^53.
    ranked = ranked.select(
        "doc_id", "stratum", "size", "text_crc32", "h",
        ((2 * (F.col("rows_before") + F.col("r")) - 1).cast("double") / (2 * F.col("stratum_rows")).cast("double")).alias("f"),
    ).withColumn("span", F.floor(F.col("f") * ranges).cast("long"))

    # Rows before each range in two steps: of the runs of RUN ranges (few rows), then inside a run.
    spans = ranked.groupBy("span").agg(F.count("*").alias("n")).withColumn("run", F.floor(F.col("span") / RUN))
    order = W.orderBy("run")
    runs = spans.groupBy("run").agg(F.sum("n").alias("n")).select(
        F.col("run").alias("run_"),
        F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("run_before"),
        F.sum("n").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("all_rows"),
    )
    inside = W.partitionBy("run").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(runs, F.col("run") == F.col("run_"))
    spans = spans.select(F.col("span").alias("span_"), (F.col("run_before") + F.col("inside")).alias("rows_before"), "all_rows")
    in_span = W.partitionBy("span").orderBy("f", "h", "stratum", "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("r", F.row_number().over(in_span)).join(spans, F.col("span") == F.col("span_"))
    at = F.col("rows_before") + F.col("r") - 1  # 0-based place in the whole order
    # Whole numbers only: the shard s begins at the least place p with p * n_shards >= s * all_rows.
    placed = placed.withColumn("at", at).withColumn("shard", F.expr(f"(at * {n_shards}) div all_rows"))
    begin = F.expr(f"(shard * all_rows + {n_shards - 1}) div {n_shards}")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("at") - begin).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("stratum"),
    )


#: crc32 has no function in DuckDB, so the SQL gives it from a table of the 256 byte steps.
SHARDING_SQL = """
WITH RECURSIVE steps(b, k, c) AS (
  SELECT range, 0, range::UBIGINT FROM range(256)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
bytes AS (
  SELECT doc_id, source, coalesce(text, '') AS body FROM documents
), crcs AS (
  SELECT body, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, strlen(body)), lambda i: ('0x' || substr(hex(encode(body)), 2 * i + 1, 2))::UBIGINT)),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS crc
  FROM (SELECT DISTINCT body FROM bytes), crc_table
), hashed AS (
  SELECT doc_id, source AS stratum, strlen(body) + 1 AS size, crc AS text_crc32, md5('42:' || doc_id) AS h
  FROM bytes JOIN crcs USING (body)
), ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id, text_crc32, size) - 1)::DOUBLE
            / (2 * count(*) OVER (PARTITION BY stratum))::DOUBLE AS f
  FROM hashed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY f, h, stratum, doc_id, text_crc32, size) - 1 AS place, count(*) OVER () AS n FROM ranked
), cut AS (SELECT *, (place * 16) // n AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard::INTEGER AS shard,
       (place - (shard * n + 15) // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard, stratum
FROM cut
"""
