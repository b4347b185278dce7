"""Document fingerprints by winnowing, with DataFrame and SQL functions only.

1. A text's tokens are its runs of letters, marks and digits in lower case, and each other character that isn't
   white space, also each Chinese and Japanese character, as no spaces stand between their words.
2. A gram is GRAM tokens in a row. Its hash is the cyclic polynomial of the tokens' hashes: the next one follows from
   it by a rotation and the exchange of two tokens. A text with fewer tokens is one gram.
3. Of each WINDOW grams in a row the least is chosen, of equal ones the rightmost. What is chosen, with its
   place, is the fingerprint. Two texts that share WINDOW + GRAM - 1 tokens in a row share a chosen gram of them.
   A text with few grams has smaller windows, which choose all that a larger one would choose and more.
4. Likeness is the Jaccard similarity of the chosen hashes.

A gram's order in a window is one 64-bit number: the first 34 bits of its hash, then its place, counted
downwards, so that one minimum settles both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import staged

GRAM, WINDOW = 3, 8
#: A window has at most so many of a text's grams: one in LEAST_GRAMS. Windows are WINDOW halved until they fit.
LEAST_GRAMS = 8
#: Places that a text may have.
PLACES = 1 << 30
TOKEN = r"[\p{L}\p{M}\p{N}&&[^぀-ヿ㐀-鿿豈-﫿]]+|[^\x20\x09-\x0D]"
#: Rows that a cell of neighbouring keys is meant to hold, cells at least and at most.
CELL_ROWS, LEAST_CELLS, MOST_CELLS = 20_000, 1024, 4096
LEAST_ID = -(1 << 63)


def _bound(value: str, name: str, body: str) -> str:
    """SQL of body in which name stands for value, which is made once for a row."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _turned(value: str, bits: int) -> str:
    """SQL of a 64-bit number turned to the left."""
    return f"(shiftleft({value}, {bits}) | shiftrightunsigned({value}, {64 - bits}))" if bits else value


def fingerprint(text: str, gram: int = GRAM, window: int = WINDOW) -> Column:
    """struct<hashes: array<bigint>, places: array<int>> of a text column: the chosen grams in the order of their places (0-based, in tokens).

    A null text has null, a text without tokens empty arrays.
    """
    tokens = f"transform(regexp_extract_all(lower({text}), '{TOKEN.replace(chr(92), chr(92) * 2)}', 0), w -> xxhash64(w))"
    rolled = " ^ ".join(_turned(f"get(t, i + {j})", gram - 1 - j) for j in range(gram))
    grams = f"""CASE WHEN size(t) = 0 THEN array() WHEN size(t) < {gram} THEN array(aggregate(t, 0L, (h, x) -> {_turned('h', 1)} ^ x))
      ELSE transform(sequence(0, size(t) - {gram}), i -> {rolled}) END"""
    keys = f"transform(g, (h, i) -> (h & {-PLACES}L) | ({PLACES - 1}L - i))"
    widths = [window]
    while widths[-1] > 1:
        widths.append(widths[-1] // 2)
    least = " ".join(
        f"WHEN size(k) >= {w * LEAST_GRAMS if w > 1 else 1} THEN transform(sequence(0, size(k) - {w}), i -> {'least(' + ', '.join(f'get(k, i + {j})' for j in range(w)) + ')' if w > 1 else 'get(k, i)'})"
        for w in widths
    )
    chosen = f"array_distinct(CASE {least} ELSE array() END)"
    place = f"cast({PLACES - 1}L - (c & {PLACES - 1}L) as int)"
    places = f"transform({_bound(keys, 'k', chosen)}, c -> {place})"
    made = f"named_struct('hashes', transform(p, i -> get(g, i)), 'places', p)"
    return F.expr(f"if({text} IS NULL, NULL, {_bound(tokens, 't', _bound(grams, 'g', _bound(places, 'p', made)))})")


def written(hashes: str, places: str) -> Column:
    """The fingerprint as text: hash (hexadecimal) and place of each chosen gram, comma-joined."""
    return F.expr(f"array_join(zip_with({hashes}, {places}, (h, p) -> concat(lower(hex(h)), ':', p)), ',')")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two arrays of hashes, 1 if both are empty."""
    both = F.array_union(a, b)
    return F.when(F.size(both) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(both), F.lit(1)))


def _celled(rows: DataFrame) -> DataFrame:
    """rows (k, ...) with cell: a number that grows with k, about equally many rows in each.

    The cells' limits are quantiles of k over all rows, at most MOST_CELLS - 1 numbers; a row finds its own by bisection.
    """
    n = rows.count()
    cells = min(MOST_CELLS, max(LEAST_CELLS, n // CELL_ROWS))
    cuts = rows.agg(F.percentile_approx("k", [i / cells for i in range(1, cells)], 100 * cells)).first()[0] or []
    cuts = sorted(set(cuts)) or [0]
    steps = [1 << j for j in reversed(range(len(cuts).bit_length()))]
    # The key goes along in the state: a lambda that names a column of the row confuses the inference of join filters.
    state = F.struct(F.lit(0).alias("at"), F.col("k").alias("k"))
    further = lambda a, s: F.struct(F.when(a["k"] >= F.get(F.lit(cuts), a["at"] + s - 1), a["at"] + s).otherwise(a["at"]).alias("at"), a["k"].alias("k"))
    place = F.aggregate(F.lit(steps), state, further, lambda a: a["at"])
    return rows.withColumn("cell", place)


def with_next(rows: DataFrame, add, columns: list[str]) -> DataFrame:
    """add(rows (k, text)) with next_<column> of the next row, by k descending, then text; after the last comes the first.

    Rows are dealt to cells of neighbouring keys and put in order within a cell. The last row of a cell
    meets the first of the next cell in a join with one row for each cell. No window holds more than a cell. Rows of one k lie in one cell.
    """
    rows = _celled(rows)
    order = W.partitionBy("cell").orderBy(F.desc("k"), "text")
    inside = add(rows).select("*", *(F.lead(c).over(order).alias(f"in_{c}") for c in columns), F.lead(F.lit(True)).over(order).alias("more"))
    tops = staged(rows.groupBy("cell").agg(F.max("k").alias("k")), "tops")  # MOST_CELLS rows at most
    by_cell = W.orderBy(F.desc("cell"))
    following = tops.select("cell", F.coalesce(F.lead("cell").over(by_cell), F.first("cell").over(by_cell)).alias("next_cell"))
    heads = rows.join(F.broadcast(tops.select("k")), "k", "left_semi").withColumn("r", F.row_number().over(order)).where("r = 1")
    heads = staged(add(heads).select(F.col("cell").alias("next_cell"), *(F.col(c).alias(f"head_{c}") for c in columns)), "heads").join(F.broadcast(following), "next_cell")
    heads = heads.select(F.col("cell").alias("of"), *(f"head_{c}" for c in columns))
    met = inside.join(heads, (F.col("cell") == F.col("of")) & F.col("more").isNull(), "left")
    return met.select(*(c for c in add(rows).columns if c != "cell"), *(F.when(F.col("more"), F.col(f"in_{c}")).otherwise(F.col(f"head_{c}")).alias(f"next_{c}") for c in columns))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last n_chars div 3 code points replaced by the first as many, or all, of the next
    document's, by descending key; after the last comes the first, which may be the document itself. A null
    text is an empty one; null keys come last. Rows that repeat a key follow one another by their texts, so equal rows
    are each other's next. Keys are whole numbers. Other columns of df are not read; an empty table gives an empty result.
    """
    rows = df.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LEAST_ID)).alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    add = lambda r: r.withColumn("f", fingerprint("text")).select("k", "text", "cell", F.col("f.hashes").alias("hashes"), F.col("f.places").alias("places"))
    rows = with_next(rows, add, ["text", "hashes"]).withColumn("n", F.char_length("text"))
    edited = F.expr("concat(substring(text, 1, n - n div 3), substring(next_text, 1, cast(n div 3 as int)))")
    rows = rows.select("k", "n", "hashes", "places", "next_hashes", edited.alias("edited")).withColumn("e", fingerprint("edited"))
    back = F.when(F.col("k") == LEAST_ID, F.lit(None)).otherwise(F.col("k")).cast(df.schema[key].dataType)
    return rows.select(
        back.alias(key), F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), written("hashes", "places").alias("fingerprint"),
        written("e.hashes", "e.places").alias("edited_fingerprint"), likeness("hashes", "e.hashes").alias("near_edited"), likeness("hashes", "next_hashes").alias("near_next"),
    )
