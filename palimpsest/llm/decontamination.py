"""Benchmark decontamination by templates, with DataFrame and SQL functions only.

1. Words become a template: numbers, names and units are typed placeholders, other words are in
   lower case without the punctuation around them. So a question whose numbers or names were
   changed keeps its template. A run of names is one placeholder: Paris may become New York.
   An item has up to three templates (views), a document one. The first is the item's own. In the second names are
   plain words: a copy in lower or upper case has no names either. In the third, of items that begin with a run of names,
   that run is a name, as it is inside a sentence.
2. Windows of WINDOW template words are hashed and joined with the benchmark's by hash. A window
   of placeholders mostly says nothing and isn't used. Items of SHORTEST to WINDOW - 1 words are one window
   of their own length. Shorter items, and those that have only windows of placeholders, are matched
   by their bare words in lower case instead, without placeholders.
   An item's first word is never a name in the item. In a document a window that begins with a name
   is therefore hashed with the plain word too.
3. Hits of a document and an item on one diagonal (equal difference of places) are one copy. Slots
   must be consistent in it: a value of the item has one value in the document. Others are out.
4. An item is in a document if SHARE of a view's windows or more are in consistent copies.

Windows of a document stay with its row until they meet the benchmark; what is shuffled are hits.
Distinct windows of the benchmark are broadcast if they are few enough (`short_list`), and otherwise
joined by sorting, hot windows split. Items of one text are matched once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import free_name, short_list, staged

WINDOW, SHORTEST, SHARE = 8, 5, 0.5
#: Placeholders that a window may hold at most, as a share.
MOST_SLOTS = 0.5
#: Items that a window may have to meet them at once.
MOST_ITEMS = 64
LEAST_ID = -(1 << 63)
#: Stands for the space between the names of a run.
JOINED = "\\u0002"
NAME = r"\\p{Lu}\\p{Ll}+"
#: A name or a run of names; possessive (*+), as Java goes a step deeper into its stack for each round of a group that may be given back.
NAMES = f"^{NAME}(?:{JOINED}{NAME})*+$"
#: Space between two names of which the first doesn't begin a sentence. It begins with the space: most spaces end there, as no capital follows.
BETWEEN_NAMES = rf"[\\x20\\x09-\\x0D]+(?={NAME}(?![\\p{{L}}\\p{{N}}\\x27’-]))(?<=[^.!?:\\x20\\x09-\\x0D][\\x20\\x09-\\x0D]\\p{{Lu}}\\p{{Ll}}{{1,40}}[\\x20\\x09-\\x0D]{{1,4}})"
RUN_FIRST = rf"^[\\x20\\x09-\\x0D]*{NAME}[\\x20\\x09-\\x0D]+{NAME}(?![\\p{{L}}\\p{{N}}\\x27’-])"
# Punctuation stripped from words, ends of sentences, words for numbers, units.
PUNCTUATION = ".,;:!?()[]{}\"«»“”„¿¡…"
SENTENCE_ENDS = (".", "!", "?", ":")
NUMBERS = "one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons ml l litre litres liter liters s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent % $ € £ dollar dollars euro euros cent cents kmh mph kwh w kw v a hz khz mhz ghz b kb mb gb tb degrees".split()


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _bound(value: str, name: str, body: str) -> str:
    """SQL of body in which name stands for value, which is made once for a row."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def template_sql(text: str, names: bool = True) -> str:
    """SQL of array<struct<t, raw>>: the template word and the bare word of each word of a text, a run of names being one word.

    r: the words; b: without the punctuation around them; l: those in lower case. Without `names` they are plain words.
    """
    if names:
        text = f"regexp_replace({text}, '{BETWEEN_NAMES}', '{JOINED}')"
    name = f"""
      when w <> get(b, i) and i > 0 and right(get(r, i - 1), 1) not in {_in(SENTENCE_ENDS)} and get(b, i) rlike '{NAMES}' then '<name>'""" * names
    words = f"filter(split({text}, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"
    bare = f"transform(r, w -> coalesce(nullif(btrim(w, '{PUNCTUATION}'), ''), w))"
    before = "get(l, i - 1)"
    kind = f"""case
      when left(w, 1) between '0' and '9' then case when w rlike '^[0-9][0-9.,:/]*%?$' then '<number>' when w rlike '^[0-9][0-9.,]*[a-z]+$' then '<quantity>' else w end
      when w in {_in(NUMBERS)} then '<number>'
      when w in {_in(UNITS)} and i > 0 and (left({before}, 1) between '0' and '9' or {before} in {_in(NUMBERS)}) then '<unit>'{name}
      else w end"""
    made = f"transform(l, (w, i) -> struct({kind} as t, w as raw))"
    return _bound(words, "r", _bound(bare, "b", _bound("transform(b, w -> lower(w))", "l", made)))


def _hash_at(n: int, first: str = "t", rest: str = "t", mark: str = "") -> str:
    """SQL of the hash of the n words from place i (from 1) on; word by word, as slices of arrays are copied."""
    return f"xxhash64(get({first}, i - 1){''.join(f', get({rest}, i + {j - 1})' for j in range(1, n))}{mark})"


def windows_sql(template: str, lengths: list[int], few_slots: bool, bare: list[int] | None = None) -> str:
    """SQL of array<struct<place, hash>>: the windows of a template, of each of the lengths, and of its bare words, of the lengths in bare.

    few_slots: only windows that are mostly words. The benchmark's are chosen so; a document's
    other windows then have no equal among them, and its windows that begin with a name are hashed with the plain word too.
    Each word is hashed once (t: template words, b: bare words), a window from its words' hashes.
    """
    every = []
    for n in lengths:
        places = f"if(size(t) >= {n}, sequence(1, size(t) - {n} + 1), array())"
        if few_slots:
            places = f"filter({places}, i -> size(filter(slice(c.t, i, {n}), w -> left(w, 1) = '<' and right(w, 1) = '>')) <= {int(n * MOST_SLOTS)})"
        every.append(f"transform({places}, i -> struct(i as place, {_hash_at(n)} as hash))")
        if not few_slots:
            named = f"filter({places}, i -> t[i - 1] = xxhash64('<name>'))"
            every.append(f"transform({named}, i -> struct(i as place, {_hash_at(n, 'b')} as hash))")
    for n in bare or []:
        every.append(f"transform(if(size(b) >= {n}, sequence(1, size(b) - {n} + 1), array()), i -> struct(i as place, {_hash_at(n, 'b', 'b', ", 'bare'")} as hash))")
    hashes = lambda of: f"transform(c.{of}, w -> xxhash64(w))"
    return _bound(template, "c", _bound(hashes("t"), "t", _bound(hashes("raw"), "b", f"concat({', '.join(every)})")))


def matches(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """(doc, item, n_windows, n_found) of each document and item with a consistent hit; n_found of the n_windows windows of the item's best view.

    share: what the caller asks for at least; items that reach less may have fewer windows found.
    """
    items = benchmark.select(F.col(f"`{item}`").alias("item"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text")).where("item IS NOT NULL").dropDuplicates(["item"])
    items = staged(items, "given")
    equal = staged(items.join(items.groupBy("text").agg(F.min("item").alias("one")), "text").select("one", "item", "text"), "equal")  # items of one text are matched once
    items = equal.where("item = one").select("item", "text")
    first_names = f"CASE WHEN text RLIKE '{RUN_FIRST}' THEN {_bound(template_sql("concat('x ', text)"), 'c', 'slice(c, 2, greatest(size(c) - 1, 0))')} END"
    views = items.select("item", F.expr(template_sql("text")).alias("c0"), F.expr(template_sql("text", False)).alias("c1"), F.expr(first_names).alias("c2"))
    each = F.expr("array(struct(0 AS view, c0 AS c), struct(1 AS view, if(transform(c0, w -> w.t) = transform(c1, w -> w.t), NULL, c1) AS c), struct(2 AS view, c2 AS c))")
    items = views.select("item", F.explode(each).alias("v")).select("item", "v.view", "v.c").withColumn("n", F.least(F.size("c"), F.lit(WINDOW)))
    items = staged(items.where("c IS NOT NULL AND n > 0"), "items")
    lengths = sorted(r.n for r in items.where(F.col("n") >= SHORTEST).select("n").distinct().collect()) or [WINDOW]
    own = "CASE n " + " ".join(f"WHEN {n} THEN {windows_sql('c', [n], True)}" for n in lengths) + " END"
    made = staged(items.select("item", "view", "n", "c", F.expr(own).alias("w")), "own")
    few = made.where("view = 0 AND (w IS NULL OR size(w) = 0)")
    bare = sorted(r.n for r in few.select("n").distinct().collect())
    windows = made.where("size(w) > 0").select("item", "view", F.explode("w").alias("w"))
    for n in bare:
        windows = windows.unionByName(few.where(F.col("n") == n).select("item", "view", F.explode(F.expr(windows_sql("c", [], True, [n]))).alias("w")))
    wanted = staged(windows.select("item", "view", F.col("w.place").alias("item_place"), "w.hash"), "wanted")
    totals = wanted.groupBy("item", "view").agg(F.count("*").alias("n_windows"))

    # h tells rows apart that share a key: each text is matched alone.
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    docs = df.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LEAST_ID)).alias("doc"), F.xxhash64(body).alias("h"), body.alias("text"))
    found = (
        docs.select("doc", "h", F.explode(F.expr(windows_sql(template_sql("text"), lengths, False, bare))).alias("w"))
        .select("doc", "h", F.col("w.place").alias("place"), "w.hash")
    )
    hits = staged(_hits(found, wanted, share), "hits")

    # Slots of the copies: places of the item that a hit covers and that hold a placeholder.
    placeholder = "left(w.t, 1) = '<' and right(w.t, 1) = '>'"
    slots = items.select("item", "view", "n", F.posexplode("c").alias("p", "w")).where(placeholder).select("item", "view", "n", (F.col("p") + 1).alias("slot"), F.col("w.raw").alias("value"))
    copy = ["doc", "h", "item", "view", "diagonal"]
    covered = hits.join(slots, ["item", "view"]).where("slot >= item_place AND slot < item_place + n").select(*copy, "slot", "value").distinct()
    covered = staged(covered.withColumn("place", F.col("diagonal") + F.col("slot")), "covered")
    some = docs.join(covered.select("doc", "h").distinct(), ["doc", "h"], "left_semi")
    words = some.select("doc", "h", F.posexplode(F.expr(template_sql("text"))).alias("p", "w")).select("doc", "h", (F.col("p") + 1).alias("place"), F.col("w.raw").alias("filled"))
    values = covered.join(words, ["doc", "h", "place"]).groupBy(*copy, "value").agg(F.min("filled").alias("a"), F.max("filled").alias("b"))
    broken = values.where("a <> b").select(*copy).distinct()
    good = hits.join(broken, copy, "left_anti").select("doc", "h", "item", "view", "item_place").distinct()
    by_text = good.groupBy("doc", "h", "item", "view").agg(F.count("*").alias("n_found")).join(totals, ["item", "view"])
    best = by_text.groupBy("doc", "item").agg(F.max_by(F.struct("n_found", "n_windows"), F.struct(F.col("n_found") / F.col("n_windows"), "n_found")).alias("b"))
    return best.select("doc", F.col("item").alias("one"), "b.n_found", "b.n_windows").join(equal.select("one", "item"), "one").select("doc", "item", "n_found", "n_windows")


def _hits(found: DataFrame, wanted: DataFrame, share: float) -> DataFrame:
    """(doc, h, item, view, item_place, diagonal) of equal windows of documents and items.

    Windows of documents meet the distinct hashes first. A window of more than MOST_ITEMS items meets them only in documents that
    share another window with the item, except for items of which such windows alone could be `share`: nothing is lost, and a
    phrase that thousands of items begin with doesn't give each document that has it thousands of rows.
    """
    hashes = staged(wanted.groupBy("hash").agg(F.count("*").alias("n_items")), "hashes")
    met = staged(found.join(short_list(hashes), "hash").select("doc", "h", "place", "hash", (F.col("n_items") > MOST_ITEMS).alias("often")), "met")
    if met.where("often").isEmpty():
        pairs = met.join(wanted, "hash")
    else:
        marked = wanted.join(hashes, "hash").withColumn("often", F.col("n_items") > MOST_ITEMS)
        enough = marked.groupBy("item", "view").agg((F.count_if("often") >= share * F.count("*")).alias("alone"))
        marked = staged(marked.join(enough, ["item", "view"]).select("item", "view", "item_place", "hash", "often", "alone"), "marked")
        first = staged(met.drop("often").join(marked.where("NOT often OR alone").drop("often", "alone"), "hash"), "rare")
        known = first.select("doc", "h", "item", "view").distinct()
        more = met.where("often").drop("often").join(known, ["doc", "h"]).join(marked.where("often AND NOT alone").drop("often", "alone"), ["hash", "item", "view"])
        pairs = first.unionByName(more)
    return pairs.select("doc", "h", "item", "view", "item_place", (F.col("place") - F.col("item_place")).alias("diagonal")).distinct()


def contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """One row per row of df: key, n_items (benchmark items in it), first_item (the least), n_found (their windows), contaminated.

    Null and empty texts hold no item; null and empty items are in no document. Rows that repeat a key are
    judged together, so are rows without a key. Other columns are not read. Without items, or without rows, nothing
    is contaminated.
    """
    pairs = matches(df, benchmark, key, text, share=share).where(F.col("n_found") >= share * F.col("n_windows"))
    by_doc = staged(pairs.groupBy("doc").agg(F.count("*").alias("n_items"), F.min("item").alias("first_item"), F.sum("n_found").alias("n_found")), "contaminated")
    doc = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LEAST_ID))
    out = df.select(F.col(f"`{key}`").alias("_key"), doc.alias("doc")).join(by_doc, "doc", "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("_key").alias(key), F.coalesce("n_items", zero).alias("n_items"), "first_item", F.coalesce("n_found", zero).alias("n_found"), F.col("n_items").isNotNull().alias("contaminated"))


def clean(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """The rows of df whose document holds no benchmark item, with all columns, whatever they are called.

    Rows that repeat a key, and rows without one, are judged together: if one holds an item, all go.
    """
    pairs = matches(df, benchmark, key, text, share=share).where(F.col("n_found") >= share * F.col("n_windows"))
    own = free_name(df, "_own")
    bad = staged(pairs.select(F.col("doc").alias(own)).distinct(), "bad")
    return df.withColumn(own, F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LEAST_ID))).join(short_list(bad), own, "left_anti").drop(own)
