"""What the record model has room for without a prescribed procedure: contradictions, credibility, dependencies, schedules.

The thresholds are fixed values, the procedures are this library's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.scoring import by_value, clamp, recency

# Likeness from which two records may contradict each other, and what each kind of contradiction costs.
ALIKE, PENALTIES = 0.75, {"negation": 0.08, "antonym": 0.05}
# Words that deny.
NEGATIONS = "not n't don't doesn't isn't aren't won't can't never no none neither nor impossible false incorrect untrue".split()
# Words that exclude each other.
ANTONYMS = (
    "true false", "yes no", "good bad", "right wrong", "love hate", "like dislike", "hot cold", "fast slow", "big small", "large small", "high low", "young old", "alive dead",
    "success failure", "win lose", "increase decrease", "accept reject", "agree disagree", "allow forbid", "always never", "buy sell", "create destroy", "early late", "easy hard",
    "empty full", "enter exit", "happy sad", "include exclude", "possible impossible", "present absent", "remember forget", "safe dangerous", "same different", "strong weak",
)
# Likeness from which two records of a type are the same.
DEDUP_LIKENESS = {"fact": 0.92, "procedure": 0.88, "error": 0.85, "preference": 0.95, "decision": 0.95, "note": 0.90, "observation": 0.90, "event": 0.88}
DEFAULT_LIKENESS = 0.90
# How deep a record has been worked on.
DEPTHS = {"stored": 0.1, "retrieved": 0.2, "used_in_answer": 0.4, "confirmed": 0.6, "enriched": 0.8, "consolidated": 1.0}
# Credibility of a new source, what being right and wrong changes, its bounds; weights of a resolution.
CREDIBILITY = {"initial": 0.5, "correct": 0.05, "incorrect": 0.1, "least": 0.1, "most": 1.0}
RESOLUTION = {"confidence": 0.4, "recency": 0.3, "credibility": 0.3}
# Dependencies from which a part depends on too much, and links from which it is a hotspot.
MANY_DEPENDENCIES, MANY_LINKS = 15, 10
# Weights of a store's health.
HEALTH = {"gaps": 0.15, "confidence": 0.15, "contradictions": 0.15, "staleness": 0.10, "concepts": 0.15, "links": 0.10, "temporal": 0.10, "processing": 0.10}


def _words(text: str) -> Column:
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}']+"))


def stance(text: Column) -> Column:
    """(denies, one, other) of a text: whether it has a word that denies, and a bit for each pair of ANTONYMS of which it has the first, or the second, word."""
    words = _words(text)
    none = F.lit(0).cast("long")

    def mask(side: int) -> Column:
        bits: dict[str, int] = {}
        for k, pair in enumerate(ANTONYMS):
            bits[pair.split()[side]] = bits.get(pair.split()[side], 0) | 1 << k
        known = F.create_map(*(c for word, b in bits.items() for c in (F.lit(word), F.lit(b).cast("long"))))
        return F.aggregate(words, none, lambda m, w: m.bitwiseOR(F.coalesce(known[w], none)))

    return F.struct(F.arrays_overlap(words, F.array(*map(F.lit, NEGATIONS))).alias("denies"), mask(0).alias("one"), mask(1).alias("other"))


def contradictions(pairs: DataFrame, texts: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, kind, penalty) of pairs (a, b) of alike texts (id, text): only one of them denies, or one has a word and the other its opposite.

    texts: None if the pairs have the stances of their texts as tag_a and tag_b. keep: further columns of the pairs.
    """
    rows = pairs
    if texts is not None:
        made = texts.select("id", stance(F.col("text")).alias("tag"))
        for c in "ab":
            rows = rows.join(made.select(F.col("id").alias(c), F.col("tag").alias(f"tag_{c}")), c)
    opposite = F.expr("(tag_a.one & tag_b.other) | (tag_a.other & tag_b.one)") != 0
    kinds = F.array(F.when(F.col("tag_a.denies") != F.col("tag_b.denies"), "negation"), F.when(opposite, "antonym"))
    return rows.select("a", "b", *keep, F.explode(F.array_compact(kinds)).alias("kind")).withColumn("penalty", by_value(PENALTIES, F.col("kind"), 0.0))


def credibility(votes: DataFrame) -> DataFrame:
    """(source, credibility) out of votes (source, correct)."""
    counted = votes.groupBy("source").agg(F.count_if("correct").alias("right"), F.count_if(~F.col("correct")).alias("wrong"))
    value = CREDIBILITY["initial"] + CREDIBILITY["correct"] * F.col("right") - CREDIBILITY["incorrect"] * F.col("wrong")
    return counted.select("source", F.round(clamp(value, CREDIBILITY["least"], CREDIBILITY["most"]), 6).alias("credibility"))


def weighed(records: DataFrame, now: Column) -> DataFrame:
    """(id, score) of records (id, confidence, created_at, credibility): their weight where they contradict each other."""
    score = RESOLUTION["confidence"] * F.coalesce("confidence", F.lit(0.5)) + RESOLUTION["recency"] * recency(F.col("created_at"), now) + RESOLUTION["credibility"] * F.coalesce("credibility", F.lit(CREDIBILITY["initial"]))
    return records.select("id", F.round(score, 6).alias("score"))


def resolved(pairs: DataFrame, records: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """(a, b, chosen) of contradicting pairs: the record (see `weighed`) with the greater score, the least id among equals.

    records: None if the pairs have the scores as score_a and score_b.
    """
    rows = pairs
    if records is not None:
        scored = weighed(records, now)
        rows = rows.select("a", "b").distinct()
        for c in "ab":
            rows = rows.join(scored.select(F.col("id").alias(c), F.col("score").alias(f"score_{c}")), c)
    first = (F.col("score_a") > F.col("score_b")) | ((F.col("score_a") == F.col("score_b")) & (F.col("a") < F.col("b")))
    made = rows.select("a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("chosen"))
    return made if records is not None else made.distinct()


def same_by_type(pairs: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, similarity) of records (id, type) of one type that are alike enough for it; types: None if the pairs have them as tag_a and tag_b."""
    rows = pairs
    if types is not None:
        for c in "ab":
            rows = rows.join(types.select(F.col("id").alias(c), F.col("type").alias(f"tag_{c}")), c)
    return rows.where("tag_a = tag_b").where(F.col("similarity") >= by_value(DEDUP_LIKENESS, F.col("tag_a"), DEFAULT_LIKENESS)).select("a", "b", "similarity", F.col("tag_a").alias("type"))


def depth(level: Column) -> Column:
    return by_value(DEPTHS, level, 0.0)


def insights(links: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, insight, n) of parts (id) by their links (src, dst): too many dependencies, a hotspot of links, used by nothing."""
    once = links.select("src", "dst").distinct()
    out = once.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
    into = once.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"))
    zero = F.lit(0)
    rows = parts.select("id").join(out, "id", "left").join(into, "id", "left").select("id", F.coalesce("n_out", zero).alias("n_out"), F.coalesce("n_in", zero).alias("n_in"))
    total = F.col("n_in") + F.col("n_out")
    found = F.array(
        F.when(F.col("n_out") >= MANY_DEPENDENCIES, F.struct(F.lit("many dependencies").alias("insight"), F.col("n_out").alias("n"))),
        F.when(total >= MANY_LINKS, F.struct(F.lit("hotspot").alias("insight"), total.alias("n"))),
        F.when(F.col("n_in") == 0, F.struct(F.lit("unused").alias("insight"), F.col("n_in").alias("n"))),
    )
    return rows.select("id", F.explode(F.array_compact(found)).alias("f")).select("id", "f.*")


def due(tasks: DataFrame, now: Column) -> DataFrame:
    """Pending tasks (id, next_run, status, recurring) whose time has come, the longest overdue first."""
    return tasks.where((F.col("status") == "pending") & (F.col("next_run") <= now)).orderBy("next_run", "id")


def completed(tasks: DataFrame, done: DataFrame, now: Column, every: str = "INTERVAL '1' DAY") -> DataFrame:
    """tasks after some are done: a recurring one is pending again later, others are completed."""
    rows = tasks.join(done.select("id").distinct().withColumn("_done", F.lit(True)), "id", "left")
    again = F.col("_done") & F.col("recurring")
    rows = rows.withColumn("next_run", F.when(again, F.col("next_run") + F.expr(every)).otherwise(F.col("next_run")))
    rows = rows.withColumn("status", F.when(again, "pending").when(F.col("_done"), "completed").otherwise(F.col("status")))
    return rows.withColumn("last_run", F.when(F.col("_done"), now).otherwise(F.col("last_run"))).select(*tasks.columns)


def health(parts: dict[str, Column]) -> Column:
    """0 to 100 out of the eight parts, each from 0 to 1."""
    total = F.lit(0.0)
    for name, weight in HEALTH.items():
        total = total + weight * clamp(parts[name], 0.0, 1.0)
    return F.round(100 * total).cast("long")
