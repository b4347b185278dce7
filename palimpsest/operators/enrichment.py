"""What is derived from a record's text: type, importance, tags, noise, equal and similar texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Phrases of each type, in order of precedence.
TYPE_PHRASES = {
    "decision": ("decided", "decision", "chose", "will use", "going with", "selected"),
    "procedure": ("step 1", "steps:", "how to", "procedure", "process:", "run ", "install ", "configure "),
    "preference": ("prefer", "always use", "never use", "like ", "don't like", "better than"),
    "event": ("happened", "occurred", "deployed", "released", "started", "finished", "migrated"),
    "observation": ("noticed", "observed", "seems like", "appears to", "found that", "discovered"),
    "fact": ("is ", "are ", "uses ", "has ", "the ", "version"),
}
# What types and words add to importance.
TYPE_BOOST = {"decision": 0.2, "procedure": 0.15, "preference": 0.1, "fact": 0.05}
WORD_BOOST = ((("critical", "important", "breaking"), 0.15), (("error", "bug", "fix"), 0.1), (("security", "vulnerability"), 0.15))
# Openings of replies that say nothing.
NOISE_OPENINGS = ("I'll help you with that", "Let me ", "Sure, ", "OK, ", "Certainly", "Here's what I found", "I understand", "Let me think about", "I apologize", "I'm sorry")
# Words that are never tags.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can must need to of in for on with at by from as into through "
    "during before after above below between out off over under again further then once here there when where why how all each every both few more most other some such no nor "
    "not only own same so than too very just because but and or if while about up its it this that these those i me my we our you your he him his she her they them their what "
    "which who whom use used using"
).split()


def any_of(low: Column, phrases) -> Column:
    """Whether a text holds any of the phrases, as they are."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p))
    return out


def classify(low: Column) -> Column:
    """First type of which a phrase is in the lower-case text, else note."""
    out = None
    for name, phrases in TYPE_PHRASES.items():
        out = F.when(any_of(low, phrases), name) if out is None else out.when(any_of(low, phrases), name)
    return out.otherwise("note")


def importance(low: Column, content: Column, kind: Column) -> Column:
    """0.5, more by type and words, less if under 20 bytes, more if over 200; between 0.1 and 1."""
    score, boost = F.lit(0.5), None
    for name, value in TYPE_BOOST.items():
        boost = F.when(kind == name, value) if boost is None else boost.when(kind == name, value)
    score = score + boost.otherwise(0.0)
    for words, value in WORD_BOOST:
        score = score + F.when(any_of(low, words), value).otherwise(0.0)
    n = F.octet_length(content)
    score = score + F.when(n < 20, -0.1).when(n > 200, 0.05).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), score))


def tags(df: DataFrame, k: int = 5, key: str = "id", content: str = "content") -> DataFrame:
    """(key, tag, n, r): the k most frequent words of each text; ties by the word."""
    words = df.select(key, F.explode(F.split(F.lower(content), r"\s+")).alias("w")).select(key, F.regexp_replace("w", r"[^\p{L}\p{N}_-]", "").alias("tag"))
    words = words.where((F.octet_length("tag") >= 3) & ~F.col("tag").isin(STOP_WORDS))
    counted = words.groupBy(key, "tag").agg(F.count("*").alias("n"))
    order = W.partitionBy(key).orderBy(F.desc("n"), "tag")
    return counted.withColumn("r", F.row_number().over(order).cast("long")).where(F.col("r") <= k)


def noise(content: Column) -> Column:
    """Under 50 bytes; under 200 with the opening of a reply; under 500 in braces; without the white space around the text."""

    def judged(text: Column) -> Column:
        n, opening = F.octet_length(text), F.lit(False)
        for phrase in NOISE_OPENINGS:
            opening = opening | text.startswith(phrase)
        return (n < 50) | ((n < 200) & opening) | ((n < 500) & text.startswith("{") & text.endswith("}"))

    return F.element_at(F.transform(F.array(F.regexp_replace(content, r"^\s+|\s+$", "")), judged), 1)  # the text is made once


def exact_copies(df: DataFrame, key: str = "id", group: str = "project_id", content: str = "content") -> DataFrame:
    """(key, first): the least key of the same group whose text has the same SHA-256.

    A partial aggregation by hash, joined back: no window over a group of copies.
    """
    hashed = df.select(key, group, F.sha2(F.col(content).cast("binary"), 256).alias("h"))
    firsts = hashed.groupBy(group, "h").agg(F.min(key).alias("first"))
    return hashed.join(firsts, [group, "h"]).select(key, "first")


def recent_similar(df: DataFrame, newest: int = 20, least: float = 0.85) -> DataFrame:
    """Pairs (id, other): word sets of other, among a project's `newest` newest, have a Jaccard over `least`; the newest hit.

    Words are exchanged as hashes, and only pairs whose sizes allow the likeness are compared.
    """
    order = W.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("id"))
    recent = df.select("project_id", "id", "created_at").withColumn("place", F.row_number().over(order)).where(F.col("place") <= newest)
    words = F.array_distinct(F.transform(F.filter(F.split(F.lower("content"), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    sets = df.select("id", "project_id", words.alias("words")).withColumn("n", F.size("words"))
    other = recent.select("id", "place").join(sets, "id").select("project_id", F.col("id").alias("other"), F.col("words").alias("theirs"), F.col("n").alias("m"), "place")
    small = sets.select("id", "project_id", "n", "words").join(other, "project_id").where((F.col("id") != F.col("other")) & (F.least("n", "m") > least * F.greatest("n", "m")))
    pairs = (
        small.withColumn("both", F.size(F.array_intersect("words", "theirs")))
        .withColumn("jaccard", F.expr("both / cast(n + m - both as double)")).where(F.col("jaccard") > least)
    )
    return pairs.groupBy("id").agg(F.min_by("other", "place").alias("other"), F.round(F.min_by("jaccard", "place"), 6).alias("jaccard"))
