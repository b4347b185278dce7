"""Named parts of source files by a scan of lines, and what changed between two states of the files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words that begin a definition, by kind.
KINDS = {"function": ("fn", "def", "function", "func"), "class": ("class", "struct", "enum", "trait", "interface", "impl")}
WORDS = "|".join(w for words in KINDS.values() for w in words)
#: A definition: at most two modifiers, a word of KINDS, a name.
DEFINITION = rf"^\s*(?:(?:pub|async|export|static|public|private|abstract|final)\s+){{0,2}}({WORDS})\s+([A-Za-z_][A-Za-z0-9_]*)"


def definitions(files: DataFrame) -> DataFrame:
    """(path, kind, name, first_line, last_line, n, hash) of files (path, content): each definition up to the line before the next one.

    Definitions of one kind and name in a file are one row: n of them, the first's and the last's lines, a hash of their texts in order. Blanks at
    the ends of lines don't count. A null content has none.
    """
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    word, name = F.regexp_extract("text", DEFINITION, 1), F.regexp_extract("text", DEFINITION, 2)
    kind = F.when(word.isin(*KINDS["class"]), "class").when(word != "", "function")
    order = W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.withColumn("kind", kind).withColumn("name", F.when(word != "", name)).withColumn("k", F.count("kind").over(order)).where("k > 0")
    spans = rows.groupBy("path", "k").agg(
        F.max("kind").alias("kind"), F.max("name").alias("name"), (F.min("line") + 1).alias("first_line"), (F.max("line") + 1).alias("last_line"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.rtrim("text").alias("t")))), lambda x: x["t"]), "\n")).alias("hash"),
    )
    return spans.groupBy("path", "kind", "name").agg(
        F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.count("*").alias("n"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "hash"))), lambda x: x["hash"]), ",")).alias("hash"),
    )


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, changed, added, removed, modified, n_unchanged) of two tables of definitions; names are sorted and comma-joined, moved ones are unchanged."""
    keys = ["path", "kind", "name"]
    both = old.select(*keys, F.col("hash").alias("was")).join(new.select(*keys, F.col("hash").alias("now")), keys, "full")
    what = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified").otherwise("unchanged")
    rows = both.select("path", "name", what.alias("what"))
    named = lambda w: F.array_join(F.array_sort(F.collect_list(F.when(F.col("what") == w, F.col("name")))), ",").alias(w)
    return rows.groupBy("path").agg(
        (F.count_if(F.col("what") != "unchanged") > 0).alias("changed"), named("added"), named("removed"), named("modified"), F.count_if(F.col("what") == "unchanged").alias("n_unchanged")
    )
