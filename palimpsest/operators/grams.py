"""Substring search over a table of character grams: a phrase meets the records that hold its rarest gram, and those are verified."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a gram. Shorter phrases have none and are looked for in all records of their project.
GRAM = 3


def grams_of(text: F.Column, size: int = GRAM) -> F.Column:
    """The distinct grams of a text in lower case."""
    made = lambda chars: F.transform(F.sequence(F.lit(0), F.size(chars) - size), lambda i: F.concat(*(F.get(chars, i + j) for j in range(size))))
    every = F.element_at(F.transform(F.array(F.split(F.lower(text), "")), made), 1)  # the characters are split once
    return F.when(F.char_length(F.lower(text)) >= size, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def grams(records: DataFrame, size: int = GRAM) -> DataFrame:
    """(gram, project_id, id) of records (id, project_id, content): the index, to be written once and joined by gram and project."""
    return records.select("project_id", "id", F.explode(grams_of(F.col("content"), size)).alias("gram")).select("gram", "project_id", "id")


def candidates(index: DataFrame, queries: DataFrame, size: int = GRAM) -> DataFrame:
    """(query_id, id) of the records that hold the rarest gram of a query's text; queries (query_id, text, project_id) have `size` characters or more.

    Grams are counted over the whole index, but only those that a query asks for.
    """
    asked = queries.select("query_id", "project_id", F.explode(grams_of(F.col("text"), size)).alias("gram"))
    counts = index.join(asked.select("gram", "project_id").distinct(), ["gram", "project_id"], "left_semi").groupBy("gram", "project_id").agg(F.count("*").alias("n"))
    # A gram that no record of the project has is the rarest of all: such a query has no candidates.
    rarest = asked.join(counts, ["gram", "project_id"], "left").groupBy("query_id", "project_id").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    return rarest.join(index, ["gram", "project_id"]).select("query_id", "id")


def containing(records: DataFrame, index: DataFrame, queries: DataFrame, size: int = GRAM) -> DataFrame:
    """Records with the columns of the queries (query_id, text, project_id, ...) whose text they hold, in any case, in their project."""
    held = F.contains(F.lower("content"), F.lower("text"))
    long = F.char_length(F.lower("text")) >= size
    met = candidates(index, queries.where(long), size).join(queries.where(long).drop("project_id").dropDuplicates(["query_id"]), "query_id")
    short = records.join(queries.where(~long), "project_id")
    found = records.join(met, "id")
    return found.where(held).unionByName(short.select(*found.columns).where(held))
