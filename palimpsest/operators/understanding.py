"""What a question means: its intent, expanded words, time operators. Column expressions and projections only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of each intent with their weight in tenths and their name; intents in order of precedence.
INTENTS = {
    "factual": (
        (r"(?i)\bwhat\s+is\b", 8, "what-is"), (r"(?i)\bwho\s+is\b", 8, "who-is"), (r"(?i)\bdefine\b", 7, "define"), (r"(?i)\bversion\b", 5, "version"),
        (r"(?i)\bv\d+\.\d+", 6, "version-ref"), (r"(?i)\bname\s+of\b", 4, "name-of"), (r"(?i)\bhow\s+many\b", 5, "how-many"), (r"(?i)\bwhich\b", 3, "which"),
        (r"(?i)\bis\s+it\s+true\b", 5, "truth-check"),
    ),
    "social_reasoning": (
        (r"(?i)\bbelieves?\b", 7, "believes"), (r"(?i)\bthinks?\b", 6, "thinks"), (r"(?i)\bprefers?\b", 7, "prefers"), (r"(?i)\bopinion\b", 6, "opinion"),
        (r"(?i)\btheory\s+of\s+mind\b", 8, "tom"),
    ),
    "error_debug": (
        (r"(?i)\berror\b", 8, "error"), (r"(?i)\bbug\b", 7, "bug"), (r"(?i)\bcrash\b", 7, "crash"), (r"(?i)\bstack\s*trace\b", 8, "stacktrace"),
        (r"(?i)\bfail(ed|ure|ing)?\b", 6, "fail"), (r"(?i)\bpanic\b", 6, "panic"), (r"(?i)\bE\d{4}\b", 7, "error-code"), (r"(?i)\bdebug\b", 5, "debug"),
    ),
    "temporal": (
        (r"(?i)\bwhen\b", 8, "when"), (r"(?i)\blast:\d+[dwm]\b", 9, "last-n"), (r"(?i)\bbefore:", 9, "before-op"), (r"(?i)\bafter:", 9, "after-op"),
        (r"(?i)\bduring:", 8, "during-op"), (r"(?i)\brecent(ly)?\b", 6, "recent"), (r"(?i)\byesterday\b", 7, "yesterday"),
        (r"(?i)\blast\s+(week|month|year)\b", 7, "last-period"), (r"(?i)\btoday\b", 6, "today"), (r"(?i)\bbetween:\S+\.\.\S+", 9, "between-op"),
    ),
    "navigational": (
        (r"(?i)\bwhere\s+is\b", 8, "where-is"), (r"(?i)\bfind\b", 5, "find"), (r"[/\\]\w+\.\w+", 7, "file-path"), (r"https?://", 8, "url"), (r"(?i)\blocate\b", 5, "locate"),
        (r"(?i)\bpath\s+to\b", 6, "path-to"),
    ),
    "exploratory": (
        (r"(?i)\bhow\s+to\b", 8, "how-to"), (r"(?i)\bwhy\b", 7, "why"), (r"(?i)\bexplain\b", 7, "explain"), (r"(?i)\bcompare\b", 6, "compare"),
        (r"(?i)\bdifference\s+between\b", 6, "diff-between"), (r"(?i)\brelat(ed|ion)\b", 4, "related"),
    ),
}
# Exploratory and error questions in one are exploratory the more, in tenths.
COMPOUND, COMPOUND_BONUS, COMPOUND_NAME = 6, 5, "compound:how-to-fix"
# What short forms stand for.
SHORT_FORMS = {
    "db": "database", "api": "endpoint", "mcp": "model context protocol", "jwt": "token", "sql": "query database", "css": "style", "html": "markup", "js": "javascript",
    "ts": "typescript", "ui": "interface", "ux": "experience", "ci": "integration", "cd": "deployment", "pr": "pull request", "os": "operating system", "cli": "command",
    "sdk": "kit", "env": "environment", "config": "configuration", "repo": "repository", "dep": "dependency", "deps": "dependencies", "impl": "implementation",
    "fn": "function", "param": "parameter", "args": "arguments", "auth": "authentication", "regex": "pattern", "onnx": "model inference", "fts": "fulltext search",
}
# Groups of words for one another; a word takes the first two others of its group.
SYNONYMS = (
    "fix bug patch repair", "error exception failure fault", "create add new make generate", "search find query lookup", "delete remove drop purge",
    "update modify change edit", "config configuration settings options", "fast quick speed performance", "slow latency delay lag", "test check verify validate",
    "build compile assemble package", "deploy release publish ship", "log trace debug monitor", "store save persist write", "load read fetch retrieve",
    "start begin init launch", "stop end halt terminate",
)


def expansions() -> dict[str, list[str]]:
    """Word to the words that expand it: its long form, then two of its group."""
    out = {word: long.split() for word, long in SHORT_FORMS.items()}
    for group in SYNONYMS:
        words = group.split()
        for word in words:
            out[word] = SHORT_FORMS.get(word, "").split() + [w for w in words if w != word][:2]
    return out


def intent_scores(text: Column) -> dict[str, Column]:
    """Tenths of each intent: the weights of its patterns that are in the text."""
    scores = {name: sum((F.when(text.rlike(p), w).otherwise(0) for p, w, _ in patterns), F.lit(0)) for name, patterns in INTENTS.items()}
    both = (scores["exploratory"] >= COMPOUND) & (scores["error_debug"] >= COMPOUND)
    return {**scores, "exploratory": scores["exploratory"] + F.when(both, COMPOUND_BONUS).otherwise(0)}


def detected(df: DataFrame, text: str = "text") -> DataFrame:
    """df with intent (the greatest score; among equals the one that precedes), confidence and signals (names of its patterns).

    A text without any pattern, or null, is factual with confidence 0.
    """
    given = F.coalesce(F.col(text), F.lit(""))
    scores = intent_scores(given)
    rows = df.withColumn("_scores", F.array(*(F.struct(s.alias("score"), F.lit(-k).alias("place"), F.lit(name).alias("intent")) for k, (name, s) in enumerate(scores.items()))))
    rows = rows.withColumn("_best", F.array_max("_scores"))
    names = F.lit(None).cast("array<string>")
    for name, patterns in INTENTS.items():
        own = F.array_compact(F.array(*(F.when(given.rlike(p), label) for p, _, label in patterns)))
        if name == "exploratory":
            both = (scores["error_debug"] >= COMPOUND) & (scores["exploratory"] >= COMPOUND)
            own = F.concat(own, F.when(both, F.array(F.lit(COMPOUND_NAME))).otherwise(F.array().cast("array<string>")))
        names = F.when(F.col("_best.intent") == name, own).otherwise(names)
    rows = rows.withColumn("intent", F.col("_best.intent")).withColumn("confidence", F.least(F.col("_best.score") / 20.0, F.lit(1.0))).withColumn("signals", names)
    return rows.drop("_scores", "_best")


def expanded(text: Column) -> Column:
    """The words of a text in lower case and those that expand them, each once, in order."""
    table = F.create_map(*(x for word, more in expansions().items() for x in (F.lit(word), F.array(*map(F.lit, more)))))
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    more = F.transform(words, lambda w: F.concat(F.array(w), F.coalesce(table[w], F.array().cast("array<string>"))))
    return F.array_sort(F.array_distinct(F.flatten(more)))


DAY, MONTH = r"(\d{4}-\d{2}-\d{2})", r"(\d{4}-\d{2})"
OPERATORS = {
    "before": rf"(?i)\bbefore:{DAY}\b", "after": rf"(?i)\bafter:{DAY}\b", "as_of": rf"(?i)\bas_of:{DAY}\b", "last": r"(?i)\blast:(\d+)([dwm])\b",
    "during": rf"(?i)\bduring:{MONTH}\b", "between": rf"(?i)\bbetween:{DAY}\.\.{DAY}\b",
}


def time_operators(df: DataFrame, now: Column, text: str = "text") -> DataFrame:
    """df with clean (the text without operators, white space as one blank), before, after and as_of (days as YYYY-MM-DD).

    Of several operators a later one in OPERATORS wins: last gives after, during and between give both. The first
    of each kind counts, all are taken out. A month is 30 days in last.
    """
    given = F.coalesce(F.col(text), F.lit(""))

    def found(name: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(given, OPERATORS[name], group), F.lit(""))

    clean = given
    for pattern in OPERATORS.values():
        clean = F.regexp_replace(clean, pattern, "")
    days = F.expr("try_cast(_n AS bigint)") * F.when(F.lower("_unit") == "w", 7).when(F.lower("_unit") == "m", 30).otherwise(1)
    rows = df.withColumn("_n", found("last")).withColumn("_unit", found("last", 2)).withColumn("_month", found("during"))
    since = F.when(days > 0, F.date_format(F.date_sub(now.cast("date"), days.cast("int")), "yyyy-MM-dd"))
    year, month = F.substring("_month", 1, 4).cast("int"), F.substring("_month", 6, 2).cast("int")
    following = F.when(month == 12, F.format_string("%04d-01-01", year + 1)).otherwise(F.format_string("%04d-%02d-01", year, month + 1))
    until = F.when(F.col("_month").isNotNull(), following)
    rows = rows.withColumn("clean", F.trim(F.regexp_replace(clean, r"\s+", " ")))
    rows = rows.withColumn("before", F.coalesce(found("between", 2), until, found("before")))
    rows = rows.withColumn("after", F.coalesce(found("between"), F.concat("_month", F.lit("-01")), since, found("after")))
    return rows.withColumn("as_of", found("as_of")).drop("_n", "_unit", "_month")


def prepared(df: DataFrame, now: Column, text: str = "text", as_of: str | None = None) -> DataFrame:
    """df with all that a search needs: intent, confidence, signals, effective (clean text, or the text if that is empty), keywords, before, after, as_of.

    keywords: the expanded words of the effective text. An explicit as_of (a column of df) beats the operator.
    """
    own = F.col(as_of).cast("string") if as_of else F.lit(None).cast("string")
    rows = time_operators(detected(df.withColumn("_given", own), text), now, text)
    rows = rows.withColumn("effective", F.when(F.col("clean") == "", F.coalesce(F.col(text), F.lit(""))).otherwise(F.col("clean")))
    rows = rows.withColumn("keywords", expanded(F.col("effective"))).withColumn("as_of", F.coalesce("_given", "as_of"))
    return rows.drop("_given", "clean")
