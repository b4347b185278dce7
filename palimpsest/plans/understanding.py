"""Queries over questions: conversations' user turns with openings and time operators that make every rule fire."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import understanding
from palimpsest.operators.understanding import COMPOUND, COMPOUND_BONUS, COMPOUND_NAME, INTENTS, OPERATORS, expansions
from palimpsest.plans.base import now, query
from palimpsest.sources.tables import table

OPENINGS = (
    "", "what is ", "when did it fail: ", "where is /src/main.rs: ", "how to fix this error: ", "who believes ", "explain the config bug, ", "find db ", "compare v1.20 and ",
    "why ", "which version, recently: ", "see https://x.org ", "E1234 crash: ", "delete repo ",
)
ENDINGS = (
    "", " before:2024-01-10", " after:2024-01-03  today", " last:2w", " during:2023-12", " between:2024-01-02..2024-01-20", " as_of:2024-01-05 last:0d", " LAST:3m before:2024-01-30",
    " during:2024-02 after:2024-01-01 before:2024-01-02",
)


def _case(values, by: str) -> str:
    return f"CASE {by} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values) if v) + " ELSE '' END"


ASK = f"{_case(OPENINGS, f'conv_id % {len(OPENINGS)}')} || coalesce(text, '') || {_case(ENDINGS, f'(conv_id + turn) % {len(ENDINGS)}')}"
QUESTIONS_SQL = f"questions AS (SELECT conv_id, turn, {ASK} AS text FROM conversations WHERE role = 'user')"


def questions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").selectExpr("conv_id", "turn", f"{ASK} AS text")


def _score(name: str) -> str:
    return "(" + " + ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {w} ELSE 0 END" for p, w, _ in INTENTS[name]) + ")"


def _names(name: str) -> str:
    own = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{label}' END" for p, _, label in INTENTS[name])
    more = f" || CASE WHEN s_exploratory >= {COMPOUND + COMPOUND_BONUS} AND s_error_debug >= {COMPOUND} AND compound THEN ['{COMPOUND_NAME}'] ELSE [] END" if name == "exploratory" else ""
    return f"list_filter([{own}], lambda s: s IS NOT NULL){more}"


_SCORES = ", ".join(f"{_score(n)} AS raw_{n}" for n in INTENTS)
INTENT_SQL = f"""{QUESTIONS_SQL}, raw_scores AS (SELECT *, {_SCORES} FROM questions),
boosted AS (SELECT *, raw_exploratory >= {COMPOUND} AND raw_error_debug >= {COMPOUND} AS compound, {", ".join(f"raw_{n} AS s_{n}" for n in INTENTS if n != "exploratory")},
  raw_exploratory + CASE WHEN raw_exploratory >= {COMPOUND} AND raw_error_debug >= {COMPOUND} THEN {COMPOUND_BONUS} ELSE 0 END AS s_exploratory FROM raw_scores),
best AS (SELECT *, greatest({", ".join(f"s_{n}" for n in INTENTS)}) AS top FROM boosted),
intents AS (SELECT *, CASE {" ".join(f"WHEN s_{n} = top THEN '{n}'" for n in INTENTS)} END AS intent, least(top / 20.0::DOUBLE, 1) AS confidence FROM best)"""


@query(f"WITH {INTENT_SQL} SELECT conv_id, turn, intent, round(confidence, 6) AS confidence, array_to_string(CASE intent {' '.join(f'''WHEN '{n}' THEN {_names(n)}''' for n in INTENTS)} END, ',') AS signals FROM intents")
def query_intent(spark, sf_dir):
    rows = understanding.detected(questions(spark, sf_dir))
    return rows.select("conv_id", "turn", "intent", F.round("confidence", 6).alias("confidence"), F.array_join("signals", ",").alias("signals"))


_DICT = "dictionary(word, more) AS (VALUES " + ", ".join(f"('{w}', [{', '.join(repr(m) for m in more)}])" for w, more in expansions().items()) + ")"


def _expanded_sql(of: str) -> str:
    return f"""{_DICT}, tokens AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(lower({of}), '\\s+'), lambda w: w <> '')) AS word FROM asked_for),
all_words AS (SELECT conv_id, turn, word FROM tokens UNION SELECT conv_id, turn, unnest(more) FROM tokens JOIN dictionary USING (word)),
expanded AS (SELECT conv_id, turn, string_agg(word, ' ' ORDER BY word) AS keywords FROM all_words GROUP BY 1, 2)"""


@query(f"WITH {QUESTIONS_SQL}, asked_for AS (SELECT * FROM questions), {_expanded_sql('text')} SELECT conv_id, turn, coalesce(keywords, '') AS keywords FROM questions LEFT JOIN expanded USING (conv_id, turn)")
def query_expansion(spark, sf_dir):
    return questions(spark, sf_dir).select("conv_id", "turn", F.array_join(understanding.expanded(F.col("text")), " ").alias("keywords"))


def _found(name: str, group: int = 1) -> str:
    return f"nullif(regexp_extract(text, '{OPERATORS[name]}', {group}), '')"


_CLEAN = "text"
for _p in OPERATORS.values():
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '', 'g')"
_DAYS = f"(TRY_CAST({_found('last')} AS BIGINT) * CASE lower({_found('last', 2)}) WHEN 'w' THEN 7 WHEN 'm' THEN 30 ELSE 1 END)"
_MONTH = _found("during")
_NEXT = f"CASE WHEN substr({_MONTH}, 6, 2) = '12' THEN format('{{:04d}}-01-01', substr({_MONTH}, 1, 4)::INTEGER + 1) WHEN {_MONTH} IS NOT NULL THEN format('{{:04d}}-{{:02d}}-01', substr({_MONTH}, 1, 4)::INTEGER, substr({_MONTH}, 6, 2)::INTEGER + 1) END"
TIMES_SQL = f"""times AS (SELECT conv_id, turn, text, trim(regexp_replace({_CLEAN}, '\\s+', ' ', 'g')) AS clean, coalesce({_found("between", 2)}, {_NEXT},
  {_found("before")}) AS before,
  coalesce({_found("between")}, {_MONTH} || '-01', CASE WHEN {_DAYS} > 0 THEN strftime(DATE '2024-02-01' - {_DAYS}::INTEGER, '%Y-%m-%d') END,
  {_found("after")}) AS after, {_found("as_of")} AS as_of FROM questions)"""


@query(f"WITH {QUESTIONS_SQL}, {TIMES_SQL} SELECT conv_id, turn, clean, before, after, as_of FROM times")
def query_time_operators(spark, sf_dir):
    return understanding.time_operators(questions(spark, sf_dir), now()).select("conv_id", "turn", "clean", "before", "after", "as_of")


@query(f"""WITH {INTENT_SQL}, {TIMES_SQL}, asked_for AS (SELECT *, CASE WHEN clean = '' THEN text ELSE clean END AS effective FROM times), {_expanded_sql('effective')}
SELECT conv_id, turn, intent, effective, coalesce(keywords, '') AS keywords, before, after, coalesce(CASE WHEN conv_id % 5 = 0 THEN '2024-01-01' END, as_of) AS as_of
FROM asked_for JOIN intents USING (conv_id, turn) LEFT JOIN expanded USING (conv_id, turn)""")
def query_prepare(spark, sf_dir):
    """Every fifth conversation has an explicit date, which beats the operator."""
    rows = questions(spark, sf_dir).withColumn("given", F.expr("CASE WHEN conv_id % 5 = 0 THEN '2024-01-01' END"))
    made = understanding.prepared(rows, now(), as_of="given")
    return made.select("conv_id", "turn", "intent", "effective", F.array_join("keywords", " ").alias("keywords"), "before", "after", "as_of")
