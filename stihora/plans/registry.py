"""Registry of queries, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stihora.functions import text as T
from stihora.operators import relations as R

from .tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def poems(spark: SparkSession, d: str) -> DataFrame:
    return R.poems(table(spark, d, "stripped_songs"))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return R.rule_tagged(R.token_table(R.line_table(poems(spark, d))))


def sql_trim(x: str) -> str:
    """SQL of a text without outer white space."""
    return f"regexp_replace({x}, '^{T.WS}+|{T.WS}+$', '', 'g')"


def sql_lines(x: str) -> str:
    """SQL of a text's trimmed lines that are not blank."""
    return rf"[x for x in [{sql_trim('x')} for x in regexp_split_to_array({x}, '\r\n|\n|\r')] if x <> '']"


#: The base relations as common table expressions; the last one has the rule tagger's columns.
POEMS = f"""WITH latest AS (SELECT * FROM stripped_songs QUALIFY row_number() OVER (PARTITION BY poem_id ORDER BY ingested_at DESC) = 1),
poems AS (SELECT poem_id, {sql_trim("author")} AS author, song_title AS title, array_to_string([{sql_trim("x")} for x in string_split(song_text, chr(10))], chr(10)) AS text
  FROM latest WHERE {sql_trim("author")} <> '' AND {sql_trim("song_text")} <> '')"""
LINES = (
    POEMS
    + rf""",
split AS (SELECT *, {sql_lines("text")} AS ls FROM poems),
lines AS (SELECT poem_id, author, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM split)"""
)
TOKENS = (
    LINES
    + rf""",
words AS (SELECT *, regexp_extract_all(lower(line), '\p{{L}}+') AS ws FROM lines),
bare AS (SELECT poem_id, author, line_no, unnest(ws) AS word, generate_subscripts(ws, 1) AS tok_no FROM words),
tokens AS (SELECT *, CASE WHEN length(word) > 5 THEN regexp_replace(word, '{R.ARTICLE}', '') ELSE word END AS lemma,
  CASE WHEN length(word) <= 3 THEN 'ADP' WHEN regexp_matches(word, '{R.VERB_END}') THEN 'VERB' WHEN regexp_matches(word, '{R.ADJ_END}') THEN 'ADJ'
    WHEN regexp_matches(word, '{R.ADV_END}') THEN 'ADV' ELSE 'NOUN' END AS pos,
  CASE WHEN length(word) > 5 AND regexp_matches(word, '{R.ARTICLE}') THEN 'Definite=Def' ELSE 'Definite=Ind' END || '|' ||
  CASE WHEN regexp_matches(word, '{R.PLURAL}') THEN 'Number=Plur' ELSE 'Number=Sing' END AS feats FROM bare)"""
)
CONTENT = TOKENS + ", content AS (SELECT * FROM tokens WHERE pos <> 'ADP')"
#: Examples of generated poems, one row for each key.
GENERATED = """examples AS (SELECT * FROM synthetic_dataset QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY generated_at DESC) = 1)"""


def generated(spark: SparkSession, d: str) -> DataFrame:
    return R.latest(table(spark, d, "synthetic_dataset"), ["example_id"], "generated_at")
