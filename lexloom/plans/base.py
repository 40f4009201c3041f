"""Inputs that the named queries share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus, lexicon
from ..tables import table


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def source_name(c):
    return F.lower(F.trim(c))


def sentences(spark: SparkSession, d: str, heldout: bool = False) -> DataFrame:
    return corpus.corpus(table(spark, d, "build_frames"), heldout=heldout).select("sent_id", "lang", F.coalesce(source_name(F.col("source")), F.lit("")).alias("source"), "text")


def words(spark: SparkSession, d: str) -> DataFrame:
    """(lang, word, count)."""
    return lexicon.frequency_list(table(spark, d, "lexicon"), "w", "c")


def weights(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mix_targets").select("source", "weight")


WORD_RE = q(f"^({X.WORD})$")


def is_word(c: str) -> str:
    return f"regexp_matches({c}, {WORD_RE})"


def left_class(c: str) -> str:
    return f"CASE WHEN length({c}) <= 3 THEN '=' || {c} ELSE '*' || right({c}, 2) END"


def right_class(c: str) -> str:
    return f"CASE WHEN length({c}) <= 2 THEN '=' || {c} ELSE '*' || right({c}, 2) END"


def fold_accents(c: str) -> str:
    return f"translate({c}, {q(X.ACCENTED)}, {q(X.UNACCENTED)})"


def fold_yo(c: str) -> str:
    return f"translate({c}, 'ёЁ', 'еЕ')"


def frames_sql(name: str = "s", held: bool = False) -> str:
    return f"{name} AS (SELECT sent_id, lang, coalesce(lower(trim(source)), '') AS source, text, regexp_extract_all(lower(text), {q(X.TOKEN)}) AS t FROM build_frames WHERE text IS NOT NULL AND sent_id IS NOT NULL AND sent_id % 50 {'=' if held else '<>'} 0 AND NOT regexp_matches(text, {q(X.STOCK)}))"


#: s: sentences with tokens; tok: their words; nb: neighbours; lex: the lexicon; uni, prs: counts of words of the lexicon.
S = frames_sql()
TOK = f"tok AS (SELECT lang, source, sent_id, word FROM (SELECT lang, source, sent_id, unnest(t) AS word FROM s) WHERE {is_word('word')})"
NB = f"nb AS (SELECT lang, source, t[i] AS prev, t[i + 2] AS word FROM (SELECT lang, source, t, unnest(range(1, len(t) - 1)) AS i FROM s) WHERE t[i + 1] = ' ' AND {is_word('t[i]')} AND {is_word('t[i + 2]')})"
LEX = f"lex AS (SELECT lang, lower(w) AS word, max(c) AS count FROM lexicon WHERE c >= 1 AND {is_word('lower(w)')} GROUP BY ALL)"
PRIOR = "pri AS (SELECT lang, word, count, CAST(floor(round(greatest(ln(greatest(total, 1)) - ln(count + 0.5), 0) * 1000, 6)) AS INTEGER) AS prior_milli FROM lex JOIN (SELECT lang, sum(count) AS total FROM lex GROUP BY 1) USING (lang))"
PAIRS = """uni AS (SELECT lang, word, count(*) AS n FROM tok SEMI JOIN lex USING (lang, word) GROUP BY ALL),
  prs AS (SELECT lang, prev, word, count(*) AS n FROM nb SEMI JOIN lex USING (lang, word) SEMI JOIN (SELECT lang, word AS prev FROM lex) p USING (lang, prev) GROUP BY ALL)"""
