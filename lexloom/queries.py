"""All queries of the core operators, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import context, corpus, decode, files, functions, interactive, more, words

PLANS = (corpus, context, decode, interactive, functions, files, words, more)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return decode.l04_suggest(spark, d)


def queries() -> dict:
    return {f.__name__: f for plan in PLANS for f in plan.NAMES}


def oracle_sql() -> dict[str, str]:
    return {k: v for plan in PLANS for k, v in plan.sql().items()}
