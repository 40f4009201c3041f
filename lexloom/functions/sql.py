"""Functions of the engine under names in SQL: scalar ones as SQL expressions, the channel as a Pandas function, tokens as a table function."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import Config
from . import text as X

#: name -> (parameters, result, body); the same expressions as in ``text`` and ``numbers``.
SCALARS = {
    "left_class": ("w STRING", "STRING", "CASE WHEN length(w) <= 3 THEN concat('=', w) ELSE concat('*', right(w, 2)) END"),
    "right_class": ("w STRING", "STRING", "CASE WHEN length(w) <= 2 THEN concat('=', w) ELSE concat('*', right(w, 2)) END"),
    "fold_yo": ("w STRING", "STRING", "translate(w, 'ёЁ', 'еЕ')"),
    "fold_accents": ("w STRING", "STRING", f"translate(w, '{X.ACCENTED}', '{X.UNACCENTED}')"),
    "key_cost": ("d2 DOUBLE", "DOUBLE", "least(d2 / (2 * 0.45D * 0.45D), 6.0D) + 0.5D"),
    "quant05": ("x DOUBLE", "INT", "CAST(greatest(0, least(255, round(round(x / 0.05D, 9)) + 128)) AS INT)"),
    "dequant05": ("b INT", "DOUBLE", "b * 0.05D - 6.4D"),
    "prior_milli": ("n BIGINT, total BIGINT", "INT", "CAST(floor(round(greatest(ln(CAST(greatest(total, 1) AS DOUBLE)) - ln(n + 0.5D), 0.0D) * 1000, 6)) AS INT)"),
}


def register(spark: SparkSession, cfg: Config = Config()) -> None:
    """Makes the functions known to a session: those of ``SCALARS``, edit_cost(typed, word) and the table function tokenize(text).

    Nulls give null, and no token.
    """
    for name, (parameters, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")

    from ..operators.channel import edit_costs

    @F.pandas_udf("double")
    def edit_cost(typed: pd.Series, word: pd.Series) -> pd.Series:
        both = typed.notna() & word.notna() & (typed.str.len() > 0) & (word.str.len() > 0)
        out = pd.Series([None] * len(typed), index=typed.index, dtype="float64")
        if both.any():
            out[both] = edit_costs(typed[both].str.lower().tolist(), word[both].str.lower().tolist(), cfg)
        return out

    spark.udf.register("edit_cost", edit_cost)

    import re

    # the Java class is one of Latin-1 and Cyrillic ranges, which Python reads alike
    pattern = X.TOKEN

    class Tokenize:
        def eval(self, text: str) -> Iterator[tuple[int, str]]:
            yield from enumerate(re.findall(pattern, text.lower(), re.DOTALL) if text else ())

    spark.udtf.register("tokenize", F.udtf(Tokenize, returnType="pos int, token string"))
