"""Queries over the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators.context import KEYS
from ..tables import table
from . import base as B
from .base import LEX, S, q


def f02_marks(s, d):
    tok = F.explode(X.words_and_marks(F.col("text")))
    return B.sentences(s, d).select("lang", tok.alias("tok")).where(~X.is_word(F.col("tok"))).groupBy("lang", "tok").agg(F.count("*").alias("n"))


def f03_spoken_words(s, d):
    return B.sentences(s, d).groupBy("lang").agg(F.sum(F.size(X.spoken_words(F.col("text")))).alias("n"))


def f05_graph_words(s, d):
    return B.sentences(s, d).select("lang", F.explode(X.graph_words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")).where("n >= 3")


def f09_as_typed(s, d):
    w = B.words(s, d)
    return w.select("lang", "word", X.like_typed(F.col("word"), F.initcap("word")).alias("cap"), X.like_typed(F.col("word"), F.upper("word")).alias("upper_form"), X.like_typed(F.col("word"), F.col("word")).alias("plain"))


def f16_german_variants(s, d):
    v = B.words(s, d).where("lang = 'de'").select("word", F.explode(X.german_variants(F.col("word"))).alias("variant"))
    return v.join(B.words(s, d).where("lang = 'de'").select(F.col("word").alias("variant"), F.lit(True).alias("known")), "variant", "left").select("word", "variant", F.coalesce("known", F.lit(False)).alias("known"))


def f19_previews(s, d):
    return table(s, d, "documents").select("doc_id", X.one_line(F.regexp_replace("text", r"[\x0B\x1C-\x1F]", " ")).alias("preview"))


PARTICIPLES = ("ющий", "вшаяся", "щ", "емый")


def f20_participles(s, d):
    """Russian words and what their stems make with the endings of participles and others."""
    made = B.words(s, d).where("lang = 'ru'").select(F.explode(F.array("word", *[F.concat("word", F.lit(e)) for e in PARTICIPLES])).alias("word")).distinct()
    return made.where(X.is_active_participle(F.col("word"))).select("word")


def f22_mark_bits(s, d):
    return B.sentences(s, d).groupBy("lang", X.mark_bits(F.col("text")).cast("long").alias("bits")).agg(F.count("*").alias("n"))


def f34_key_costs(s, d):
    at = [(name, c, float(shift[r] + i), float(r)) for name, (rows, shift) in KEYS.items() for r, row in enumerate(rows) for i, c in enumerate(row)]
    k = s.createDataFrame(at, "board string, ch string, x double, y double")
    a, b = k.alias("a"), k.alias("b")
    d2 = F.pow(F.col("a.x") - F.col("b.x"), F.lit(2)) + F.pow(F.col("a.y") - F.col("b.y"), F.lit(2))
    return a.join(b, F.col("a.board") == F.col("b.board")).where("a.ch <> b.ch").select(F.col("a.board").alias("board"), F.col("a.ch").alias("typed"), F.col("b.ch").alias("meant"), F.round(N.key_cost(d2), 6).alias("cost"))


def pred23_sentence_ends(s, d):
    return B.sentences(s, d).groupBy("lang", X.ends_sentence(F.col("text")).alias("ends")).agg(F.count("*").alias("n"))


def pred24_vowelless(s, d):
    return B.words(s, d).where(X.vowelless(F.col("word"))).select("lang", "word")


NAMES = (f02_marks, f03_spoken_words, f05_graph_words, f09_as_typed, f16_german_variants, f19_previews, f20_participles, f22_mark_bits, f34_key_costs, pred23_sentence_ends, pred24_vowelless)


def sql() -> dict[str, str]:
    spoken = "regexp_extract_all(text, '[\\p{L}\\p{N}]+(?:[-''’][\\p{L}\\p{N}]+)*')"
    keys = ", ".join(f"({q(name)}, {q(c)}, {shift[r] + i}::DOUBLE, {r}::DOUBLE)" for name, (rows, shift) in KEYS.items() for r, row in enumerate(rows) for i, c in enumerate(row))
    marked = f"translate(text, {q(X.DASHES + X.QUOTES)}, {q('—' * len(X.DASHES) + chr(34) * len(X.QUOTES))})"
    german = [("ss", "ß"), ("ß", "ss"), ("ae", "ä"), ("oe", "ö"), ("ue", "ü"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue")]
    return {
        "f02_marks": f"WITH {S} SELECT lang, tok, count(*) AS n FROM (SELECT lang, unnest(t) AS tok FROM s) WHERE NOT regexp_matches(tok, '^\\s+$') AND NOT {B.is_word('tok')} GROUP BY ALL",
        "f03_spoken_words": f"WITH {S} SELECT lang, CAST(sum(len({spoken})) AS BIGINT) AS n FROM s GROUP BY lang",
        "f05_graph_words": f"WITH {S} SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(list_transform({spoken}, lambda w: regexp_replace(translate(lower(w), 'ё', 'е'), '\\p{{N}}+', '0', 'g'))) AS word FROM s) GROUP BY ALL HAVING count(*) >= 3",
        "f09_as_typed": f"WITH {LEX} SELECT lang, word, CASE WHEN upper(left(word, 1)) <> lower(left(word, 1)) THEN upper(left(word, 1)) || substr(word, 2) ELSE word END AS cap, CASE WHEN length(word) > 1 AND upper(word) <> lower(word) THEN upper(word) WHEN upper(left(word, 1)) <> left(word, 1) THEN upper(word) ELSE word END AS upper_form, word AS plain FROM lex",
        "f16_german_variants": f"WITH {LEX}, v AS (SELECT DISTINCT word, unnest([{', '.join(f'replace(word, {q(a)}, {q(b)})' for a, b in german)}]) AS variant FROM lex WHERE lang = 'de') SELECT word, variant, variant IN (SELECT word FROM lex WHERE lang = 'de') AS known FROM v WHERE variant <> word",
        "f19_previews": "SELECT doc_id, CASE WHEN length(p) > 40 THEN left(p, 39) || '…' ELSE p END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS p FROM documents)",
        "f20_participles": f"WITH {LEX} SELECT word FROM (SELECT DISTINCT unnest([word, {', '.join('word || ' + q(e) for e in PARTICIPLES)}]) AS word FROM lex WHERE lang = 'ru') WHERE regexp_matches(regexp_replace(translate(word, 'ё', 'е'), '(ся|сь)$', ''), '(ущ|ющ|ащ|ящ|вш)(ий|ая|ее|ие|его|ей|их|ему|им|ую|ими|ем)$|(ш)(ий|ая|ее|ие)$')",
        "f22_mark_bits": f"WITH {S} SELECT lang, CAST({' + '.join(f'CASE WHEN contains({marked}, {q(m)}) THEN {1 << i} ELSE 0 END' for i, m in enumerate(',.!?:;—' + chr(34) + '()'))} AS BIGINT) AS bits, count(*) AS n FROM s GROUP BY ALL",
        "f34_key_costs": f"WITH k(board, ch, x, y) AS (VALUES {keys}) SELECT a.board, a.ch AS typed, b.ch AS meant, round(least((pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / (2 * 0.45 * 0.45), 6.0) + 0.5, 6) AS cost FROM k a JOIN k b ON a.board = b.board AND a.ch <> b.ch",
        "pred23_sentence_ends": f"WITH {S} SELECT lang, rtrim(text) = '' OR (regexp_matches(rtrim(text), '[.!?…][»”\")]*$') AND NOT regexp_matches(rtrim(text), '(^|[\\s(])\\p{{L}}\\.$|(^|\\s)(т|д|п|e|z|i|u|s|g|p)\\.\\s?(е|к|н|п|g|B|d|a|ex)\\.$')) AS ends, count(*) AS n FROM s GROUP BY ALL",
        "pred24_vowelless": f"WITH {LEX} SELECT lang, word FROM lex WHERE NOT regexp_matches(word, '[aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿаеёиоуыэюя]')",
    }
