"""Queries over sentences and lists."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import numbers as N
from ..functions import text as X
from ..operators import corpus as C
from ..operators import lexicon as L
from ..tables import table
from . import base as B
from . import index as I
from .base import LEX, NB, PAIRS, PRIOR, S, TOK, q


def f01_tokens_by_lang(s, d):
    return C.token_totals(B.sentences(s, d))


def f08_ending_classes(s, d):
    return C.word_tokens(B.sentences(s, d)).groupBy("lang", X.left_class(F.col("word")).alias("lclass"), X.right_class(F.col("word")).alias("rclass")).agg(F.count("*").alias("n"))


def a01_lexicon(s, d):
    return B.words(s, d)


def a02_summed_list(s, d):
    return L.summed(table(s, d, "lexicon"), "w", "c")


def a03_unigrams_top(s, d):
    rk = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return C.unigrams(B.sentences(s, d)).withColumn("rk", rk).where("rk <= 50")


def a03_pairs(s, d):
    return C.in_lexicon(C.pair_counts(B.sentences(s, d)), B.words(s, d), "prev", "word").select("lang", "prev", "word", "n")


def a04_source_mixture(s, d):
    return I._mixed(s, d)[0].select("lang", "word", F.round("mass", 9).alias("mass"), "raw")


def w01_neighbours(s, d):
    return C.pair_counts(B.sentences(s, d)).where("n >= 2")


def w03_bigrams_kept(s, d):
    return I.space(s, d, "pairs")


def a09_ending_pmi(s, d):
    return I.space(s, d, "endings")


def a06_form_share(s, d):
    lex = table(s, d, "lexicon").where(X.is_word(F.lower("w"))).select("lang", F.lower("w").alias("word"), F.coalesce("c", F.lit(0)).alias("count")).groupBy("lang", "word").agg(F.max("count").alias("count"))
    forms = lex.select("lang", F.col("word").alias("form"), F.substring("word", 1, 5).alias("lemma"))
    return L.with_forms(lex, forms)


def u01_union_lists(s, d):
    slang = table(s, d, "slang").where(~F.col("c0").startswith("#"))
    return L.union_lists(B.words(s, d), L.frequency_list(slang, "c0", "c1"))


def u02_only_in_slang(s, d):
    slang = L.frequency_list(table(s, d, "slang").where(~F.col("c0").startswith("#")), "c0", "c1")
    return slang.join(B.words(s, d), ["lang", "word"], "left_anti")


def u05_overlay(s, d):
    slang = L.frequency_list(table(s, d, "slang").where(~F.col("c0").startswith("#")), "c0", "c1")
    return L.overlay(B.words(s, d), slang)


def pred01_charset(s, d):
    return table(s, d, "lexicon").where("w IS NOT NULL").groupBy("lang", X.is_word(F.lower("w")).alias("ok")).agg(F.count("*").alias("n"))


def pred04_artifacts(s, d):
    return B.words(s, d).where(X.is_artifact(F.col("word"))).select("lang", "word")


def pred05_06_kept_words(s, d):
    lex = B.words(s, d)
    verbs = lex.where(F.col("word").rlike("(ть|ти|чь|ться|тись|чься)$"))
    allowed = L.frequency_list(table(s, d, "slang"), "c0", "c1")
    return L.keep_words(lex, allowed, verbs, 20)


def pred08_14_minority_spellings(s, d):
    return L.minority_spellings(B.words(s, d))


def pred09_yo_variants(s, d):
    return L.with_yo_variants(B.words(s, d))


def pred10_scripts(s, d):
    return B.words(s, d).groupBy("lang", X.script(F.col("word")).alias("script")).agg(F.count("*").alias("n"))


def pred11_casing_classes(s, d):
    raw = F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}'-]+"), F.lit(0)))
    return B.sentences(s, d).select("lang", raw.alias("w")).where(F.col("w").rlike(r"^\p{L}+$")).groupBy("lang", X.casing_class(F.col("w")).alias("kind")).agg(F.count("*").alias("n"))


def pred12_contaminated(s, d):
    lex = B.words(s, d)
    return L.contaminated(lex.where("lang = 'pt'"), lex.where("lang = 'es'"), 2.0)


def pred13_ocr_errors(s, d):
    return L.ocr_errors(B.words(s, d), times=5)


def pred15_skewed_variants(s, d):
    return L.skewed_variants(B.words(s, d), "é", "e", 1.0)


def pred16_first_of_each(s, d):
    return C.first_of_each(table(s, d, "build_frames").where("sent_id IS NOT NULL"))


def pred17_without_words(s, d):
    lex = B.words(s, d)
    bare = lex.select("lang", "word").where(X.fold_accents(F.col("word")) != F.col("word")).select("lang", X.fold_accents(F.col("word")).alias("word")).distinct().join(lex, ["lang", "word"], "left_anti")
    return C.without_words(B.sentences(s, d), bare).groupBy("lang").agg(F.count("*").alias("n"))


def pred22_stretched(s, d):
    return C.unigrams(B.sentences(s, d)).where(X.is_stretched(F.col("word")))


def a23_a24_casing(s, d):
    return C.casing_flags(C.casing_counts(B.sentences(s, d)))


def a26_coverage(s, d):
    return C.coverage(B.sentences(s, d, heldout=True), B.words(s, d))


def a26_misses(s, d):
    return C.misses(B.sentences(s, d, heldout=True), B.words(s, d))


def a25_proper_only(s, d):
    counts = C.casing_counts(B.sentences(s, d))
    readings = counts.select("lang", "word", F.explode(F.array(F.col("lo") == 0, F.col("cap") > 0)).alias("is_name"))
    return L.proper_only(readings)


def a27_factored_priors(s, d):
    w = B.words(s, d).where(F.length("word") > 4).select("lang", "word", F.expr("substring(word, 1, length(word) - 2)").alias("lemma"), F.right("word", F.lit(2)).alias("slot"), "count")
    return L.factored_priors(w)


def f11_layout_flip(s, d):
    return B.words(s, d).select("lang", "word", X.flip_layout(F.col("word")).alias("flipped"), X.home_row(F.col("word")).alias("home"))


def f30_priors(s, d):
    return L.ranked(B.words(s, d)).select("lang", "word", "prior_milli", "rk")


def f31_quantised(s, d):
    p = L.priors(B.words(s, d)).withColumn("code", N.quantise(F.col("prior_milli")))
    return p.groupBy("lang", "code").agg(F.count("*").alias("n"), F.max(F.abs(N.dequantise(F.col("code")) - F.col("prior_milli"))).alias("worst"))


def f13_slang_forms(s, d):
    lex = B.words(s, d)
    slang = table(s, d, "slang").where("c2 IS NOT NULL AND NOT startswith(c0, '#')").select("lang", F.lower("c0").alias("word"), F.lower("c2").alias("model"), F.coalesce("c1", F.lit(0)).alias("count")).distinct()
    paradigm = lex.withColumn("stem", F.substring("word", 1, 7)).where(F.length("word") > 7).join(slang.select("lang", F.col("model").alias("lemma"), F.substring("model", 1, 7).alias("stem")).distinct(), ["lang", "stem"]).select("lang", "lemma", F.col("word").alias("form"))
    return L.inflect_by_analogy(slang, paradigm)


def f15_compounds(s, d):
    """German words, and those made of one twice with a linking s, cut into a known modifier and head."""
    lex = B.words(s, d).where("lang = 'de'")
    made = lex.select("lang", "word").union(lex.select("lang", F.concat("word", F.lit("s"), "word"))).distinct()
    return L.compounds(made, lex.where(F.length("word") >= 4))


NAMES = (f01_tokens_by_lang, f08_ending_classes, a01_lexicon, a02_summed_list, a03_unigrams_top, a03_pairs, a04_source_mixture, w01_neighbours, w03_bigrams_kept, a09_ending_pmi,
         a06_form_share, u01_union_lists, u02_only_in_slang, u05_overlay, pred01_charset, pred04_artifacts, pred05_06_kept_words, pred08_14_minority_spellings, pred09_yo_variants, pred10_scripts,
         pred11_casing_classes, pred12_contaminated, pred13_ocr_errors, pred15_skewed_variants, pred16_first_of_each, pred17_without_words, pred22_stretched, a23_a24_casing, a26_coverage, a26_misses,
         a25_proper_only, a27_factored_priors, f11_layout_flip, f30_priors, f31_quantised, f13_slang_forms, f15_compounds)


def sql() -> dict[str, str]:
    casing = lambda w: f"CASE WHEN {w} = lower({w}) THEN 'lower' WHEN {w} = upper({w}) AND length({w}) > 1 THEN 'upper' WHEN left({w}, 1) = upper(left({w}, 1)) AND substr({w}, 2) = lower(substr({w}, 2)) THEN 'cap' WHEN regexp_matches({w}, '^\\p{{Lu}}[\\p{{Ll}}]*([-''’]\\p{{Lu}}?[\\p{{Ll}}]*)+$') THEN 'compound' ELSE 'mixed' END"
    slang = f"sl AS (SELECT lang, lower(c0) AS word, max(c1) AS count FROM slang WHERE NOT starts_with(c0, '#') AND c1 >= 1 AND {B.is_word('lower(c0)')} GROUP BY ALL)"
    mixed = f"""{S}, {TOK}, {NB}, {LEX}, u0 AS (SELECT lang, source, word, count(*) AS n FROM tok SEMI JOIN lex USING (lang, word) GROUP BY ALL),
      unit AS (SELECT lang, source, coalesce(any_value(weight), 1.0) / sum(n) AS unit FROM u0 LEFT JOIN mix_targets USING (source) GROUP BY ALL),
      um AS (SELECT lang, word, sum(unit * n) AS mass, CAST(sum(n) AS BIGINT) AS raw FROM u0 JOIN unit USING (lang, source) GROUP BY ALL)"""
    bare = B.fold_accents("word")
    raw3 = f"r3 AS (SELECT lang, regexp_extract_all(text, '[\\p{{L}}''-]+|\\s+|.') AS t FROM s), ins AS (SELECT lang, t[i + 2] AS w FROM (SELECT lang, t, unnest(range(1, len(t) - 1)) AS i FROM r3) WHERE t[i + 1] = ' ' AND regexp_matches(t[i], '^\\p{{L}}') AND regexp_matches(t[i + 2], '^\\p{{L}}')), cc AS (SELECT lang, lower(w) AS word, count(*) FILTER (k = 'lower') AS lo, count(*) FILTER (k = 'cap') AS cap, count(*) FILTER (k = 'upper') AS caps FROM (SELECT lang, w, {casing('w')} AS k FROM ins) GROUP BY ALL)"
    flip = lambda c: f"translate({c}, {q(''.join(a + b for l, r in zip(X.LATIN_ROWS, X.CYRILLIC_ROWS) for a, b in zip(l, r)))}, {q(''.join(b + a for l, r in zip(X.LATIN_ROWS, X.CYRILLIC_ROWS) for a, b in zip(l, r)))})"
    homes = [(a, b) for l, h in (*zip(X.LATIN_ROWS, X.LATIN_HOMES), *zip(X.CYRILLIC_ROWS, X.CYRILLIC_HOMES)) for a, b in zip(l, h) if b != ";"]
    return {
        "f01_tokens_by_lang": f"WITH {S} SELECT lang, CAST(sum(len(t)) AS BIGINT) AS tokens, CAST(sum(len(list_filter(t, lambda x: {B.is_word('x')}))) AS BIGINT) AS words FROM s GROUP BY lang",
        "f08_ending_classes": f"WITH {S}, {TOK} SELECT lang, {B.left_class('word')} AS lclass, {B.right_class('word')} AS rclass, count(*) AS n FROM tok GROUP BY ALL",
        "a01_lexicon": f"WITH {LEX} SELECT * FROM lex",
        "a02_summed_list": f"SELECT lang, lower(w) AS word, CAST(sum(coalesce(c, 0)) AS BIGINT) AS count FROM lexicon WHERE {B.is_word('lower(w)')} GROUP BY ALL",
        "a03_unigrams_top": f"WITH {S}, {TOK} SELECT * FROM (SELECT lang, word, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS INTEGER) AS rk FROM (SELECT lang, word, count(*) AS n FROM tok GROUP BY ALL)) WHERE rk <= 50",
        "a03_pairs": f"WITH {S}, {TOK}, {NB}, {LEX}, {PAIRS} SELECT * FROM prs",
        "a04_source_mixture": f"WITH {mixed} SELECT lang, word, round(mass, 9) AS mass, raw FROM um",
        "w01_neighbours": f"WITH {S}, {NB} SELECT lang, prev, word, count(*) AS n FROM nb GROUP BY ALL HAVING count(*) >= 2",
        "w03_bigrams_kept": f"""WITH {mixed}, p0 AS (SELECT lang, source, prev, word, count(*) AS n FROM nb SEMI JOIN lex USING (lang, word) SEMI JOIN (SELECT lang, word AS prev FROM lex) p USING (lang, prev) GROUP BY ALL),
          pm AS (SELECT lang, prev, word, sum(unit * n) AS mass, sum(n) AS raw FROM p0 JOIN unit USING (lang, source) GROUP BY ALL HAVING sum(n) >= 3),
          us AS (SELECT *, CASE WHEN regexp_matches(word, '[а-яё]') THEN 'cyr' ELSE 'lat' END AS script FROM um), ms AS (SELECT lang, script, sum(mass) AS sm FROM us GROUP BY ALL),
          sc AS (SELECT pm.lang, pm.prev, pm.word, round(pm.mass / a.mass, 9) AS p, round(pm.mass / b.mass, 9) AS q, b.mass / ms.sm AS share FROM pm JOIN us a ON a.lang = pm.lang AND a.word = pm.prev JOIN us b ON b.lang = pm.lang AND b.word = pm.word JOIN ms ON ms.lang = pm.lang AND ms.script = b.script),
          kept AS (SELECT lang, prev, word, p FROM (SELECT *, row_number() OVER (PARTITION BY lang, prev ORDER BY p DESC, word) AS rl, row_number() OVER (PARTITION BY lang, word ORDER BY q DESC, prev) AS rr FROM sc WHERE round(ln(p) - ln(share), 6) >= 1) WHERE rl <= 64 OR rr <= 8),
          yo AS (SELECT lang, {B.fold_yo('prev')} AS prev, {B.fold_yo('word')} AS word, max(p) AS p FROM kept WHERE prev LIKE '%ё%' OR word LIKE '%ё%' GROUP BY ALL),
          rows AS (SELECT * FROM kept UNION ALL SELECT * FROM yo ANTI JOIN kept USING (lang, prev, word) SEMI JOIN lex USING (lang, word) SEMI JOIN (SELECT lang, word AS prev FROM lex) l USING (lang, prev))
          SELECT lang, prev, word, CAST(round_even(round(-ln(least(p, 1)) * 1000, 6), 0) AS INTEGER) AS nats_milli FROM rows""",
        "a09_ending_pmi": f"""WITH {S}, {TOK}, {NB}, {LEX}, {PAIRS}, r AS (SELECT lang, {B.right_class('word')} AS rclass, sum(n) AS r FROM uni GROUP BY ALL), b AS (SELECT lang, {B.left_class('prev')} AS lclass, {B.right_class('word')} AS rclass, sum(n) AS c FROM prs GROUP BY ALL), l AS (SELECT lang, lclass, sum(c) AS l FROM b GROUP BY ALL), t AS (SELECT lang, sum(r) AS total FROM r GROUP BY ALL)
          SELECT lang, lclass, rclass, CAST(round_even(round((greatest(-8, least(8, (ln(c / l) - ln(r / total)) * c / (c + 5.0))) + 8) * 1000, 6), 0) AS INTEGER) AS pmi8_milli FROM b JOIN l USING (lang, lclass) JOIN r USING (lang, rclass) JOIN t USING (lang) WHERE c >= 3""",
        "a06_form_share": f"""WITH f AS (SELECT lang, lower(w) AS word, left(lower(w), 5) AS lemma, max(coalesce(c, 0)) AS count FROM lexicon WHERE {B.is_word('lower(w)')} GROUP BY ALL)
          SELECT lang, word, CAST(greatest(count, CASE WHEN count > 0 THEN count ELSE greatest(1, round_even(round(0.02 * max(count) OVER (PARTITION BY lang, lemma), 6), 0)) END) AS BIGINT) AS count FROM f""",
        "u01_union_lists": f"WITH {LEX}, {slang} SELECT lang, word, max(count) AS count FROM (SELECT * FROM lex UNION ALL SELECT * FROM sl) GROUP BY ALL",
        "u02_only_in_slang": f"WITH {LEX}, {slang} SELECT * FROM sl ANTI JOIN lex USING (lang, word)",
        "u05_overlay": f"WITH {LEX}, {slang} SELECT lang, word, count, 0 AS src FROM lex UNION ALL SELECT lang, word, count, 1 FROM sl ANTI JOIN lex USING (lang, word)",
        "pred01_charset": f"SELECT lang, {B.is_word('lower(w)')} AS ok, count(*) AS n FROM lexicon WHERE w IS NOT NULL GROUP BY ALL",
        "pred04_artifacts": f"WITH {LEX} SELECT lang, word FROM lex WHERE regexp_matches(word, '^[''-]|[''-]$') OR starts_with(substr(word, 2), '-' || left(word, 1)) OR (regexp_matches(word, '^[\\p{{L}}\\p{{N}}_]{{2}}') AND starts_with(substr(word, 3), '-' || left(word, 2)))",
        "pred05_06_kept_words": f"""WITH {LEX}, al AS (SELECT DISTINCT lang, lower(c0) AS word FROM slang WHERE c1 >= 1 AND {B.is_word('lower(c0)')}), vb AS (SELECT lang, word FROM lex WHERE regexp_matches(word, '(ть|ти|чь|ться|тись|чься)$'))
          SELECT lang, word, count FROM lex WHERE (lang, word) IN (SELECT (lang, word) FROM al) OR (count >= 20 AND NOT (regexp_matches(word, '^[''-]|[''-]$') OR starts_with(substr(word, 2), '-' || left(word, 1)) OR (regexp_matches(word, '^[\\p{{L}}\\p{{N}}_]{{2}}') AND starts_with(substr(word, 3), '-' || left(word, 2))))
            AND word NOT IN ({', '.join(map(q, L.GLUED))}) AND NOT regexp_matches(word, {q(L.HYPHENLESS)}) AND NOT (starts_with(word, 'не') AND (lang, substr(word, 3)) IN (SELECT (lang, word) FROM vb)))""",
        "pred08_14_minority_spellings": f"WITH {LEX} SELECT lang, word, major FROM (SELECT lang, word, first_value(word) OVER (PARTITION BY lang, {bare} ORDER BY count DESC, word DESC) AS major FROM lex) WHERE word <> major",
        "pred09_yo_variants": f"WITH {LEX} SELECT lang, word, max(count) AS count FROM (SELECT * FROM lex UNION ALL SELECT lang, {B.fold_yo('word')}, count FROM lex WHERE word LIKE '%ё%') GROUP BY ALL",
        "pred10_scripts": f"WITH {LEX} SELECT lang, CASE WHEN regexp_matches(word, '[а-яё]') THEN 'cyr' ELSE 'lat' END AS script, count(*) AS n FROM lex GROUP BY ALL",
        "pred11_casing_classes": f"WITH {S}, w AS (SELECT lang, unnest(regexp_extract_all(text, '[\\p{{L}}''-]+')) AS w FROM s) SELECT lang, {casing('w')} AS kind, count(*) AS n FROM w WHERE regexp_matches(w, '^\\p{{L}}+$') GROUP BY ALL",
        "pred12_contaminated": f"WITH {LEX} SELECT a.word, a.count AS own_n, b.count AS foreign_n FROM lex a JOIN lex b USING (word) WHERE a.lang = 'pt' AND b.lang = 'es' AND b.count >= 2 * a.count",
        "pred13_ocr_errors": f"WITH {LEX}, k AS (SELECT lang, word, count, left(word, i - 1) || '_' || substr(word, i + 1) AS key FROM (SELECT *, CAST(unnest(range(1, length(word) + 1)) AS INTEGER) AS i FROM lex)), b AS (SELECT lang, key, max(count) AS best FROM k GROUP BY ALL) SELECT lang, word, count, max(best) AS best FROM k JOIN b USING (lang, key) WHERE best >= 5 * count GROUP BY ALL",
        "pred15_skewed_variants": f"WITH {LEX} SELECT a.lang, a.word, b.word AS variant, a.count, b.count AS other FROM lex a JOIN lex b ON a.lang = b.lang AND b.word = replace(a.word, 'é', 'e') WHERE a.word LIKE '%é%' AND a.count >= b.count",
        "pred16_first_of_each": "WITH k AS (SELECT DISTINCT sent_id, regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', '', 'g') AS key FROM build_frames WHERE sent_id IS NOT NULL) SELECT sent_id, bool_or(sent_id = least_id) AS kept FROM k JOIN (SELECT key, min(sent_id) AS least_id FROM k GROUP BY key) USING (key) GROUP BY sent_id",
        "pred17_without_words": f"WITH {S}, {TOK}, {LEX}, ban AS (SELECT DISTINCT lang, {bare} AS word FROM lex WHERE {bare} <> word), b2 AS (SELECT * FROM ban ANTI JOIN lex USING (lang, word)), hit AS (SELECT DISTINCT sent_id FROM tok SEMI JOIN b2 USING (lang, word)) SELECT lang, count(*) AS n FROM s ANTI JOIN hit USING (sent_id) GROUP BY lang",
        "pred22_stretched": f"WITH {S}, {TOK} SELECT lang, word, count(*) AS n FROM tok WHERE len(list_filter(range(1, length(word) - 1), lambda i: substr(word, i, 1) = substr(word, i + 1, 1) AND substr(word, i, 1) = substr(word, i + 2, 1))) > 0 OR (length(word) = 2 AND left(word, 1) = right(word, 1)) GROUP BY ALL",
        "a23_a24_casing": f"WITH {S}, {raw3} SELECT *, CASE WHEN lo + cap + caps >= 5 AND caps >= 0.8 * (lo + cap + caps) THEN 2 WHEN lo + cap + caps >= 5 AND cap + caps >= 0.8 * (lo + cap + caps) THEN 1 ELSE 0 END AS flag FROM cc",
        "a26_coverage": f"WITH {B.frames_sql('s', True)}, {TOK}, {LEX} SELECT tok.lang, count(*) AS tokens, count(lex.word) AS hits, count(*) FILTER ({B.fold_accents('tok.word')} <> tok.word) AS accented, count(lex.word) FILTER ({B.fold_accents('tok.word')} <> tok.word) AS accented_hits, round(count(lex.word) / count(*), 6) AS coverage FROM tok LEFT JOIN lex ON lex.lang = tok.lang AND lex.word = tok.word GROUP BY tok.lang",
        "a26_misses": f"WITH {B.frames_sql('s', True)}, {TOK}, {LEX} SELECT * FROM (SELECT lang, word, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS INTEGER) AS rk FROM (SELECT lang, word, count(*) AS n FROM tok ANTI JOIN lex USING (lang, word) GROUP BY ALL)) WHERE rk <= 20",
        "a25_proper_only": f"WITH {S}, {raw3} SELECT lang, word FROM cc WHERE lo = 0 AND cap > 0",
        "a27_factored_priors": f"""WITH {LEX}, w AS (SELECT lang, word, left(word, length(word) - 2) AS lemma, right(word, 2) AS slot, count FROM lex WHERE length(word) > 4), l AS (SELECT lang, lemma, sum(count) AS lc FROM w GROUP BY ALL), t AS (SELECT lang, sum(count) AS total FROM w GROUP BY ALL), o AS (SELECT lang, slot, sum(count) AS used, sum(lc) AS offered FROM w JOIN l USING (lang, lemma) GROUP BY ALL),
          m AS (SELECT lang, word, lemma, slot, count, round(round((ln(total) - ln(lc + 0.5)) / 0.05, 6)) * 0.05 + round(round(-ln((used + 0.5) / (offered + 1)) / 0.05, 6)) * 0.05 AS made, ln(total) - ln(count + 0.5) AS tru FROM w JOIN l USING (lang, lemma) JOIN o USING (lang, slot) JOIN t USING (lang)),
          x AS (SELECT lang, word, lemma, slot, CAST(round(made * 1000) AS INTEGER) AS milli, round(count * abs(made - tru), 3) AS loss FROM m) SELECT *, row_number() OVER (PARTITION BY lang ORDER BY loss DESC, word, slot) <= 1000 AS exact FROM x""",
        "f11_layout_flip": f"WITH {LEX} SELECT lang, word, {flip('word')} AS flipped, translate(word, {q(''.join(a for a, _ in homes))}, {q(''.join(b for _, b in homes))}) AS home FROM lex",
        "f30_priors": f"WITH {LEX}, {PRIOR} SELECT lang, word, prior_milli, CAST(row_number() OVER (PARTITION BY lang ORDER BY count DESC, word) AS INTEGER) AS rk FROM pri",
        "f31_quantised": f"WITH {LEX}, {PRIOR} SELECT lang, CAST((prior_milli + 25) // 50 AS INTEGER) AS code, count(*) AS n, CAST(max(abs((prior_milli + 25) // 50 * 50 - prior_milli)) AS INTEGER) AS worst FROM pri GROUP BY ALL",
        "f15_compounds": f"""WITH {LEX}, h AS (SELECT word FROM lex WHERE lang = 'de' AND length(word) >= 4), cw AS (SELECT word FROM lex WHERE lang = 'de' UNION SELECT word || 's' || word FROM lex WHERE lang = 'de'), c AS (SELECT word, left(word, i) AS modifier, substr(word, i + 1) AS head FROM (SELECT word, CAST(unnest(range(4, length(word) - 3)) AS INTEGER) AS i FROM cw)), v AS (SELECT DISTINCT word, head, unnest([modifier, regexp_replace(modifier, 's$', '')]) AS modifier FROM c WHERE head IN (FROM h))
          SELECT 'de' AS lang, word, modifier, head FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY length(head) DESC, length(modifier) DESC) AS rn FROM v WHERE modifier IN (FROM h)) WHERE rn = 1""",
    }
