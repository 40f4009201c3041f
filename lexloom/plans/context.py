"""Queries over models of context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..data import COMMA_SURE, GERUND_IDIOMS
from ..functions import numbers as N
from ..functions import text as X
from ..operators import context as K
from ..operators import corpus as C
from ..tables import table
from . import base as B
from . import index as I
from .base import LEX, NB, PAIRS, S, TOK, q


def j08_confusions(s, d):
    return I.space(s, d, "confusions")


def _spelled(s, d):
    """The lexicon with Russian verbs in -ся and -ься beside those in -т, and words without their accents."""
    words = B.words(s, d)
    verbs = words.where("lang = 'ru' AND word LIKE '%т'").select("lang", F.explode(F.array(F.struct(F.concat("word", F.lit("ся")).alias("word"), "count"), F.struct(F.concat("word", F.lit("ься")).alias("word"), (F.col("count") + 1).alias("count")))).alias("z")).select("lang", "z.word", "z.count")
    bare = words.select("lang", X.fold_accents(F.col("word")).alias("word"), (F.col("count") + 100).alias("count")).where("lang <> 'ru'")
    return words.unionByName(verbs).unionByName(bare).groupBy("lang", "word").agg(F.max("count").alias("count"))


def j10_spelling_pairs(s, d):
    return K.spelling_pairs(_spelled(s, d), I.space(s, d, "confusions"))


def j09_accent_groups(s, d):
    words = _spelled(s, d)
    return K.accent_groups(words, K.spelling_pairs(words, I.space(s, d, "confusions")))


def _observed(s, d):
    return K.observations(B.sentences(s, d), I.space(s, d, "confusions"))


def a21_observations(s, d):
    return _observed(s, d).select("lang", "a", "b", "truth", F.explode("features").alias("feature")).groupBy("lang", "a", "b", "truth", "feature").agg(F.count("*").alias("n"))


def a22_decision_list(s, d):
    return I.space(s, d, "rules")


def l18_evidence(s, d):
    obs, rules = _observed(s, d), I.space(s, d, "rules")
    typed = obs.select("lang", F.concat_ws(":", "id", "pos", "a", "b").alias("id"), F.col("truth").alias("typed"), F.when(F.col("truth") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("alt"), F.get(F.filter("features", lambda f: f.startswith("w+1=")), 0).alias("f")).where("f IS NOT NULL")
    return K.evidence(typed.select("lang", "id", "typed", "alt", F.expr("substring(f, 5)").alias("next")), rules)


def w04_gaps(s, d):
    return K.gaps(B.sentences(s, d)).groupBy("lang", "comma", "first", "and_before").agg(F.count("*").alias("n"))


def _commas(s, d):
    return I.space(s, d, "commas")


def a13_comma_logits(s, d):
    return _commas(s, d)


def l20_comma_odds(s, d):
    return K.comma_odds(K.bare_gaps(B.sentences(s, d, heldout=True)), _commas(s, d))


def d09_commas_to_put(s, d):
    odds = K.comma_odds(K.bare_gaps(B.sentences(s, d, heldout=True)), _commas(s, d))
    return odds.where((F.col("odds_milli") >= round(COMMA_SURE * 1000)) & ~F.col("b").isin(*[g for g, _ in GERUND_IDIOMS])).select("lang", "a", "b", "odds_milli")


def a10_a12_class_pairs(s, d):
    return I.space(s, d, "topics")


def a11_ppmi(s, d):
    pairs = C.pair_counts(B.sentences(s, d)).where("n >= 3").select(F.concat_ws(":", "lang", "prev").alias("prev"), F.concat_ws(":", "lang", "word").alias("word"), "n")
    return K.ppmi(pairs, "prev", "word", "n")


def a08_tag_pairs(s, d):
    return I.space(s, d, "tag_pairs")


def a16_a17_frames(s, d):
    rows = I.space(s, d, "frames")
    return rows.select("lang", "key", F.posexplode("values").alias("i", "v")).select("lang", "key", "i", F.bround(F.round(F.col("v") * 1000, 3), 0).cast("int").alias("milli"))


def a18_agreement(s, d):
    pairs = C.pair_counts(B.sentences(s, d))
    return K.agree_shares(pairs.select("lang", F.col("prev").alias("key"), (F.right("prev", F.lit(1)) == F.right("word", F.lit(1))).alias("agrees"), "n"))


def a19_kind_fit(s, d):
    pairs = C.pair_counts(B.sentences(s, d)).select(F.concat_ws(":", "lang", F.right("prev", F.lit(1))).alias("left"), F.concat_ws(":", "lang", F.right("word", F.lit(1))).alias("right"), "n")
    return K.kind_fit(pairs).withColumnsRenamed({"left": "l", "right": "r"})


def f33_pair_nats(s, d):
    pairs, uni = C.pair_counts(B.sentences(s, d)).where("n >= 3"), C.unigrams(B.sentences(s, d)).withColumnsRenamed({"word": "prev", "n": "n_prev"})
    return pairs.join(uni, ["lang", "prev"]).select("lang", "prev", "word", N.nats_milli(F.col("n") / F.col("n_prev")).alias("nats_milli"), N.quant05(-F.ln(F.col("n") / F.col("n_prev"))).alias("byte"))


def j03_pair_masses(s, d):
    """Pairs with the counts of both words and of all words in the right one's script."""
    uni = C.unigrams(B.sentences(s, d))
    script = uni.groupBy("lang", X.script(F.col("word")).alias("script")).agg(F.sum("n").alias("n_script"))
    of = lambda name, n: uni.select("lang", F.col("word").alias(name), F.col("n").alias(n))
    pairs = C.pair_counts(B.sentences(s, d)).where("n >= 2").withColumn("script", X.script(F.col("word")))
    return pairs.join(of("prev", "n_prev"), ["lang", "prev"]).join(of("word", "n_word"), ["lang", "word"]).join(F.broadcast(script), ["lang", "script"]).select("lang", "prev", "word", "n", "n_prev", "n_word", "n_script")


NAMES = (j08_confusions, j10_spelling_pairs, j09_accent_groups, a21_observations, a22_decision_list, l18_evidence, w04_gaps, a13_comma_logits, l20_comma_odds, d09_commas_to_put, a10_a12_class_pairs, a11_ppmi,
         a08_tag_pairs, a16_a17_frames, a18_agreement, a19_kind_fit, f33_pair_nats, j03_pair_masses)


def sql() -> dict[str, str]:
    near = "near(x, y) AS (VALUES " + ", ".join(f"({q(a)}, {q(b)})" for a, b in K.near_keys()) + ")"
    fa = B.fold_accents
    top = f"{LEX}, tw AS (SELECT * FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count DESC, word) AS rk FROM lex))"
    conf = f"""{top}, {near}, hl AS (SELECT *, substr(word, i, 1) AS ch, left(word, i - 1) || '_' || substr(word, i + 1) AS key FROM (SELECT *, CAST(unnest(range(1, length(word) + 1)) AS INTEGER) AS i FROM tw)),
      mt AS (SELECT l.lang, l.word AS a, r.word AS b, l.ch AS x, r.ch AS y FROM hl l JOIN hl r ON l.lang = r.lang AND l.key = r.key AND l.rk < r.rk),
      db AS (SELECT h.lang, h.word AS long, h.rk AS rl, t.word, t.rk FROM hl h JOIN tw t ON t.lang = h.lang AND t.word = left(h.word, h.i - 1) || substr(h.word, h.i + 1) WHERE substr(h.word, h.i + 1, 1) = h.ch),
      conf AS (SELECT lang, a, b FROM mt WHERE (x, y) IN (FROM near) OR ({fa('x')} = {fa('y')} AND ({fa('x')} = x OR {fa('y')} = y)) UNION SELECT lang, CASE WHEN rl < rk THEN long ELSE word END, CASE WHEN rl < rk THEN word ELSE long END FROM db)"""
    wm = f"wm AS (SELECT sent_id, lang, list_filter(t, lambda x: NOT regexp_matches(x, '^\\s+$')) AS t FROM s)"
    w = lambda c: f"regexp_matches({c}, '^[\\p{{L}}''-]')"
    obs = f"""{S}, {wm}, {conf}, pl AS (SELECT lang, sent_id, i, t[i] AS truth, CASE WHEN i > 1 THEN t[i - 1] END AS p1, CASE WHEN i > 2 THEN t[i - 2] END AS p2, t[i + 1] AS n1 FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM wm)),
      ob AS (SELECT lang, a, b, truth, sent_id, i, unnest(list_filter([CASE WHEN p1 IS NULL THEN 'bos' WHEN NOT {w('p1')} THEN 'p-1=' || p1 ELSE 'w-1=' || p1 END, CASE WHEN {w('p1')} AND {w('p2')} THEN 'w-2=' || p2 END, CASE WHEN n1 IS NULL OR n1 IN ('.', '!', '?') THEN 'eos' WHEN {w('n1')} THEN 'w+1=' || n1 END], lambda x: x IS NOT NULL)) AS feature
        FROM pl JOIN (SELECT lang, a, b, unnest([a, b]) AS truth FROM conf) USING (lang, truth) WHERE {w('truth')})"""
    rules = f"""{obs}, o1 AS (SELECT lang, a, b, truth FROM pl JOIN (SELECT lang, a, b, unnest([a, b]) AS truth FROM conf) USING (lang, truth) WHERE {w('truth')}), tot AS (SELECT lang, a, b, count(*) FILTER (truth = a) AS na, count(*) FILTER (truth <> a) AS nb FROM o1 GROUP BY ALL HAVING count(*) FILTER (truth = a) > 0 AND count(*) FILTER (truth <> a) > 0),
      ft AS (SELECT lang, a, b, feature, count(*) FILTER (truth = a) AS ca, count(*) FILTER (truth <> a) AS cb FROM ob WHERE starts_with(feature, 'w+1=') GROUP BY ALL HAVING count(*) >= 3),
      sc AS (SELECT *, round(ln((ca + 0.5) / (na + 1.0)) - ln((cb + 0.5) / (nb + 1.0)), 6) AS llr FROM ft JOIN tot USING (lang, a, b)),
      rl AS (SELECT lang, a, b, feature, CASE WHEN llr > 0 THEN a ELSE b END AS word, CAST(round_even(least(abs(llr), 6) * 1000, 0) AS INTEGER) AS strength_milli FROM (SELECT *, row_number() OVER (PARTITION BY lang, a, b ORDER BY abs(llr) DESC, feature DESC) AS rn FROM sc WHERE abs(llr) >= 1 AND CASE WHEN llr > 0 THEN ca ELSE cb END >= 2) WHERE rn <= 20)"""
    iw = B.is_word

    def gaps(held: bool) -> str:
        return f"""{B.frames_sql('s', held)}, {wm}, g0 AS (SELECT lang, sent_id, i, t, t[i] AS a FROM (SELECT *, CAST(unnest(range(1, len(t) + 1)) AS INTEGER) AS i FROM wm) WHERE {iw('t[i]')}),
          g1 AS (SELECT lang, sent_id, i, a, CASE WHEN t[i + 1] = ',' AND {iw('t[i + 2]')} THEN t[i + 2] WHEN {iw('t[i + 1]')} THEN t[i + 1] END AS b, coalesce(t[i + 1] = ',' AND {iw('t[i + 2]')}, false) AS comma,
            coalesce(list_filter(back, lambda x: x IN ('.', '!', '?') OR {iw('x')})[-1], '.') IN ('.', '!', '?') AS first,
            list_contains(w[greatest(1, len(w) - 2):], 'и') AS and_before FROM (SELECT *, list_filter(back[coalesce(list_last(list_filter(range(1, len(back) + 1), lambda k: back[k] IN (',', '.', '!', '?'))), 0) + 1:], lambda x: {iw('x')}) AS w FROM (SELECT *, t[1:i - 1] AS back FROM g0))),
          g AS (SELECT * FROM g1 WHERE b IS NOT NULL)"""

    lo = lambda k, n, p: f"ln((({k} + 5 * {p}) / ({n} + 5.0)) / (1 - ({k} + 5 * {p}) / ({n} + 5.0)))"
    r3 = lambda v: f"CAST(round_even(round({v} * 1000, 6), 0) AS INTEGER)"
    commas = f"""bs AS (SELECT lang, p, ln(p / (1 - p)) AS base FROM (SELECT lang, count(*) FILTER (comma) / count(*) AS p FROM g GROUP BY lang) WHERE p > 0 AND p < 1),
      sb AS (SELECT lang, b AS w, {lo('count(*) FILTER (comma)', 'count(*)', 'any_value(p)')} AS v, any_value(base) AS base FROM g JOIN bs USING (lang) GROUP BY ALL HAVING count(*) >= 10),
      sa AS (SELECT lang, a AS w, {lo('count(*) FILTER (comma)', 'count(*)', 'any_value(p)')} AS v, any_value(base) AS base FROM g JOIN bs USING (lang) GROUP BY ALL HAVING count(*) >= 10),
      sp AS (SELECT lang, a, b, {lo('count(*) FILTER (comma)', 'count(*)', 'any_value(p)')} AS v, any_value(base) AS base FROM g JOIN bs USING (lang) GROUP BY ALL HAVING count(*) >= 10),
      ct AS (SELECT lang, '@' AS key, {r3('base')} AS logit_milli FROM bs UNION ALL SELECT lang, '>' || w, {r3('v')} FROM sb WHERE round(abs(v - base), 6) >= 0.5 UNION ALL SELECT lang, '<' || w, {r3('v')} FROM sa WHERE round(abs(v - base), 6) >= 0.5
        UNION ALL SELECT sp.lang, a || ' ' || b, {r3('sp.v')} FROM sp LEFT JOIN sb ON sb.lang = sp.lang AND sb.w = sp.b LEFT JOIN sa ON sa.lang = sp.lang AND sa.w = sp.a WHERE round(abs(sp.v - (sp.base + coalesce(sb.v - sp.base, 0) + coalesce(sa.v - sp.base, 0))), 6) >= 1)"""
    odds = f"""WITH {gaps(False)}, {commas}, {gaps(True).replace('s AS (', 'hs AS (', 1).replace('FROM s)', 'FROM hs)').replace(' FROM s)', ' FROM hs)').replace('wm AS', 'hwm AS').replace('FROM wm)', 'FROM hwm)').replace('FROM s', 'FROM hs').replace('g0', 'hg0').replace('g1', 'hg1').replace(' g AS', ' hg AS')},
      od AS (SELECT DISTINCT p.lang, p.a, p.b, coalesce(vp.logit_milli, coalesce(va.logit_milli, v0.logit_milli) + coalesce(vb.logit_milli, v0.logit_milli) - v0.logit_milli) AS odds_milli FROM (SELECT DISTINCT lang, a, b FROM hg) p JOIN ct v0 ON v0.lang = p.lang AND v0.key = '@'
        LEFT JOIN ct vp ON vp.lang = p.lang AND vp.key = {B.fold_yo('p.a')} || ' ' || {B.fold_yo('p.b')} LEFT JOIN ct va ON va.lang = p.lang AND va.key = '<' || {B.fold_yo('p.a')} LEFT JOIN ct vb ON vb.lang = p.lang AND vb.key = '>' || {B.fold_yo('p.b')})"""
    spelled = f"""sp0 AS (SELECT lang, word, max(count) AS count FROM (SELECT * FROM lex UNION ALL SELECT lang, word || 'ся', count FROM lex WHERE lang = 'ru' AND word LIKE '%т' UNION ALL SELECT lang, word || 'ься', count + 1 FROM lex WHERE lang = 'ru' AND word LIKE '%т' UNION ALL SELECT lang, {fa('word')}, count + 100 FROM lex WHERE lang <> 'ru') GROUP BY ALL),
      tv AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY count DESC, word) AS rk FROM sp0)"""
    spell = f"""WITH {conf}, {spelled}, pr AS (SELECT 'ru' AS lang, * FROM (VALUES {', '.join(f'({q(a)}, {q(b)})' for a, b in K.PREPOSITIONS)}) v(x, y) UNION ALL SELECT lang, word, regexp_replace(word, 'тся$', 'ться') FROM tv WHERE word LIKE '%тся' AND lang = 'ru'),
          rk AS (SELECT DISTINCT pr.lang, CASE WHEN a.rk < b.rk THEN x ELSE y END AS a, CASE WHEN a.rk < b.rk THEN y ELSE x END AS b FROM pr JOIN tv a ON a.lang = pr.lang AND a.word = x JOIN tv b ON b.lang = pr.lang AND b.word = y) SELECT * FROM rk ANTI JOIN (SELECT lang, a, b FROM conf UNION SELECT lang, b, a FROM conf) c USING (lang, a, b)"""
    return {
        "j08_confusions": f"WITH {conf} SELECT DISTINCT * FROM conf",
        "j10_spelling_pairs": spell,
        "j09_accent_groups": f"WITH {LEX}, {spelled}, g AS (SELECT lang, word, count, {fa('word')} AS bare FROM sp0 WHERE count >= 100 AND length(word) >= 3), sp AS ({spell}) SELECT x.lang, x.word AS a, y.word AS b FROM g x JOIN g y ON x.lang = y.lang AND x.bare = y.bare AND (x.count > y.count OR (x.count = y.count AND x.word > y.word)) ANTI JOIN (SELECT lang, a, b FROM sp UNION SELECT lang, b, a FROM sp) c ON c.lang = x.lang AND c.a = x.word AND c.b = y.word",
        "a21_observations": f"WITH {obs} SELECT lang, a, b, truth, feature, count(*) AS n FROM ob GROUP BY ALL",
        "a22_decision_list": f"WITH {rules} SELECT * FROM rl",
        "l18_evidence": f"""WITH {rules}, ty AS (SELECT DISTINCT lang, a, b, sent_id || ':' || (i - 1) || ':' || a || ':' || b AS id, CASE WHEN truth = a THEN b ELSE a END AS alt, feature FROM ob WHERE starts_with(feature, 'w+1='))
          , ev AS (SELECT id, CASE WHEN word = alt THEN strength_milli ELSE -strength_milli END AS v FROM ty JOIN rl USING (lang, a, b, feature) UNION ALL SELECT id, 6000 FROM ty WHERE alt = 'об' AND 'о' IN (a, b) AND regexp_matches(feature, '^w.1=[аоуэиы]'))
          SELECT id, CAST(arg_max(v, (abs(v), v)) AS INTEGER) AS for_alt FROM ev GROUP BY id""",
        "w04_gaps": f"WITH {gaps(False)} SELECT lang, comma, first, and_before, count(*) AS n FROM g GROUP BY ALL",
        "a13_comma_logits": f"WITH {gaps(False)}, {commas} SELECT * FROM ct",
        "l20_comma_odds": f"{odds} SELECT * FROM od",
        "d09_commas_to_put": f"{odds} SELECT * FROM od WHERE odds_milli >= {round(COMMA_SURE * 1000)} AND b NOT IN ({', '.join(q(g) for g, _ in GERUND_IDIOMS)})",
        "a10_a12_class_pairs": f"""WITH {S}, {TOK}, {LEX}, bg AS (SELECT DISTINCT sent_id, tok.lang || ':' || left(tok.word, 2) AS cls FROM tok JOIN lex USING (lang, word)), sv AS (SELECT * FROM bg WHERE sent_id IN (SELECT sent_id FROM bg GROUP BY 1 HAVING count(*) > 1)), n AS (SELECT count(DISTINCT sent_id) AS n FROM sv), sg AS (SELECT cls, count(*) AS s FROM sv GROUP BY 1),
          pr AS (SELECT x.cls AS a, y.cls AS b, count(*) AS c FROM sv x JOIN sv y ON x.sent_id = y.sent_id AND x.cls < y.cls GROUP BY ALL HAVING count(*) >= 20), pm AS (SELECT a, b, c, round(ln(CAST(c AS DOUBLE) * n / (x.s * y.s)) * c / (c + 20), 6) AS pmi FROM pr JOIN sg x ON x.cls = a JOIN sg y ON y.cls = b, n)
          SELECT a, b, c, CAST(round_even(pmi * 1000, 0) AS INTEGER) AS pmi_milli FROM pm WHERE abs(pmi) >= 0.3""",
        "a11_ppmi": f"WITH {S}, {NB}, p AS (SELECT lang || ':' || prev AS prev, lang || ':' || word AS word, count(*) AS n FROM nb GROUP BY ALL HAVING count(*) >= 3) SELECT prev, word, round(greatest(ln(CAST(n AS DOUBLE) * sum(n) OVER () / (CAST(sum(n) OVER (PARTITION BY prev) AS DOUBLE) * sum(n) OVER (PARTITION BY word))), 0), 6) AS ppmi FROM p",
        "a08_tag_pairs": f"""WITH {S}, {TOK}, {NB}, {LEX}, {PAIRS}, tg AS (SELECT lang, word, list_distinct(['*' || right(word, 1), '*' || right(word, 2)]) AS tags FROM lex), b AS (SELECT p.lang, l.ltag, r.rtag, sum(n * (1.0 / l.k) * (1.0 / r.k)) AS c FROM prs p JOIN (SELECT lang, word AS prev, unnest(tags) AS ltag, len(tags) AS k FROM tg) l USING (lang, prev) JOIN (SELECT lang, word, unnest(tags) AS rtag, len(tags) AS k FROM tg) r USING (lang, word) GROUP BY ALL)
          SELECT lang, ltag, rtag, CAST(round_even(round((greatest(-8, least(8, (ln(CAST(c AS DOUBLE) / l) - ln(CAST(r AS DOUBLE) / total)) * CAST(c AS DOUBLE) / (c + 5.0))) + 8) * 1000, 6), 0) AS INTEGER) AS pmi8_milli FROM (SELECT lang, ltag, rtag, CAST(c AS DOUBLE) AS c, CAST(sum(c) OVER (PARTITION BY lang, ltag) AS DOUBLE) AS l, CAST(sum(c) OVER (PARTITION BY lang, rtag) AS DOUBLE) AS r, CAST(sum(c) OVER (PARTITION BY lang) AS DOUBLE) AS total FROM b) WHERE round(c, 6) >= 1""",
        "a16_a17_frames": f"""WITH {S}, {NB}, p AS (SELECT lang, prev AS key, greatest(coalesce(list_position([{', '.join(map(q, I.OUTCOMES))}], {fa('right(word, 1)')}), 1) - 1, 0) AS o, count(*) AS n FROM nb GROUP BY ALL), kk AS (SELECT lang, key, sum(n) AS n FROM p GROUP BY ALL HAVING sum(n) >= 50), sh AS (SELECT l.lang, i, greatest(coalesce(sum(p.n), 0) / any_value(l.total), 1e-6) AS pr FROM (SELECT lang, sum(n) AS total FROM p GROUP BY 1) l CROSS JOIN (SELECT unnest(range(8)) AS i) LEFT JOIN p ON p.lang = l.lang AND p.o = i GROUP BY l.lang, i),
          v AS (SELECT kk.lang, kk.key, i, round(ln((coalesce(x.n, 0) + 20 * pr) / (kk.n + 20) / pr), 3) AS v FROM kk JOIN sh ON sh.lang = kk.lang LEFT JOIN (SELECT lang, key, o, sum(n) AS n FROM p GROUP BY ALL) x ON x.lang = kk.lang AND x.key = kk.key AND x.o = i)
          SELECT lang, key, CAST(i AS INTEGER) AS i, CAST(round_even(round(v * 1000, 3), 0) AS INTEGER) AS milli FROM (SELECT *, max(abs(v)) OVER (PARTITION BY lang, key) AS m FROM v) WHERE round(m, 3) >= 0.3""",
        "a18_agreement": f"""WITH {S}, {NB}, c AS (SELECT lang, prev AS key, count(*) FILTER (right(prev, 1) = right(word, 1)) AS yes, count(*) AS n FROM nb GROUP BY ALL), g AS (SELECT lang, sum(yes) / sum(n) AS p FROM c GROUP BY lang HAVING sum(yes) > 0 AND sum(yes) < sum(n))
          SELECT lang, key, {r3('ln((yes + 20 * p) / (n + 20) / p)')} AS agree_milli, {r3('ln((n - yes + 20 * (1 - p)) / (n + 20) / (1 - p))')} AS disagree_milli FROM c JOIN g USING (lang)""",
        "a19_kind_fit": f"WITH {S}, {NB}, p AS (SELECT lang || ':' || right(prev, 1) AS l, lang || ':' || right(word, 1) AS r, count(*) AS n FROM nb GROUP BY ALL) SELECT l, r, n, {r3('ln(CAST(n AS DOUBLE) * sum(n) OVER () / (CAST(sum(n) OVER (PARTITION BY l) AS DOUBLE) * sum(n) OVER (PARTITION BY r)))')} AS fit_milli FROM p",
        "f33_pair_nats": f"WITH {S}, {TOK}, {NB}, p AS (SELECT lang, prev, word, count(*) AS n FROM nb GROUP BY ALL HAVING count(*) >= 3), u AS (SELECT lang, word AS prev, count(*) AS np FROM tok GROUP BY ALL) SELECT lang, prev, word, {r3('-ln(least(n / np, 1))')} AS nats_milli, CAST(greatest(0, least(255, round(round(-ln(n / np) / 0.05, 9)) + 128)) AS INTEGER) AS byte FROM p JOIN u USING (lang, prev)",
        "j03_pair_masses": f"WITH {S}, {TOK}, {NB}, u AS (SELECT lang, word, count(*) AS n FROM tok GROUP BY ALL), sc AS (SELECT lang, regexp_matches(word, '[а-яё]') AS cyr, CAST(sum(n) AS BIGINT) AS n_script FROM u GROUP BY ALL), p AS (SELECT lang, prev, word, count(*) AS n FROM nb GROUP BY ALL HAVING count(*) >= 2) SELECT p.lang, prev, p.word, p.n, l.n AS n_prev, r.n AS n_word, n_script FROM p JOIN u l ON l.lang = p.lang AND l.word = p.prev JOIN u r ON r.lang = p.lang AND r.word = p.word JOIN sc ON sc.lang = p.lang AND cyr = regexp_matches(p.word, '[а-яё]')",
    }
