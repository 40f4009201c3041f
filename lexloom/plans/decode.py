"""Queries over typed strings, facts, and measures."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..data import ABOVE_SPACE, ONE_LETTER_WORDS
from ..operators import context as K
from ..operators import corpus as C
from ..operators import decode as D
from ..operators import evaluate as E
from ..operators import graph as G
from ..operators import lexicon as L
from ..operators import rerank as R
from ..operators import vectors as V
from ..operators.channel import ALPHABET
from ..operators.place import place
from ..tables import ready, table
from . import base as B
from . import index as I
from .base import LEX, NB, PAIRS, PRIOR, S, TOK, q


def _lex(s, d):
    return I.space(s, d, "dictionary")


def e01_typos(s, d):
    return E.typos(B.words(s, d))


def e02_bands(s, d):
    return E.bands(L.ranked(B.words(s, d))).groupBy("lang", "band").agg(F.count("*").alias("n"), F.max("prior_milli").alias("dearest"))


def _asked(s, d):
    """Errors of the word of every lexicon row whose id is divisible by 20: the stated query set for searches."""
    rows = table(s, d, "lexicon").where("word_id % 20 = 0").select("lang", F.lower("w").alias("word"))
    return E.typos(_lex(s, d).join(rows, ["lang", "word"], "left_semi")).withColumn("qid", F.xxhash64("lang", "word", "kind"))


def _every(s, d):
    """Errors of every word of the dictionary."""
    return E.typos(_lex(s, d)).withColumn("qid", F.xxhash64("lang", "word", "kind"))


def l04_suggest(s, d):
    return D.suggest(_every(s, d).select("qid", "lang", "typed"), _lex(s, d)).select("lang", "typed", "word", "edit", "cost", "rk").distinct()


def a35_accuracy(s, d):
    asked = _every(s, d).withColumnRenamed("word", "meant")
    return E.accuracy(place(asked.select("qid", "lang", "typed", "meant"), _lex(s, d)), asked.select("qid", "meant", "kind"), "kind")


def d01_autocorrect(s, d):
    """At normal strength, with completions of what was typed."""
    lex, asked = _lex(s, d), _asked(s, d).select("qid", "lang", "typed")
    low = F.lower("typed")
    more = D.complete(asked.select("lang", low.alias("prefix")), lex).select("lang", F.col("prefix").alias("low"), "word", "cost_milli")
    finished = asked.withColumn("low", low).join(more, ["lang", "low"]).select("qid", "word", (F.lit(0.7) * (F.length("word") - F.length("low"))).alias("edit"), (F.col("cost_milli") / 1000).alias("cost"))
    return R.auto_correct(D.suggest(asked, lex), lex, completions=finished).select("typed", "chosen").distinct()


def l04_levenshtein_control(s, d):
    typed = _asked(s, d).where("kind IN ('delete', 'double', 'swap', 'slip')").select("lang", "typed").distinct().withColumn("qid", F.xxhash64("lang", "typed"))
    return D.nearest_by_levenshtein(typed, B.words(s, d)).join(typed.select("qid", "lang"), "qid").select("lang", "typed", "word", "dist", "rk")


def l07_complete(s, d):
    lex = _lex(s, d)
    return D.complete(lex.select("lang", F.left("word", F.lit(3)).alias("prefix")), lex)


def pred20_is_prefix(s, d):
    lex = _lex(s, d)
    return D.is_prefix(E.typos(lex, ("swap",)).select("lang", F.col("typed").alias("prefix")), lex)


def pred19_contains(s, d):
    known = B.words(s, d).select("lang", "word")
    return C.unigrams(B.sentences(s, d, heldout=True)).join(known, ["lang", "word"], "left_semi")


def _pairs(s, d):
    return I.space(s, d, "pairs")


def l09_predict(s, d):
    pairs = _pairs(s, d)
    return D.predict(pairs.select("lang", "prev"), pairs)


def l08_complete_after(s, d):
    pairs = _pairs(s, d)
    return D.complete_after(pairs.select("lang", "prev", F.left("word", F.lit(1)).alias("prefix")), pairs)


def l27_word_cost(s, d):
    return D.word_costs(C.unigrams(B.sentences(s, d, heldout=True)).select("lang", "word"), _lex(s, d))


def l26_casing(s, d):
    flags = I.space(s, d, "casing").select("lang", "word", "flag")
    return B.words(s, d).join(flags, ["lang", "word"], "left").select("lang", "word", F.coalesce("flag", F.lit(0)).alias("flag"))


def j24_split(s, d):
    return D.split_in_two(_glued(s, d), _lex(s, d))


def j25_hyphen(s, d):
    lex = _lex(s, d)
    hy = lex.where("word LIKE '%-%'").select("lang", F.split("word", "-", 2).alias("z")).select("lang", F.col("z")[0].alias("prev"), F.col("z")[1].alias("word"))
    return D.hyphen_joins(C.pair_counts(B.sentences(s, d)).select("lang", "prev", "word").union(hy), lex)


def d04_merge(s, d):
    return D.merges(C.pair_counts(B.sentences(s, d)), _lex(s, d))


def l15_context_cost(s, d):
    places = C.pair_counts(B.sentences(s, d, heldout=True)).select("lang", "prev", "word").join(_lex(s, d).select("lang", "word", "prior_milli"), ["lang", "word"])
    return R.in_context(places, _pairs(s, d), I.space(s, d, "endings")).select("lang", "prev", "word", "cost_milli")


def l14_rerank(s, d):
    lex = _lex(s, d)
    rows = table(s, d, "lexicon").where("word_id % 20 = 0").select("lang", F.lower("w").alias("word"))
    heard = C.pair_counts(B.sentences(s, d, heldout=True)).join(lex.join(rows, ["lang", "word"], "left_semi").select("lang", "word"), ["lang", "word"], "left_semi")
    few = E.typos(heard.groupBy("lang", "word").agg(F.min("prev").alias("prev")).select("lang", "word"), ("slip",)).join(heard.groupBy("lang", "word").agg(F.min("prev").alias("prev")), ["lang", "word"]).withColumn("qid", F.xxhash64("lang", "word"))
    found = D.suggest(few.select("qid", "lang", "typed"), lex).join(few.select("qid", "prev"), "qid")
    return R.rerank(found, _pairs(s, d), I.space(s, d, "endings"), lex).select("typed", "word", "cost", "rk")


def g11_lemma_fit(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    places = table(s, d, "embeddings").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    return R.lemma_fit(places, v)


def _facts(s, d) -> DataFrame:
    n, r, c, p = (table(s, d, t) for t in ("nation", "region", "customer", "supplier"))
    key = lambda t, k: F.concat(F.lit(t), F.col(k).cast("string"))
    return reduce(DataFrame.union, [
        n.select(key("n", "n_nationkey").alias("s"), F.lit("in_region").alias("r"), key("r", "n_regionkey").alias("o")),
        c.select(key("c", "c_custkey"), F.lit("lives_in"), key("n", "c_nationkey")),
        p.select(key("s", "s_suppkey"), F.lit("sits_in"), key("n", "s_nationkey")),
        c.join(table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_semi").join(n, c["c_nationkey"] == n["n_nationkey"]).select(key("c", "c_custkey"), F.lit("of_region"), key("r", "n_regionkey")),
        p.join(n, p["s_nationkey"] == n["n_nationkey"]).select(key("s", "s_suppkey"), F.lit("of_region"), key("r", "n_regionkey")),
        r.select(key("r", "r_regionkey"), F.lit("named"), F.col("r_name")),
    ]).distinct()


def g01_rules(s, d):
    facts = _facts(s, d)
    steps = facts.where("r IN ('in_region', 'lives_in', 'sits_in', 'of_region')")
    return G.mine_rules(steps).select("head", "body", "support", "size", "pca_size", "head_coverage", "confidence", "pca", "prob")


def a31_code_gain(s, d):
    return G.mine_rules(_facts(s, d).where("r IN ('in_region', 'lives_in', 'sits_in', 'of_region')")).select("head", "body", F.round("gain", 3).alias("gain"))


def a32_exceptions(s, d):
    """Suppliers are guessed to deal in the region where they sit; what they deal in is the region of most of their customers' orders."""
    facts = _facts(s, d).union(_deals(s, d))
    return G.exceptions(facts, [("deals_in", "sits_in in_region"), ("deals_in", "of_region")])


def _deals(s, d) -> DataFrame:
    """(s, r, o): the region that most of a supplier's lines go to (ties: the larger key), and who owes."""
    li, o, c, n, p = (table(s, d, t) for t in ("lineitem", "orders", "customer", "nation", "supplier"))
    to = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("o_orderkey").alias("l_orderkey"), "n_regionkey")
    sums = li.select("l_orderkey", "l_suppkey").join(to, "l_orderkey").groupBy("l_suppkey", "n_regionkey").agg(F.count("*").alias("n"))
    most = sums.groupBy("l_suppkey").agg(F.max(F.struct("n", "n_regionkey"))["n_regionkey"].alias("region"))
    deals = most.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("s"), F.lit("deals_in").alias("r"), F.concat(F.lit("r"), F.col("region").cast("string")).alias("o"))
    return deals.union(p.where("s_acctbal < 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.lit("owes"), F.lit("bank")))


RULES = [("of_region", "lives_in in_region", 0.9), ("of_region", "sits_in in_region", 0.8), ("under", "of_region named", 0.7)]


def g02_closure(s, d):
    return G.closure(_facts(ready(s), d), RULES)


def a36_calibration(s, d):
    ev = table(s, d, "events").select((F.col("value") / (F.col("value") + 50)).alias("p"), F.col("event_type").isin("purchase", "click").alias("y")).where("p >= 0")
    return E.calibration(ev, "p", "y")


def a33_rhythm(s, d):
    return E.rhythm(table(s, d, "events"))


def a34_fit_line(s, d):
    ev = table(s, d, "events").select("user_id", F.col("value").alias("y"), (F.hour("ts") * 60 + F.minute("ts")).cast("double").alias("x"))
    return E.fit_line(ev, "user_id", "x", "y")


def d13_strip(s, d):
    pairs = _pairs(s, d)
    top = D.predict(pairs.select("lang", "prev"), pairs)
    return R.strip(top.withColumn("qid", F.concat_ws(":", "lang", "prev")))


def _glued(s, d) -> DataFrame:
    """(lang, typed): neighbours seen three times or more, written without the space, and with a letter above the space for it."""
    pairs = C.in_lexicon(C.pair_counts(B.sentences(s, d)), B.words(s, d), "prev", "word").where("n >= 3")
    slipped = F.when(F.col("lang") == "ru", "ь").otherwise("v")
    return pairs.select("lang", F.explode(F.array(F.concat("prev", "word"), F.concat("prev", slipped, "word"))).alias("typed")).distinct()


def d06_prefer_split(s, d):
    """Two words against the cheapest single word with a letter less."""
    lex, typed = _lex(s, d), _glued(s, d)
    less = typed.select("lang", "typed", F.explode(F.transform(F.sequence(F.lit(1), F.length("typed")), lambda i: F.concat(F.substring("typed", F.lit(1), i - 1), F.col("typed").substr(i + 1, F.length("typed"))))).alias("word")).distinct()
    single = less.join(lex.select("lang", "word", "prior_milli"), ["lang", "word"]).select("lang", "typed", "word", F.bround(F.round(0.4 * F.col("prior_milli") + 4000, 6), 0).cast("int").alias("cost_milli"))
    best = single.groupBy("lang", "typed").agg(F.min(F.struct("cost_milli", "word")).alias("b")).select("lang", "typed", "b.cost_milli", "b.word")
    return R.prefer_split(best, D.split_in_two(typed, lex))


PREFIXES, EXACT = ("лол", "пло", "cra", "mer"), ("lol", "sds")


def pred07_offensive(s, d):
    return B.words(s, d).where(L.is_offensive(F.col("word"), list(PREFIXES), list(EXACT))).select("lang", "word")


def pred25_languages_of_words(s, d):
    """The languages whose lexicon has a word, in order of the languages."""
    return B.words(s, d).groupBy("word").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))  # at most as many as there are languages


def d11_zone_letters(s, d):
    """The first three letters of every word, and each letter of its language's keys."""
    lex = B.words(s, d)
    heads = lex.select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(4))), lambda n: F.substring("word", F.lit(1), n))).alias("prefix")).distinct()
    typed = lex.where("length(word) >= 3").select("lang", F.left("word", F.lit(3)).alias("typed"))
    keys = {name: "".join(rows) for name, (rows, _) in K.KEYS.items()}
    return R.zone_letters(typed.where("lang = 'ru'"), heads, keys["cyr"]).union(R.zone_letters(typed.where("lang <> 'ru'"), heads, keys["lat"]))


def j16_partners(s, d):
    conf = I.space(s, d, "confusions")
    return conf.select("lang", F.col("a").alias("word"), F.col("b").alias("partner")).union(conf.select("lang", "b", "a"))


def g14_kmeans(s, d):
    return V.kmeans(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 10).groupBy("cluster").agg(F.count("*").alias("n"))


def g12_kneser_ney(s, d):
    return V.kneser_ney(C.in_lexicon(C.pair_counts(B.sentences(s, d)), B.words(s, d), "prev", "word").select("lang", "prev", "word", "n"))


NAMES = (pred07_offensive, pred25_languages_of_words, d11_zone_letters, j16_partners, g14_kmeans, g12_kneser_ney, e01_typos, e02_bands, l04_suggest, a35_accuracy, d01_autocorrect, l04_levenshtein_control, l07_complete, pred20_is_prefix, pred19_contains, l09_predict, l08_complete_after, l27_word_cost, l26_casing, j24_split, j25_hyphen,
         d04_merge, l15_context_cost, l14_rerank, g11_lemma_fit, g01_rules, a31_code_gain, a32_exceptions, g02_closure, a36_calibration, a33_rhythm, a34_fit_line, d13_strip, d06_prefer_split)


def sql() -> dict[str, str]:
    from . import context as X
    from . import corpus as P

    bi = P.sql()["w03_bigrams_kept"].removeprefix("WITH ")
    cut = bi.rindex("SELECT lang, prev, word, CAST")
    pairs = f"{bi[:cut].rstrip()}, bg AS ({bi[cut:]})"
    en = P.sql()["a09_ending_pmi"].removeprefix("WITH ")
    r3 = lambda v: f"CAST(round_even(round({v}, 6), 0) AS INTEGER)"

    def place(kind: str) -> str:
        return f"CAST('0x' || substr(md5({q(kind + '0')} || word), 1, 7) AS BIGINT) % greatest(length(word), 1)"

    slips = [(a, b) for row in (*E.X.LATIN_ROWS, *E.X.CYRILLIC_ROWS) for a, b in zip(row, row[1:])]
    flips = [(a, b) for l, c in zip(E.X.LATIN_ROWS, E.X.CYRILLIC_ROWS) for a, b in zip(l, c)]
    homes = [(a, b) for l, h in (*zip(E.X.LATIN_ROWS, E.X.LATIN_HOMES), *zip(E.X.CYRILLIC_ROWS, E.X.CYRILLIC_HOMES)) for a, b in zip(l, h) if b != ";"]

    def typos(src: str, kinds=E.KINDS) -> str:
        made = {
            "delete": "left(word, i) || substr(word, i + 2)",
            "double": "left(word, i) || substr(word, i + 1, 1) || substr(word, i + 1, 1) || substr(word, i + 2)",
            "swap": "left(word, i) || substr(word, i + 2, 1) || substr(word, i + 1, 1) || substr(word, i + 3)",
            "slip": f"left(word, i) || translate(substr(word, i + 1, 1), {q(''.join(a for a, _ in slips))}, {q(''.join(b for _, b in slips))}) || substr(word, i + 2)",
            "layout": f"translate(word, {q(''.join(a + b for a, b in flips))}, {q(''.join(b + a for a, b in flips))})",
            "home": f"translate(word, {q(''.join(a for a, _ in homes))}, {q(''.join(b for _, b in homes))})",
        }
        each = " UNION ALL ".join(f"SELECT lang, word, {q(k)} AS kind, {made[k]} AS typed FROM (SELECT *, CAST({place(k)} AS INTEGER) AS i FROM {src})" for k in kinds)
        return f"ty AS (SELECT * FROM ({each}) WHERE typed <> word AND length(typed) > 0)"

    wide = [c for c in ALPHABET if ord(c) > 127]
    one = lambda c: f"translate({c}, {q(''.join(wide))}, {q(''.join(x for x in map(chr, range(33, 127)) if x not in string.ascii_lowercase + chr(39) + '-')[: len(wide)])})"  # noqa: E731 - a byte per letter
    ranked = f"{LEX}, {PRIOR}, rk AS (SELECT lang, word, count, prior_milli, row_number() OVER (PARTITION BY lang ORDER BY count DESC, word) AS rk FROM pri)"
    facts = """f AS (SELECT 'n' || n_nationkey AS s, 'in_region' AS r, 'r' || n_regionkey AS o FROM nation UNION SELECT 'c' || c_custkey, 'lives_in', 'n' || c_nationkey FROM customer UNION SELECT 's' || s_suppkey, 'sits_in', 'n' || s_nationkey FROM supplier
      UNION SELECT 'c' || c_custkey, 'of_region', 'r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION SELECT 's' || s_suppkey, 'of_region', 'r' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT 'r' || r_regionkey, 'named', r_name FROM region)"""
    gap = "g AS (SELECT user_id, ts, event_id, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS DOUBLE) AS gap FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL)"
    glued = f"""{S}, {TOK}, {NB}, {LEX}, {PRIOR}, {PAIRS}, gl AS (SELECT DISTINCT lang, unnest([prev || word, prev || CASE WHEN lang = 'ru' THEN 'ь' ELSE 'v' END || word]) AS typed FROM prs WHERE n >= 3),
      ol AS (SELECT lang, typed, CASE lang {' '.join(f"WHEN {q(k)} THEN {q(v)}" for k, v in ONE_LETTER_WORDS.items())} ELSE '' END AS one FROM gl WHERE length(typed) >= 4 AND (lang, typed) NOT IN (SELECT (lang, word) FROM lex)),
      ct AS (SELECT lang, typed, one, i, CAST(unnest(CASE WHEN contains({q(ABOVE_SPACE)}, substr(typed, i + 1, 1)) AND i + 1 < length(typed) THEN [0, 1] ELSE [0] END) AS INTEGER) AS over FROM (SELECT *, CAST(unnest(range(1, length(typed))) AS INTEGER) AS i FROM ol)),
      cp AS (SELECT *, left(typed, i) AS l, substr(typed, i + 1 + over) AS r FROM ct),
      sp AS (SELECT lang, typed, left_w, right_w, cost_milli FROM (SELECT *, row_number() OVER (PARTITION BY lang, typed ORDER BY cost_milli, i, over) AS rn FROM (SELECT c.lang, c.typed, i, over, l AS left_w, r AS right_w, {r3('0.4 * (a.prior_milli + b.prior_milli) + CASE WHEN over = 1 THEN 2000 ELSE 3000 END')} AS cost_milli
        FROM cp c JOIN pri a ON a.lang = c.lang AND a.word = l JOIN pri b ON b.lang = c.lang AND b.word = r WHERE (length(l) >= 2 OR contains(one, l)) AND (length(r) >= 2 OR contains(one, r)))) WHERE rn = 1)"""
    stem = "regexp_replace(word, '^(за|на|по|про|вы|от|до|при|пере|раз|рас|об|у|с)?', '')"
    conf = X.sql()["j08_confusions"]
    mined = f"""WITH {facts}, f2 AS (SELECT * FROM f WHERE r <> 'named'), st AS (SELECT r AS step, s AS a, o AS b FROM f2 UNION SELECT '~' || r, o, s FROM f2), bd AS (SELECT step AS body, a AS x, b AS y FROM st UNION SELECT l.step || ' ' || k.step, l.a, k.b FROM st l JOIN st k ON l.b = k.a WHERE l.a <> k.b),
          sz AS (SELECT body, count(*) AS size FROM bd GROUP BY 1), sp AS (SELECT r AS head, body, count(*) AS support FROM bd JOIN f2 ON s = x AND o = y GROUP BY ALL HAVING count(*) >= 5), kn AS (SELECT DISTINCT r AS head, s AS x FROM f2), pc AS (SELECT head, body, count(*) AS pca_size FROM bd JOIN kn USING (x) GROUP BY ALL), hd AS (SELECT r AS head, count(*) AS hs FROM f2 GROUP BY 1),
          nn AS (SELECT count(*) AS ne FROM (SELECT s FROM f2 UNION SELECT o FROM f2)), nr AS (SELECT count(DISTINCT r) AS nr FROM f2),
          al AS (SELECT *, support / pca_size AS p, CASE WHEN body LIKE '% %' THEN log2(nr * (2 * nr) ** 2) ELSE log2(nr * 2 * nr) END AS bits FROM sp JOIN pc USING (head, body) JOIN sz USING (body) JOIN hd USING (head), nn, nr WHERE body <> head),
          gn AS (SELECT *, support * 2 * log2(greatest(ne, 2)) - bits - log2(pca_size + 1) - (lgamma(pca_size + 1) - lgamma(support + 1) - lgamma(pca_size - support + 1)) / ln(2) AS gain FROM al WHERE p >= 0.3)"""
    code = lambda n, k: f"(log2({n} + 1) + (lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1)) / ln(2))"
    deals = """dl AS (SELECT 's' || l_suppkey AS s, 'deals_in' AS r, 'r' || n_regionkey AS o FROM (SELECT l_suppkey, n_regionkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY k DESC, n_regionkey DESC) AS rn FROM (SELECT l_suppkey, n_regionkey, count(*) AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY l_suppkey, n_regionkey)) WHERE rn = 1
      UNION ALL SELECT 's' || s_suppkey, 'owes', 'bank' FROM supplier WHERE s_acctbal < 0)"""
    return {
        "pred07_offensive": f"WITH {LEX} SELECT lang, word FROM lex WHERE {' OR '.join(f'starts_with(word, {q(p)}) OR starts_with({stem}, {q(p)})' for p in PREFIXES)} OR word IN ({', '.join(map(q, EXACT))})",
        "pred25_languages_of_words": f"WITH {LEX} SELECT word, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM lex GROUP BY word",
        "d11_zone_letters": f"WITH {LEX}, t AS (SELECT DISTINCT lang, left(word, 3) AS typed FROM lex WHERE length(word) >= 3), h AS (SELECT DISTINCT lang, left(word, 4) AS prefix FROM lex) SELECT t.lang, typed, letter, h.prefix IS NOT NULL AS alive FROM (SELECT *, unnest(CASE WHEN lang = 'ru' THEN [{', '.join(map(q, ''.join(K.KEYS['cyr'][0])))}] ELSE [{', '.join(map(q, ''.join(K.KEYS['lat'][0])))}] END) AS letter FROM t) t LEFT JOIN h ON h.lang = t.lang AND h.prefix = typed || letter",
        "j16_partners": f"SELECT lang, a AS word, b AS partner FROM ({conf}) UNION ALL SELECT lang, b, a FROM ({conf})",
        "g12_kneser_ney": f"""WITH {S}, {TOK}, {NB}, {LEX}, {PAIRS}, c AS (SELECT lang, word, count(*) AS before FROM prs GROUP BY ALL), k AS (SELECT lang, count(*) AS kinds FROM prs GROUP BY ALL), l AS (SELECT lang, prev, sum(n) AS total, count(*) AS after FROM prs GROUP BY ALL)
          SELECT lang, prev, word, round(ln(greatest(n - 0.75, 0) / total + 0.75 * after / total * before / kinds), 6) AS logp FROM prs JOIN l USING (lang, prev) JOIN c USING (lang, word) JOIN k USING (lang)""",
        "e01_typos": f"WITH {LEX}, {typos('lex')} SELECT * FROM ty",
        "e02_bands": f"WITH {ranked} SELECT lang, CAST(CASE WHEN rk <= 100 THEN 0 WHEN rk <= 1000 THEN 1 WHEN rk <= 10000 THEN 2 ELSE 3 END AS INTEGER) AS band, count(*) AS n, max(prior_milli) AS dearest FROM rk GROUP BY ALL",
        "l04_levenshtein_control": f"""WITH {ranked}, few AS (SELECT DISTINCT lex.lang, lex.word FROM lex JOIN lexicon x ON x.lang = lex.lang AND lower(x.w) = lex.word WHERE x.word_id % 20 = 0), {typos('few', ('delete', 'double', 'swap', 'slip'))}, t AS (SELECT DISTINCT lang, typed FROM ty)
          SELECT lang, typed, word, CAST(dist AS INTEGER) AS dist, CAST(rk AS INTEGER) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY lang, typed ORDER BY dist, word) AS rk FROM (SELECT lang, typed, word, levenshtein({one('typed')}, {one('word')}) AS dist FROM t JOIN lex USING (lang)) WHERE dist <= 2) WHERE rk <= 3""",
        "l07_complete": f"""WITH {ranked}, p AS (SELECT DISTINCT lang, left(word, 3) AS prefix FROM lex), c AS (SELECT lang, prefix, word, {r3('0.4 * prior_milli + 700 * (length(word) - length(prefix))')} AS cost_milli FROM p JOIN pri USING (lang) WHERE starts_with(word, prefix))
          SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, prefix ORDER BY cost_milli, word) AS INTEGER) AS rk FROM c) WHERE rk <= 8""",
        "pred20_is_prefix": f"WITH {LEX}, {typos('lex', ('swap',))}, p AS (SELECT DISTINCT lang, typed AS prefix FROM ty) SELECT lang, prefix, EXISTS (SELECT 1 FROM lex WHERE lex.lang = p.lang AND starts_with(lex.word, p.prefix)) AS known FROM p",
        "pred19_contains": f"WITH {B.frames_sql('s', True)}, {TOK}, {LEX} SELECT lang, word, count(*) AS n FROM tok SEMI JOIN lex USING (lang, word) GROUP BY ALL",
        "l09_predict": f"WITH {pairs} SELECT lang, prev, word, nats_milli, CAST(rk AS INTEGER) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY lang, prev ORDER BY nats_milli, word) AS rk FROM bg) WHERE rk <= 3",
        "l08_complete_after": f"WITH {pairs} SELECT lang, prev, prefix, word, nats_milli, CAST(rk AS INTEGER) AS rk FROM (SELECT *, left(word, 1) AS prefix, row_number() OVER (PARTITION BY lang, prev, left(word, 1) ORDER BY nats_milli, word) AS rk FROM bg) WHERE rk <= 3",
        "l27_word_cost": f"WITH {B.frames_sql('s', True)}, {TOK}, {LEX}, {PRIOR} SELECT DISTINCT t.lang, t.word, {r3('0.4 * prior_milli')} AS cost_milli FROM (SELECT DISTINCT lang, word FROM tok) t LEFT JOIN pri ON pri.lang = t.lang AND pri.word = t.word",
        "l26_casing": f"WITH {P.sql()['a23_a24_casing'].removeprefix('WITH ').replace('SELECT *, CASE WHEN lo', ', fl AS (SELECT *, CASE WHEN lo', 1)}), {LEX} SELECT lex.lang, lex.word, coalesce(flag, 0) AS flag FROM lex LEFT JOIN fl USING (lang, word)",
        "j24_split": f"WITH {glued} SELECT lang, typed, left_w AS \"left\", right_w AS \"right\", cost_milli FROM sp",
        "j25_hyphen": f"WITH {S}, {NB}, {LEX}, {PRIOR}, c AS (SELECT DISTINCT lang, prev, word FROM nb UNION SELECT lang, left(word, strpos(word, '-') - 1), substr(word, strpos(word, '-') + 1) FROM lex WHERE word LIKE '%-%') SELECT c.lang, prev, c.word, pri.word AS joined, prior_milli FROM c JOIN pri ON pri.lang = c.lang AND pri.word = prev || '-' || c.word",
        "d04_merge": f"WITH {S}, {NB}, {LEX}, {PRIOR}, c AS (SELECT DISTINCT lang, prev, word FROM nb), m AS (SELECT *, unnest(['', 'c', 'v', 'b', 'n', 'm', 'с', 'м', 'и', 'т', 'ь']) AS mid FROM c) SELECT m.lang, prev, m.word, pri.word AS joined, prior_milli FROM m JOIN pri ON pri.lang = m.lang AND pri.word = prev || mid || m.word",
        "l15_context_cost": f"""WITH {pairs}, ep AS (WITH {en}), {B.frames_sql('hs', True)}, hn AS (SELECT DISTINCT lang, t[i] AS prev, t[i + 2] AS word FROM (SELECT lang, t, unnest(range(1, len(t) - 1)) AS i FROM hs) WHERE t[i + 1] = ' ' AND {B.is_word('t[i]')} AND {B.is_word('t[i + 2]')}), {PRIOR}
          SELECT h.lang, h.prev, h.word, {r3("-ln(0.5 * coalesce(exp(-(nats_milli / 1000)), 0) + 0.5 * exp(greatest(-4.0, least(4.0, coalesce(pmi8_milli / 1000 - 8, 0.0))) - prior_milli / 1000)) * 1000")} AS cost_milli FROM hn h JOIN pri ON pri.lang = h.lang AND pri.word = h.word LEFT JOIN bg ON bg.lang = h.lang AND bg.prev = h.prev AND bg.word = h.word LEFT JOIN ep ON ep.lang = h.lang AND ep.lclass = {B.left_class('h.prev')} AND ep.rclass = {B.right_class('h.word')}""",
        "g11_lemma_fit": "SELECT x.vec_id AS a, y.vec_id AS b, round(list_sum(list_transform(range(1, len(x.embedding) + 1), lambda i: CAST(x.embedding[i] AS DOUBLE) * CAST(y.embedding[i] AS DOUBLE))), 4) AS fit FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1",
        "g01_rules": f"{mined} SELECT head, body, support, size, pca_size, round(support / hs, 6) AS head_coverage, round(support / size, 6) AS confidence, round(p, 6) AS pca, round((support + 1) / (pca_size + 2), 6) AS prob FROM gn WHERE gain > 0",
        "a31_code_gain": f"{mined} SELECT head, body, round(gain, 3) AS gain FROM gn WHERE gain > 0",
        "a32_exceptions": f"""WITH {facts}, {deals}, fx AS (SELECT * FROM f UNION SELECT * FROM dl), cd AS (SELECT DISTINCT s AS e, 'has' AS how, r AS rel FROM fx UNION SELECT o, 'is', r FROM fx),
          pa AS (SELECT DISTINCT 'deals_in' AS head, 'sits_in in_region' AS body, a.s AS x, b.o AS y, a.o AS z FROM fx a JOIN fx b ON a.o = b.s WHERE a.r = 'sits_in' AND b.r = 'in_region' AND a.s <> b.o UNION ALL SELECT DISTINCT 'deals_in', 'of_region', s, o, NULL FROM fx WHERE r = 'of_region'),
          jp AS (SELECT p.*, fx.s IS NOT NULL AS ok FROM pa p LEFT JOIN fx ON fx.r = p.head AND fx.s = p.x AND fx.o = p.y WHERE p.x IN (SELECT s FROM fx WHERE r = 'deals_in')), jd AS (SELECT DISTINCT head, body, x, y, ok FROM jp), nz AS (SELECT head, body, x, y, count(*) AS zs FROM jp WHERE z IS NOT NULL GROUP BY ALL),
          ty AS (SELECT head, body, 'X' AS side, how, rel, ok FROM jd JOIN cd ON e = x UNION ALL SELECT head, body, 'Y', how, rel, ok FROM jd JOIN cd ON e = y UNION ALL SELECT head, body, 'Z', how, rel, ok FROM (SELECT head, body, x, y, ok, how, rel, count(*) AS m FROM jp JOIN cd ON e = z GROUP BY ALL) JOIN nz USING (head, body, x, y) WHERE m = zs),
          ta AS (SELECT head, body, side, how, rel, count(*) AS n, count(*) FILTER (ok) AS k FROM ty GROUP BY ALL), ev AS (SELECT head, body, count(*) AS an, count(*) FILTER (ok) AS ak FROM jd GROUP BY ALL),
          fl AS (SELECT *, an - n AS rest_n, ak - k AS rest_k FROM ta JOIN ev USING (head, body) WHERE n < an AND k * (an - n) <= (ak - k) * n),
          pc AS (SELECT *, round(log2(6 * (SELECT count(DISTINCT r) FROM fx)) + {code('n', 'k')} + {code('rest_n', 'rest_k')}, 6) AS bits, round({code('an', 'ak')}, 6) AS base FROM fl)
          SELECT head, body, side, how, rel, n, k, rest_n, rest_k, bits, base, bits < base AS pays FROM (SELECT *, row_number() OVER (PARTITION BY head, body ORDER BY bits, side, how, rel) AS rn FROM pc) WHERE rn = 1""",
        "g02_closure": f"""WITH {facts}, base AS (SELECT *, 1.0::DOUBLE AS credence FROM f), r1 AS (SELECT a.s, 'of_region' AS r, b.o, CASE a.r WHEN 'lives_in' THEN 0.9 ELSE 0.8 END::DOUBLE AS credence FROM f a JOIN f b ON a.o = b.s AND b.r = 'in_region' WHERE a.r IN ('lives_in', 'sits_in')),
          k1 AS (SELECT s, r, o, max(credence) AS credence FROM (SELECT * FROM base UNION ALL SELECT * FROM r1) GROUP BY ALL), r2 AS (SELECT a.s, 'under' AS r, b.o, 0.7 * a.credence * b.credence AS credence FROM k1 a JOIN k1 b ON a.o = b.s AND b.r = 'named' WHERE a.r = 'of_region')
          SELECT s, r, o, round(max(credence), 9) AS credence FROM (SELECT * FROM k1 UNION ALL SELECT * FROM r2) GROUP BY s, r, o""",
        "a36_calibration": "SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS conf, round(avg(y::INT), 6) AS acc FROM (SELECT value / (value + 50) AS p, event_type IN ('purchase', 'click') AS y FROM events) WHERE p >= 0 GROUP BY 1",
        "a33_rhythm": f"""WITH {gap}, rc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM g WHERE gap > 0 AND gap <= 10000000000000) WHERE rn <= 40), m AS (SELECT user_id, count(*) AS n, quantile_cont(gap, 0.5) AS med FROM rc GROUP BY 1 HAVING count(*) >= 12),
          dv AS (SELECT user_id, n, med, quantile_cont(abs(gap - med), 0.5) AS mad FROM rc JOIN m USING (user_id) GROUP BY ALL) SELECT user_id, n, round(med, 1) AS med, round(mad, 1) AS mad, round(greatest(1.8 * med, med + 4 * mad, med + 60000), 1) AS held_above FROM dv""",
        "a34_fit_line": "SELECT user_id, count(*) AS n, round(regr_slope(value, (hour(ts) * 60 + minute(ts))::DOUBLE), 6) AS slope, round(regr_intercept(value, (hour(ts) * 60 + minute(ts))::DOUBLE), 6) AS intercept FROM events GROUP BY user_id",
        "d13_strip": f"WITH {pairs}, t AS (SELECT lang || ':' || prev AS qid, word, row_number() OVER (PARTITION BY lang, prev ORDER BY nats_milli, word) AS rk FROM bg) SELECT qid, max(word) FILTER (rk = 2) AS s1, max(word) FILTER (rk = 1) AS s2, max(word) FILTER (rk = 3) AS s3 FROM t WHERE rk <= 3 GROUP BY qid",
        "d06_prefer_split": f"""WITH {glued}, ls AS (SELECT DISTINCT lang, typed, left(typed, i - 1) || substr(typed, i + 1) AS word FROM (SELECT *, CAST(unnest(range(1, length(typed) + 1)) AS INTEGER) AS i FROM gl)),
          one AS (SELECT lang, typed, min(c1) AS c1, arg_min(word, (c1, word)) AS word FROM (SELECT lang, typed, word, {r3('0.4 * prior_milli + 4000')} AS c1 FROM ls JOIN pri USING (lang, word)) GROUP BY ALL)
          SELECT lang, typed, CASE WHEN cost_milli IS NOT NULL AND (c1 IS NULL OR cost_milli + 1000 < c1) THEN left_w || ' ' || right_w ELSE word END AS chosen FROM sp FULL JOIN one USING (lang, typed)""",
    }
