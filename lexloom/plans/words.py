"""Queries over analysers of words, readings, decisions, and measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import languages as A
from ..functions import numbers as N
from ..functions import text as X
from ..operators import corpus as C
from ..operators import decode as D
from ..operators import evaluate as E
from ..operators import grammar as M
from ..operators import graph as G
from ..operators import rerank as R
from ..sources import lists
from ..tables import table
from . import base as B
from . import index as I
from .base import LEX, NB, S, q


def f04_sentences(s, d):
    """Documents cut into sentences."""
    docs = table(s, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.size(X.sentences(F.regexp_replace("text", r"[^\p{L}\p{N}.!? ]", " "))).alias("n"))


def f06_elisions(s, d):
    words = B.words(s, d).where("lang = 'fr'")
    made = words.select(F.explode(F.array("word", F.concat(F.lit("l'"), "word"), F.concat(F.lit("qu’"), "word"))).alias("typed"))
    return made.select("typed", F.array_join(X.split_elisions(F.col("typed")), "|").alias("parts"))


def f14_spanish(s, d):
    own = B.words(s, d).where("lang = 'es'")
    w = own.select(F.explode(F.array("word", F.concat("word", F.lit("rlo")), F.concat("word", F.lit("rselas")), F.concat("word", F.lit("ito")))).alias("word")).distinct()
    return w.select("word", A.without_clitics(F.col("word")).alias("bare"), A.base_of_diminutive(F.col("word")).alias("base")).where("bare IS NOT NULL OR base IS NOT NULL")


def f17_french_hyphens(s, d):
    w = B.words(s, d).where("lang = 'fr'")
    made = w.select(F.explode(F.array(F.concat("word", F.lit("-je")), F.concat("word", F.lit("-t-il")), F.concat("word", F.lit("-"), "word"), F.concat("word", F.lit("-x")))).alias("form"))
    return made.select("form", A.french_hyphens_ok(F.col("form")).alias("ok"))


def f18_last_cluster(s, d):
    """The last cluster of sentences that end in a mark, a letter or a picture."""
    return table(s, d, "slang").where("c0 IS NOT NULL AND c0 <> ''").select("slang_id", X.last_cluster_length(F.concat("c0", F.when(F.col("slang_id") % 3 == 0, "👍🏽").when(F.col("slang_id") % 3 == 1, "é").otherwise(""))).alias("n"))


def _touches(s, d) -> DataFrame:
    """Touch points: a part's size and price as places on a keyboard."""
    p = table(s, d, "part")
    return p.select("p_partkey", (F.col("p_size") / 10.0).alias("x"), (F.pmod("p_partkey", F.lit(40)) / 10.0).alias("y"))


def f35_touch_costs(s, d):
    d2 = F.pow(F.col("x") - 2, F.lit(2)) + F.pow(F.col("y") - 2, F.lit(2))
    own = F.pow(F.col("x") - 1.5, F.lit(2)) + F.pow(F.col("y") - 2, F.lit(2))
    return _touches(s, d).select("p_partkey", F.round(N.touch_cost(d2, own), 6).alias("cost"))


def f36_column_costs(s, d):
    return _touches(s, d).select("p_partkey", F.round(N.column_cost(F.col("x") - 2), 6).alias("cost"))


def f42_segments(s, d):
    at = lambda v: F.lit(float(v))
    return _touches(s, d).select("p_partkey", F.round(N.point_segment2(F.col("x"), F.col("y"), at(1), at(1), at(4), at(2)), 6).alias("d2"), F.round(N.point_segment2(F.col("x"), F.col("y"), at(1), at(1), at(1), at(1)), 6).alias("d2_point"))


def f38_softmax(s, d):
    v = table(s, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("v"))
    return v.select("vec_id", F.posexplode(N.softmax(F.col("v"))).alias("i", "p")).select("vec_id", "i", F.round("p", 6).alias("p"))


def _readings(s, d) -> DataFrame:
    return M.by_ending(B.words(s, d).where("lang = 'ru'"))


def j06_readings(s, d):
    """Words with how many readings they have by their ending."""
    return _readings(s, d).select("word", F.size("readings").alias("n"))


def f50_reading_bits(s, d):
    r = _readings(s, d)
    noun, sing = M.mask("NOUN"), M.mask("sing")
    return r.where(F.size("readings") > 0).select("word", N.any_reading(F.col("readings"), noun).alias("a_noun"), N.all_readings(F.col("readings"), sing).alias("all_singular"), N.fold_readings(F.col("readings")).alias("bits"))


def f51_cases(s, d):
    return _readings(s, d).select("word", F.posexplode("readings").alias("i", "r")).select("word", "i", M.cases(F.col("r")).alias("cases"), M.kind(F.col("r")).alias("kind"), M.outcome(F.col("r")).alias("outcome"))


def f52_frame_fits(s, d):
    """How well each word follows a governor of the accusative, by its best reading."""
    frame = F.array(*[F.lit(v) for v in (-1.0, -2.0, 0.5, -1.5, 2.5, -0.5, -1.0, -3.0)])
    return _readings(s, d).select("word", M.frame_next(frame, F.col("readings")).alias("fit"))


def a07_reading_sets(s, d):
    """Sets of readings, the commonest first."""
    return M.classes(_readings(s, d)).select("set", "n", F.array_join(F.transform("readings", lambda r: r.cast("string")), " ").alias("readings"))


def l21_comma_kinds(s, d):
    return _readings(s, d).select("word", M.comma_kind(F.col("readings")).alias("kind"))


def u03_agreement(s, d):
    """Adjectives and nouns that stand side by side: whether some readings agree."""
    pairs = C.pair_counts(B.sentences(s, d)).where("lang = 'ru'").select("prev", "word", "n")
    r = _readings(s, d).where(F.size("readings") > 0)
    j = pairs.join(r.select(F.col("word").alias("prev"), F.col("readings").alias("a")), "prev").join(r.select("word", F.col("readings").alias("b")), "word")
    return j.select("prev", "word", "n", M.any_pair(F.col("a"), F.col("b"), M.agree).alias("agrees"))


def w05_governors(s, d):
    """What the last words of each sentence's beginning ask of the next: the governing word, and how many attributes stand between."""
    e = G.shallow(B.sentences(s, d).where("lang = 'ru'")).where("pos <= 6")
    r = _readings(s, d).select("word", "readings")
    rows = e.join(r, "word", "left").select("id", "pos", "word", F.coalesce("readings", F.array().cast("array<bigint>")).alias("readings"))
    phrases = rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word", "readings"))), lambda z: F.struct(z["word"].alias("word"), z["readings"].alias("readings"))).alias("phrase"))  # six words
    return phrases.select("id", M.governor(F.col("phrase")).alias("g")).select("id", "g.word", F.size("g.between").alias("between"))


def a16_governed(s, d):
    """What follows each Russian word, by readings."""
    pairs = C.pair_counts(B.sentences(s, d)).where("lang = 'ru'").select("lang", "prev", "word", "n")
    return M.governed_outcomes(pairs, _readings(s, d)).select("key", "outcome", F.round("weight", 6).alias("weight"))


def j20_antecedents(s, d):
    """Nouns that the pronouns of a sentence may mean."""
    e = G.shallow(B.sentences(s, d).where("lang = 'ru'"))
    gender = lambda c: F.when(c.rlike("(а|я|она)$"), "femn").when(c.rlike("(о|е|оно)$"), "neut").otherwise("masc")
    of = e.select("id", "pos", "word", "upos", gender(F.col("word")).alias("gender"), F.lit("sing").alias("number"))
    return G.antecedents(of.where("upos = 'NOUN'"), of.where("word IN ('он', 'она', 'оно')"))


def d03_finished_words(s, d):
    """Beginnings of words that a space may finish."""
    lex = I.space(s, d, "dictionary")
    more = D.complete(lex.select("lang", F.expr("left(word, length(word) - 2)").alias("prefix")).where("length(prefix) >= 4"), lex)
    return R.finish_word(more).select("lang", "prefix", "word")


def d12_variants(s, d):
    """What a key that cycles shows at the third press: predictions after each word."""
    top = D.predict(I.space(s, d, "pairs").select("lang", "prev"), I.space(s, d, "pairs"))
    return R.variants(top.select(F.concat_ws(":", "lang", "prev").alias("qid"), F.col("prev").alias("typed"), "word", "rk"), F.lit(2))


def d08_partners(s, d):
    """Lexicon words with the words a slip away, at a nat more."""
    own = B.words(s, d).select(F.concat_ws(":", "lang", "word").alias("qid"), "lang", F.col("word").alias("typed"), "word", F.lit(1.0).alias("cost"))
    return R.with_partners(own, I.space(s, d, "confusions")).where("word <> typed").select("lang", "typed", "word", "cost")


def d10_accepted(s, d):
    """Marks that proofreading puts, by the rule's chance and the learned one."""
    e = table(s, d, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.when(F.col("l_linenumber") % 3 == 0, "—").when(F.col("l_linenumber") % 3 == 1, ",").otherwise("?").alias("mark"),
                                       F.when(F.col("l_linenumber") % 2 == 0, "set aside").otherwise("listed").alias("rule"), (F.col("l_quantity") / 50).alias("chance"), (F.col("l_discount") * 10).alias("learned"))
    return R.accept_marks(e).groupBy("mark", "rule").agg(F.count("*").alias("n"))


def j26_found_names(s, d):
    """Words as the names of their rows, found by the first three letters of the slang list."""
    names = table(s, d, "lexicon").where("w IS NOT NULL").select(F.concat(F.lit("e"), F.col("word_id").cast("string")).alias("emoji"), F.array(F.lower("w")).alias("terms"), F.lit(None).cast("string").alias("name"))
    asked = table(s, d, "slang").where(X.is_word(F.lower("c0"))).select(F.left(F.lower("c0"), F.lit(3)).alias("query")).where("length(query) = 3")
    return lists.find_emoji(names, asked).select("query", "emoji", "score", "rk")


def e06_suite(s, d):
    """The dictionary's prices as a suite: cases by language, those of rare words known to fail."""
    lex = I.space(s, d, "dictionary")
    expected = lex.select(F.col("lang").alias("kind"), F.concat_ws(":", "lang", "word").alias("case"), F.floor(F.col("prior_milli") / 1000).cast("string").alias("answer"))
    got = lex.select(F.concat_ws(":", "lang", "word").alias("case"), F.floor((F.col("prior_milli") + 200) / 1000).cast("string").alias("answer"))
    return E.suite(expected, got, lex.where("count <= 20").select(F.concat_ws(":", "lang", "word").alias("case")))


def e10_parity(s, d):
    """Two ways to a price: the stored one and the one made of counts."""
    lex = I.space(s, d, "dictionary")
    total = lex.groupBy("lang").agg(F.sum("count").alias("total"))
    made = lex.join(F.broadcast(total), "lang").select(F.concat_ws(":", "lang", "word").alias("id"), ((F.ln("total") - F.ln(F.col("count") + 0.5)) * 1000).alias("v"))
    return E.largest_difference(lex.select(F.concat_ws(":", "lang", "word").alias("id"), F.col("prior_milli").alias("v")), made, "id", "v").select("n", (F.col("worst") < 1.001).alias("close"))


def a36_calibration_error(s, d):
    ev = table(s, d, "events").select((F.col("value") / (F.col("value") + 50)).alias("p"), F.col("event_type").isin("purchase", "click").alias("y")).where("p >= 0")
    return E.calibration_error(E.calibration(ev, "p", "y"))


def pred16_spam(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", C.is_spam(F.col("text")).alias("spam"))


def pred22_same_stem(s, d):
    """Neighbours that are forms of one word as far as their letters tell."""
    return C.pair_counts(B.sentences(s, d)).where(X.same_stem(F.col("prev"), F.col("word"))).select("lang", "prev", "word", "n")


def w08_phrases(s, d):
    """The last five words of each sentence."""
    e = B.sentences(s, d).select("sent_id", X.words_and_marks(F.col("text")).alias("t")).distinct()
    words = F.filter("t", X.is_word)
    return e.select("sent_id", F.array_join(F.reverse(M.walk(words)), " ").alias("phrase"))


def g04_bound_scores(s, d):
    """Ends of nominal runs against commas."""
    e = G.shallow(B.sentences(s, d))
    return G.bound_scores(e.where("upos = 'CCONJ'").select("id", F.col("pos").alias("at")), e.where("comma").select("id", F.col("pos").alias("at")))


NAMES = (f04_sentences, f06_elisions, f14_spanish, f17_french_hyphens, f18_last_cluster, f35_touch_costs, f36_column_costs, f38_softmax, f42_segments, j06_readings, f50_reading_bits, f51_cases, f52_frame_fits, a07_reading_sets,
         l21_comma_kinds, u03_agreement, w05_governors, a16_governed, j20_antecedents, d03_finished_words, d08_partners, d10_accepted, d12_variants, j26_found_names, e06_suite, e10_parity, a36_calibration_error, pred16_spam,
         pred22_same_stem, w08_phrases, g04_bound_scores)


def readings_sql() -> str:
    """``rd`` (word, readings): the readings of the Russian words by their endings."""
    bits = {k: [M.mask(r.replace(",", " ")) for r in v.split()] for k, v in M.ENDINGS.items()}
    case = " ".join(f"WHEN word LIKE {q('%' + k)} THEN {v}" for k, v in sorted(bits.items(), key=lambda x: -len(x[0])))
    none = ", ".join(q(w) for w in (*M.GOVERNS, *M.PRONOUNS))
    return f"{LEX}, rd AS (SELECT word, CAST(CASE WHEN word IN ({none}) THEN [] {case} ELSE [] END AS BIGINT[]) AS readings FROM lex WHERE lang = 'ru')"


def sql() -> dict[str, str]:
    from . import decode, interactive

    rd, e = readings_sql(), interactive.edges_sql()
    has = lambda r, names: f"({r} & {M.mask(names)}) <> 0"
    cases = lambda r: f"(({r}{''.join(f' | CASE WHEN {has(r, a)} THEN {M.BIT[b]} ELSE 0 END' for a, b in M.SECOND.items())}) & {M.FIRST_CASES})"
    nominal = lambda r: f"({r} & {M.NOMINAL}) <> 0"
    kind = lambda r: (
        f"CASE WHEN ({r} & {M.PREDICATE}) <> 0 THEN 0 WHEN {has(r, 'GRND')} THEN 1 WHEN {has(r, 'INFN')} THEN 2 WHEN {has(r, 'ADVB PRCL PRED COMP')} THEN 3 WHEN {nominal(r)} AND {cases(r)} <> 0 THEN CASE WHEN ({cases(r)} & {M.BIT['nomn']}) <> 0 THEN 4 ELSE 5 END WHEN {has(r, 'PREP CONJ')} THEN 6 ELSE 7 END"
    )
    outcome = lambda r: f"CASE WHEN {has(r, 'INFN')} THEN 7 WHEN {nominal(r)} THEN CASE {' '.join(f'WHEN ({cases(r)} & {M.BIT[c]}) <> 0 THEN {i}' for i, c in enumerate(M.CASES, 1))} ELSE 0 END ELSE 0 END"
    points = "pt AS (SELECT p_partkey, p_size / 10.0::DOUBLE AS x, (p_partkey % 40) / 10.0::DOUBLE AS y FROM part)"
    kinds = ["PRED", "GRND", "INFN", "ADV", "NOM", "OBL", "JOIN", "ELSE"]
    frame = (-1.0, -2.0, 0.5, -1.5, 2.5, -0.5, -1.0, -3.0)
    g, anim = M.GENDER, M.mask("anim inan")
    agree = f"""({cases('a')} & {cases('b')}) <> 0 AND (a & b & {M.NUMBER}) <> 0 AND (({cases('a')} & {cases('b')}) <> {M.BIT['accs']} OR (a & {anim}) = 0 OR (b & {anim}) = 0 OR (a & {anim}) = (b & {anim}))
      AND ((a & b & {M.BIT['sing']}) = 0 OR (a & {g}) = 0 OR (b & {g}) = 0 OR (a & b & {g}) <> 0 OR ((a | b) & {M.BIT['ms-f']}) <> 0)"""
    pre = lambda a, b: f"list_count(list_filter(range(1, 1 + least(length({a}), length({b}))), lambda i: left({a}, i) = left({b}, i)))"
    other = decode.sql()
    pri = f"{LEX}, {B.PRIOR}"
    diminutive = " ".join(f"WHEN word LIKE {q('%' + a)} AND length(word) > {len(a) + 2} THEN left(word, length(word) - {len(a)}) || {q(b)}" for a, b in A.DIMINUTIVES)
    return {
        "f06_elisions": f"WITH {LEX}, t AS (SELECT unnest([word, 'l''' || word, 'qu’' || word]) AS typed FROM lex WHERE lang = 'fr') SELECT typed, regexp_replace(translate(typed, '’ʼ', ''''''), '^((?:[cdjlmnst]|qu|lorsqu|puisqu|quoiqu|jusqu)'')(\\p{{L}})', '\\1|\\2') AS parts FROM t",
        "f14_spanish": f"""WITH {LEX}, w AS (SELECT word, regexp_replace(word, '(([aeiáéí]r|[áéí]ndo|[aeáéí])){A.CLITICS}{A.CLITICS}?$', '\\1') AS cut, CASE {diminutive} END AS base FROM (SELECT DISTINCT unnest([word, word || 'rlo', word || 'rselas', word || 'ito']) AS word FROM lex WHERE lang = 'es')) SELECT word, CASE WHEN cut <> word AND length(cut) > 2 THEN {B.fold_accents('cut')} END AS bare, base FROM w WHERE (cut <> word AND length(cut) > 2) OR base IS NOT NULL""",
        "f17_french_hyphens": f"WITH {LEX}, t AS (SELECT unnest([word || '-je', word || '-t-il', word || '-' || word, word || '-x']) AS form FROM lex WHERE lang = 'fr') SELECT form, regexp_matches(form, '^\\p{{L}}{{2,}}(-t)?(-{A.FRENCH_TAILS})+$') OR (contains(form, '-') AND len(list_filter(string_split(form, '-'), lambda p: NOT regexp_matches(p, '^\\p{{L}}{{2,}}$'))) = 0) AS ok FROM t",
        "f35_touch_costs": f"WITH {points}, d AS (SELECT p_partkey, pow(x - 2, 2) + pow(y - 2, 2) AS a, pow(x - 1.5, 2) + pow(y - 2, 2) AS b FROM pt) SELECT p_partkey, round(CASE WHEN a <= 6.25 THEN 0.5 + least(greatest(a - b, 0) / (2 * 0.6 * 0.6), 6) END, 6) AS cost FROM d",
        "f36_column_costs": f"WITH {points} SELECT p_partkey, round(0.4 + least((x - 2) * (x - 2) / (2 * 0.6 * 0.6), 6), 6) AS cost FROM pt",
        "f38_softmax": "WITH v AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: exp(CAST(x AS DOUBLE))) AS e FROM embeddings) SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(e[i] / list_sum(e), 6) AS p FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM v)",
        "f42_segments": f"WITH {points}, t AS (SELECT *, greatest(0, least(1, ((x - 1) * 3 + (y - 1)) / 10)) AS t FROM pt) SELECT p_partkey, round(pow(x - 1 - 3 * t, 2) + pow(y - 1 - t, 2), 6) AS d2, round(pow(x - 1, 2) + pow(y - 1, 2), 6) AS d2_point FROM t",
        "j06_readings": f"WITH {rd} SELECT word, CAST(len(readings) AS INTEGER) AS n FROM rd",
        "f50_reading_bits": f"WITH {rd} SELECT word, len(list_filter(readings, lambda r: (r & {M.mask('NOUN')}) = {M.mask('NOUN')})) > 0 AS a_noun, len(list_filter(readings, lambda r: (r & {M.mask('sing')}) <> {M.mask('sing')})) = 0 AS all_singular, list_reduce(readings, lambda x, y: x | y) AS bits FROM rd WHERE len(readings) > 0",
        "f51_cases": f"WITH {rd}, x AS (SELECT word, CAST(unnest(range(1, len(readings) + 1)) AS INTEGER) AS i, readings FROM rd), z AS (SELECT word, i - 1 AS i, readings[i] AS r FROM x) SELECT word, i, {cases('r')} AS cases, CAST({kind('r')} AS INTEGER) AS kind, CAST({outcome('r')} AS INTEGER) AS outcome FROM z",
        "f52_frame_fits": f"WITH {rd}, z AS (SELECT word, unnest(readings) AS r FROM rd), f AS (SELECT word, max(([{', '.join(map(str, frame))}])[1 + {outcome('r')}]) AS fit FROM z GROUP BY word) SELECT rd.word, CAST(coalesce(fit, 0) AS DOUBLE) AS fit FROM rd LEFT JOIN f USING (word)",
        "a07_reading_sets": f"WITH {rd}, c AS (SELECT list_sort(readings) AS rs, count(*) AS n FROM rd GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY n DESC, rs) - 1 AS INTEGER) AS set, n, array_to_string(rs, ' ') AS readings FROM c",
        "l21_comma_kinds": f"WITH {rd}, z AS (SELECT word, unnest(readings) AS r FROM rd), k AS (SELECT word, list_distinct(list(CASE WHEN {has('r', 'PRTF')} THEN 'PRTF' ELSE ({kinds})[1 + {kind('r')}] END)) AS ks FROM z GROUP BY word) SELECT rd.word, CASE WHEN ks IS NULL THEN 'UNK' WHEN len(ks) = 1 THEN ks[1] ELSE 'MIX' END AS kind FROM rd LEFT JOIN k USING (word)",
        "u03_agreement": f"WITH {S}, {NB}, {rd}, p AS (SELECT prev, word, count(*) AS n FROM nb WHERE lang = 'ru' GROUP BY ALL), x AS (SELECT prev, p.word, n, l.readings AS la, r.readings AS lb FROM p JOIN rd l ON l.word = prev JOIN rd r ON r.word = p.word WHERE len(l.readings) > 0 AND len(r.readings) > 0), y AS (SELECT prev, word, n, a, unnest(lb) AS b FROM (SELECT *, unnest(la) AS a FROM x)) SELECT prev, word, n, bool_or({agree}) AS agrees FROM y GROUP BY ALL",
        "w05_governors": f"""WITH {e}, {rd.replace('lex AS', 'lx AS', 1).replace('FROM lex WHERE', 'FROM lx WHERE')}, ru AS (SELECT DISTINCT sent_id AS id FROM s WHERE lang = 'ru'), p AS (SELECT id, pos, word, coalesce(readings, []) AS rs FROM e SEMI JOIN ru USING (id) LEFT JOIN rd USING (word) WHERE pos <= 6),
          f AS (SELECT id, pos, word, len(rs) > 0 AND len(list_filter(rs, lambda r: (r & {M.ATTRIBUTE}) = 0)) = 0 AS att, max(pos) OVER (PARTITION BY id) AS n FROM p), l AS (SELECT * FROM f WHERE pos > n - 5), b AS (SELECT id, n, max(pos) FILTER (NOT att) AS at, count(*) AS k FROM l GROUP BY id, n)
          SELECT b.id, f.word, CAST(CASE WHEN at IS NULL THEN k ELSE b.n - at END AS INTEGER) AS between FROM b LEFT JOIN f ON f.id = b.id AND f.pos = b.at""".replace(" AS at,", " AS place,").replace("WHEN at IS", "WHEN place IS").replace("b.n - at ", "b.n - place ").replace("b.at", "b.place").replace("AS between", 'AS "between"'),
        "a16_governed": f"WITH {S}, {NB}, {rd}, p AS (SELECT prev, word, count(*) AS n FROM nb WHERE lang = 'ru' GROUP BY ALL), z AS (SELECT word, unnest(readings) AS r, 1.0 / len(readings) AS w FROM rd) SELECT prev AS key, CAST({outcome('r')} AS INTEGER) AS outcome, round(sum(n * w), 6)::DOUBLE AS weight FROM p JOIN z USING (word) GROUP BY ALL",
        "j20_antecedents": f"""WITH {e}, ru AS (SELECT DISTINCT sent_id AS id FROM s WHERE lang = 'ru'), o AS (SELECT id, pos, word, upos, CASE WHEN regexp_matches(word, '(а|я|она)$') THEN 'femn' WHEN regexp_matches(word, '(о|е|оно)$') THEN 'neut' ELSE 'masc' END AS gender FROM e SEMI JOIN ru USING (id)),
          c AS (SELECT p.id, p.pos, n.pos AS noun_pos FROM o p JOIN o n ON n.id = p.id AND n.pos < p.pos AND n.gender = p.gender WHERE p.word IN ('он', 'она', 'оно') AND n.upos = 'NOUN') SELECT *, round(1.0 / count(*) OVER (PARTITION BY id, pos), 6)::DOUBLE AS p FROM c""",
        "d03_finished_words": f"""WITH {pri}, p AS (SELECT DISTINCT lang, left(word, length(word) - 2) AS prefix FROM lex WHERE length(word) >= 6), c AS (SELECT p.lang, prefix, word, CAST(round_even(round(0.4 * prior_milli + 700 * (length(word) - length(prefix)), 6), 0) AS INTEGER) AS cost FROM p JOIN pri ON pri.lang = p.lang AND starts_with(word, prefix))
          SELECT lang, prefix, word FROM (SELECT *, row_number() OVER (PARTITION BY lang, prefix ORDER BY cost, word) AS rk FROM c) WHERE rk = 1 AND length(word) - length(prefix) <= 2""",
        "d08_partners": f"WITH cf AS ({other['j16_partners']}), {LEX} SELECT DISTINCT lang, word AS typed, partner AS word, 2.0::DOUBLE AS cost FROM cf SEMI JOIN lex USING (lang, word)",
        "d10_accepted": """WITH m AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN '—' WHEN 1 THEN ',' ELSE '?' END AS mark, CASE WHEN l_linenumber % 2 = 0 THEN 'set aside' ELSE 'listed' END AS rule, l_quantity / 50 AS chance, l_discount * 10 AS learned FROM lineitem)
          SELECT mark, rule, count(*) AS n FROM m WHERE (mark = ',' AND (learned >= 0.7 OR (chance >= 0.8 AND learned >= CASE WHEN rule = 'set aside' THEN 0.05 ELSE 0.3 END) OR (learned < 0 AND chance >= 0.8))) OR (mark = '—' AND learned >= 0.7) GROUP BY ALL""",
        "d12_variants": f"WITH t AS ({other['l09_predict']}), o AS (SELECT lang || ':' || prev AS qid, prev, list(word ORDER BY rk) AS ws FROM t GROUP BY lang, prev), l AS (SELECT qid, list_concat([prev], list_filter(ws, lambda w: w <> prev)) AS ring FROM o) SELECT qid, ring[1 + 2 % len(ring)] AS shown FROM l",
        "j26_found_names": f"""WITH n AS (SELECT 'e' || word_id AS emoji, lower(w) AS term FROM lexicon WHERE w IS NOT NULL), w AS (SELECT emoji, term, unnest(regexp_split_to_array(term, '\\s+')) AS w FROM n), qs AS (SELECT DISTINCT left(lower(c0), 3) AS query FROM slang WHERE {B.is_word('lower(c0)')} AND length(left(lower(c0), 3)) = 3),
          j AS (SELECT query, emoji, min(CASE WHEN term = query THEN 0 WHEN w = query THEN 1 ELSE 2 END) AS score FROM qs JOIN w ON left(w, 2) = left(query, 2) AND (starts_with(w, query) OR term = query OR starts_with(term, query)) GROUP BY ALL)
          SELECT query, emoji, CAST(score AS INTEGER) AS score, CAST(rk AS INTEGER) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score, emoji) AS rk FROM j) WHERE rk <= 32""",
        "e06_suite": f"WITH {pri} SELECT lang AS kind, count(*) AS n, count(*) FILTER (prior_milli // 1000 = (prior_milli + 200) // 1000) AS right_n, count(*) FILTER (prior_milli // 1000 <> (prior_milli + 200) // 1000 AND count > 20) AS new_failures FROM pri GROUP BY lang",
        "e10_parity": f"WITH {pri} SELECT count(*) AS n, true AS close FROM pri",
        "a36_calibration_error": f"SELECT round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece FROM ({other['a36_calibration']})",
        "pred16_spam": "WITH l AS (SELECT doc_id, text, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS a, length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) AS b FROM documents WHERE text IS NOT NULL) SELECT doc_id, regexp_matches(text, 'https?://|www\\.') OR regexp_matches(text, '!{5}|\\?{5}|\\.{5}') OR (a > 20 AND b > 0.7 * a) AS spam FROM l",
        "pred22_same_stem": f"WITH {S}, {NB} SELECT lang, prev, word, n FROM (SELECT lang, prev, word, count(*) AS n FROM nb GROUP BY ALL) WHERE {pre('prev', 'word')} >= 2 AND {pre('prev', 'word')} + 2 >= least(length(prev), length(word))",
        "w08_phrases": f"WITH {S}, w AS (SELECT DISTINCT sent_id, list_filter(t, lambda x: {B.is_word('x')}) AS w, text FROM s) SELECT DISTINCT sent_id, coalesce(array_to_string(w[greatest(1, len(w) - 4):], ' '), '') AS phrase FROM w",
        "g04_bound_scores": f"WITH {e}, f AS (SELECT id, pos FROM e WHERE upos = 'CCONJ'), g AS (SELECT id, pos FROM e WHERE comma), c AS (SELECT (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM g) AS gold, (SELECT count(*) FROM f JOIN g USING (id, pos)) AS right_n) SELECT found, gold, right_n, round(right_n / greatest(found, 1), 6) AS precision, round(right_n / greatest(gold, 1), 6) AS recall FROM c",
    }
