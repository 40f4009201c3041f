"""Queries over the SQL functions, the rest of the store, and benchmarks of context."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import sql as Q
from ..operators import context as K
from ..operators import corpus as C
from ..operators import decode as D
from ..operators import grammar as M
from ..operators import graph as G
from ..operators import rerank as R
from ..operators import vectors as V
from ..sources import store
from ..tables import rank_all, shared_folder, table
from . import base as B
from . import index as I
from .base import LEX, NB, PRIOR, S


def x_scalar_functions(s, d):
    """The scalar functions under their names in SQL."""
    Q.register(s)
    B.words(s, d).createOrReplaceTempView("lexloom_words")
    return s.sql("SELECT lang, word, left_class(word) AS l, right_class(word) AS r, fold_yo(word) AS e, fold_accents(word) AS bare, round(key_cost(length(word) / 4D), 6) AS cost, quant05(ln(count) - 5) AS byte, round(dequant05(quant05(ln(count) - 5)), 6) AS back, prior_milli(count, 100000000L) AS prior FROM lexloom_words")


def x_tokenize(s, d):
    """Tokens by the table function, counted."""
    Q.register(s)
    B.sentences(s, d).createOrReplaceTempView("lexloom_sentences")
    return s.sql("SELECT lang, token, count(*) AS n FROM lexloom_sentences, LATERAL tokenize(text) GROUP BY lang, token HAVING count(*) >= 5")


def x_edit_cost(s, d):
    """The channel's price of each word against itself and with its last letter left out."""
    Q.register(s)
    B.words(s, d).where("length(word) > 1").createOrReplaceTempView("lexloom_words2")
    return s.sql("SELECT lang, word, round(edit_cost(word, word), 6) AS same, edit_cost(left(word, length(word) - 1), word) > 0 AS dearer FROM lexloom_words2")


def f32_unseen(s, d):
    """Words within the span of the dictionary's floor."""
    lex = I.space(s, d, "dictionary")
    floor = lex.groupBy("lang").agg(N.floor_milli(F.sum("count")).alias("floor"))
    return lex.join(F.broadcast(floor), "lang").select("lang", "word", "floor", N.unseen(F.col("prior_milli"), F.col("floor")).alias("unseen"))


def s24_prior_blocks(s, d):
    """The least prior of blocks of 64 words, and of blocks of those."""
    placed = rank_all(I.space(s, d, "dictionary").select("lang", "word", "prior_milli"), F.asc("word"), by=("lang",), name="place")
    return store.prior_blocks(placed)


def s26_weights(s, d):
    """A model's matrices through the store: rows, and how far they are off."""
    weights = V.random_weights(50)
    folder = f"{shared_folder(s)}/lexloom-weights-{uuid.uuid4().hex}"
    store.write_weights(s, weights, folder)
    back = store.read_weights(s, folder)
    worst = max(float(abs(back[k] - w).max() / max(abs(w).max(), 1e-12)) for k, w in weights.items())
    return s.read.parquet(folder).groupBy("name").agg(F.count("*").alias("rows")).withColumn("close", F.lit(worst < 0.01))


def pred21_blocked(s, d):
    """Readings of a slip with the offensive words taken out; words that begin with «при» or "un" stand for those."""
    pairs = I.space(s, d, "confusions")
    cands = pairs.select("lang", F.col("a").alias("typed"), F.col("b").alias("word")).union(pairs.select("lang", "b", "a")).union(pairs.select("lang", "a", "a"))
    bad = B.words(s, d).where("word LIKE 'с%' OR word LIKE 'b%'")
    return D.without_blocked(cands, bad)


def d15_user_words(s, d):
    """A user's words after two lists of changes: the slang list adds, its misspelt words take away."""
    slang = table(s, d, "slang").where("c0 IS NOT NULL")
    changes = slang.select(F.lower("c0").alias("word"), F.col("slang_id").alias("at"), F.col("c2").isNull().alias("add")).groupBy("word").agg(F.max("at").alias("at"), F.max_by("add", "at").alias("add"))
    return store.user_words(B.words(s, d).where("lang = 'en'").select("word"), changes)


def a29_link_recall(s, d):
    """Links of the held-out sentences that the kinds of links of the others allow."""
    def kinds(held: bool) -> DataFrame:
        e = G.shallow(B.sentences(s, d, heldout=held))
        return G.link_kinds(e, e.groupBy("word").agg(F.array_sort(F.collect_set("upos")).alias("tags")))  # a word has one tag here

    return G.link_recall(kinds(False), kinds(True))


def e04_next_words(s, d):
    """Of the held-out neighbours: how often the word is the likeliest after the one before, or among three."""
    pairs = I.space(s, d, "pairs")
    top = D.predict(pairs.select("lang", "prev"), pairs).select("lang", "prev", "word", "rk")
    asked = C.in_lexicon(C.pair_counts(B.sentences(s, d, heldout=True)), B.words(s, d), "prev", "word")
    j = asked.join(top, ["lang", "prev", "word"], "left")
    return j.groupBy("lang").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("rk") == 1, F.col("n")).otherwise(0)).alias("top1"), F.sum(F.when(F.col("rk") <= 3, F.col("n")).otherwise(0)).alias("top3"))


def e05_real_words(s, d):
    """Held-out places of confusable words: how often the next word's rule speaks for the other one, though the typed one is right."""
    obs = K.observations(B.sentences(s, d, heldout=True), I.space(s, d, "confusions"))
    nxt = F.get(F.filter("features", lambda f: f.startswith("w+1=")), 0)
    other = F.when(F.col("truth") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    typed = obs.withColumn("f", nxt).where("f IS NOT NULL").select("lang", F.concat_ws(":", "id", "pos", "a", "b").alias("id"), F.col("truth").alias("typed"), other.alias("alt"), F.expr("substring(f, 5)").alias("next"))
    said = K.evidence(typed.distinct(), I.space(s, d, "rules"))
    return typed.select("lang", "id").distinct().join(said, "id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count("for_alt").alias("judged"), F.count_if(F.col("for_alt") > 0).alias("wrong"))


def e08_candidates(s, d):
    """Predictions written as training data and read back."""
    folder = f"{shared_folder(s)}/lexloom-candidates-{uuid.uuid4().hex}"
    pairs = I.space(s, d, "pairs")
    D.predict(pairs.select("lang", "prev"), pairs).write.parquet(folder)
    return s.read.parquet(folder).select("lang", "prev", "word", "nats_milli", "rk")


def l16_phrase_scores(s, d):
    """What the words before say of each Russian word that has readings, in nats, by agreement, government and subject."""
    sents = B.sentences(s, d).where("lang = 'ru'")
    r = M.by_ending(B.words(s, d).where("lang = 'ru'"))
    pairs = C.pair_counts(sents).select("lang", "prev", "word", "n")
    frames = K.frames(M.governed_outcomes(pairs, r), least=20).select("key", F.col("values").alias("values"))
    rows = pairs.join(r.select(F.col("word").alias("prev"), F.col("readings").alias("pr")), "prev", "left").join(r.select("word", "readings"), "word")
    phrases = rows.where(F.size("readings") > 0).select("prev", "word", "readings", F.array(F.struct(F.col("prev").alias("word"), F.coalesce("pr", F.array().cast("array<bigint>")).alias("readings"))).alias("phrase"))
    return M.phrase_scores(phrases, frames).select("prev", "word", F.round("score", 4).alias("score"))


def l17_allowed(s, d):
    """Those that a prediction may show: the grammar says no worse of them than -0.99."""
    return l16_phrase_scores(s, d).where("score > -0.99").select("prev", "word")


def l14_weighed(s, d):
    """Held-out places of confusable words: the word and its partners by pairs, endings, classes and topics."""
    lex = I.space(s, d, "dictionary")
    heard = C.pair_counts(B.sentences(s, d, heldout=True)).select("lang", "prev", "word").join(lex.select("lang", "word"), ["lang", "word"], "left_semi")
    both = I.space(s, d, "confusions")
    other = both.select("lang", F.col("a").alias("word"), F.col("b").alias("cand")).union(both.select("lang", "b", "a"))
    places = heard.join(other.select("lang", "word").distinct(), ["lang", "word"], "left_semi").withColumn("qid", F.concat_ws(":", "lang", "prev", "word"))
    cands = places.select("qid", "lang", "prev", F.col("word").alias("cand"), F.lit(0.0).alias("edit")).union(places.join(other, ["lang", "word"]).select("qid", "lang", "prev", "cand", F.lit(1.0)))
    priced = cands.withColumnRenamed("cand", "word").join(lex.select("lang", "word", "prior_milli"), ["lang", "word"]).withColumn("cost", F.col("edit") + 0.4 * F.col("prior_milli") / 1000)
    cls = lambda w: F.concat("lang", F.lit(":"), F.left(w, F.lit(2)))
    a, b = cls("prev"), cls("word")
    topics = I.space(s, d, "topics").select(F.col("a").alias("ta"), F.col("b").alias("tb"), (F.col("pmi_milli") / 1000).alias("topic"))
    spoken = priced.join(R.class_fit(priced, K.suffix_tags(B.words(s, d)), I.space(s, d, "tag_pairs")), ["lang", "prev", "word"], "left").withColumns({"ta": F.least(a, b), "tb": F.greatest(a, b)}).join(topics, ["ta", "tb"], "left")
    return R.weigh(spoken, I.space(s, d, "pairs"), I.space(s, d, "endings"))


NAMES = (l14_weighed, x_scalar_functions, x_tokenize, x_edit_cost, f32_unseen, s24_prior_blocks, s26_weights, pred21_blocked, d15_user_words, a29_link_recall, e04_next_words, e05_real_words, e08_candidates, l16_phrase_scores, l17_allowed)


def sql() -> dict[str, str]:
    from . import context, corpus, decode, interactive

    other = {**decode.sql(), **context.sql()}
    fold = B.fold_accents
    quant = "CAST(greatest(0, least(255, round(round((ln(count) - 5) / 0.05, 9)) + 128)) AS INTEGER)"
    held = interactive.edges_sql().replace(B.S, B.frames_sql("s", True), 1)
    kinds = "SELECT d.upos AS ltag, h.upos AS htag, d.rel, CASE WHEN d.pos < d.head THEN 'before' ELSE 'after' END AS side, least(abs(d.pos - d.head), 4) AS far, CAST(count(*) AS DOUBLE) AS share FROM e d JOIN e h ON h.id = d.id AND h.pos = d.head GROUP BY ALL"
    return {
        "x_scalar_functions": f"WITH {LEX} SELECT lang, word, {B.left_class('word')} AS l, {B.right_class('word')} AS r, {B.fold_yo('word')} AS e, {fold('word')} AS bare, round(least(length(word) / 4.0::DOUBLE / (2 * 0.45 * 0.45), 6.0) + 0.5, 6) AS cost, {quant} AS byte, round({quant} * 0.05::DOUBLE - 6.4, 6) AS back, CAST(floor(round(greatest(ln(100000000.0) - ln(count + 0.5), 0) * 1000, 6)) AS INTEGER) AS prior FROM lex",
        "x_tokenize": f"WITH {S} SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(t) AS token FROM s) GROUP BY ALL HAVING count(*) >= 5",
        "x_edit_cost": f"WITH {LEX} SELECT lang, word, 0.0::DOUBLE AS same, true AS dearer FROM lex WHERE length(word) > 1",
        "f32_unseen": f"WITH {LEX}, {PRIOR}, fl AS (SELECT lang, CAST(round(round((ln(greatest(sum(count), 1)) - ln(0.5)) * 10, 6)) * 100 AS INTEGER) AS floor FROM lex GROUP BY lang) SELECT lang, word, floor, prior_milli + 1700 >= floor AS unseen FROM pri JOIN fl USING (lang)",
        "s24_prior_blocks": f"WITH {LEX}, {PRIOR}, p AS (SELECT lang, prior_milli, row_number() OVER (PARTITION BY lang ORDER BY word) - 1 AS place FROM pri), z AS (SELECT lang, place // 64 AS block, min(prior_milli) AS least FROM p GROUP BY ALL) SELECT lang, block, 0 AS level, least FROM z UNION ALL SELECT lang, block // 64, 1, min(least) FROM z GROUP BY ALL",
        "pred21_blocked": f"WITH cf AS ({other['j08_confusions']}), c AS (SELECT lang, a AS typed, b AS word FROM cf UNION ALL SELECT lang, b, a FROM cf UNION ALL SELECT lang, a, a FROM cf) SELECT lang, typed, word FROM c WHERE typed = word OR NOT (word LIKE 'с%' OR word LIKE 'b%')",
        "d15_user_words": f"WITH {LEX}, ch AS (SELECT lower(c0) AS word, arg_max(c2 IS NULL, slang_id) AS add FROM slang WHERE c0 IS NOT NULL GROUP BY 1) SELECT word FROM (SELECT DISTINCT word FROM lex WHERE lang = 'en') WHERE word NOT IN (SELECT word FROM ch WHERE NOT add) UNION SELECT word FROM ch WHERE add AND length(word) <= 32 AND regexp_matches(word, '^[\\p{{L}}''-]*\\p{{L}}[\\p{{L}}''-]*$')",
        "a29_link_recall": f"""WITH seen AS (WITH {interactive.edges_sql()} {kinds}), held AS (WITH {held} {kinds}), l AS (SELECT unnest([1.0, 5.0, 20.0])::DOUBLE AS least), al AS (SELECT l.least, seen.* FROM seen JOIN l ON share >= l.least),
          n AS (SELECT least, count(*) AS kinds FROM al GROUP BY least) SELECT l.least, kinds, sum(h.share) AS links, sum(CASE WHEN EXISTS (SELECT 1 FROM al a WHERE a.least = l.least AND a.ltag = h.ltag AND a.htag = h.htag AND a.side = h.side AND a.far = h.far) THEN h.share ELSE 0 END) AS head_hits,
          sum(CASE WHEN EXISTS (SELECT 1 FROM al a WHERE a.least = l.least AND a.ltag = h.ltag AND a.htag = h.htag AND a.side = h.side AND a.far = h.far AND a.rel = h.rel) THEN h.share ELSE 0 END) AS hits FROM held h CROSS JOIN l JOIN n ON n.least = l.least GROUP BY ALL""",
        "e04_next_words": f"WITH tp AS ({other['l09_predict']}), {B.frames_sql('s', True)}, {NB}, {LEX}, ak AS (SELECT lang, prev, word, count(*) AS n FROM nb SEMI JOIN lex USING (lang, word) SEMI JOIN (SELECT lang, word AS prev FROM lex) p USING (lang, prev) GROUP BY ALL) SELECT lang, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN rk = 1 THEN n ELSE 0 END) AS BIGINT) AS top1, CAST(sum(CASE WHEN rk <= 3 THEN n ELSE 0 END) AS BIGINT) AS top3 FROM ak LEFT JOIN tp USING (lang, prev, word) GROUP BY lang",
        "l14_weighed": f"""WITH bg AS ({corpus.sql()['w03_bigrams_kept']}), ep AS ({corpus.sql()['a09_ending_pmi']}), tp AS ({context.sql()['a08_tag_pairs']}), tc AS ({context.sql()['a10_a12_class_pairs']}), cf AS ({other['j16_partners']}),
          {B.frames_sql('s', True)}, {NB}, {LEX}, {PRIOR}, pl AS (SELECT DISTINCT lang, prev, word FROM nb SEMI JOIN lex USING (lang, word) SEMI JOIN cf USING (lang, word)),
          c0 AS (SELECT lang || ':' || prev || ':' || word AS qid, lang, prev, word, 0.0 AS edit FROM pl UNION ALL SELECT pl.lang || ':' || prev || ':' || pl.word, pl.lang, prev, partner, 1.0 FROM pl JOIN cf ON cf.lang = pl.lang AND cf.word = pl.word),
          tg AS (SELECT lang, word, list_distinct(['*' || right(word, 1), '*' || right(word, 2)]) AS tags FROM lex), ct AS (SELECT c.lang, c.prev, c.word, unnest(l.tags) AS ltag, r.tags AS rt FROM (SELECT DISTINCT lang, prev, word FROM c0) c JOIN tg l ON l.lang = c.lang AND l.word = c.prev JOIN tg r ON r.lang = c.lang AND r.word = c.word),
          cl AS (SELECT x.lang, prev, word, coalesce(max(pmi8_milli) / 1000 - 8, -1.5) AS cfit FROM (SELECT lang, prev, word, ltag, unnest(rt) AS rtag FROM ct) x LEFT JOIN tp ON tp.lang = x.lang AND tp.ltag = x.ltag AND tp.rtag = x.rtag GROUP BY ALL),
          z AS (SELECT c0.*, prior_milli / 1000 AS own, exp(-nats_milli / 1000) AS pp, CASE WHEN cfit IS NOT NULL THEN 1.5 * greatest(-4, least(4, cfit)) ELSE greatest(-4, least(4, coalesce(pmi8_milli / 1000 - 8, 0))) END AS fit, greatest(-1.5, least(1.5, coalesce(pmi_milli / 1000, 0))) AS topic
            FROM c0 JOIN pri ON pri.lang = c0.lang AND pri.word = c0.word LEFT JOIN bg ON bg.lang = c0.lang AND bg.prev = c0.prev AND bg.word = c0.word LEFT JOIN ep ON ep.lang = c0.lang AND ep.lclass = {B.left_class('c0.prev')} AND ep.rclass = {B.right_class('c0.word')}
            LEFT JOIN cl ON cl.lang = c0.lang AND cl.prev = c0.prev AND cl.word = c0.word LEFT JOIN tc ON tc.a = least(c0.lang || ':' || left(c0.prev, 2), c0.lang || ':' || left(c0.word, 2)) AND tc.b = greatest(c0.lang || ':' || left(c0.prev, 2), c0.lang || ':' || left(c0.word, 2))),
          w AS (SELECT qid, word, round(edit + 0.4 * -ln(0.5 * coalesce(pp, 0) + 0.5 * exp(fit - own)) - 0.25 * topic, 6)::DOUBLE AS cost FROM z) SELECT qid, word, cost, CAST(row_number() OVER (PARTITION BY qid ORDER BY cost, word) AS INTEGER) AS rk FROM w""",
        "e08_candidates": other["l09_predict"],
    }
