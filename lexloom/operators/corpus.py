"""Counts over sentences: tokens, neighbours, mixtures of sources, pairs and endings, casing, coverage.

Neighbours are read off the token array of a sentence, so nothing is shuffled before counts are partial sums;
dictionaries are joined to counts, never to tokens.  Only tables of a row per language (and script or source) are
broadcast: their size is the number of languages, not of rows, and a language of a third of all rows isn't a key of
any shuffle on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X

HOLDOUT = 50


def corpus(df: DataFrame, id_col: str = "sent_id", text: str = "text", heldout: bool = False, stock: str = X.STOCK) -> DataFrame:
    """Sentences with an id and a text, without stock sentences; those held out (id divisible by 50) or the rest."""
    kept = df.where(F.col(text).isNotNull() & F.col(id_col).isNotNull() & ~F.col(text).rlike(stock))
    return kept.where((F.pmod(F.col(id_col), F.lit(HOLDOUT)) == 0) == F.lit(heldout))


def with_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("toks", X.tokens(F.col(text)))


def token_totals(sents: DataFrame) -> DataFrame:
    """(lang, tokens, words)."""
    return with_tokens(sents).groupBy("lang").agg(F.sum(F.size("toks")).alias("tokens"), F.sum(F.size(F.filter("toks", X.is_word))).alias("words"))


def word_tokens(sents: DataFrame, *keep: str) -> DataFrame:
    """One row per word as it stands: lang, kept columns, word."""
    return with_tokens(sents).select("lang", *keep, F.explode(F.filter("toks", X.is_word)).alias("word"))


def unigrams(sents: DataFrame, *by: str) -> DataFrame:
    return word_tokens(sents, *by).groupBy("lang", *by, "word").agg(F.count("*").alias("n"))


def neighbours(sents: DataFrame, *keep: str) -> DataFrame:
    """(lang, kept, prev, word): words with one blank between them; anything else between breaks the pair."""
    t = F.col("toks")
    three = with_tokens(sents).select("lang", *keep, F.explode(F.arrays_zip(t.alias("a"), F.slice(t, F.lit(2), F.size(t)).alias("gap"), F.slice(t, F.lit(3), F.size(t)).alias("b"))).alias("z"))
    named = three.select("lang", *keep, F.col("z.a").alias("prev"), F.col("z.gap"), F.col("z.b").alias("word"))
    return named.where((F.col("gap") == " ") & X.is_word(F.col("prev")) & X.is_word(F.col("word"))).drop("gap")


def pair_counts(sents: DataFrame, *by: str) -> DataFrame:
    return neighbours(sents, *by).groupBy("lang", *by, "prev", "word").agg(F.count("*").alias("n"))


def in_lexicon(df: DataFrame, lexicon: DataFrame, *columns: str) -> DataFrame:
    """Rows whose words all stand in the lexicon of their language (semi joins)."""
    for c in columns:
        df = df.join(lexicon.select("lang", F.col("word").alias(c)), ["lang", c], "left_semi")
    return df


def source_units(uni: DataFrame, weights: DataFrame) -> DataFrame:
    """(lang, source, unit): what one word of a source weighs, its weight over its words; a source without a weight counts 1."""
    totals = uni.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    return totals.join(weights.select("source", "weight"), "source", "left").select("lang", "source", (F.coalesce("weight", F.lit(1.0)) / F.col("words")).alias("unit"))


def mixture(counts: DataFrame, units: DataFrame, *keys: str) -> DataFrame:
    """Counts by source (lang, source, keys, n) as weighted shares of their source's words, summed: (lang, keys, mass, raw)."""
    return counts.join(F.broadcast(units), ["lang", "source"]).groupBy("lang", *keys).agg(F.sum(F.col("unit") * F.col("n")).alias("mass"), F.sum("n").alias("raw"))


def bigrams(uni: DataFrame, pairs: DataFrame, lexicon: DataFrame, min_count: int = 3, min_gain: float = 1.0, per_left: int = 64, per_right: int = 8) -> DataFrame:
    """(lang, prev, word, nats_milli) of the pairs worth keeping.

    ``uni`` (lang, word, mass) and ``pairs`` (lang, prev, word, mass, raw) hold words of the lexicon only.  A pair is
    kept with ``min_count`` sightings and a gain of ``min_gain`` nats over its right word alone, if it is among the
    likeliest of its left or of its right word (ties: the other word in order).  A pair with ё is kept with е too,
    unless that is a pair of its own.
    """
    by_script = uni.groupBy("lang", X.script(F.col("word")).alias("script")).agg(F.sum("mass").alias("script_mass"))
    right = uni.join(F.broadcast(by_script), ["lang"]).where(F.col("script") == X.script(F.col("word"))).select("lang", F.col("word").alias("right"), F.col("mass").alias("mass_b"), "script_mass")
    left = uni.select("lang", F.col("word").alias("left"), F.col("mass").alias("mass_a"))
    scored = (
        pairs.where(F.col("raw") >= min_count).select("lang", F.col("prev").alias("left"), F.col("word").alias("right"), "mass")
        .join(left, ["lang", "left"]).join(right, ["lang", "right"])
        .withColumn("p", F.round(F.col("mass") / F.col("mass_a"), 9)).withColumn("q", F.round(F.col("mass") / F.col("mass_b"), 9))
        .where(F.round(F.ln("p") - F.ln(F.col("mass_b") / F.col("script_mass")), 6) >= min_gain)
    )
    rn = lambda part, by, other: F.row_number().over(Window.partitionBy("lang", part).orderBy(F.desc(by), other))
    kept = scored.withColumn("rl", rn("left", "p", "right")).withColumn("rr", rn("right", "q", "left")).where((F.col("rl") <= per_left) | (F.col("rr") <= per_right)).select("lang", "left", "right", "p")
    plain = (
        kept.select("lang", X.fold_yo(F.col("left")).alias("l"), X.fold_yo(F.col("right")).alias("r"), "p", "left", "right")
        .where((F.col("l") != F.col("left")) | (F.col("r") != F.col("right")))
        .groupBy("lang", F.col("l").alias("left"), F.col("r").alias("right")).agg(F.max("p").alias("p"))
        .join(kept, ["lang", "left", "right"], "left_anti")
    )
    return kept.union(in_lexicon(plain, lexicon, "left", "right").select("lang", "left", "right", "p")).select("lang", F.col("left").alias("prev"), F.col("right").alias("word"), N.nats_milli(F.col("p")).alias("nats_milli"))


def ending_pmi(uni: DataFrame, pairs: DataFrame, min_count: int = 3) -> DataFrame:
    """(lang, lclass, rclass, pmi8_milli) from word counts and pair counts; the left margin counts pairs only."""
    right = uni.groupBy("lang", X.right_class(F.col("word")).alias("rclass")).agg(F.sum("n").alias("r"))
    total = right.groupBy("lang").agg(F.sum("r").alias("total"))
    both = pairs.groupBy("lang", X.left_class(F.col("prev")).alias("lclass"), X.right_class(F.col("word")).alias("rclass")).agg(F.sum("n").alias("c"))
    left = both.groupBy("lang", "lclass").agg(F.sum("c").alias("l"))
    pmi = (F.ln(F.col("c") / F.col("l")) - F.ln(F.col("r") / F.col("total"))) * F.col("c") / (F.col("c") + 5.0)
    return both.where(F.col("c") >= min_count).join(left, ["lang", "lclass"]).join(right, ["lang", "rclass"]).join(F.broadcast(total), "lang").select("lang", "lclass", "rclass", N.pmi8_milli(pmi).alias("pmi8_milli"))


def casing_counts(sents: DataFrame, text: str = "text") -> DataFrame:
    """(lang, word, lo, cap, caps): how words are written inside sentences, after another word and a blank."""
    t = F.col("toks")
    raw = sents.withColumn("toks", F.regexp_extract_all(F.col(text), F.lit(rf"[\p{{L}}'-]+|\s+|."), F.lit(0)))
    three = raw.select("lang", F.explode(F.arrays_zip(t.alias("a"), F.slice(t, F.lit(2), F.size(t)).alias("gap"), F.slice(t, F.lit(3), F.size(t)).alias("b"))).alias("z"))
    w = three.select("lang", F.col("z.a"), F.col("z.gap"), F.col("z.b").alias("w")).where((F.col("gap") == " ") & F.col("a").rlike(r"^\p{L}") & F.col("w").rlike(r"^\p{L}"))
    kind = X.casing_class(F.col("w"))
    return w.groupBy("lang", F.lower("w").alias("word")).agg(F.count_if(kind == "lower").alias("lo"), F.count_if(kind == "cap").alias("cap"), F.count_if(kind == "upper").alias("caps"))


def casing_flags(counts: DataFrame, least: int = 5, share: float = 0.8) -> DataFrame:
    """(lang, word, lo, cap, caps, flag): 2 for words mostly in capitals, 1 mostly with a capital, 0 else."""
    n = F.col("lo") + F.col("cap") + F.col("caps")
    flag = F.when((n >= least) & (F.col("caps") >= share * n), 2).when((n >= least) & (F.col("cap") + F.col("caps") >= share * n), 1).otherwise(0)
    return counts.select("lang", "word", "lo", "cap", "caps", flag.alias("flag"))


def coverage(heldout: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(lang, tokens, hits, accented, accented_hits, coverage) of the words of held-out sentences."""
    uni = unigrams(heldout)
    flagged = uni.join(lexicon.select("lang", "word", F.lit(1).alias("hit")).distinct(), ["lang", "word"], "left")
    hit, acc = F.col("hit").isNotNull(), X.fold_accents(F.col("word")) != F.col("word")
    s = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return flagged.groupBy("lang").agg(F.sum("n").alias("tokens"), s(hit).alias("hits"), s(acc).alias("accented"), s(acc & hit).alias("accented_hits"), F.round(s(hit) / F.sum("n"), 6).alias("coverage"))


def misses(heldout: DataFrame, lexicon: DataFrame, k: int = 20) -> DataFrame:
    """(lang, word, n, rk): the commonest held-out words the lexicon lacks."""
    lacking = unigrams(heldout).join(lexicon, ["lang", "word"], "left_anti")
    return lacking.withColumn("rk", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rk") <= k)


def first_of_each(df: DataFrame, text: str = "text", id_col: str = "sent_id") -> DataFrame:
    """Near-copies by a normalised key (lower case, letters and digits only); the least id of a key is kept: (id, kept)."""
    key = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", "")
    keyed = df.select(F.col(id_col).alias("id"), F.md5(key.cast("binary")).alias("key")).distinct()
    least = keyed.groupBy("key").agg(F.min("id").alias("least"))
    return keyed.join(least, "key").groupBy("id").agg(F.max(F.col("id") == F.col("least")).alias("kept")).withColumnRenamed("id", id_col)


def is_spam(text: Column) -> Column:
    """Links, sign runs and sentences mostly in capitals."""
    letters, capitals = F.length(F.regexp_replace(text, r"[^\p{L}]", "")), F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))
    return text.rlike(r"https?://|www\.|([!?.])\1{4,}") | ((letters > 20) & (capitals > 0.7 * letters))


def without_words(sents: DataFrame, banned: DataFrame, id_col: str = "sent_id") -> DataFrame:
    """Sentences none of whose words stand in ``banned`` (lang, word): an anti join on the ids of the others."""
    hit = word_tokens(sents, id_col).join(banned, ["lang", "word"], "left_semi").select(id_col).distinct()
    return sents.join(hit, id_col, "left_anti")
