"""Building a lexicon: lists, forms, filters, factored priors, and the store of priors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..tables import rank_all

# Words that are often run together.
GLUED = ("вобщем", "вообщем", "впринципе", "всмысле", "впорядке", "вообщето", "тоесть", "чтоли", "какбы", "ачем", "тото", "втом")
HYPHENLESS = "^(кто|что|где|когда|как|куда|откуда|почему|зачем|чей|чья|чье|чьё|чьи|какой|какая|какое|какие|какого|какому|каким|каком|какую|кого|кому|кем|ком|чего|чему|чем|чём)(то|нибудь|либо)$"


def frequency_list(df: DataFrame, word: str, count: str, min_count: int = 1) -> DataFrame:
    """(lang, word, count): lower case, letters only, the largest count of a word."""
    w = F.lower(F.col(word))
    return df.where(X.is_word(w) & (F.col(count) >= min_count)).groupBy("lang", w.alias("word")).agg(F.max(count).alias("count"))


def summed(df: DataFrame, word: str, count: str) -> DataFrame:
    w = F.lower(F.col(word))
    return df.where(X.is_word(w)).groupBy("lang", w.alias("word")).agg(F.sum(F.coalesce(F.col(count), F.lit(0))).alias("count"))


def union_lists(*lists: DataFrame) -> DataFrame:
    """Lists (lang, word, count) together, each word with its largest count."""
    return reduce(DataFrame.unionByName, lists).groupBy("lang", "word").agg(F.max("count").alias("count"))


def overlay(dictionary: DataFrame, user: DataFrame) -> DataFrame:
    """A user's words beside the dictionary, which wins on equal words."""
    both = dictionary.select("lang", "word", "count", F.lit(0).alias("src")).unionByName(user.select("lang", "word", "count", F.lit(1).alias("src")))
    return both.groupBy("lang", "word").agg(F.min_by("count", "src").alias("count"), F.min("src").alias("src"))


def is_glued(word: Column) -> Column:
    return word.isin(*GLUED) | word.rlike(HYPHENLESS)


def keep_words(counts: DataFrame, allowed: DataFrame, verbs: DataFrame, keep_frequent: int) -> DataFrame:
    """Words of an allowed list, or frequent ones that are neither clipped nor run together (не with a verb form)."""
    flagged = (
        counts.join(allowed.select("lang", "word", F.lit(True).alias("ok")).distinct(), ["lang", "word"], "left")
        .withColumn("tail", F.when(F.col("word").startswith("не"), F.col("word").substr(F.lit(3), F.length("word"))))
        .join(verbs.select("lang", F.col("word").alias("tail"), F.lit(True).alias("verb")).distinct(), ["lang", "tail"], "left")
    )
    ok = F.col("ok") | ((F.col("count") >= keep_frequent) & ~X.is_artifact(F.col("word")) & ~is_glued(F.col("word")) & F.col("verb").isNull())
    return flagged.where(F.coalesce(ok, F.lit(False))).select("lang", "word", "count")


def with_forms(counts: DataFrame, forms: DataFrame, share: float = 0.02) -> DataFrame:
    """Every form of a lemma joins: its own count, or a share of its lemma's top form, at least 1; never below what it has.

    ``forms`` (lang, form, lemma) may list a form several times; a count of 0 counts as none.
    """
    f = forms.join(counts.select("lang", F.col("word").alias("form"), "count"), ["lang", "form"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    top = f.groupBy("lang", "lemma").agg(F.max("count").alias("top"))
    given = F.when(F.col("count") > 0, F.col("count")).otherwise(F.greatest(F.lit(1), F.bround(F.round(share * F.col("top"), 6), 0).cast("long")))
    formed = f.join(top, ["lang", "lemma"]).select("lang", F.col("form").alias("word"), given.cast("long").alias("count"))
    return union_lists(counts.select("lang", "word", "count"), formed)


def with_yo_variants(counts: DataFrame) -> DataFrame:
    spelled = counts.where(F.col("word").contains("ё")).select("lang", X.fold_yo(F.col("word")).alias("word"), "count")
    return union_lists(counts.select("lang", "word", "count"), spelled)


def priors(counts: DataFrame) -> DataFrame:
    """(lang, word, count, prior_milli): prices by language."""
    total = counts.groupBy("lang").agg(F.sum("count").alias("total"))
    return counts.join(F.broadcast(total), "lang").select("lang", "word", "count", N.prior_milli(F.col("count"), F.col("total")).alias("prior_milli"))


def ranked(counts: DataFrame) -> DataFrame:
    """The same with rk: rank 1 is the commonest of its language, ties in order of the words."""
    return rank_all(priors(counts), F.desc("count"), F.asc("word"), by=("lang",), first=1)


def is_offensive(word: Column, prefixes: list[str], exact: list[str]) -> Column:
    """Prefix-aware: a listed word, or a listed stem behind a verb prefix."""
    stem = F.regexp_replace(word, "^(за|на|по|про|вы|от|до|при|пере|раз|рас|об|у|с)?", "")
    hit = reduce(lambda a, b: a | b, [word.startswith(p) | stem.startswith(p) for p in prefixes], F.lit(False))
    return hit | word.isin(*exact)


def contaminated(own: DataFrame, foreign: DataFrame, ratio: float = 10.0) -> DataFrame:
    """Words that are ``ratio`` times commoner in a foreign list: (word, own_n, foreign_n)."""
    return own.select("word", F.col("count").alias("own_n")).join(foreign.select("word", F.col("count").alias("foreign_n")), "word").where(F.col("foreign_n") >= ratio * F.col("own_n"))


def ocr_errors(counts: DataFrame, letters: str | None = None, times: int = 5) -> DataFrame:
    """Words a single substitution away from one that is ``times`` times commoner, by a key with the letter cut out.

    With ``letters`` only places that hold one of them, in the rarer word, count.
    """
    keyed = counts.select("lang", "word", "count", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i")).withColumn("key", F.concat(F.expr("substring(word, 1, i - 1)"), F.lit("_"), F.expr("substring(word, i + 1)")))
    best = keyed.groupBy("lang", "key").agg(F.max("count").alias("best"))
    wrong = keyed if letters is None else keyed.where(F.expr("substring(word, i, 1)").isin(*letters))
    return wrong.join(best, ["lang", "key"]).where(F.col("best") >= times * F.col("count")).groupBy("lang", "word", "count").agg(F.max("best").alias("best"))


def minority_spellings(counts: DataFrame) -> DataFrame:
    """(lang, word, major): words whose accent-folded group has a commoner spelling."""
    bare = X.fold_accents(F.col("word"))
    top = counts.groupBy("lang", bare.alias("bare")).agg(F.max(F.struct("count", "word")).alias("t"), F.count("*").alias("n")).where("n > 1")
    return counts.withColumn("bare", bare).join(top, ["lang", "bare"]).where(F.col("word") != F.col("t.word")).select("lang", "word", F.col("t.word").alias("major"))


def skewed_variants(counts: DataFrame, a: str, b: str, times: float = 2.0) -> DataFrame:
    """Pairs of spellings with ``a`` and ``b`` swapped where the first is ``times`` commoner: (lang, word, variant, count, other)."""
    made = counts.where(F.col("word").contains(a)).withColumn("variant", F.replace("word", F.lit(a), F.lit(b)))
    return made.join(counts.select("lang", F.col("word").alias("variant"), F.col("count").alias("other")), ["lang", "variant"]).where(F.col("count") >= times * F.col("other")).select("lang", "word", "variant", "count", "other")


def proper_only(readings: DataFrame) -> DataFrame:
    """(lang, word): forms all of whose readings (lang, word, is_name) are names."""
    return readings.groupBy("lang", "word").agg(F.bool_and("is_name").alias("every")).where("every").select("lang", "word")


def factored_priors(words: DataFrame, exact: int = 1000, step: float = 0.05) -> DataFrame:
    """Priors as lemma x slot: (lang, word, lemma, slot, milli, loss, exact).

    ``words`` (lang, word, lemma, slot, count).  A slot's share is of the counts of all lemmas that offer it; the
    ``exact`` words with the largest count x error keep their own price.
    """
    lemma = words.groupBy("lang", "lemma").agg(F.sum("count").alias("lc"))
    total = words.groupBy("lang").agg(F.sum("count").alias("total"))
    offered = words.join(lemma, ["lang", "lemma"]).groupBy("lang", "slot").agg(F.sum("count").alias("used"), F.sum("lc").alias("offered"))
    steps = lambda x: F.round(F.round(x / step, 6)) * step
    j = words.join(lemma, ["lang", "lemma"]).join(offered, ["lang", "slot"]).join(F.broadcast(total), "lang")
    made = steps(F.ln("total") - F.ln(F.col("lc") + 0.5)) + steps(-F.ln((F.col("used") + 0.5) / (F.col("offered") + 1)))
    true = F.ln("total") - F.ln(F.col("count") + 0.5)
    out = j.select("lang", "word", "lemma", "slot", F.round(made * 1000).cast("int").alias("milli"), F.round(F.col("count") * F.abs(made - true), 3).alias("loss"))
    # the ``exact`` largest of each language: a limit by group that keeps that many rows of a task before it shuffles
    rn = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("loss"), "word", "slot"))
    largest = out.withColumn("rn", rn).where(F.col("rn") <= exact).select("lang", "word", "lemma", "slot", F.lit(True).alias("exact"))
    return out.join(largest, ["lang", "word", "lemma", "slot"], "left").withColumn("exact", F.coalesce("exact", F.lit(False)))


def inflect_by_analogy(new: DataFrame, paradigm: DataFrame) -> DataFrame:
    """Forms of new words like a model word's: (lang, word, form, count).

    ``new`` (lang, word, model, count), ``paradigm`` (lang, lemma, form).  The model's stem is what all its forms
    share; the new word must end as the model does after its stem.
    """
    p = paradigm.groupBy("lang", "lemma").agg(F.array_sort(F.collect_set("form")).alias("forms"))
    first, last = F.col("forms")[0], F.element_at("forms", -1)  # in sorted order these differ first
    j = new.join(p, (new["lang"] == p["lang"]) & (new["model"] == p["lemma"])).select(new["lang"], "word", "count", "model", "forms", F.least(X.common_prefix(first, last), X.common_prefix(first, F.col("model"))).alias("stem"))
    ending = F.expr("substring(model, stem + 1)")
    fits = j.withColumn("ending", ending).where(F.col("word").endswith(F.col("ending")) & (F.length("word") > F.length("ending")))
    base = F.expr("substring(word, 1, length(word) - length(ending))")
    return fits.select("lang", "word", "count", base.alias("base"), "stem", F.explode("forms").alias("f")).select("lang", "word", F.concat("base", F.expr("substring(f, stem + 1)")).alias("form"), "count")


def compounds(words: DataFrame, heads: DataFrame, least: int = 4) -> DataFrame:
    """Compounds as a known modifier (with a linking s, or none) and the longest known head: (lang, word, modifier, head)."""
    cuts = words.select("lang", "word", F.explode(F.sequence(F.lit(least), F.length("word") - least)).alias("i")).where(F.col("i") > 0).select("lang", "word", F.expr("substring(word, 1, i)").alias("modifier"), F.expr("substring(word, i + 1)").alias("head"))
    known = heads.select("lang", F.col("word").alias("head"))
    hit = cuts.join(known, ["lang", "head"], "left_semi").select("lang", "word", "head", F.explode(F.array_distinct(F.array("modifier", F.regexp_replace("modifier", "s$", "")))).alias("modifier"))
    full = hit.join(heads.select("lang", F.col("word").alias("modifier")), ["lang", "modifier"], "left_semi")
    rn = F.row_number().over(Window.partitionBy("lang", "word").orderBy(F.desc(F.length("head")), F.desc(F.length("modifier"))))
    return full.withColumn("rn", rn).where("rn = 1").select("lang", "word", "modifier", "head")


def expand_affixes(stems: DataFrame, rules: DataFrame, twofold: bool = False) -> DataFrame:
    """Dictionary words with affix flags to all their forms: (form, lemma).

    ``stems`` (word, flags array<string>), ``rules`` (flag, kind 'SFX'|'PFX', strip, add, condition regex, cross boolean,
    next array<string>).  Prefixes combine with suffixes where both cross; twofold suffixes are one more join.
    """
    s = stems.select(F.col("word").alias("lemma"), F.col("word").alias("form"), F.col("flags"))

    def once(of: DataFrame, kind: str) -> DataFrame:
        j = of.select("lemma", "form", F.explode("flags").alias("flag"), F.col("flags").alias("all_flags")).join(rules.where(F.col("kind") == kind), "flag")
        fits = F.expr("form rlike concat('(', condition, ')', '$')") if kind == "SFX" else F.expr("form rlike concat('^(', condition, ')')")
        strip = F.expr("(kind = 'SFX' AND endswith(form, strip)) OR (kind = 'PFX' AND startswith(form, strip))")
        made = F.expr("concat(substring(form, 1, length(form) - length(strip)), add)") if kind == "SFX" else F.expr("concat(add, substring(form, length(strip) + 1))")
        return j.where(fits & strip).select("lemma", made.alias("form"), F.col("next").alias("flags"), "all_flags", "cross")

    suffixed, prefixed = once(s, "SFX"), once(s, "PFX")
    crossed = once(suffixed.where("cross").select("lemma", "form", F.col("all_flags").alias("flags")), "PFX").where("cross")
    parts = [s.select("form", "lemma"), suffixed.select("form", "lemma"), prefixed.select("form", "lemma"), crossed.select("form", "lemma")]
    if twofold:
        parts.append(once(suffixed.select("lemma", "form", "flags"), "SFX").select("form", "lemma"))
    return reduce(DataFrame.union, parts).distinct()
