"""Models of context: confusion pairs, observations and rules, commas, topics, grammar counts and frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X

# Phone rows from top to bottom and how far each is moved to the right, in keys.
KEYS = {"cyr": (("йцукенгшщзх", "фывапролджэ", "ячсмитьбю"), (0.0, 0.0, 1.0)), "lat": (("qwertyuiop", "asdfghjkl", "zxcvbnm"), (0.0, 0.5, 1.5))}
# A preposition and its other form, and не / ни.
PREPOSITIONS = (("в", "во"), ("с", "со"), ("к", "ко"), ("о", "об"), ("об", "обо"), ("о", "обо"), ("из", "изо"), ("от", "ото"), ("над", "надо"), ("под", "подо"), ("перед", "передо"), ("без", "безо"), ("не", "ни"))


def near_keys() -> list[tuple[str, str]]:
    """Pairs of keys that one slip confuses: beside each other or touching in the next row."""
    out = []
    for rows, shift in KEYS.values():
        at = [(x + shift[r], r, c) for r, row in enumerate(rows) for x, c in enumerate(row)]
        out += [(a, b) for ax, ay, a in at for bx, by, b in at if a != b and abs(ay - by) <= 1 and abs(ax - bx) <= 1 + (0.01 if ay == by else 0.6)]
    return out


def _commoner(n: str, word: str, other_n: str, other: str):
    """Whether the first word comes before the second: the larger count, ties in order of the words."""
    return (F.col(n) > F.col(other_n)) | ((F.col(n) == F.col(other_n)) & (F.col(word) < F.col(other)))


def confusions(counts: DataFrame) -> DataFrame:
    """(lang, a, b) of words (lang, word, count) one slip apart: a neighbouring key, an accent left out, a doubled letter written once.

    A similarity self-join by keys with the letter cut out at a place, so that no two words are compared that don't
    meet; ``a`` is the commoner.
    """
    spark = counts.sparkSession
    near = spark.createDataFrame(near_keys(), "x string, y string")
    at = counts.select("lang", "word", "count", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i")).withColumn("ch", F.expr("substring(word, i, 1)"))
    holed = at.withColumn("key", F.concat(F.expr("substring(word, 1, i - 1)"), F.lit("_"), F.expr("substring(word, i + 1)")))
    side = lambda w, n, c: holed.select("lang", "key", F.col("word").alias(w), F.col("count").alias(n), F.col("ch").alias(c))
    meet = side("a", "na", "x").join(side("b", "nb", "y"), ["lang", "key"]).where((F.col("a") != F.col("b")) & _commoner("na", "a", "nb", "b")).select("lang", "a", "b", "x", "y")
    slips = meet.join(F.broadcast(near), ["x", "y"], "left_semi").select("lang", "a", "b")
    accents = meet.where((X.fold_accents(F.col("x")) == X.fold_accents(F.col("y"))) & ((X.fold_accents(F.col("x")) == F.col("x")) | (X.fold_accents(F.col("y")) == F.col("y")))).select("lang", "a", "b")
    single = at.where(F.expr("substring(word, i + 1, 1) = ch")).select("lang", F.col("word").alias("long"), F.col("count").alias("nl"), F.concat(F.expr("substring(word, 1, i - 1)"), F.expr("substring(word, i + 1)")).alias("word"))
    first = _commoner("nl", "long", "count", "word")
    doubled = single.join(counts.select("lang", "word", "count"), ["lang", "word"]).select("lang", F.when(first, F.col("long")).otherwise(F.col("word")).alias("a"), F.when(first, F.col("word")).otherwise(F.col("long")).alias("b"))
    return slips.union(accents).union(doubled).distinct()


def spelling_pairs(counts: DataFrame, have: DataFrame) -> DataFrame:
    """(lang, a, b): prepositions with о, -тся / -ться; those not in ``have`` in either order."""
    listed = counts.sparkSession.createDataFrame(PREPOSITIONS, "x string, y string").withColumn("lang", F.lit("ru"))
    reflexive = counts.where(F.col("word").endswith("тся") & (F.col("lang") == "ru")).select("lang", F.col("word").alias("x"), F.regexp_replace("word", "тся$", "ться").alias("y"))
    of = lambda w, n: counts.select("lang", F.col("word").alias(w), F.col("count").alias(n))
    ranked = listed.select("lang", "x", "y").union(reflexive).join(of("x", "nx"), ["lang", "x"]).join(of("y", "ny"), ["lang", "y"])
    first = _commoner("nx", "x", "ny", "y")
    pairs = ranked.select("lang", F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b")).distinct()
    either = have.select("lang", "a", "b").union(have.select("lang", F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(either, ["lang", "a", "b"], "left_anti")


def accent_groups(counts: DataFrame, have: DataFrame, min_count: int = 100, min_length: int = 3) -> DataFrame:
    """(lang, a, b): all pairs of words (lang, word, count) that are equal without accents, ``a`` the commoner; those not in ``have`` in either order.

    A group has no more words than its letters have accents, so it is small whatever the lexicon's size.
    """
    bare = counts.where((F.col("count") >= min_count) & (F.length("word") >= min_length)).select("lang", "word", "count", X.fold_accents(F.col("word")).alias("bare"))
    of = lambda w, n: bare.select("lang", "bare", F.col("word").alias(w), F.col("count").alias(n))
    pairs = of("a", "na").join(of("b", "nb"), ["lang", "bare"]).where((F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") > F.col("b")))).select("lang", "a", "b")
    either = have.select("lang", "a", "b").union(have.select("lang", F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(either, ["lang", "a", "b"], "left_anti")


def observations(sents: DataFrame, pairs: DataFrame, cap: int = 20_000, id_col: str = "sent_id") -> DataFrame:
    """(lang, a, b, truth, id, pos, features): places of confusable words with what stands around them.

    Of each pair and word the first ``cap`` by id and place are kept.  Features: bos, p-1, w-1, w-2, eos, w+1.
    """
    word = lambda t: t.isNotNull() & t.rlike(r"^[\p{L}'-]")
    toks = F.col("toks")
    at = lambda k: F.get(toks, F.col("pos") + k)
    placed = (
        sents.withColumn("toks", X.words_and_marks(F.col("text")))
        .select("lang", F.col(id_col).alias("id"), "toks", F.posexplode("toks").alias("pos", "truth"))
        .where(word(F.col("truth")))
        .select("lang", "id", "pos", "truth", F.when(F.col("pos") > 0, at(-1)).alias("p1"), F.when(F.col("pos") > 1, at(-2)).alias("p2"), at(1).alias("n1"))
    )
    sides = pairs.select("lang", "a", "b", F.explode(F.array("a", "b")).alias("truth"))
    joined = placed.join(sides, ["lang", "truth"])
    rn = F.row_number().over(Window.partitionBy("lang", "a", "b", "truth").orderBy("id", "pos"))
    feats = F.array_compact(F.array(
        F.when(F.col("p1").isNull(), F.lit("bos")).when(~word(F.col("p1")), F.concat(F.lit("p-1="), "p1")).otherwise(F.concat(F.lit("w-1="), "p1")),
        F.when(word(F.col("p1")) & word(F.col("p2")), F.concat(F.lit("w-2="), "p2")),
        F.when(F.col("n1").isNull() | F.col("n1").isin(".", "!", "?"), F.lit("eos")).when(word(F.col("n1")), F.concat(F.lit("w+1="), "n1")),
    ))
    return joined.withColumn("rn", rn).where(F.col("rn") <= cap).select("lang", "a", "b", "truth", "id", "pos", feats.alias("features"))


def decision_list(obs: DataFrame, min_count: int = 10, min_favoured: int = 5, min_llr: float = 1.0, most: int = 20, clamp: float = 6.0, prefixes: tuple[str, ...] = ("w+1=", "c+1=")) -> DataFrame:
    """(lang, a, b, feature, word, strength_milli): the strongest features of each pair whose two words were both seen."""
    is_a = F.col("truth") == F.col("a")
    total = obs.groupBy("lang", "a", "b").agg(F.count_if(is_a).alias("na"), F.count_if(~is_a).alias("nb")).where("na > 0 AND nb > 0")
    used = reduce(lambda x, y: x | y, [F.col("feature").startswith(p) for p in prefixes])
    feats = obs.select("lang", "a", "b", "truth", F.explode("features").alias("feature")).where(used)
    seen = feats.groupBy("lang", "a", "b", "feature").agg(F.count_if(is_a).alias("ca"), F.count_if(~is_a).alias("cb")).where(F.col("ca") + F.col("cb") >= min_count)
    llr = F.round(F.ln((F.col("ca") + 0.5) / (F.col("na") + 1.0)) - F.ln((F.col("cb") + 0.5) / (F.col("nb") + 1.0)), 6)
    scored = seen.join(total, ["lang", "a", "b"]).withColumn("llr", llr).where((F.abs("llr") >= min_llr) & (F.when(F.col("llr") > 0, F.col("ca")).otherwise(F.col("cb")) >= min_favoured))
    rn = F.row_number().over(Window.partitionBy("lang", "a", "b").orderBy(F.desc(F.abs("llr")), F.desc("feature")))
    return scored.withColumn("rn", rn).where(F.col("rn") <= most).select("lang", "a", "b", "feature", F.when(F.col("llr") > 0, F.col("a")).otherwise(F.col("b")).alias("word"), F.bround(F.least(F.abs("llr"), F.lit(clamp)) * 1000, 0).cast("int").alias("strength_milli"))


def evidence(typed: DataFrame, rules: DataFrame, phonetic: float = 6.0) -> DataFrame:
    """What the next word says for the other of a pair: the one strongest rule that matches (typed: id, lang, typed, alt, next).

    «о» before a vowel is «об» by ``phonetic`` nats, whatever the word.  Of rules of one strength the one for ``alt`` holds.
    """
    key = lambda x, y: F.array_sort(F.array(x, y))
    t = typed.select("id", "lang", "typed", "alt", "next", F.concat(F.lit("w+1="), "next").alias("feature"), key(F.col("typed"), F.col("alt")).alias("pair"))
    r = rules.select("lang", "feature", "word", "strength_milli", key(F.col("a"), F.col("b")).alias("pair"))
    by_rule = t.join(r, ["lang", "feature", "pair"]).select("id", F.when(F.col("word") == F.col("alt"), F.col("strength_milli")).otherwise(-F.col("strength_milli")).alias("for_alt"))
    about = (F.col("typed") == "о") & (F.col("alt") == "об") & F.lower("next").rlike("^[аоуэиы]")
    by_sound = t.where(about).select("id", F.lit(round(phonetic * 1000)).alias("for_alt"))
    return by_rule.union(by_sound).groupBy("id").agg(F.max_by("for_alt", F.struct(F.abs("for_alt"), "for_alt")).alias("for_alt"))


# Commas

def bare_gaps(sents: DataFrame) -> DataFrame:
    """(lang, a, b, comma): the pairs of ``gaps`` without their places and what stands before; read off shifted copies of the token array."""
    t = F.col("toks")
    after = lambda k: F.slice(t, F.lit(k + 1), F.size(t))
    z = sents.withColumn("toks", X.words_and_marks(F.col("text"))).select("lang", F.explode(F.arrays_zip(t.alias("a"), after(1).alias("x"), after(2).alias("y"))).alias("z")).select("lang", "z.a", "z.x", "z.y")
    comma = (F.col("x") == ",") & X.is_word(F.col("y"))
    b = F.when(comma, F.col("y")).when(X.is_word(F.col("x")), F.col("x"))
    return z.where(X.is_word(F.col("a"))).select("lang", "a", b.alias("b"), F.coalesce(comma, F.lit(False)).alias("comma")).where(F.col("b").isNotNull())


def gaps(sents: DataFrame, id_col: str = "sent_id") -> DataFrame:
    """(lang, id, pos, a, b, comma, first, and_before): pairs of words with nothing or only a comma between them.

    ``first``: a begins a sentence.  ``and_before``: «и» among the three words before a since the last comma or end.
    Both are kept by one fold over the sentence's own array.
    """
    word, end = X.is_word, lambda x: x.isin(".", "!", "?")
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<struct<a:string,first:boolean,and_before:boolean>>").alias("out"), F.lit(True).alias("first"), none.alias("last"))
    state = lambda out, first, last: F.struct(out.alias("out"), first.alias("first"), last.alias("last"))

    def step(acc, x):
        here = F.when(word(x), F.struct(x.alias("a"), acc["first"].alias("first"), F.array_contains(acc["last"], "и").alias("and_before")))
        last = F.when(end(x) | (x == ","), none).when(word(x), F.slice(F.concat(acc["last"], F.array(x)), F.greatest(F.size(acc["last"]) - 1, F.lit(1)), F.lit(3))).otherwise(acc["last"])
        return state(F.concat(acc["out"], F.array(here)), F.when(end(x), F.lit(True)).when(word(x), F.lit(False)).otherwise(acc["first"]), last)

    t = F.col("toks")
    read = sents.withColumn("toks", X.words_and_marks(F.col("text"))).select("lang", F.col(id_col).alias("id"), "toks", F.aggregate(t, start, step)["out"].alias("read"))
    after = lambda k: F.slice(t, F.lit(k + 1), F.size(t))
    each = read.select("lang", "id", F.posexplode(F.arrays_zip(F.col("read").alias("r"), after(1).alias("x"), after(2).alias("y"))).alias("pos", "z")).select("lang", "id", "pos", "z.r.a", "z.r.first", "z.r.and_before", "z.x", "z.y")
    comma = (F.col("x") == ",") & word(F.col("y"))
    b = F.when(comma, F.col("y")).when(word(F.col("x")), F.col("x"))
    return each.where(F.col("a").isNotNull()).select("lang", "id", "pos", "a", b.alias("b"), F.coalesce(comma, F.lit(False)).alias("comma"), "first", "and_before").where(F.col("b").isNotNull())


def comma_table(g: DataFrame, least: int = 50, single: float = 0.5, pair: float = 1.0) -> DataFrame:
    """(lang, key, logit_milli): "@" the base, "<w" after a word, ">w" before one, "a b" a pair that says more than its parts."""
    c = g.groupBy("lang", "a", "b").agg(F.count("*").alias("n"), F.count_if("comma").alias("k"))  # the sentences are read once, all else sums these
    base = c.groupBy("lang").agg((F.sum("k") / F.sum("n")).alias("p")).where("p > 0 AND p < 1").withColumn("base", F.ln(F.col("p") / (1 - F.col("p"))))
    odds = lambda k, n: N.logit(F.col(k), F.col(n), F.col("p")).alias("v")

    def side(word: str, tag: str) -> DataFrame:
        sums = c.groupBy("lang", word).agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where(F.col("n") >= least)
        return sums.join(F.broadcast(base), "lang").select("lang", F.col(word).alias("w"), odds("k", "n"), "base", F.lit(tag).alias("tag"))

    before, after = side("b", ">"), side("a", "<")
    pairs = (
        c.where(F.col("n") >= least).join(F.broadcast(base), "lang").select("lang", "a", "b", odds("k", "n"), "base")
        .join(before.select("lang", F.col("w").alias("b"), F.col("v").alias("vb")), ["lang", "b"], "left")
        .join(after.select("lang", F.col("w").alias("a"), F.col("v").alias("va")), ["lang", "a"], "left")
    )
    guess = F.col("base") + F.coalesce(F.col("vb") - F.col("base"), F.lit(0.0)) + F.coalesce(F.col("va") - F.col("base"), F.lit(0.0))
    m = lambda v: F.bround(F.round(v * 1000, 6), 0).cast("int").alias("logit_milli")
    singles = before.unionByName(after).where(F.round(F.abs(F.col("v") - F.col("base")), 6) >= single).select("lang", F.concat("tag", "w").alias("key"), m(F.col("v")))
    own = pairs.where(F.round(F.abs(F.col("v") - guess), 6) >= pair).select("lang", F.concat_ws(" ", "a", "b").alias("key"), m(F.col("v")))
    return base.select("lang", F.lit("@").alias("key"), m(F.col("base"))).unionByName(singles).unionByName(own)


def comma_odds(places: DataFrame, table: DataFrame) -> DataFrame:
    """(lang, a, b, odds_milli) of pairs (lang, a, b): the pair's own, else the base and what each word adds."""
    look = lambda key, name: table.select("lang", F.col("key").alias(key), F.col("logit_milli").alias(name))
    j = (
        places.select("lang", "a", "b").distinct()
        .withColumns({"kp": F.concat_ws(" ", X.fold_yo(F.col("a")), X.fold_yo(F.col("b"))), "ka": F.concat(F.lit("<"), X.fold_yo(F.col("a"))), "kb": F.concat(F.lit(">"), X.fold_yo(F.col("b"))), "k0": F.lit("@")})
        .join(look("k0", "v0"), ["lang", "k0"]).join(look("kp", "vp"), ["lang", "kp"], "left").join(look("ka", "va"), ["lang", "ka"], "left").join(look("kb", "vb"), ["lang", "kb"], "left")
    )
    odds = F.coalesce(F.col("vp"), F.coalesce("va", "v0") + F.coalesce("vb", "v0") - F.col("v0"))
    return j.select("lang", "a", "b", odds.cast("int").alias("odds_milli"))


# Topics


def class_pairs(bags: DataFrame, min_pairs: int = 20, min_pmi: float = 0.3, shrink: float = 20.0) -> DataFrame:
    """(a, b, c, pmi_milli) of classes in one bag (id, cls); bags of two classes or more count."""
    once = bags.distinct()
    several = once.groupBy("id").agg(F.array_sort(F.collect_set("cls")).alias("cs")).where(F.size("cs") > 1)  # as many as there are classes, at most
    n = several.count()
    single = several.select(F.explode("cs").alias("cls")).groupBy("cls").agg(F.count("*").alias("s"))
    pairs = several.select("cs", F.posexplode("cs").alias("i", "a")).select("a", F.explode(F.expr("slice(cs, i + 2, size(cs))")).alias("b")).groupBy("a", "b").agg(F.count("*").alias("c")).where(F.col("c") >= min_pairs)
    j = pairs.join(single.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a").join(single.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b")
    pmi = F.ln(F.col("c") * F.lit(float(n)) / (F.col("sa") * F.col("sb"))) * F.col("c") / (F.col("c") + shrink)
    return j.withColumn("pmi", F.round(pmi, 6)).where(F.abs("pmi") >= min_pmi).select("a", "b", "c", F.bround(F.col("pmi") * 1000, 0).cast("int").alias("pmi_milli"))


def ppmi(pairs: DataFrame, row: str, col: str, count: str) -> DataFrame:
    """(row, col, ppmi) of counts: ln(c total / (row sum x col sum)), not below 0."""
    r, c = pairs.groupBy(row).agg(F.sum(count).alias("r")), pairs.groupBy(col).agg(F.sum(count).alias("k"))
    total = r.groupBy(F.lit(1).alias("one")).agg(F.sum("r").alias("total"))
    j = pairs.join(r, row).join(c, col).withColumn("one", F.lit(1)).join(F.broadcast(total), "one")  # one row
    return j.select(row, col, F.round(F.greatest(F.ln(F.col(count) * F.col("total") / (F.col("r").cast("double") * F.col("k"))), F.lit(0.0)), 6).alias("ppmi"))


# Grammar


def tag_pairs(pairs: DataFrame, tags: DataFrame) -> DataFrame:
    """(lang, ltag, rtag, pmi8_milli): each of a word's n readings counts 1/n, a pair of them 1/(n m); pairs below 1 are dropped."""
    t = tags.withColumn("w", F.lit(1.0) / F.size("tags"))
    left = t.select("lang", F.col("word").alias("prev"), F.explode("tags").alias("ltag"), F.col("w").alias("lw"))
    right = t.select("lang", "word", F.explode("tags").alias("rtag"), F.col("w").alias("rw"))
    both = pairs.join(left, ["lang", "prev"]).join(right, ["lang", "word"]).groupBy("lang", "ltag", "rtag").agg(F.sum(F.col("n") * F.col("lw") * F.col("rw")).alias("c"))
    l, r = both.groupBy("lang", "ltag").agg(F.sum("c").alias("l")), both.groupBy("lang", "rtag").agg(F.sum("c").alias("r"))
    total = both.groupBy("lang").agg(F.sum("c").alias("total"))
    pmi = (F.ln(F.col("c") / F.col("l")) - F.ln(F.col("r") / F.col("total"))) * F.col("c") / (F.col("c") + 5.0)
    return both.where(F.round(F.col("c"), 6) >= 1).join(l, ["lang", "ltag"]).join(r, ["lang", "rtag"]).join(F.broadcast(total), "lang").select("lang", "ltag", "rtag", N.pmi8_milli(pmi).alias("pmi8_milli"))


def frames(governed: DataFrame, outcomes: int = 8, least: int = 100, alpha: float = 20.0, says: float = 0.3) -> DataFrame:
    """(lang, key, values): smoothed log ratios of what follows a governor, over the outcomes of all of them.

    ``governed`` (lang, key, outcome 0..outcomes-1, weight double).  Keys seen less than ``least`` times and those whose
    ratios all stay below ``says`` are dropped.
    """
    sums = [F.sum(F.when(F.col("outcome") == i, F.col("weight")).otherwise(0.0)) for i in range(outcomes)]
    rows = governed.groupBy("lang", "key").agg(F.array(*sums).alias("row"), F.sum("weight").alias("n")).where(F.col("n") >= least)
    every = governed.groupBy("lang").agg(F.array(*sums).alias("all"), F.sum("weight").alias("total"))
    shares = F.transform("all", lambda x: F.greatest(x / F.col("total"), F.lit(1e-6)))
    values = F.transform(N.smoothed_ratios(F.col("row"), F.col("shares")), lambda v: F.round(v, 3))
    return rows.join(F.broadcast(every.select("lang", shares.alias("shares"))), "lang").select("lang", "key", values.alias("values")).where(F.round(F.array_max(F.transform("values", F.abs)), 3) >= says)


def agree_shares(pairs: DataFrame, alpha: float = 20.0) -> DataFrame:
    """(lang, key, agree_milli, disagree_milli): how much oftener than all others a word agrees (lang, key, agrees, n)."""
    s = pairs.groupBy("lang", "key").agg(F.sum(F.when(F.col("agrees"), F.col("n")).otherwise(0)).alias("yes"), F.sum("n").alias("n"))
    g = pairs.groupBy("lang").agg((F.sum(F.when(F.col("agrees"), F.col("n")).otherwise(0)) / F.sum("n")).alias("p")).where("p > 0 AND p < 1")
    m = lambda k, p: F.bround(F.round(F.ln((k + alpha * p) / (F.col("n") + alpha) / p) * 1000, 6), 0).cast("int")
    return s.join(F.broadcast(g), "lang").select("lang", "key", m(F.col("yes"), F.col("p")).alias("agree_milli"), m(F.col("n") - F.col("yes"), 1 - F.col("p")).alias("disagree_milli"))


def kind_fit(pairs: DataFrame) -> DataFrame:
    """(left, right, n, fit_milli): kinds of subject against kinds of what follows, seen over expected by chance."""
    l, r = pairs.groupBy("left").agg(F.sum("n").alias("l")), pairs.groupBy("right").agg(F.sum("n").alias("r"))
    total = l.groupBy(F.lit(1).alias("one")).agg(F.sum("l").alias("total"))
    j = pairs.groupBy("left", "right").agg(F.sum("n").alias("n")).join(l, "left").join(r, "right").withColumn("one", F.lit(1)).join(F.broadcast(total), "one")  # one row
    return j.select("left", "right", "n", F.bround(F.round(F.ln(F.col("n") * F.col("total") / (F.col("l").cast("double") * F.col("r"))) * 1000, 6), 0).cast("int").alias("fit_milli"))


def tag_table(spark: SparkSession, rows: list[tuple[str, str, list[str]]]) -> DataFrame:
    return spark.createDataFrame(rows, "lang string, word string, tags array<string>")


def suffix_tags(words: DataFrame) -> DataFrame:
    """Readings by ending, for languages without a tagged dictionary: the last letter and the last two."""
    return words.select("lang", "word", F.array_distinct(F.array(F.concat(F.lit("*"), F.right("word", F.lit(1))), F.concat(F.lit("*"), F.right("word", F.lit(2))))).alias("tags"))

