"""What a place says for and against words, and the decisions that follow from costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..data import COMPLETE_FROM, COMPLETE_ON_SPACE, GRAMMAR_GAP, GRAMMAR_SLIP, KNOWN_SLIP, ONE_SLIP, SPACE_EARLY, STRENGTHS
from ..functions import numbers as N
from ..functions import text as X


def in_context(cands: DataFrame, pairs: DataFrame, endings: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Candidates (lang, prev, word, prior_milli, ...) with cost_milli of the word after ``prev``.

    A known pair and the word's own prior, moved by what its ending says after the left word's, are mixed; a place
    without a left word costs the prior.
    """
    c = cands.withColumn("lclass", X.left_class(F.col("prev"))).withColumn("rclass", X.right_class(F.col("word")))
    j = c.join(pairs.select("lang", "prev", "word", "nats_milli"), ["lang", "prev", "word"], "left").join(endings.select("lang", "lclass", "rclass", "pmi8_milli"), ["lang", "lclass", "rclass"], "left")
    fit = cfg.endings * F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.coalesce(F.col("pmi8_milli") / 1000 - 8, F.lit(0.0))))
    mixed = N.contextual(F.col("prior_milli") / 1000, F.col("nats_milli") / 1000, fit, cfg.ctx_lambda)
    cost = F.when(F.col("prev").isNull(), F.col("prior_milli") / 1000).otherwise(mixed)
    return j.withColumn("cost_milli", F.bround(F.round(cost * 1000, 6), 0).cast("int")).drop("lclass", "rclass", "nats_milli", "pmi8_milli")


def rerank(cands: DataFrame, pairs: DataFrame, endings: DataFrame, lexicon: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(qid, typed, word, cost, rk): corrections (qid, lang, typed, prev, word, edit) in the order that the place gives them."""
    with_prior = cands.join(lexicon.select("lang", "word", "prior_milli"), ["lang", "word"])
    priced = in_context(with_prior, pairs, endings, cfg).withColumn("cost", F.round(cfg.w_ch * F.col("edit") + cfg.w_lm * F.col("cost_milli") / 1000, 6))
    return priced.withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy("cost", "word"))).select("qid", "typed", "word", "cost", "rk")


# How far a fit and a topic may move a word, and what a pair of readings never seen together says.
FIT_CLAMP, TOPIC_CLAMP, UNSEEN_CLASS_PAIR = 4.0, 1.5, -1.5


def class_fit(places: DataFrame, tags: DataFrame, tag_pairs: DataFrame) -> DataFrame:
    """(lang, prev, word, class_fit): how much likelier a word's grammar is after the previous one's, by the best pair of their readings.

    ``places`` (lang, prev, word), ``tags`` (lang, word, tags); places with a word without readings have no row.
    """
    of = lambda w, t: tags.where(F.size("tags") > 0).select("lang", F.col("word").alias(w), F.col("tags").alias(t))
    j = places.select("lang", "prev", "word").distinct().join(of("prev", "lt"), ["lang", "prev"]).join(of("word", "rt"), ["lang", "word"])
    each = j.select("lang", "prev", "word", F.explode("lt").alias("ltag"), "rt").select("lang", "prev", "word", "ltag", F.explode("rt").alias("rtag"))
    scored = each.join(tag_pairs.select("lang", "ltag", "rtag", "pmi8_milli"), ["lang", "ltag", "rtag"], "left")
    return scored.groupBy("lang", "prev", "word").agg(F.coalesce(F.max("pmi8_milli") / 1000 - 8, F.lit(UNSEEN_CLASS_PAIR)).alias("class_fit"))


def weigh(cands: DataFrame, pairs: DataFrame, endings: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(qid, word, cost, rk): candidates (qid, lang, prev, word, edit, cost) as the place gives them; cost less edit is the word's own price.

    Further columns of ``cands`` speak where they are there and not null: ``frame_fit`` (the previous word's frame), ``class_fit`` (the
    readings of both), ``lemma_fit`` (the lemma vectors), ``phrase`` with ``by_subject`` (what the words before rule and ask), ``topic``
    (the mean of the sense classes of the sentence), and ``chooser`` (a model's log odds).  The frame speaks before the classes, and these before
    the endings.  A place without a previous word keeps the word's own price.  Ties go in order of the words.
    """
    at = lambda c: F.col(c) if c in cands.columns else F.lit(None).cast("double")
    clamp = lambda x, most: F.greatest(F.lit(-most), F.least(F.lit(most), x))
    c = cands.withColumn("__l", X.left_class(F.col("prev"))).withColumn("__r", X.right_class(F.col("word")))
    j = c.join(pairs.select("lang", "prev", "word", "nats_milli"), ["lang", "prev", "word"], "left").join(endings.select("lang", F.col("lclass").alias("__l"), F.col("rclass").alias("__r"), "pmi8_milli"), ["lang", "__l", "__r"], "left")
    forms = F.coalesce(F.nullif(at("frame_fit"), F.lit(0.0)), at("class_fit"))
    ending = F.coalesce(F.col("pmi8_milli") / 1000 - 8, F.lit(0.0))
    fit = F.when(forms.isNotNull(), cfg.classes * clamp(forms, FIT_CLAMP)).otherwise(cfg.endings * clamp(ending, FIT_CLAMP))
    lemma = cfg.lemma * clamp(F.coalesce(at("lemma_fit"), F.lit(0.0)), FIT_CLAMP)
    own = (F.col("cost") - F.col("edit")) / cfg.w_lm
    mixed = F.when(F.col("prev").isNull(), own).otherwise(N.contextual(own, F.col("nats_milli") / 1000, fit + lemma, cfg.ctx_lambda))
    phrase = F.when(F.coalesce(at("by_subject").cast("boolean"), F.lit(False)), cfg.subject).otherwise(cfg.phrase) * F.coalesce(at("phrase"), F.lit(0.0))
    chooser = clamp(cfg.chooser * F.coalesce(at("chooser"), F.lit(0.0)), cfg.chooser_clamp)
    topic = cfg.topic * clamp(F.coalesce(at("topic"), F.lit(0.0)), TOPIC_CLAMP)
    priced = j.select("qid", "word", F.round(F.col("edit") + cfg.w_lm * mixed - phrase - chooser - topic, 6).alias("cost"))
    return priced.withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy("cost", "word")))


def topic_shift(words: DataFrame, topics: DataFrame, pmi: DataFrame, weight: float = 0.25, most: float = 1.5) -> DataFrame:
    """(id, word, shift_milli): a word (id, word, cls) against the topics of a place (id, topic): the mean of what is known, clamped."""
    j = words.join(topics, "id").join(pmi.select(F.col("a").alias("cls"), F.col("b").alias("topic"), "pmi_milli"), ["cls", "topic"], "left")
    mean = F.avg(F.coalesce("pmi_milli", F.lit(0))) / 1000
    return j.groupBy("id", "word").agg(F.bround(F.round(-weight * F.greatest(F.lit(-most), F.least(F.lit(most), mean)) * 1000, 6), 0).cast("int").alias("shift_milli"))


def lemma_fit(places: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, fit): dot products of the vectors of two ids."""
    v = lambda k, x: vectors.select(F.col("id").alias(k), F.col("vec").alias(x))
    return places.join(v("a", "va"), "a").join(v("b", "vb"), "b").select("a", "b", F.round(N.dot(F.col("va"), F.col("vb")), 4).alias("fit"))


# Decisions

def auto_correct(cands: DataFrame, known: DataFrame, strength: str = "normal", completions: DataFrame | None = None, rejected: DataFrame | None = None, fits: DataFrame | None = None) -> DataFrame:
    """(qid, typed, chosen): the best candidate (qid, lang, typed, word, edit, cost) where it may replace what was typed, else what was typed.

    It must be cheap for its length, lead the runner-up, and beat a typed word that is itself ``known`` (lang, word) by a margin;
    a known word gives way to one slip only, except at strength "always".  ``completions`` (qid, word, edit, cost) that
    add few letters compete where enough was typed.  ``rejected`` (typed, word) never come.  ``fits`` (qid, word, fit) says how
    the grammar of the place likes the typed word and others, in nats: another form of a known word which it likes much better needs no
    slip, and may even be a completion, for the price of an early space.  Several capitals, a letter drawn out, a
    short token without a vowel (unless one slip from a word) and single letters are left as they are.
    Strings without a candidate have no row; ties go in order of the words.
    """
    per_letter, lead, margin = STRENGTHS[strength]
    low, n = F.lower("typed"), F.length(F.lower(F.col("typed")))
    if fits is None:
        fits = cands.sparkSession.createDataFrame([], f"qid {cands.schema['qid'].dataType.simpleString()}, word string, fit double")
    asked = cands.select("qid", "lang", "typed").distinct().withColumn("low", low)
    asked = asked.join(known.select("lang", F.col("word").alias("low"), F.lit(True).alias("known")).distinct(), ["lang", "low"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    asked = asked.withColumn("guarded", F.col("known") & F.lit(strength != "always")).join(fits.select("qid", F.col("word").alias("low"), F.col("fit").alias("own_fit")), ["qid", "low"], "left")
    rows = cands.select("qid", "word", "edit", "cost", F.lit(False).alias("more"))
    if completions is not None:
        rows = rows.unionByName(completions.select("qid", "word", "edit", "cost", F.lit(True).alias("more")))
    each = asked.join(rows, "qid").join(fits.select("qid", "word", "fit"), ["qid", "word"], "left")
    if rejected is not None:
        each = each.join(rejected.select(F.lower("typed").alias("low"), "word", F.lit(True).alias("no")).distinct(), ["low", "word"], "left").where("no IS NULL OR word = low")
    extra = F.length("word") - F.length("low")
    form = F.coalesce((F.col("edit") <= GRAMMAR_SLIP) & X.same_stem(F.col("low"), F.col("word")) & (F.col("fit") - F.col("own_fit") >= GRAMMAR_GAP), F.lit(False))
    each = each.withColumn("form", form).withColumn("early", F.col("more") & F.col("guarded"))
    finishes = extra.between(1, COMPLETE_ON_SPACE) & F.when(F.col("guarded"), F.col("form")).otherwise(F.length("low") >= COMPLETE_FROM)
    each = each.where(~F.col("more") | finishes).withColumn("cost", F.col("cost") + F.when(F.col("early"), SPACE_EARLY).otherwise(0.0))
    best = each.groupBy("qid", "lang", "typed", "low", "known", "guarded", "word").agg(F.min_by(F.struct("edit", "cost", "form", "early"), F.struct("cost", F.col("more").cast("int"))).alias("z"), F.min(F.when(~F.col("more"), F.col("edit"))).alias("slip"))
    best = best.select("*", "z.edit", "z.cost", "z.form", "z.early").drop("z")
    other = F.col("word") != F.col("low")
    of = Window.partitionBy("qid")
    first = of.orderBy((~other).cast("int"), "cost", "word")
    ranked = (
        best.withColumn("own", F.min(F.when(~other, F.col("cost"))).over(of))
        .withColumn("near", F.min(F.when(other & F.col("slip").isNotNull(), F.struct("cost", "word", "slip"))).over(of)["slip"] <= ONE_SLIP)
        .withColumn("next", F.lead(F.when(other, F.col("cost"))).over(first))
        .withColumn("rn", F.row_number().over(first))
        .where("rn = 1")
    )
    length = F.length("low")
    abbreviation = length.between(2, 5) & X.vowelless(F.col("low")) & ~F.coalesce("near", F.lit(False))
    capitals = F.length(F.regexp_replace("typed", r"\P{Lu}", "")) >= 2
    shaped = abbreviation | capitals | X.is_drawn_out(F.col("low"))
    cheap = (F.col("edit") <= F.lit(per_letter) * F.greatest(length, F.lit(3))) & (F.col("next").isNull() | (F.round(F.col("next") - F.col("cost"), 6) >= lead))
    beats = F.coalesce(F.col("cost") + F.when(F.col("early"), 0.0).otherwise(margin) < F.col("own"), F.lit(False))
    real = ~F.col("known") | (((F.col("edit") <= KNOWN_SLIP) | F.col("form") | ~F.col("guarded")) & beats)
    take = other & (length >= 2) & ~shaped & cheap & real
    return ranked.select("qid", "typed", F.when(take, X.like_typed(F.col("word"), F.col("typed"))).otherwise(F.col("typed")).alias("chosen"))


def finish_word(prefixes: DataFrame, least: int = 4, most_more: int = 2) -> DataFrame:
    """Completions (lang, prefix, word, rk) that a space may take: enough typed, little left."""
    return prefixes.where((F.length("prefix") >= least) & (F.length("word") - F.length("prefix") <= most_more) & (F.col("rk") == 1))


def prefer_split(single: DataFrame, split: DataFrame, margin_milli: int = 1000) -> DataFrame:
    """(lang, typed, chosen): the two words where they beat the single word by a margin, or where there is none."""
    j = split.join(single.select("lang", "typed", F.col("cost_milli").alias("one"), "word"), ["lang", "typed"], "full")
    two = F.col("cost_milli").isNotNull() & (F.col("one").isNull() | (F.col("cost_milli") + margin_milli < F.col("one")))
    return j.select("lang", "typed", F.when(two, F.concat_ws(" ", "left", "right")).otherwise(F.col("word")).alias("chosen"))


def two_word_window(prev: DataFrame, cur: DataFrame, pairs: DataFrame, margin: float = 1.5) -> DataFrame:
    """(qid, p, c, cost): the cheapest readings of two neighbouring words, at most five by three; another than the first must win by a margin.

    ``prev`` and ``cur`` (qid, lang, word, cost, rk) hold few readings of each place.
    """
    p = prev.where("rk <= 5").select("qid", "lang", F.col("word").alias("p"), F.col("cost").alias("cp"), F.col("rk").alias("rp"))
    c = cur.where("rk <= 3").select("qid", F.col("word").alias("c"), F.col("cost").alias("cc"), F.col("rk").alias("rc"))
    j = p.join(c, "qid").join(pairs.select("lang", F.col("prev").alias("p"), F.col("word").alias("c"), "nats_milli"), ["lang", "p", "c"], "left")
    cost = F.round(F.col("cp") + F.least(F.col("cc"), F.coalesce(F.col("nats_milli") / 1000, F.lit(1e9))), 6)
    priced = j.withColumn("cost", cost).withColumn("stay", (F.col("rp") == 1) & (F.col("rc") == 1)).withColumn("biased", F.col("cost") + F.when(F.col("stay"), 0.0).otherwise(margin))
    rn = F.row_number().over(Window.partitionBy("qid").orderBy("biased", "p", "c"))
    return priced.withColumn("rn", rn).where("rn = 1").select("qid", "p", "c", "cost")


def with_partners(cands: DataFrame, partners: DataFrame, cost: float = 1.0) -> DataFrame:
    """Candidates with the spelling partners (lang, a, b) of what was typed, at a fixed cost beyond its own."""
    both = partners.select("lang", F.col("a").alias("typed"), F.col("b").alias("word")).union(partners.select("lang", "b", "a"))
    made = cands.where(F.col("word") == F.col("typed")).drop("word").join(both, ["lang", "typed"]).withColumn("cost", F.col("cost") + cost)
    return cands.unionByName(made.select(*cands.columns)).groupBy("qid", "lang", "typed", "word").agg(F.min("cost").alias("cost"))


def strip(cands: DataFrame, slots: int = 3) -> DataFrame:
    """(qid, s1, s2, s3): the best in the middle of a strip of three."""
    place = F.when(F.col("rk") == 1, 2).when(F.col("rk") == 2, 1).otherwise(F.col("rk"))
    at = lambda i: F.max(F.when(place == i, F.col("word"))).alias(f"s{i}")
    return cands.where(F.col("rk") <= slots).groupBy("qid").agg(*[at(i) for i in range(1, slots + 1)])


def variants(cands: DataFrame, presses: Column) -> DataFrame:
    """(qid, shown): what a key that cycles shows after a number of presses: the typed string, then the candidates."""
    ring = F.array_distinct(F.concat(F.array("typed"), F.transform(F.array_sort("z"), lambda x: x["word"])))
    each = cands.groupBy("qid", "typed").agg(F.collect_list(F.struct("rk", "word")).alias("z")).select("qid", ring.alias("ring"))  # at most top_k
    return each.select("qid", F.get("ring", F.pmod(presses, F.size("ring"))).alias("shown"))


def zone_letters(typed: DataFrame, heads: DataFrame, alphabet: str) -> DataFrame:
    """(lang, typed, letter, alive): which next letters still lead to a word; ``heads`` (lang, prefix) are all heads of words."""
    nxt = typed.distinct().select("lang", "typed", F.explode(F.array(*map(F.lit, alphabet))).alias("letter")).withColumn("prefix", F.concat("typed", "letter"))
    return nxt.join(heads.select("lang", "prefix", F.lit(True).alias("hit")).distinct(), ["lang", "prefix"], "left").select("lang", "typed", "letter", F.coalesce("hit", F.lit(False)).alias("alive"))


# Commas and marks that may be put


def accept_marks(placed: DataFrame, at_enter: bool = False) -> DataFrame:
    """Placed marks (mark, rule, chance, learned) that proofreading puts, by rule and by the learned chance."""
    aside = F.col("rule").isin("set aside")
    comma = (F.col("mark") == ",") & ((F.col("learned") >= 0.7) | ((F.col("chance") >= 0.8) & (F.col("learned") >= F.when(aside, 0.05).otherwise(0.3))) | ((F.col("learned") < 0) & (F.col("chance") >= 0.8)))
    dash = (F.col("mark") == "—") & (F.col("learned") >= 0.7)
    end = (F.col("mark") == "?") & F.lit(at_enter)
    return placed.where(comma | dash | end)
