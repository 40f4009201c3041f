"""Readings as bits, agreement and government as expressions, and what a phrase says of the next word.

A word's readings are an array of bigint, one bit per grammeme.  Agreement of two readings, the fit of a predicate and
its subject and the cases a preposition governs are column expressions over those bits, so that a join of pairs is
judged in the JVM; the walk back over a phrase folds its last words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..data import GOVERNS, PRONOUNS
from ..tables import rank_all

# Grammemes by name; the bit of each is its place.
GRAMMEMES = (
    "NOUN ADJF ADJS COMP VERB INFN PRTF PRTS GRND NUMR ADVB NPRO PRED PREP CONJ PRCL INTJ "
    "masc femn neut ms-f sing plur nomn gent datv accs ablt loct voct gen2 acc2 loc2 1per 2per 3per past pres futr anim inan"
).split()
BIT = {g: 1 << i for i, g in enumerate(GRAMMEMES)}


def mask(names: str) -> int:
    return sum(BIT[n] for n in names.split())


GENDER, NUMBER, PERSON, TENSE = mask("masc femn neut ms-f"), mask("sing plur"), mask("1per 2per 3per"), mask("past pres futr")
FIRST_CASES, SECOND = mask("nomn gent datv accs ablt loct voct"), {"gen2": "gent", "acc2": "accs", "loc2": "loct"}
NOMINAL, ATTRIBUTE, PREDICATE = mask("NOUN ADJF PRTF NPRO NUMR"), mask("ADJF PRTF"), mask("VERB ADJS PRTS")
CASES = ("nomn", "gent", "datv", "accs", "ablt", "loct")


def government(spark: SparkSession) -> DataFrame:
    """(word, cases): the dimension table of prepositions."""
    return spark.createDataFrame([(w, mask(c)) for w, c in GOVERNS.items()], "word string, cases long")


def pronouns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, mask(g)) for w, g in PRONOUNS.items()], "word string, subject long")


def bits_of(tag: Column) -> Column:
    """A reading written as grammemes with commas; unknown ones are left out."""
    table = F.create_map(*[F.lit(x) for kv in BIT.items() for x in kv])
    return F.aggregate(F.split(tag, r"[,\s]+"), F.lit(0).cast("long"), lambda a, g: a.bitwiseOR(F.coalesce(table[g].cast("long"), F.lit(0))))


def has(r: Column, m: int) -> Column:
    return r.bitwiseAND(F.lit(m)) != 0


def cases(r: Column) -> Column:
    """The case bits, second cases as the first."""
    second = [F.when(has(r, BIT[a]), BIT[b]).otherwise(0) for a, b in SECOND.items()]
    return reduce(lambda a, b: a.bitwiseOR(b), second, r).bitwiseAND(F.lit(FIRST_CASES))


def agree(a: Column, b: Column) -> Column:
    """A case and the number in common, in the singular the gender, in the accusative alone the animacy."""
    both = cases(a).bitwiseAND(cases(b))
    ga, gb = a.bitwiseAND(F.lit(GENDER)), b.bitwiseAND(F.lit(GENDER))
    la, lb = a.bitwiseAND(F.lit(mask("anim inan"))), b.bitwiseAND(F.lit(mask("anim inan")))
    number = a.bitwiseAND(b).bitwiseAND(F.lit(NUMBER))
    alive = (both != BIT["accs"]) | (la == 0) | (lb == 0) | (la == lb)
    gender = ~has(number, BIT["sing"]) | (ga == 0) | (gb == 0) | (ga.bitwiseAND(gb) != 0) | has(ga.bitwiseOR(gb), BIT["ms-f"])
    return (both != 0) & (number != 0) & alive & gender


def fits_subject(p: Column, s: Column) -> Column:
    """A predicate's reading and a subject's: number; gender in the past and of short forms; person in the present; the imperative with the second person."""
    g = s.bitwiseAND(F.lit(GENDER))
    gender = ~has(p, BIT["sing"]) | (g == 0) | has(g, BIT["ms-f"]) | (p.bitwiseAND(g) != 0)
    short, past, timed = has(p, mask("ADJS PRTS")), has(p, BIT["past"]), has(p, TENSE)
    person = p.bitwiseAND(s).bitwiseAND(F.lit(PERSON)) != 0
    return (p.bitwiseAND(s).bitwiseAND(F.lit(NUMBER)) != 0) & F.when(short | past, gender).when(~timed, has(s, BIT["2per"])).otherwise(person)


def any_pair(a: Column, b: Column, test) -> Column:
    """Whether some reading of one word and some of another pass a test."""
    return F.exists(a, lambda x: F.exists(b, lambda y: test(x, y)))


def kind(r: Column) -> Column:
    """0 predicate, 1 gerund, 2 infinitive, 3 adverbial, 4 nominative, 5 another case, 6 preposition or conjunction, 7 else."""
    return (
        F.when(has(r, PREDICATE), 0).when(has(r, BIT["GRND"]), 1).when(has(r, BIT["INFN"]), 2).when(has(r, mask("ADVB PRCL PRED COMP")), 3)
        .when(has(r, NOMINAL) & (cases(r) != 0), F.when(has(cases(r), BIT["nomn"]), 4).otherwise(5)).when(has(r, mask("PREP CONJ")), 6).otherwise(7)
    )


def outcome(r: Column) -> Column:
    """What follows a governor: 0 other, 1 to 6 a case, 7 an infinitive."""
    c = cases(r)
    by_case = reduce(lambda acc, x: F.when(has(c, BIT[x[1]]), x[0]).otherwise(acc), reversed([*enumerate(CASES, 1)]), F.lit(0))
    return F.when(has(r, BIT["INFN"]), 7).when(has(r, NOMINAL), by_case).otherwise(0)


def frame_next(frame: Column, readings: Column) -> Column:
    """How much likelier than anywhere a word comes after a governor (an array of 8), by its best reading."""
    return F.coalesce(F.array_max(F.transform(readings, lambda r: F.get(frame, outcome(r)))), F.lit(0.0))


def walk(phrase: Column) -> Column:
    """The last five words of a phrase, last first."""
    return F.reverse(F.slice(phrase, F.greatest(F.lit(1), F.size(phrase) - 4), F.lit(5)))


def governor(phrase: Column) -> Column:
    """The word that governs what comes next: the nearest one back that is no attribute, over at most four attributes.

    ``phrase`` array<struct<word,readings>>; struct<word,between> with the
    readings passed over; word is null where no other word stands there.
    """
    only_attribute = lambda r: (F.size(r) > 0) & F.forall(r, lambda x: has(x, ATTRIBUTE))
    start = F.struct(F.lit(None).cast("string").alias("word"), F.array().cast("array<array<bigint>>").alias("between"))
    found = F.aggregate(
        walk(phrase), start,
        lambda acc, w: F.when(acc["word"].isNotNull(), acc).when(only_attribute(w["readings"]), F.struct(acc["word"].alias("word"), F.concat(acc["between"], F.array(w["readings"])).alias("between"))).otherwise(F.struct(w["word"].alias("word"), acc["between"].alias("between"))),
    )
    return found


def misfits(df: DataFrame, phrase: str = "phrase", readings: str = "readings") -> DataFrame:
    """``df`` with ``misfit``: the grammar rules a word out after a phrase.

    All its readings must be ruled out: by the case its preposition governs, by the attributes before it, or by a
    subject it doesn't fit.  A phrase is array<struct<word,readings>>.
    """
    gov = F.create_map(*[F.lit(x) for w, c in GOVERNS.items() for x in (w, mask(c))])
    pro = F.create_map(*[F.lit(x) for w, m in PRONOUNS.items() for x in (w, mask(m))])
    g = governor(F.col(phrase))
    attributes, word, r = g["between"], g["word"], F.col(readings)
    governed, subject = gov[word], pro[word]
    allowed = F.when(governed.isNotNull() & F.forall(attributes, lambda a: F.exists(a, lambda x: cases(x).bitwiseAND(governed) != 0)), governed)
    noun = lambda x: has(x, NOMINAL) & (cases(x) != 0)
    fits_phrase = F.exists(r, lambda x: (allowed.isNull() | (cases(x).bitwiseAND(allowed) != 0)) & F.forall(attributes, lambda a: F.exists(a, lambda y: agree(y, x))))
    asked = allowed.isNotNull() | (F.size(attributes) > 0)
    by_phrase = asked & F.forall(r, noun) & ~fits_phrase
    by_subject = subject.isNotNull() & (F.size(attributes) == 0) & F.forall(r, lambda x: has(x, PREDICATE)) & ~F.exists(r, lambda x: fits_subject(x, subject))
    return df.withColumn("misfit", F.when(F.size(r) == 0, F.lit(False)).otherwise(F.coalesce(by_phrase, F.lit(False)) | F.coalesce(by_subject, F.lit(False))))


def phrase_scores(df: DataFrame, frames: DataFrame, disagree: float = -2.0, fits: float = 0.5, misfit: float = -2.5, phrase: str = "phrase", readings: str = "readings") -> DataFrame:
    """``df`` with ``score``: what the phrase says for a word, in nats; frames (key, values) are those of governors."""
    g = governor(F.col(phrase))
    pro = F.create_map(*[F.lit(x) for w, m in PRONOUNS.items() for x in (w, mask(m))])
    r = F.col(readings)
    j = df.withColumn("__key", g["word"]).withColumn("__between", g["between"]).join(frames.select(F.col("key").alias("__key"), F.col("values").alias("__frame")), "__key", "left")
    subject = pro[F.col("__key")]
    by_subject = F.when(F.exists(r, lambda x: has(x, PREDICATE) & fits_subject(x, subject)), fits).when(F.forall(r, lambda x: has(x, PREDICATE)), misfit).otherwise(0.0)
    agrees = F.forall("__between", lambda a: any_pair(a, r, agree))
    by_frame = F.when(F.col("__frame").isNotNull(), frame_next(F.col("__frame"), r)).otherwise(0.0)
    score = F.when(subject.isNotNull(), by_subject).otherwise(by_frame + F.when(agrees, 0.0).otherwise(disagree))
    return j.withColumn("score", F.round(F.when(F.size(r) == 0, 0.0).otherwise(score), 6)).drop("__key", "__between", "__frame")


def governed_outcomes(pairs: DataFrame, readings: DataFrame) -> DataFrame:
    """(lang, key, outcome, weight): what follows each word, a word of n readings counting 1/n for each."""
    r = readings.select("lang", "word", F.explode("readings").alias("r"), (F.lit(1.0) / F.size("readings")).alias("w"))
    return pairs.join(r, ["lang", "word"]).groupBy("lang", F.col("prev").alias("key"), outcome(F.col("r")).alias("outcome")).agg(F.sum(F.col("n") * F.col("w")).alias("weight"))


def classes(readings: DataFrame) -> DataFrame:
    """(set, n, readings): sets of readings by how many words have them, the commonest first; ties in order of the sets."""
    sets = readings.groupBy(F.array_sort("readings").alias("readings")).agg(F.count("*").alias("n"))
    return rank_all(sets, F.desc("n"), F.asc("readings"), name="set").select("set", "n", "readings")


def comma_kind(readings: Column) -> Column:
    """A word's kind for commas: that of all its readings, MIX where they differ, UNK without any."""
    names = ("PRED", "GRND", "INFN", "ADV", "NOM", "OBL", "JOIN", "ELSE")
    kinds = F.array_distinct(F.transform(readings, lambda r: F.when(has(r, BIT["PRTF"]), "PRTF").otherwise(F.get(F.array(*map(F.lit, names)), kind(r)))))
    return F.when(F.size(readings) == 0, "UNK").when(F.size(kinds) == 1, kinds[0]).otherwise("MIX")


def linked_tag(upos: Column, rel: Column, readings: Column) -> Column:
    """The reading a link leaves: a subject's nominative, an object's accusative or genitive, else the first of its part of speech."""
    want = F.when(rel == "nsubj", BIT["nomn"]).when(rel.isin("obj", "iobj"), mask("accs gent datv")).otherwise(FIRST_CASES)
    part = F.when(upos == "NOUN", BIT["NOUN"]).when(upos == "VERB", mask("VERB INFN GRND")).when(upos == "ADJ", mask("ADJF ADJS COMP")).otherwise((1 << 17) - 1)
    fit = F.filter(readings, lambda r: (r.bitwiseAND(part) != 0) & (~has(r, NOMINAL) | (cases(r).bitwiseAND(want) != 0)))
    return F.coalesce(F.get(fit, 0), F.get(readings, 0))



# Own table: readings by ending, for lexicons without a tagged dictionary.
ENDINGS = {
    "ый": "ADJF,masc,sing,nomn ADJF,masc,sing,accs,inan",
    "ий": "ADJF,masc,sing,nomn ADJF,masc,sing,accs,inan",
    "ая": "ADJF,femn,sing,nomn",
    "ое": "ADJF,neut,sing,nomn ADJF,neut,sing,accs",
    "ые": "ADJF,plur,nomn ADJF,plur,accs,inan",
    "ого": "ADJF,masc,sing,gent ADJF,neut,sing,gent",
    "ому": "ADJF,masc,sing,datv ADJF,neut,sing,datv",
    "ет": "VERB,sing,3per,pres",
    "ит": "VERB,sing,3per,pres",
    "ют": "VERB,plur,3per,pres",
    "ал": "VERB,masc,sing,past",
    "ил": "VERB,masc,sing,past",
    "ала": "VERB,femn,sing,past",
    "ила": "VERB,femn,sing,past",
    "или": "VERB,plur,past",
    "ать": "INFN",
    "ить": "INFN",
    "я": "GRND NOUN,inan,femn,sing,nomn",
    "ость": "NOUN,inan,femn,sing,nomn NOUN,inan,femn,sing,accs",
    "ение": "NOUN,inan,neut,sing,nomn NOUN,inan,neut,sing,accs",
    "тель": "NOUN,anim,masc,sing,nomn",
    "ник": "NOUN,anim,masc,sing,nomn",
    "ок": "NOUN,inan,masc,sing,nomn NOUN,inan,masc,sing,accs",
    "ура": "NOUN,inan,femn,sing,nomn",
    "ина": "NOUN,inan,femn,sing,nomn",
    "ка": "NOUN,inan,femn,sing,nomn",
    "у": "NOUN,inan,femn,sing,accs NOUN,inan,masc,sing,datv",
    "о": "ADVB",
}


def by_ending(words: DataFrame) -> DataFrame:
    """(lang, word, readings): readings of words (lang, word) by their longest ending in the table; prepositions, pronouns and words without one have none."""
    bits = {k: [mask(r.replace(",", " ")) for r in v.split()] for k, v in ENDINGS.items()}
    none = F.array().cast("array<bigint>")
    found = none
    for ending in sorted(bits, key=len):
        found = F.when(F.col("word").endswith(ending), F.array(*(F.lit(b).cast("long") for b in bits[ending]))).otherwise(found)
    out = F.when(F.col("word").isin(*GOVERNS, *PRONOUNS), none).otherwise(found)
    return words.select("lang", "word", out.alias("readings"))

