"""Key spaces that several queries read: built once a session into the store, then read from there."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import context as K
from ..operators import corpus as C
from ..operators import lexicon as L
from ..sources import store
from ..tables import ready, shared_folder
from . import base as B

#: The tables a key space is made of; those not listed are made of all three.
NEEDS = {"dictionary": ("lexicon",), "confusions": ("lexicon",), "yo": ("lexicon",)}
ALL = ("build_frames", "lexicon", "mix_targets")
_BUILT: dict[tuple, str] = {}


def _stamp(s: SparkSession, d: str, space: str) -> tuple:
    """When the tables were written, and how large they are: another one means another store."""
    out = []
    for name in NEEDS.get(space, ALL):
        path = s._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        fs = path.getFileSystem(s._jsc.hadoopConfiguration())
        out.append((fs.getContentSummary(path).getLength(), fs.getFileStatus(path).getModificationTime()))
    return tuple(out)


def space(s: SparkSession, d: str, name: str) -> DataFrame:
    """A key space of the tables of a folder, from the store."""
    key = (s.sparkContext.applicationId, d, name, _stamp(s, d, name))
    if key not in _BUILT:
        folder = f"{shared_folder(s)}/lexloom-store-{uuid.uuid4().hex}"
        store.write(MAKE[name](ready(s), d), folder, name)
        _BUILT[key] = folder
    return store.read(s, _BUILT[key], name)


def _mixed(s, d):
    sents, lex = B.sentences(ready(s), d), B.words(s, d)
    uni = C.in_lexicon(C.unigrams(sents, "source"), lex, "word").checkpoint()  # a row per word and source, read several times
    units = C.source_units(uni, B.weights(s, d))
    return C.mixture(uni, units, "word"), C.mixture(C.in_lexicon(C.pair_counts(sents, "source"), lex, "prev", "word"), units, "prev", "word"), lex


def _pairs(s, d):
    return C.bigrams(*_mixed(s, d))


def _endings(s, d):
    sents, lex = B.sentences(s, d), B.words(s, d)
    return C.ending_pmi(C.in_lexicon(C.unigrams(sents), lex, "word"), C.in_lexicon(C.pair_counts(sents), lex, "prev", "word"))


def _tag_pairs(s, d):
    lex = B.words(s, d)
    return K.tag_pairs(C.in_lexicon(C.pair_counts(B.sentences(s, d)), lex, "prev", "word"), K.suffix_tags(lex))


def _rules(s, d):
    return K.decision_list(K.observations(B.sentences(ready(s), d), K.confusions(B.words(s, d))).checkpoint(), min_count=3, min_favoured=2)


def _commas(s, d):
    return K.comma_table(K.bare_gaps(B.sentences(s, d)), least=10)


def _casing(s, d):
    return C.casing_flags(C.casing_counts(B.sentences(s, d))).select("lang", "word", "flag")


def _yo(s, d):
    return store.yo_masks(B.words(s, d))


def _topics(s, d):
    classes = B.words(s, d).select("lang", "word", F.concat("lang", F.lit(":"), F.left("word", F.lit(2))).alias("cls"))
    bags = C.word_tokens(B.sentences(s, d), "sent_id").join(classes, ["lang", "word"]).select(F.col("sent_id").alias("id"), "cls")
    return K.class_pairs(bags, min_pairs=20, min_pmi=0.3)


OUTCOMES = ("other", "a", "e", "o", "s", "n", "t", "m")


def _frames(s, d):
    last = X.fold_accents(F.right("word", F.lit(1)))
    outcome = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, OUTCOMES)), last), F.lit(0)) - 1, F.lit(0))
    return K.frames(C.pair_counts(B.sentences(s, d)).select("lang", F.col("prev").alias("key"), outcome.cast("int").alias("outcome"), F.col("n").cast("double").alias("weight")), least=50)


MAKE: dict[str, Callable] = {
    "dictionary": lambda s, d: L.priors(B.words(s, d)),
    "pairs": _pairs,
    "endings": _endings,
    "tag_pairs": _tag_pairs,
    "frames": _frames,
    "commas": _commas,
    "confusions": lambda s, d: K.confusions(B.words(s, d)),
    "rules": _rules,
    "topics": _topics,
    "casing": _casing,
    "yo": _yo,
}
