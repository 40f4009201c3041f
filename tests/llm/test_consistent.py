import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.llm import consistent as C

LETTERS = st.text(st.sampled_from("abceopxyABCéëеёйоСΟό̈̆​‍­ 　ａＺ１ -.,!👍🙂Ａд"), max_size=12)


@settings(max_examples=400, deadline=None)
@given(LETTERS, st.sampled_from(["ru", "en", None]))
def test_form_is_its_own_form(text, lang):
    once = C.consistent_str(text, lang)
    assert C.consistent_str(once, lang) == once
    assert unicodedata.is_normalized("NFC", once)
    assert C.consistent_str(unicodedata.normalize("NFD", text), lang) == C.consistent_str(unicodedata.normalize("NFC", text), lang) or "‍" in text


@pytest.mark.parametrize(
    ("text", "lang", "form"),
    [
        ("ｈｅllo", "en", "hello"), ("hеllо", "en", "hello"), ("пpивeт", "ru", "привет"), ("новый", "ru", "новый"), ("été", "fr", "été"), ("a b c", "en", "a b c"), ("a​b­c﻿", "en", "abc"),
        ("e​́", "fr", "é"), ("Ёж ёж", "ru", "Ёж ёж"), ("éte", "fr", "éte"), ("ОК", "ru", "ОК"), ("OK", "ru", "ОК"), ("ё", "ru", "ё"), ("ë", "ru", "ё"), ("ё", "fr", "ë"), ("1！", "en", "1!"), ("", "en", ""), (None, "en", None),
        ("👨‍👩", "en", "👨‍👩"), ("a‍b", "en", "ab"), ("日本語 한글", "en", "日本語 한글"),
    ],
)
def test_cases(text, lang, form):
    assert C.consistent_str(text, lang) == form


def test_conflicting_table_is_refused():
    t = C.Transducer("lat")
    with pytest.raises(ValueError, match="two outputs"):
        t._add("а", "b")


def test_column_equals_function(spark):
    texts = ["plain", "пpивeт", "ｈｅllo", "é", "a b", "", None, "Ω Å", "x" * 50_000 + "​", "👍🙂⌨ — «…»", "日本"]
    rows = [(i, t, l) for i, (t, l) in enumerate((t, l) for t in texts for l in ("ru", "en", None, "xx"))]
    got = spark.createDataFrame(rows, "id int, text string, lang string").select("id", C.consistent(F.col("text"), F.col("lang")).alias("f")).collect()
    assert {r.id: r.f for r in got} == {i: C.consistent_str(t, l) for i, t, l in rows}


def test_words(spark):
    df = spark.createDataFrame([(1, "Some-body  can't ét​e 2x -a- b--c", "fr"), (2, None, "fr"), (3, " 12 ", "fr")], "id int, text string, lang string")
    assert {r.id: r.words for r in C.with_words(df).collect()} == {1: ["some-body", "can", "t", "éte", "x", "a", "b", "c"], 2: [], 3: []}


def test_words_of_a_batch_are_those_of_the_column(spark):
    frames = spark.read.parquet("/root/testdata/sf0.01/build_frames.parquet").where("text IS NOT NULL AND sent_id % 3 = 0").select("text", "lang")
    odd = ["x² Ⅷ ½a", "ＡＢ-ｃ d--e", "ǅ ŉ ﬁn İstanbul ΑΣ", "한글 각 日本語", "a_b 1c2 don't", "́a ẹ́ q̧́", "👨‍👩️ x", "Å Ω", "-a- b-", "ѐ ѐ"]
    df = frames.union(spark.createDataFrame([(t, l) for t in odd for l in ("ru", "en")], "text string, lang string"))
    rows = C.with_words(df).select("text", "lang", "words").collect()
    assert len(rows) > 3000 and all(C.words_of(r.text, r.lang == "ru") == r.words for r in rows)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aeКЅyсοnéё̧̣́̈ͅ​­ ﬁÅ가각क़"), max_size=9), st.sampled_from(["cyr", "lat"]))
def test_transducer_against_the_rule(text, script):
    """Without what is not seen, each letter replaced, and all composed."""
    t = C.transducer(script)
    plain = "".join(t.table.get(c, c) for c in text if c not in C.INVISIBLE)
    assert t(text) == unicodedata.normalize("NFC", plain)


def look(spark, rows, cols="tab string, id long, lang string, text string"):
    df = spark.createDataFrame(rows, cols)
    return sorted((r.tab, r.a_id, r.b_id) for r in C.look_alikes(df, "id", "text", "lang").collect())


def test_look_alikes(spark):
    rows = [("t", 1, "en", "abc"), ("t", 2, "en", "аbc"), ("t", 3, "en", "abc"), ("t", 4, "de", "аbc"), ("t", 5, "en", "Abc"), ("t", 6, "en", "..."), ("t", 7, "en", ".​.."), ("t", 8, "en", None), ("t", None, "en", "ab​c"), ("u", 2, "en", "abc"), ("t", 2, "en", "аbc"), ("t", 9, None, "x"), ("t", 10, None, "x​"), ("t", 11, "en", ""), ("t", 12, "en", "​")]
    assert look(spark, rows) == [("t", 1, 2), ("t", 2, 3), ("t", 9, 10)]


def test_copies_stay_out_of_the_join(spark):
    assert look(spark, [("t", i, "en", "same text") for i in range(2000)] + [("t", 5000, "en", "same text")]) == [("t", i, 5000) for i in range(2000)]


def test_a_hot_group_costs_its_pairs(spark):
    rows = [("t", i, "en", "same text") for i in range(30_000)] + [("t", 50_000 + i, "en", "same\u200b text") for i in range(2)]
    df = spark.createDataFrame(rows, "tab string, id long, lang string, text string")
    assert C.look_alikes(df, "id", "text", "lang").count() == 60_000


def test_empty_table_and_clashing_names(spark):
    assert look(spark, []) == []
    df = spark.createDataFrame([("t", 1, "en", "abc", 1, 2, "z"), ("t", 2, "en", "аbc", 1, 2, "z")], "tab string, id long, lang string, text string, k1 int, form int, words string")
    assert C.look_alikes(df, "id", "text", "lang").count() == 1
