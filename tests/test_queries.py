"""Every core query runs on the smallest tables, and equals its SQL where it has one."""

import pytest

from lexloom import queries as Q
from lexloom.operators import decode as D
from lexloom.operators import evaluate
from lexloom.plans import base, decode
from lexloom.tables import table
from tests.conftest import DATA, compare

ALL, SQL = Q.queries(), Q.oracle_sql()


def test_sql_names_are_queries():
    assert set(SQL) <= set(ALL)


@pytest.mark.parametrize("part", range(6))
def test_against_sql(spark, part):
    assert compare(spark, ALL, SQL, sorted(SQL)[part::6]) == []


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, name):
    assert ALL[name](spark, DATA).count() >= 0


@pytest.mark.parametrize("name", ("l04_suggest", "a35_accuracy"))
def test_corrections_ask_for_every_twentieth_row(spark, name):
    """Rare words too; the 150 commonest hold only some of them."""
    asked = decode._asked(spark, DATA)
    rows = table(spark, DATA, "lexicon").where("word_id % 20 = 0").selectExpr("lang", "lower(w) AS word").join(base.words(spark, DATA), ["lang", "word"], "left_semi").distinct()
    assert asked.select("lang", "word").distinct().exceptAll(rows).isEmpty() and rows.exceptAll(asked.select("lang", "word").distinct()).isEmpty()
    got = ALL[name](spark, DATA)
    if name == "l04_suggest":
        assert asked.select("lang", "typed").join(got, ["lang", "typed"], "left_anti").isEmpty()
    else:
        assert sum(r.n for r in got.collect()) == asked.count()


def test_corrections_of_every_word(spark):
    """All but those that no word comes near enough to."""
    typed = evaluate.typos(base.words(spark, DATA)).select("lang", "typed").distinct()
    bare = typed.join(ALL["l04_suggest"](spark, DATA), ["lang", "typed"], "left_anti").selectExpr("xxhash64(lang, typed) AS qid", "lang", "typed").cache()
    assert bare.count() < 20 and D.suggest_exhaustive(bare, decode._lex(spark, DATA)).isEmpty()


def test_accuracy_over_every_word(spark):
    typed = evaluate.typos(base.words(spark, DATA))
    assert {r.kind: r.n for r in ALL["a35_accuracy"](spark, DATA).collect()} == {r["kind"]: r["count"] for r in typed.groupBy("kind").count().collect()}


def test_gestures_are_drawn_in_every_language(spark):
    rows = table(spark, DATA, "lexicon").where("word_id % 20 = 0").selectExpr("lang", "lower(w) AS word")
    asked = base.words(spark, DATA).join(rows, ["lang", "word"], "left_semi").where("length(regexp_replace(word, \"['-]\", '')) > 1")
    drawn = {r.lang: r.n for r in ALL["l11_gesture"](spark, DATA).selectExpr("lang", "gid").distinct().groupBy("lang").agg({"gid": "count"}).withColumnRenamed("count(gid)", "n").collect()}
    assert drawn == {r["lang"]: r["count"] for r in asked.groupBy("lang").count().collect()} and len(drawn) == 6


def test_confusions_reach_rare_words(spark, tmp_path):
    letters = "bdfhkmprtx"
    words = ["".join(letters[int(c)] for c in f"{i:04d}") for i in range(3100)] + ["zoology", "zoolgy", "zpology"]
    spark.createDataFrame([(i, "en", w, 9000 - i) for i, w in enumerate(words)], "word_id long, lang string, w string, c long").write.parquet(f"{tmp_path}/lexicon.parquet")
    assert ("en", "zoology", "zpology") in {tuple(r) for r in ALL["j08_confusions"](spark, str(tmp_path)).select("lang", "a", "b").collect()}
    assert ("en", "zpology", "zoology") in {tuple(r) for r in ALL["j16_partners"](spark, str(tmp_path)).select("lang", "word", "partner").collect()}
