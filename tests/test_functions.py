from pyspark.sql import functions as F

from lexloom.functions import numbers as N
from lexloom.functions import text as X


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double'}" for n, v in values.items())).select(column).first()[0]


def test_tokens(spark):
    assert one(spark, X.tokens(F.col("t")), t="Don't go,  ёж-2!") == ["don't", " ", "go", ",", "  ", "ёж-", "2", "!"]
    assert one(spark, X.tokens(F.col("t")), t=None) == []
    assert one(spark, X.tokens(F.col("t")), t="") == []


def test_ending_classes(spark):
    assert one(spark, F.concat_ws(" ", X.left_class(F.col("w")), X.right_class(F.col("w"))), w="дом") == "=дом *ом"
    assert one(spark, X.right_class(F.col("w")), w="на") == "=на"


def test_casing(spark):
    for w, kind in (("дом", "lower"), ("Дом", "cap"), ("ДОМ", "upper"), ("Jean-Paul", "compound"), ("iPhone", "mixed")):
        assert one(spark, X.casing_class(F.col("w")), w=w) == kind
    assert one(spark, X.like_typed(F.col("w"), F.col("t")), w="дом", t="ДРМ") == "ДОМ"
    assert one(spark, X.like_typed(F.col("w"), F.col("t")), w="дом", t="Дрм") == "Дом"


def test_layouts(spark):
    assert one(spark, X.flip_layout(F.col("w")), w="ghbdtn") == "привет"
    assert one(spark, X.home_row(F.col("w")), w="you") == "jlj"


def test_yo_mask(spark):
    df = spark.createDataFrame([("елка", 1)], "w string, m long")
    assert df.select(X.yo_form(F.col("w"), F.col("m"))).first()[0] == "ёлка"


def test_shapes_of_words(spark):
    assert one(spark, X.is_artifact(F.col("w")), w="w-what") and one(spark, X.is_artifact(F.col("w")), w="'cause") and not one(spark, X.is_artifact(F.col("w")), w="half-way")
    assert one(spark, X.is_stretched(F.col("w")), w="даааа") and not one(spark, X.is_stretched(F.col("w")), w="длинный")
    assert one(spark, X.split_elisions(F.col("w")), w="l’homme") == ["l'", "homme"]
    assert one(spark, X.last_cluster_length(F.col("w")), w="a👨‍👩‍👧") >= 1
    assert one(spark, X.same_stem(F.col("a"), F.col("b")), a="столами", b="столов")


def test_sentences(spark):
    assert one(spark, X.sentences(F.col("t")), t="Он пришёл. Она ушла! А. Б. Иванов спит.") == ["Он пришёл.", "Она ушла!", "А. Б. Иванов спит."]


def test_numbers(spark):
    import math

    df = spark.createDataFrame([(3, 100)], "c long, t long")
    assert df.select(N.prior_milli(F.col("c"), F.col("t"))).first()[0] == math.floor((math.log(100) - math.log(3.5)) * 1000)
    df = spark.createDataFrame([([0.0, 1.0],)], "x array<double>")
    a, b = df.select(N.softmax(F.col("x"))).first()[0]
    assert abs(a + b - 1) < 1e-12 and b > a
    assert abs(one(spark, N.key_cost(F.col("d")), d=100.0) - 6.5) < 1e-12
    assert abs(one(spark, N.point_segment2(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(0.0)), x=0.0) - 1.0) < 1e-12
    df = spark.createDataFrame([([5, 3],)], "b array<long>")
    assert df.select(N.any_reading(F.col("b"), 4)).first()[0] and not df.select(N.all_readings(F.col("b"), 4)).first()[0] and df.select(N.fold_readings(F.col("b"))).first()[0] == 7
