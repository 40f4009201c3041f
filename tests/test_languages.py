from pyspark.sql import functions as F

from lexloom.functions import languages as G
from lexloom.streaming import grip


def one(spark, column, w):
    return spark.createDataFrame([(w,)], "w string").select(column).first()[0]


def test_spanish(spark):
    w = F.col("w")
    assert one(spark, G.without_clitics(w), "dármelo") == "dar" and one(spark, G.without_clitics(w), "mesa") is None
    assert one(spark, G.base_of_diminutive(w), "casita") == "casa" and one(spark, G.base_of_diminutive(w), "casa") is None


def test_french(spark):
    w = F.col("w")
    assert one(spark, G.french_hyphens_ok(w), "donne-moi") and one(spark, G.french_hyphens_ok(w), "va-t-il") and not one(spark, G.french_hyphens_ok(w), "a-b")


def test_names_and_tables(spark):
    assert one(spark, G.name_spans(F.col("w")), "Вчера приехал Иван Петров и ушёл") == ["Иван Петров"]
    assert [tuple(r) for r in one(spark, G.relation_table(F.col("w")), '{"nomn": {"nsubj": 3.0, "obj": 1.0}}')] == [("nomn", "nsubj", 3.0), ("nomn", "obj", 1.0)]


GRIPS = {"left": {"tilt": [-0.6, 0.0, 0.8], "spread": 0.3, "u": 0.3, "u_spread": 0.3}, "right": {"tilt": [0.6, 0.0, 0.8], "spread": 0.3, "u": 0.7, "u_spread": 0.3}}


def samples(spark):
    rows = [("s", t, [-6.0, 0.0, 8.0] if t < 40 else [6.0, 0.0, 8.0], None, False) for t in range(120)] + [("t", t, None, 0.3, False) for t in range(5)]
    return spark.createDataFrame(rows, "session string, ts_ms long, tilt array<double>, tap double, overlap boolean")


def test_grip_changes_slowly(spark):
    got = [(r.session, r.grip) for r in grip.batch(samples(spark), GRIPS).orderBy("ts_ms").collect()]
    assert got == [("s", "left"), ("s", "right")]


def test_grip_stream_equals_batch(spark, tmp_path):
    df = samples(spark)
    df.write.parquet(str(tmp_path / "in"))
    q = grip.stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), GRIPS).writeStream.format("memory").queryName("grips").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("grips").collect())) == sorted(map(tuple, grip.batch(df, GRIPS).collect()))


def test_smoothing(spark):
    df = spark.createDataFrame([("s", 0, 1.0), ("s", 1, 2.0), ("t", 0, 5.0), (None, 0, 1.0)], "session string, ts_ms long, v double")
    assert sorted((r.session, round(r.value, 6)) for r in grip.smoothed(df, "v").collect()) == [("s", 1.0), ("s", 1.2), ("t", 5.0)]
