"""The store: one partitioned table per key space, the dictionary, flags, vectors, and logs.

Writers go through Spark's committer, so a reader sees a whole table or none; where a key stands several times
the first by source and line holds, except for flags, which are or-ed.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns that a table of the store must have.
LAYOUT = {
    "dictionary": {"lang", "word", "count", "prior_milli"},
    "pairs": {"lang", "prev", "word", "nats_milli"},
    "endings": {"lang", "lclass", "rclass", "pmi8_milli"},
    "tag_pairs": {"lang", "ltag", "rtag", "pmi8_milli"},
    "frames": {"lang", "key", "values"},
    "commas": {"lang", "key", "logit_milli"},
    "confusions": {"lang", "a", "b"},
    "rules": {"lang", "a", "b", "feature", "word", "strength_milli"},
    "topics": {"a", "b", "c", "pmi_milli"},
    "casing": {"lang", "word", "flag"},
    "yo": {"lang", "e_form", "mask"},
    "lemmas": {"id", "vec", "scale", "bias", "logz"},
}


def first_holds(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def write(df: DataFrame, folder: str, space: str, sort: tuple[str, ...] = ()) -> None:
    """A key space as Parquet, by language where it has one, sorted in its files so that row groups can be skipped."""
    if missing := LAYOUT[space] - set(df.columns):
        raise ValueError(f"{space} lacks {', '.join(sorted(missing))}")
    by = ["lang"] if "lang" in df.columns else []
    keys = [*by, *(sort or sorted(LAYOUT[space] & {"word", "prev", "a", "key", "lclass", "ltag", "id", "e_form"}))]
    df.sparkSession.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{space}.schema")
    out = df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite")
    (out.partitionBy(*by) if by else out).parquet(f"{folder}/{space}")


def read(spark: SparkSession, folder: str, space: str) -> DataFrame:
    """A key space, by the schema it was written with; its columns are checked before anything is read."""
    schema = StructType.fromJson(json.loads(spark.read.text(f"{folder}/{space}.schema").first()[0]))
    if missing := LAYOUT[space] - set(schema.names):
        raise ValueError(f"{folder}/{space} lacks {', '.join(sorted(missing))}")
    return spark.read.schema(schema).parquet(f"{folder}/{space}").select(*schema.names)


def casing_flags(proper: DataFrame, offensive: DataFrame) -> DataFrame:
    """(lang, word, flag): 1 or 2 by the first line of a casing list (lang, word, flag, line), +4 for offensive words."""
    first = first_holds(proper, ["lang", "word"], ["line"]).select("lang", "word", "flag")
    bad = offensive.select("lang", "word", F.lit(4).alias("bad")).distinct()
    return first.join(bad, ["lang", "word"], "full").select("lang", "word", F.coalesce("flag", F.lit(0)).bitwiseOR(F.coalesce("bad", F.lit(0))).alias("flag"))


def prior_blocks(priors: DataFrame, size: int = 64) -> DataFrame:
    """(lang, block, level, least): the least prior of blocks of ``size`` words in order of the words, and of blocks of such blocks.

    ``priors`` (lang, place, prior_milli), where place counts from 0.  Level 0 holds blocks of words, level 1 blocks of blocks.
    """
    zero = priors.groupBy("lang", F.floor(F.col("place") / size).cast("long").alias("block")).agg(F.min("prior_milli").alias("least"))
    one = zero.groupBy("lang", F.floor(F.col("block") / size).cast("long").alias("block")).agg(F.min("least").alias("least"))
    return zero.select("lang", "block", F.lit(0).alias("level"), "least").union(one.select("lang", "block", F.lit(1), "least"))


def write_weights(spark: SparkSession, weights: dict, folder: str) -> None:
    """Matrices of a model as bytes with a scale per row: (name, row, bytes, scale)."""
    import numpy as np

    rows = []
    for name, w in weights.items():
        m = np.atleast_2d(w)
        scale = np.maximum(np.abs(m).max(-1, keepdims=True), 1e-12) / 127
        rows += [(name, i, np.round(m[i] / scale[i]).astype(int).tolist(), float(scale[i, 0]), w.ndim) for i in range(len(m))]
    spark.createDataFrame(rows, "name string, row int, bytes array<int>, scale double, dims int").withColumn("bytes", F.transform("bytes", lambda x: x.cast("tinyint"))).write.mode("overwrite").parquet(folder)


def read_weights(spark: SparkSession, folder: str) -> dict:
    """The matrices again, within half a step of each row's scale."""
    import numpy as np

    out: dict = {}
    for r in spark.read.parquet(folder).orderBy("name", "row").collect():  # a model's own size
        out.setdefault(r.name, (r.dims, []))[1].append(np.array(r.bytes, float) * r.scale)
    return {k: np.array(m) if dims == 2 else m[0] for k, (dims, m) in out.items()}


def user_words(overlay: DataFrame, changes: DataFrame) -> DataFrame:
    """(word): a user's own words after changes (word, at, add boolean); the last change of a word holds.

    Taken are words of letters with inner apostrophes and hyphens, at most 32 long.
    """
    last = changes.groupBy("word").agg(F.max_by("add", "at").alias("add"))
    fits = (F.length("word") <= 32) & F.col("word").rlike(r"^[\p{L}'-]*\p{L}[\p{L}'-]*$")
    kept = overlay.select("word").distinct().join(last.where("NOT add").select("word"), "word", "left_anti")
    return kept.union(last.where("add").where(fits).select("word")).distinct()


def yo_masks(words: DataFrame) -> DataFrame:
    """(lang, e_form, mask): which е of a word are ё, for words spelled with е that aren't words of their own."""
    bits = F.aggregate(F.transform(F.split("word", ""), lambda c, i: F.when(c == "ё", F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a + b)
    spelled = words.where(F.col("word").contains("ё")).select("lang", F.translate("word", "ё", "е").alias("e_form"), bits.alias("mask"), "count")
    own = words.select("lang", F.col("word").alias("e_form"))
    return first_holds(spelled.join(own, ["lang", "e_form"], "left_anti"), ["lang", "e_form"], ["mask"]).select("lang", "e_form", "mask")


def quantised_vectors(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """Vectors (id, vec) as bytes with a scale of their own: value = byte x scale / 127."""
    most = F.greatest(F.array_max(F.transform(vec, lambda x: F.abs(x.cast("double")))), F.lit(1e-9))
    return vectors.withColumn("scale", most).withColumn("q", F.transform(vec, lambda x: F.round(x.cast("double") / F.col("scale") * 127).cast("tinyint"))).select("id", F.col("q").alias("vec"), "scale", F.lit(0.0).alias("bias"), F.lit(0.0).alias("logz"))


def write_tsv(df: DataFrame, path: str, *sort: str) -> None:
    df.orderBy(*sort).write.mode("overwrite").csv(path, sep="\t", quote="", escape="")


def write_log(df: DataFrame, path: str, records_per_file: int = 100_000) -> None:
    """Rows as JSON lines, in files of a bounded number of records."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.option("maxRecordsPerFile", records_per_file).mode("append").text(path)
