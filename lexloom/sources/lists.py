"""Word lists, forms, corpora and annotations from text files.

Text formats are read as lines and parsed by built-in expressions; malformed lines are skipped.  Archives and
binary formats are read file by file in ``mapInPandas``, one file a task.
"""

from __future__ import annotations

import io
import struct
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X


def _lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    if encoding.upper() == "UTF-8":
        return spark.read.text(path)

    def run(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in files:
            for data in pdf["content"]:
                yield pd.DataFrame({"value": bytes(data).decode(encoding, "replace").splitlines()})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "value string")


def frequency_list(spark: SparkSession, path: str) -> DataFrame:
    """(word, count) of lines ``word count``; other lines are skipped, a word keeps its largest count."""
    z = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).where(F.size(z) >= 2).select(F.lower(z[0]).alias("word"), F.expr(r"try_cast(split(trim(value), '\\s+')[1] AS bigint)").alias("count")).where("count IS NOT NULL")
    return rows.groupBy("word").agg(F.max("count").alias("count"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a plain list in UTF-8, or in Latin-1 where a file isn't UTF-8."""

    def run(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in files:
            for data in pdf["content"]:
                try:
                    text = bytes(data).decode("utf-8")
                except UnicodeDecodeError:
                    text = bytes(data).decode("latin-1")
                yield pd.DataFrame({"word": [w.strip().lower() for w in text.splitlines() if w.strip()]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "word string")


def unmunched(spark: SparkSession, path: str, encoding: str = "KOI8-R") -> DataFrame:
    """(word) of expanded dictionary output in an eight-bit encoding."""
    return _lines(spark, path, encoding).select(F.lower(F.trim("value")).alias("word")).where("word <> ''")


def forms(spark: SparkSession, path: str) -> DataFrame:
    """(form, lemma) of tab-separated lines."""
    z = F.split("value", "\t")
    return _lines(spark, path).where(F.size(z) >= 2).select(z[0].alias("form"), z[1].alias("lemma"))


def extra_list(spark: SparkSession, path: str) -> DataFrame:
    """(word, count) of tab-separated lines; comments and further columns are ignored."""
    z = F.split("value", "\t")
    return _lines(spark, path).where(~F.col("value").startswith("#") & (F.size(z) >= 2)).select(z[0].alias("word"), F.expr("try_cast(split(value, '\\t')[1] AS bigint)").alias("count")).where(X.is_word(F.col("word")) & F.col("count").isNotNull())


def first_forms(spark: SparkSession, path: str) -> DataFrame:
    """(form, lemma) of a morphological dump ``form lemma tag``; the first line of a form holds, by file, block and line in it."""
    z = F.split("value", "\t")
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("line"))
    rows = spark.read.text(path).select("value", at.alias("at")).where(F.size(z) >= 2).select(z[0].alias("form"), z[1].alias("lemma"), "at")
    return rows.groupBy("form").agg(F.min_by("lemma", "at").alias("lemma"))


def tagged_lexicon(spark: SparkSession, path: str, keep: str) -> DataFrame:
    """Rows of a tab-separated lexicon with a header that a predicate keeps."""
    return spark.read.csv(path, sep="\t", header=True, quote="").where(keep)


def sentences(spark: SparkSession, path: str, stock: str = X.STOCK) -> DataFrame:
    """(sent_id, lang, text) of ``id lang text`` lines (plain or bz2), without held-out ids and stock sentences."""
    z = F.split("value", "\t")
    rows = _lines(spark, path).where((F.size(z) == 3) & z[0].rlike(r"^\d+$")).select(z[0].cast("long").alias("sent_id"), z[1].alias("lang"), z[2].alias("text"))
    return rows.where((F.pmod("sent_id", F.lit(50)) != 0) & ~F.col("text").rlike(stock))


def leipzig(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, word, n), (a, b, n) and (text) of tar archives with members -words, -co_n and -sentences."""

    def member(suffix: str, columns: list[str]):
        def run(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in files:
                for data in pdf["content"]:
                    with tarfile.open(fileobj=io.BytesIO(bytes(data))) as tar:
                        for m in tar.getmembers():
                            if m.name.endswith(suffix):
                                rows = [line.decode("utf-8", "replace").rstrip("\n").split("\t") for line in tar.extractfile(m)]
                                yield pd.DataFrame([r[: len(columns)] for r in rows if len(r) >= len(columns)], columns=columns)

        return run

    files = spark.read.format("binaryFile").load(path).select("content")
    words = files.mapInPandas(member("-words.txt", ["id", "word", "n"]), "id string, word string, n string").select("id", F.lower("word").alias("word"), F.expr("try_cast(n AS bigint)").alias("n"))
    pairs = files.mapInPandas(member("-co_n.txt", ["a", "b", "n"]), "a string, b string, n string").select("a", "b", F.expr("try_cast(n AS bigint)").alias("n"))
    text = files.mapInPandas(member("-sentences.txt", ["id", "text"]), "id string, text string").select("text")
    return words, pairs, text


def leipzig_counts(words: DataFrame, pairs: DataFrame, lexicon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, n) and (prev, word, n) of an archive, ids joined twice; words outside the lexicon drop out."""
    known = words.join(lexicon.select("word"), "word", "left_semi")
    both = pairs.join(known.select(F.col("id").alias("a"), F.col("word").alias("prev")), "a").join(known.select(F.col("id").alias("b"), "word"), "b")
    return known.groupBy("word").agg(F.sum("n").alias("n")), both.groupBy("prev", "word").agg(F.sum("n").alias("n"))


def dictionary_json(spark: SparkSession, path: str) -> DataFrame:
    """(word, pos, form, tags) of JSON lines (plain or gzip) with nested forms."""
    rows = spark.read.schema("word string, pos string, forms array<struct<form:string,tags:array<string>>>").json(path)
    return rows.select("word", "pos", F.explode_outer("forms").alias("f")).select("word", "pos", "f.form", "f.tags")


def suffix_automaton(spark: SparkSession, path: str) -> DataFrame:
    """(form, lemma, tag) of binary automata: magic, then nodes of (letter, final, last, target), words as form+code+tag.

    The code's first letter says how many letters of the form to cut before the rest is added.
    """

    def walk(data: bytes) -> Iterator[str]:
        if data[:4] != b"LXA1":
            raise ValueError("not an automaton")
        todo = [(struct.unpack_from(">I", data, 4)[0], b"")]
        while todo:
            at, word = todo.pop()
            while True:
                letter, flags, target = struct.unpack_from(">BBI", data, at)
                if flags & 1:
                    yield (word + bytes([letter])).decode("utf-8")
                if target:
                    todo.append((target, word + bytes([letter])))
                if flags & 2:
                    break
                at += 6

    def run(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in files:
            for data in pdf["content"]:
                out = []
                for entry in walk(bytes(data)):
                    form, code, *tag = entry.split("+")
                    cut = ord(code[0]) - ord("A") if code else 0
                    out.append((form, form[: len(form) - cut] + code[1:], tag[0] if tag else ""))
                yield pd.DataFrame(out, columns=["form", "lemma", "tag"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "form string, lemma string, tag string")


def affix_rules(spark: SparkSession, path: str) -> DataFrame:
    """(flag, kind, strip, add, condition, cross, next) of an affix file."""
    z = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).where(F.col("value").rlike(r"^(SFX|PFX)\s")).select(z.alias("z"))
    heads = rows.where(F.size("z") == 4).select(F.col("z")[0].alias("kind"), F.col("z")[1].alias("flag"), (F.col("z")[2] == "Y").alias("cross"))
    none = lambda c: F.when(c == "0", "").otherwise(c)
    add = F.split(F.col("z")[3], "/")
    body = rows.where(F.size("z") >= 5).select(F.col("z")[0].alias("kind"), F.col("z")[1].alias("flag"), none(F.col("z")[2]).alias("strip"), none(add[0]).alias("add"), F.col("z")[4].alias("condition"), F.filter(F.split(F.coalesce(F.get(add, 1), F.lit("")), ""), lambda c: c != "").alias("next"))
    return body.join(heads, ["kind", "flag"]).select("flag", "kind", "strip", "add", "condition", "cross", "next")


def affix_stems(spark: SparkSession, path: str) -> DataFrame:
    """(word, flags) of a dictionary file; the first line is its size."""
    z = F.split("value", "/")
    return _lines(spark, path).where(~F.col("value").rlike(r"^\d+$") & (F.col("value") != "")).select(z[0].alias("word"), F.filter(F.split(F.coalesce(F.get(z, 1), F.lit("")), ""), lambda c: c != "").alias("flags"))


def gestures_json(spark: SparkSession, path: str) -> DataFrame:
    """(word, grid, path) of JSON lines of drawn words."""
    return spark.read.schema("word string, grid string, curve struct<x:array<double>,y:array<double>,t:array<double>>").json(path).select("word", "grid", F.arrays_zip("curve.x", "curve.y", "curve.t").alias("path"))


def grid_json(spark: SparkSession, path: str) -> DataFrame:
    """(grid, label, x, y, width): key centres, with the grid's median key width."""
    rows = spark.read.option("multiLine", True).schema("grid string, keys array<struct<label:string,x:double,y:double,w:double,h:double>>").json(path).select("grid", F.explode("keys").alias("k"))
    flat = rows.select("grid", "k.label", (F.col("k.x") + F.col("k.w") / 2).alias("x"), (F.col("k.y") + F.col("k.h") / 2).alias("y"), F.col("k.w").alias("w"))
    return flat.join(flat.groupBy("grid").agg(F.percentile("w", 0.5).alias("width")), "grid").select("grid", "label", "x", "y", "width")


def swipes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grid, ch, x, y), (grid, width) and (word, grid, path) of the line format #key, #width, word grid x,y,t…"""
    z = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).select(z.alias("z"))
    d = lambda c: c.try_cast("double")
    keys = rows.where((F.col("z")[0] == "#key") & (F.size("z") >= 5)).select(F.col("z")[1].alias("grid"), F.col("z")[2].alias("ch"), d(F.col("z")[3]).alias("x"), d(F.col("z")[4]).alias("y"))
    width = rows.where((F.col("z")[0] == "#width") & (F.size("z") >= 3)).select(F.col("z")[1].alias("grid"), d(F.col("z")[2]).alias("width"))
    point = lambda p: F.struct(d(F.split(p, ",")[0]).alias("x"), d(F.split(p, ",")[1]).alias("y"), d(F.get(F.split(p, ","), 2)).alias("t"))
    drawn = rows.where(~F.col("z")[0].startswith("#") & (F.size("z") >= 4)).select(F.col("z")[0].alias("word"), F.col("z")[1].alias("grid"), F.transform(F.filter(F.slice("z", 3, F.size("z")), lambda p: p.contains(",")), point).alias("path"))
    return keys, width, drawn


def emoji_list(spark: SparkSession, path: str) -> DataFrame:
    """(emoji, group) of a test file: the group of the last header above a line."""

    def run(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in files:
            for data in pdf["content"]:
                group, out = None, []
                for line in bytes(data).decode("utf-8", "replace").splitlines():
                    if line.startswith("# group:"):
                        group = line.split(":", 1)[1].strip()
                    elif "; fully-qualified" in line:
                        out.append(("".join(chr(int(c, 16)) for c in line.split(";")[0].split()), group))
                yield pd.DataFrame(out, columns=["emoji", "group"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "emoji string, group string")


def emoji_names(spark: SparkSession, path: str) -> DataFrame:
    """(emoji, terms, name) of annotation XML, line by line."""
    a = lambda p, g: F.regexp_extract("value", p, g)
    tag = r'<annotation cp="([^"]+)"( type="tts")?>([^<]*)</annotation>'
    rows = _lines(spark, path).where(F.col("value").rlike(tag)).select(a(tag, 1).alias("emoji"), (a(tag, 2) != "").alias("spoken"), a(tag, 3).alias("text"))
    return rows.groupBy("emoji").agg(F.split(F.max(F.when(~F.col("spoken"), F.col("text"))), r"\s*\|\s*").alias("terms"), F.max(F.when(F.col("spoken"), F.col("text"))).alias("name"))


def find_emoji(names: DataFrame, queries: DataFrame, most: int = 32) -> DataFrame:
    """(query, emoji, score, rk): exact terms, then whole words, then beginnings of words."""
    terms = names.select("emoji", F.explode(F.array_distinct(F.concat(F.coalesce("terms", F.array()), F.filter(F.array("name"), lambda n: n.isNotNull())))).alias("term")).withColumn("term", F.lower("term"))
    keyed = terms.select("emoji", "term", F.explode(F.split("term", r"\s+")).alias("w")).select("emoji", "term", "w", F.substring("w", 1, 2).alias("k"))
    q = queries.select(F.lower("query").alias("query")).distinct().withColumn("k", F.substring("query", 1, 2))
    j = q.join(keyed, "k").where(F.expr("startswith(w, query) OR term = query OR startswith(term, query)"))
    score = F.when(F.col("term") == F.col("query"), 0).when(F.col("w") == F.col("query"), 1).otherwise(2)
    best = j.groupBy("query", "emoji").agg(F.min(score).alias("score"))
    return best.withColumn("rk", F.row_number().over(Window.partitionBy("query").orderBy("score", "emoji"))).where(F.col("rk") <= most)


def parses(spark: SparkSession, path: str) -> DataFrame:
    """(sent_id, words, upos, heads, rels, feats) of tab-separated space-joined arrays; ragged rows are skipped."""
    z = F.split("value", "\t")
    rows = _lines(spark, path).where(F.size(z) >= 6).select(z[0].cast("long").alias("sent_id"), *[F.split(z[i + 1], " ").alias(c) for i, c in enumerate(("words", "upos", "heads", "rels", "feats"))])
    same = [F.size("words") == F.size(c) for c in ("upos", "heads", "rels")]
    return rows.where(same[0] & same[1] & same[2])


def facts(spark: SparkSession, path: str) -> DataFrame:
    """(s, r, o) of tab-separated triples with a header, without self-loops and repetitions."""
    return spark.read.csv(path, sep="\t", header=True, quote="").toDF("s", "r", "o").where("s <> o").distinct()

