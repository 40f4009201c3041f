"""Same or near-same records across splits.

Every record is canonicalised to the set of its words in consistent form and lower case, and evaluation hashes are
joined with training hashes.  Records with equal sets are one class and meet by the hash of the whole set.  Sets that only
share most words meet by hashed pairs of words.  With a similarity of s, two sets of n and m words share
o >= s / (1 + s) * (n + m) words and differ in at most d = n + m - 2 o.  Take any common order of the words.  The
first L shared words stand among the first n - o + L of one set and the first m - o + L of the other.  Of the L - 1 gaps
between them, at most d / REACH (rounded down) hold REACH or more of the words that are not shared; with
L = d / REACH + 2 some two neighbours stand REACH places apart or less in both sets.  So pairs of words at most REACH places apart
among the first words are signatures by which no such two sets miss each other, and their number grows with
the number of words of a set, whatever its size.

The order is by how often the evaluation records hold a word, rare words first, counted in a table of fixed size by hash.  Words that
no evaluation record holds come first of all, and pairs with one are dropped: they meet nothing.  So are training signatures
that no evaluation signature equals, as far as a bit table of fixed size over hashes can tell.

A signature row carries its class, the number of words and a bitmap of hashed words.  Two sets that differ in d words differ
in at most d bits, so most chance meetings end inside the join, without words being fetched.  What is left is
checked by exact comparison of the words of the classes, and then the records of the classes are listed.  No
meeting is capped, and none is lost.  Copies of a record meet once: a task gives a class once, and the classes of the evaluation
side, the smaller one, are made distinct before the join.

Defined cases: null ids are no records, records without a word have no overlap; a record delivered twice counts
once; splits other than those named take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import ready
from .consistent import words_of

#: Places between the two words of a signature, at most.
REACH = 5
#: Cells of the table of word counts.
CELLS = 1 << 20
#: Words and classes that a task remembers.
MOST_KEPT = 1 << 18
#: Words of 64 bits in the table of evaluation signatures.
TABLE = 1 << 20
#: A class is 64 bits of hash, and with it the number of its words (up to SIZE, in the low bits) and a bitmap of them in the others.
SIZE, BITS = (1 << 12) - 1, 52


def records(df: DataFrame, id_col: str = "sent_id", text: str = "text", lang: str = "lang", split: str = "split", held_out=("test", "valid"), train: str = "train") -> DataFrame:
    """(id, held, text, lang): the records in a split that takes part."""
    name = F.lower(F.trim(F.col(split)))
    return df.where(F.col(id_col).isNotNull() & F.col(text).isNotNull() & name.isin(*held_out, train)).select(F.col(id_col).alias("id"), (name != train).alias("held"), F.col(text).alias("text"), F.col(lang).alias("lang"))


@lru_cache(maxsize=1 << 14)
def first_words(n: int, shared: int, of: int) -> int:
    """How many of the first words of a set of ``n`` can take part in a signature: the most that a partner of any size asks for."""
    out = 0
    for m in range(-(-shared * n // of), of * n // shared + 1):
        o = -(-shared * (n + m) // (of + shared))
        if o <= min(n, m):
            out = max(out, n - o + (n + m - 2 * o) // REACH + 2)
    return min(out, n)


class _Hashes(dict):
    """64 bits of hash of words, the last ones remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_KEPT:
            self.clear()
        self[word] = v = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return v


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two columns."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0xD1B54A32D192ED03) + (a << np.uint64(6)))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Sets:
    """The word sets of the rows of (text, lang) that have a word.

    ``rows`` are their places, ``sizes`` their numbers of words, ``hashes`` those of the words, set after set, which begin at ``starts``
    and belong to ``row``.  A class is two numbers, ``k``, a sum of hashes, and ``kn``, the number of words and a bitmap of them.
    """

    def __init__(self, batch: pa.RecordBatch, memo: _Hashes):
        self.rows, self.sets = [], []
        for i, (text, lang) in enumerate(zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist())):
            if ws := set(words_of(text, lang == "ru")):
                self.rows.append(i)
                self.sets.append(ws)
        self.sizes = np.fromiter(map(len, self.sets), np.int64, len(self.sets))
        self.hashes = np.fromiter(map(memo.__getitem__, chain.from_iterable(self.sets)), np.uint64, int(self.sizes.sum()))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.row = np.repeat(np.arange(len(self.sets)), self.sizes)
        if self.sets:
            self.k = np.add.reduceat(_mix(self.hashes, self.hashes >> np.uint64(32)), self.starts).view(np.int64)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (self.hashes % np.uint64(BITS) + np.uint64(12)), self.starts)
            self.kn = (bits | np.minimum(self.sizes, SIZE).astype(np.uint64)).view(np.int64)
        else:
            self.k = self.kn = np.zeros(0, np.int64)


def _unseen(classes: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which classes a task has not given yet."""
    out = np.zeros(len(classes), bool)
    for i, k in enumerate(classes.tolist()):
        if k not in seen:
            if len(seen) >= MOST_KEPT:
                seen.clear()
            seen.add(k)
            out[i] = True
    return out


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values stand in an ordered array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums, memo = np.zeros(CELLS, np.int64), _Hashes()
    for batch in batches:
        sums += np.bincount((_Sets(batch, memo).hashes % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
    at = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["cell", "n"])


def word_counts(held: DataFrame) -> np.ndarray:
    """How often the words of each cell of a table of fixed size stand in the sets of the evaluation records."""
    got = held.select("text", "lang").mapInArrow(_cell_counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most CELLS rows
    counts = np.zeros(CELLS, np.int64)
    counts[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return counts


SIGNATURE = "sig long, k long, kn long"


def _signatures(counts, table, shared: int, of: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (text, lang) -> one row per signature of each class, once a task; without those that a table of bits lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = _Hashes(), set()
        often = np.minimum(counts.value, (1 << 19) - 1).astype(np.uint64)
        for batch in batches:
            z = _Sets(batch, memo)
            if not len(z.sets):
                continue
            new = _unseen(z.k, seen)
            own = new[z.row]
            k, kn, n = z.k[new], z.kn[new], z.sizes[new]
            if not len(k):
                continue
            # the common order: how often the word's cell was counted, then its hash
            keys = (often[(z.hashes[own] % np.uint64(CELLS)).astype(np.int64)] << np.uint64(44)) | (z.hashes[own] >> np.uint64(20))
            row = np.repeat(np.arange(len(n)), n)
            keys = keys[np.lexsort((keys, row))]
            place = np.arange(len(keys)) - (np.cumsum(n) - n)[row]
            end = np.array([first_words(int(x), shared, of) for x in n])[row]
            met = keys >= np.uint64(1 << 44)  # words that an evaluation record may hold
            sigs, rows = [k], [np.arange(len(n))]
            for reach in range(1, REACH + 1):
                at = np.flatnonzero(met & (place + reach < end))
                at = at[met[at + reach]]
                sigs.append(_mix(keys[at], keys[at + reach]).view(np.int64))
                rows.append(row[at])
            sigs, rows = np.concatenate(sigs), np.concatenate(rows)
            if table is not None:
                cell = sigs.view(np.uint64) % np.uint64(64 * TABLE)
                held = (table.value[cell >> np.uint64(6)] >> (cell & np.uint64(63))) & np.uint64(1) == 1
                sigs, rows = sigs[held], rows[held]
            for a in range(0, len(rows), 1 << 16):
                r = rows[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(sigs[a : a + (1 << 16)]), pa.array(k[r]), pa.array(kn[r])], names=["sig", "k", "kn"])

    return run


def signature_table(held: DataFrame) -> np.ndarray:
    """A bit for each hash value of a signature that evaluation records have; a table of fixed size."""
    cell = F.col("sig").bitwiseAND(F.lit(64 * TABLE - 1))  # the remainder, as the size is a power of two
    got = held.select(F.shiftright(cell, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(F.lit(63)).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most TABLE rows
    table = np.zeros(TABLE, np.int64)
    table[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return table.view(np.uint64)


def _members(wanted) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (id, held, text, lang) -> (id, held, k, kn, words): the records of the wanted classes (of all, if None); a task gives the words of a class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = _Hashes(), set()
        for batch in batches:
            z = _Sets(batch, memo)
            kept = np.arange(len(z.rows)) if wanted is None else np.flatnonzero(_among(z.k, wanted.value))
            own, k = batch.take(pa.array(np.array(z.rows, np.int64)[kept])), z.k[kept]
            first = _unseen(k, seen)
            words = [sorted(z.sets[i]) if new else None for i, new in zip(kept.tolist(), first)]
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(k), pa.array(z.kn[kept]), pa.array(words, pa.list_(pa.string()))], names=["id", "held", "k", "kn", "words"])

    return run


@contextmanager
def _partitions(spark: SparkSession, rows: int, rows_each: int = 1_000_000):
    """Shuffles that begin with a partition per ``rows_each`` rows, and that may still be split where keys are hot."""
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(max(int(before or spark.conf.get("spark.sql.shuffle.partitions")), min(50_000, -(-rows // rows_each)))))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _of_classes(recs: DataFrame, wanted) -> DataFrame:
    kind = recs.schema["id"].dataType.simpleString()
    return recs.select("id", "held", "text", "lang").mapInArrow(_members(wanted), f"id {kind}, held boolean, k long, kn long, words array<string>")


def class_pairs(recs: DataFrame, shared: int = 7, of: int = 10, most_kept: int = 500_000, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((hk, hkn, tk, tkn): pairs of similar classes, (id, held, k, kn): the records of these classes), both written.

    Up to ``most_kept`` classes are told to the scan that fetches words, beyond that they are joined.  ``rows`` is about how many
    records there are, where the caller knows it.
    """
    spark = ready(recs.sparkSession)
    sc = spark.sparkContext
    held, train = recs.where("held"), recs.where("NOT held")
    counts = sc.broadcast(word_counts(held))
    named = lambda df, x: df.select("sig", F.col("k").alias(f"{x}k"), F.col("kn").alias(f"{x}kn"))
    of_held = held.select("text", "lang").mapInArrow(_signatures(counts, None, shared, of), SIGNATURE).distinct().checkpoint()  # the smaller side; read twice
    table = sc.broadcast(signature_table(of_held))
    h = named(of_held, "h")
    t = named(train.select("text", "lang").mapInArrow(_signatures(counts, table, shared, of), SIGNATURE), "t")
    n, m = F.col("hkn").bitwiseAND(F.lit(SIZE)), F.col("tkn").bitwiseAND(F.lit(SIZE))
    differ = F.floor(n + m - 2 * F.ceil((n + m) * shared / (of + shared)))
    other = F.shiftrightunsigned(F.col("hkn").bitwiseXOR(F.col("tkn")), 12)
    fits: Column = (of * F.least(n, m) >= shared * F.greatest(n, m)) & (F.bit_count(other) <= differ)
    pair = ["hk", "hkn", "tk", "tkn"]
    with _partitions(spark, 8 * (recs.count() if rows is None else rows)):
        met = h.join(t, "sig").where(fits).select(*pair).distinct().checkpoint()
    of_met = met.select(F.col("hk").alias("k")).union(met.select("tk")).distinct()
    kept = of_met.limit(most_kept + 1).toPandas()["k"].to_numpy(np.int64)
    if len(kept) <= most_kept:
        found = _of_classes(recs, sc.broadcast(np.sort(kept)))
    else:
        found = _of_classes(recs, None).join(of_met, "k", "left_semi").select("id", "held", "k", "kn", "words")
    found = found.checkpoint()
    words = found.where("words IS NOT NULL").groupBy("k", "kn").agg(F.first("words").alias("words"))
    side = lambda x: words.select(F.col("k").alias(f"{x}k"), F.col("kn").alias(f"{x}kn"), F.col("words").alias(f"{x}w"))
    common = F.size(F.array_intersect("hw", "tw"))
    checked = met.join(side("h"), ["hk", "hkn"]).join(side("t"), ["tk", "tkn"]).where(of * common >= shared * (F.size("hw") + F.size("tw") - common))
    return checked.select(*pair).checkpoint(), found.select("id", "held", "k", "kn").distinct()


def overlaps(recs: DataFrame, shared: int = 7, of: int = 10, most_kept: int = 500_000, rows: int | None = None) -> DataFrame:
    """(held_id, train_id): all pairs of a held-out and a training record with at least shared / of of all their words in common."""
    pairs, members = class_pairs(recs, shared, of, most_kept, rows)
    side = lambda cond, name, x: members.where(cond).select(F.col("id").alias(name), F.col("k").alias(f"{x}k"), F.col("kn").alias(f"{x}kn"))
    return pairs.join(side("held", "held_id", "h"), ["hk", "hkn"]).join(side("NOT held", "train_id", "t"), ["tk", "tkn"]).select("held_id", "train_id")


def overlap_classes(recs: DataFrame, shared: int = 7, of: int = 10, rows: int | None = None) -> DataFrame:
    """(id, held, class_id, links): every record with a word, the least id with the same words, and how many records of the other side overlap it.

    Copies are counted, not listed as pairs.  An id on both sides has a row for each.
    """
    pairs, _ = class_pairs(recs, shared, of, rows=rows)
    every = _of_classes(recs, None).select("id", "held", "k", "kn").distinct().checkpoint()
    classes = every.groupBy("k", "kn").agg(F.min("id").alias("class_id"), F.count_if("held").alias("h"), F.count_if(~F.col("held")).alias("t"))

    def links(own: str, other: str, held: bool) -> DataFrame:
        size = classes.select(F.col("k").alias(f"{other}k"), F.col("kn").alias(f"{other}kn"), F.col(other).alias("links"))
        each = pairs.join(size, [f"{other}k", f"{other}kn"]).groupBy(F.col(f"{own}k").alias("k"), F.col(f"{own}kn").alias("kn"))
        return each.agg(F.sum("links").alias("links")).withColumn("held", F.lit(held))

    sums = links("h", "t", True).unionByName(links("t", "h", False))
    return every.join(classes.select("k", "kn", "class_id"), ["k", "kn"]).join(sums, ["k", "kn", "held"], "left").select("id", "held", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def overlap_report(df: DataFrame, pairs: DataFrame, id_col: str = "sent_id", split: str = "split", source: str = "source") -> DataFrame:
    """(split, source, records, overlapping, links): held-out records per split and source, those with a partner in training, and their links."""
    links = pairs.groupBy(F.col("held_id").alias("id")).agg(F.count("*").alias("links"))
    name = F.lower(F.trim(F.col(split)))
    recs = df.where(F.col(id_col).isNotNull() & (name != "train")).groupBy(F.col(id_col).alias("id")).agg(F.max(F.struct(name.alias("split"), F.lower(F.btrim(F.col(source), F.lit(" \t\r\n "))).alias("source"))).alias("r"))
    return recs.join(links, "id", "left").groupBy("r.split", "r.source").agg(F.count("*").alias("records"), F.count("links").alias("overlapping"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"))
