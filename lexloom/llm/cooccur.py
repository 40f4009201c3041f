"""Items that appear together more often than chance.

A pair can only reach the support asked for if both items do, so the items that come into question number at most
(words of a record) / support per language, whatever the size of the corpus: that bounds the dictionary that is
broadcast, and its size is checked.  Records become sparse binary rows over it.  Each task sums its rows'
transpose-products over blocks of records into the cells of a symmetric matrix, block of items by block of items: into dense
counts where the matrix fits the memory set aside for it, into sorted runs of the cells that are not zero where it does not.
What a task holds is given out whenever it is over its bound in bytes.  The cells are summed, and compared with the
product of the diagonal (an item with itself).

Defined cases: null ids are no records; a record delivered twice counts once; a word twice in a record counts
once; null and empty texts are no record; a null lang is the language "".
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import ready
from .consistent import with_words, words_of

#: Cells of one block of items, and bytes of counts that a task holds for a language.
BLOCK_CELLS, MOST_BYTES = 1 << 22, 1 << 25
#: Rows of one block of records, and pairs that are summed at once.
BLOCK_ROWS, PAIRS = 1 << 13, 1 << 20


class Gram:
    """Counts of a symmetric matrix of items, summed over blocks of records; only a <= b is kept."""

    def __init__(self, items: int):
        self.items, self.high = items, max(1, min(items, BLOCK_CELLS // max(1, items)))
        self.dense = np.zeros(items * items, np.int64) if items * items * 8 <= MOST_BYTES else None
        self.runs: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.bytes = 0

    def add(self, offsets: np.ndarray, items: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows as offsets into ``items``, which are sorted and distinct in each row; gives out cells (a, b, n) where too many are held."""
        sizes = np.diff(offsets)
        for k in np.unique(sizes[sizes > 0]):
            starts = offsets[:-1][sizes == k]
            a, b = np.triu_indices(k)
            step = max(1, PAIRS // len(a))
            for at in range(0, len(starts), step):
                rows = items[starts[at : at + step, None] + np.arange(k)]
                for cut in range(0, len(a), PAIRS):  # the pairs of one very long row come in parts
                    self._sum(rows[:, a[cut : cut + PAIRS]].ravel(), rows[:, b[cut : cut + PAIRS]].ravel())
                    if self.bytes > MOST_BYTES:
                        yield from self.cells()

    def _sum(self, a: np.ndarray, b: np.ndarray) -> None:
        if self.dense is not None:
            self.dense += np.bincount(a * self.items + b, minlength=len(self.dense))
            return
        cells, n = np.unique(a * self.items + b, return_counts=True)
        block = cells // (self.high * self.items)
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for i, x, y in zip(block[first].tolist(), np.split(cells, first[1:]), np.split(n, first[1:])):
            self.runs.setdefault(i, []).append((x, y))
        self.bytes += cells.nbytes + n.nbytes

    def cells(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The cells that are not zero, block by block; they are forgotten then."""
        if self.dense is not None:
            at = np.flatnonzero(self.dense)
            yield at // self.items, at % self.items, self.dense[at]
            self.dense[:] = 0
        for runs in self.runs.values():
            cells, where = np.unique(np.concatenate([x for x, _ in runs]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([y for _, y in runs]), minlength=len(cells)).astype(np.int64)
            yield cells // self.items, cells % self.items, n
        self.runs, self.bytes = {}, 0


def together(df: DataFrame, terms: DataFrame, id_col: str = "sent_id", text: str = "text", lang: str = "lang", at_least: int = 5, per_mille: int = 3, lift: int = 5, most_items: int = 500_000) -> DataFrame:
    """(lang, w_a, w_b, n, n_a, n_b, n_ab, lift): pairs w_a < w_b of ``terms`` (lang, term) in one record.

    With n records that hold a word: n_ab >= at_least, 1000 n_ab >= per_mille n, n_ab n >= lift n_a n_b.  Beyond
    ``most_items`` items the dictionary is not broadcast but joined, and the pairs of each record are shuffled as sums.
    """
    spark = ready(df.sparkSession)
    base = df.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(lang, F.lit("")).alias("lang"), F.col(text).alias("text"))

    # Deliveries can only overstate how often a term stands here, so this keeps every term that has the support.
    first = base.mapInArrow(_standing, "lang string, term string, seen long, id long").checkpoint()  # narrow, and read twice
    sizes = first.where("id IS NOT NULL").select("lang", "id").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    seen = first.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("seen").alias("seen"))
    sizes = spark.createDataFrame([(r.lang, r.n) for r in sizes.collect()], "lang string, n long")  # a row per language
    enough = seen.join(F.broadcast(sizes), "lang").where((F.col("seen") >= at_least) & (1000 * F.col("seen") >= per_mille * F.col("n")))
    frequent = enough.join(terms.select("lang", "term").distinct(), ["lang", "term"], "left_semi").select("lang", "term")
    bounded = frequent.limit(most_items + 1).toPandas()
    counts = (_by_blocks(base, bounded) if len(bounded) <= most_items else _by_joins(base, frequent)).checkpoint()  # a row per pair of items, read three times

    single = counts.where("a = b").select("lang", F.col("a").alias("w"), F.col("n").alias("own"))
    pair = (
        counts.where("a <> b").where(F.col("n") >= at_least).select("lang", F.least("a", "b").alias("w_a"), F.greatest("a", "b").alias("w_b"), F.col("n").alias("n_ab"))
        .join(F.broadcast(sizes), "lang")
        .join(single.select("lang", F.col("w").alias("w_a"), F.col("own").alias("n_a")), ["lang", "w_a"])
        .join(single.select("lang", F.col("w").alias("w_b"), F.col("own").alias("n_b")), ["lang", "w_b"])
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return pair.where((1000 * F.col("n_ab") >= per_mille * F.col("n")) & (wide("n_ab") * wide("n") >= lift * wide("n_a") * wide("n_b"))).select(
        "lang", "w_a", "w_b", "n", "n_a", "n_b", "n_ab", F.round(F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b")), 6).alias("lift")
    )


def _standing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, lang, text) -> in how many texts of a batch a term stands, and the ids of the texts with a word."""
    for batch in batches:
        counts, ids, langs = {}, [], []
        for i, lang, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if ws := set(words_of(text, lang == "ru")):
                ids.append(i)
                langs.append(lang)
                own = counts.setdefault(lang, {})
                for w in ws:
                    own[w] = own.get(w, 0) + 1
        terms = [(lang, w, n, None) for lang, own in counts.items() for w, n in own.items()]
        rows = list(zip(*terms, *((l, None, None, i) for l, i in zip(langs, ids)))) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(rows, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["lang", "term", "seen", "id"])


def _by_joins(base: DataFrame, frequent: DataFrame) -> DataFrame:
    """(lang, a, b, n) where the items are too many to broadcast: they are joined, and a record's pairs counted."""
    kept = with_words(base).select("lang", "id", F.explode(F.array_distinct("words")).alias("term")).join(frequent, ["lang", "term"], "left_semi")
    rows = kept.groupBy("lang", "id").agg(F.array_sort(F.collect_set("term")).alias("ws"))  # one record
    each = rows.select("lang", "ws", F.posexplode("ws").alias("i", "a"))
    return each.select("lang", "a", F.explode(F.slice("ws", F.col("i") + 1, F.size("ws"))).alias("b")).groupBy("lang", "a", "b").agg(F.count("*").alias("n"))


def _by_blocks(base: DataFrame, frequent: pd.DataFrame) -> DataFrame:
    """(lang, a, b, n) over a broadcast dictionary of items, a <= b by place in it."""
    spark = base.sparkSession
    items = {k: sorted(v["term"]) for k, v in frequent.groupby("lang", sort=True)}
    langs = sorted(items)
    known = spark.sparkContext.broadcast(items)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {name: (i, {w: j for j, w in enumerate(known.value[name])}) for i, name in enumerate(langs)}
        for batch in batches:
            ids, tags, lists = [], [], []
            for i, lang, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if lang in places:
                    l, place = places[lang]
                    if own := sorted({j for w in words_of(text, lang == "ru") if (j := place.get(w)) is not None}):
                        ids.append(i)
                        tags.append(l)
                        lists.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tags, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["id", "l", "items"])

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Gram] = {}

        def out(i: int, cells) -> Iterator[pa.RecordBatch]:
            for a, b, n in cells:
                for start in range(0, len(a), 1 << 16):
                    cut = slice(start, start + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[cut]), i, np.int32)), pa.array(a[cut].astype(np.int32)), pa.array(b[cut].astype(np.int32)), pa.array(n[cut])], names=["l", "a", "b", "n"])

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                l = part.column(0).to_numpy()
                for i in np.unique(l).tolist():
                    lists = part.column(1).filter(pa.array(l == i))
                    own = sums.get(i) or sums.setdefault(i, Gram(len(known.value[langs[i]])))
                    yield from out(i, own.add(lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py(), lists.flatten().to_numpy().astype(np.int64)))
        for i, s in sums.items():
            yield from out(i, s.cells())

    sparse = base.mapInArrow(rows, "id long, l int, items array<int>")
    once = sparse.groupBy("l", "id").agg(F.first("items").alias("items")).select("l", "items")  # a record delivered twice
    counts = once.mapInArrow(gram, "l int, a int, b int, n long").groupBy("l", "a", "b").agg(F.sum("n").alias("n"))

    names = spark.createDataFrame([(i, name, j, t) for i, name in enumerate(langs) for j, t in enumerate(items[name])], "l int, lang string, a int, w string")
    return (
        counts.join(names.withColumnRenamed("w", "x"), ["l", "a"])
        .join(names.select("l", F.col("a").alias("b"), F.col("w").alias("y")), ["l", "b"])
        .select("lang", F.col("x").alias("a"), F.col("y").alias("b"), "n")
    )
