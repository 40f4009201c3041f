"""How often every distinct term occurs, and in how many records.

Every distinct term of a record becomes a (key, record, occurrences) row, with one row of the empty term for the record itself.
The rows are range-partitioned by key and record, so that a term of a third of all records spreads over as many
partitions as its rows need, sorted externally in each partition, and scanned once by run length: a run of one
key counts its records, and the occurrences in them.  Each scan keeps one run in memory.  Runs of a key that was cut by a
partition add up.  The bounds of the partitions are read off the rows of some records, those with the least hash; they share out the
work and change no count.

Defined cases: null and empty texts hold no term; a null id is no record; a null lang is the language ""; a record that is
delivered twice adds nothing (of texts that differ, the one with more occurrences of a term counts for it).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import spread
from .consistent import WORD, consistent, words_of

#: Rows read for the bounds, for each partition and at least.
ROWS_EACH, ROWS_LEAST = 60, 20_000
#: Terms of a record, about.
TERMS = 12


class _Codes(dict):
    """Terms of a language as numbers in the order they are met."""

    def __init__(self, keys: list[str], lang: str):
        self.keys, self.lang = keys, lang

    def __missing__(self, term: str) -> int:
        self[term] = code = len(self.keys)
        self.keys.append(f"{term}\t{self.lang}")
        return code


def _places(keys: list[str], codes: np.ndarray, records: np.ndarray, bounds: tuple[list[str], np.ndarray]) -> np.ndarray:
    """The partition of each row: how many bounds (key, record) are not above it."""
    lo, hi = (np.array([cut(bounds[0], k) for k in keys], np.int32) for cut in (bisect_left, bisect_right))
    out = lo[codes]
    for code in np.flatnonzero(lo < hi):
        own = codes == code
        out[own] += np.searchsorted(bounds[1][lo[code] : hi[code]], records[own], side="right").astype(np.int32)
    return out


def _rows(bounds) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(record, lang, text) -> (part, key, record, n) per distinct term of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, langs, codes, counts, sizes = [], {}, [], [], []
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n = {}
                for w in words_of(text, lang == "ru"):
                    n[w] = n.get(w, 0) + 1
                if n:
                    n[""] = 1
                    code = langs.get(lang) or langs.setdefault(lang, _Codes(keys, lang))
                    codes.extend(map(code.__getitem__, n))
                    counts.extend(n.values())
                sizes.append(len(n))
            codes = np.array(codes, np.int32)
            records = np.repeat(batch.column(0).to_numpy(), sizes)
            parts = _places(keys, codes, records, bounds.value) if bounds else np.zeros(len(codes), np.int32)
            columns = [pa.array(parts), pa.array(keys, pa.string()).take(pa.array(codes)), pa.array(records), pa.array(np.array(counts, np.int32))]
            for at in range(0, len(codes), 1 << 16):
                yield pa.RecordBatch.from_arrays([c.slice(at, 1 << 16) for c in columns], names=["part", "key", "record", "n"])

    return run


ROWS = "part int, key string, record long, n int"


def range_bounds(base: DataFrame, rows: int, parts: int) -> tuple[list[str], np.ndarray]:
    """(keys, records) of at most ``parts`` - 1 bounds, from the terms of the records with the least hash."""
    share = min(1.0, max(ROWS_LEAST, ROWS_EACH * parts) / TERMS / max(1, rows))
    some = base.where(F.xxhash64("record") < F.lit(min(2**63 - 1, round((share - 0.5) * 2**64))))
    got = sorted(map(tuple, some.mapInArrow(_rows(None), ROWS).select("key", "record").toPandas().itertuples(index=False)))
    cuts = sorted({got[len(got) * i // parts] for i in range(1, parts)}) if got else []
    return [k for k, _ in cuts], np.array([r for _, r in cuts], np.int64)


def run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, record, n) sorted -> (key, occurrences, records) per run of a key in a batch."""
    last_key, last_rec, last_n = None, -1, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(batch.column(0))
        starts = np.r_[0, runs.run_ends.to_numpy()[:-1]]
        rec, n = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.int64)
        begins = np.zeros(len(rec), bool)
        begins[starts] = True
        begins[1:] |= rec[1:] != rec[:-1]
        first = np.flatnonzero(begins)
        most = np.maximum.reduceat(n, first)
        added, one = most.copy(), np.ones(len(first), np.int64)
        values = runs.values.cast(pa.string())
        if values[0].as_py() == last_key and rec[0] == last_rec:  # the record goes on from the batch before
            added[0], one[0], most[0] = max(0, most[0] - last_n), 0, max(most[0], last_n)
        at = np.searchsorted(first, starts)
        yield pa.RecordBatch.from_arrays([values, pa.array(np.add.reduceat(added, at)), pa.array(np.add.reduceat(one, at))], names=["key", "occurrences", "records"])
        last_key, last_rec, last_n = values[len(starts) - 1].as_py(), rec[-1], most[-1]


def term_counts(df: DataFrame, id_col: str = "sent_id", text: str = "text", lang: str = "lang", rows: int | None = None) -> DataFrame:
    """(lang, term, occurrences, records) of every distinct term; the term "" counts the records with a word.

    ``rows`` is about how many rows ``df`` has, where the caller knows it.
    """
    rows = df.count() if rows is None else rows  # of a table without filters, from its files' footers
    base = df.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("record"), F.coalesce(lang, F.lit("")).alias("lang"), F.col(text).alias("text"))
    parts = spread(df, rows=TERMS * rows, rows_each=6_000_000)
    bounds = df.sparkSession.sparkContext.broadcast(range_bounds(base, rows, parts))
    ranged = base.mapInArrow(_rows(bounds), ROWS).repartitionById(parts, F.col("part")).select("key", "record", "n")
    scanned = ranged.sortWithinPartitions("key", "record").mapInArrow(run_lengths, "key string, occurrences long, records long")
    return (
        scanned.groupBy("key")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        .select(F.substring_index("key", "\t", -1).alias("lang"), F.substring_index("key", "\t", 1).alias("term"), "occurrences", "records")
    )


def lexicon_terms(lexicon: DataFrame, word: str = "w", count: str = "c", lang: str = "lang") -> DataFrame:
    """(lang, term, c): the words of a lexicon in consistent form and lower case that are exactly one word, with their largest count."""
    return (
        lexicon.where(F.col(word).isNotNull())
        .select(F.coalesce(lang, F.lit("")).alias("lang"), F.lower(consistent(F.col(word), F.col(lang))).alias("term"), F.coalesce(F.col(count), F.lit(0)).cast("long").alias("c"))
        .where(F.col("term").rlike(f"^{WORD}$"))
        .groupBy("lang", "term")
        .agg(F.max("c").alias("c"))
    )


def term_usefulness(counts: DataFrame, terms: DataFrame, common_percent: int = 20, rare_records: int = 2, rare_count: int = 20) -> DataFrame:
    """(lang, term, occurrences, records, c, mark): every term, also those that no record holds.

    ``mark`` is "common" in more than ``common_percent`` % of the records of the lang that hold a word, "rare" in at
    most ``rare_records`` of them with c below ``rare_count``, else null.
    """
    sizes = counts.where("term = ''").select("lang", F.col("records").alias("n"))
    joined = terms.join(counts, ["lang", "term"], "left").join(sizes, "lang", "left")
    n, r = F.coalesce("n", F.lit(0)), F.coalesce("records", F.lit(0))
    mark = F.when(100 * r > common_percent * n, "common").when((r <= rare_records) & (F.col("c") < rare_count), "rare")
    return joined.select("lang", "term", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), r.alias("records"), "c", mark.alias("mark"))
