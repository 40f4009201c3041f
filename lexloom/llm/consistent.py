"""One consistent form for text that looks the same in different characters.

A longest-match transducer is compiled once per script ("cyr" for Russian, "lat" for every other language).  Its keys
are single characters and grapheme clusters (a base with combining marks), its outputs plain letters of the script.
It is a table of states and transitions: the state after a cluster so far holds the cluster's output, a character
that belongs to the cluster leads to the next state, any other one ends the cluster.  States of the clusters in the table are
compiled beforehand, and checked: no key may have two outputs and every output must be its own consistent form.  The
state of a cluster outside the table (more marks than any letter has) is compiled when it is first met.  A text is
read once, and what comes out is composed (NFC), as no character composes across the bounds of these clusters.

Texts without a character that needs work leave untouched.

Defined cases: null stays null, empty stays empty; a null or unknown ``lang`` counts as a Latin language;
case, punctuation, digits and missing accents are never changed; a joiner between two pictographs is visible
(it makes one picture of two) and stays.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import ready

# Letters of another alphabet with the same shape.
CYRILLIC_OF_LATIN = dict(zip("aceopxyABCEHKMOPTXY", "асеорхуАВСЕНКМОРТХУ"))
LATIN_OF_CYRILLIC = dict(zip("асеорхуѕіјһԁԛԝАВСЕНКМОРТХУЅІЈԚԜ", "aceopxysijhdqwABCEHKMOPTXYSIJQW"))
LATIN_OF_GREEK = dict(zip("οΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oABEZHIKMNOPTYX"))
# Characters nobody sees, and kinds of the space.
INVISIBLE = "­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿" + "".join(map(chr, [*range(0x202A, 0x202F), *range(0x2066, 0x2070), *range(0xFE00, 0xFE10)]))
SPACES = "    　" + "".join(map(chr, range(0x2000, 0x200B)))

JOINER = "\u200d"
_SIGNS = r"‐-‧‰-⁞₠-₿←-⌨⌫-➿\x{1f300}-\x{1faff}"
#: Java classes of the characters that need work; a text without any of them is in consistent form.
ODD = {
    "lat": rf"[^\u0000-~¡-¬®-ɏ{_SIGNS}]",
    "cyr": rf"[^\u0000-@DFGIJLNQRSUVWZ\[-`bdf-nq-wz-~¡-¬®-¿ЁА-яё{_SIGNS}]",
}
#: The longest runs of letters, with single hyphens between letters kept inside.
WORD = r"\p{L}+(?:-\p{L}+)*"


def _code_points() -> Iterator[str]:
    """All characters that can change under NFC or belong to the character before."""
    return map(chr, [*range(0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20)])


@lru_cache(maxsize=1)
def _unicode() -> tuple[frozenset[str], dict[str, str]]:
    """(characters that belong to the one before or compose with it, characters that are not composed by themselves)."""
    joins, alone = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}, {}
    for c in _code_points():
        if unicodedata.combining(c):
            joins.add(c)
        parts = unicodedata.decomposition(c)
        if parts and parts[0] != "<":
            if unicodedata.normalize("NFC", c) != c:
                alone[c] = unicodedata.normalize("NFC", c)
            elif " " in parts:
                joins.add(chr(int(parts.split()[1], 16)))
    return frozenset(joins), alone


def _is_picture(c: str) -> bool:
    return "☀" <= c <= "➿" or "\U0001f000" <= c <= "\U0001faff"


class _State:
    """A cluster as far as it was read: its characters, what comes out for it, and where further characters lead."""

    __slots__ = ("after", "base", "marks", "open", "out")

    def __init__(self, base: str, marks: str, out: str, open_: bool = False):
        self.base, self.marks, self.out, self.open, self.after = base, marks, out, open_, {}


class Transducer:
    """Longest-match rewriting of characters and grapheme clusters in one pass over a text."""

    #: States that are kept beyond those of the table.
    MOST_STATES = 1 << 17

    def __init__(self, script: str):
        letters = {"lat": {**LATIN_OF_CYRILLIC, **LATIN_OF_GREEK}, "cyr": {}}[script]
        if script == "cyr":
            own = set(CYRILLIC_OF_LATIN.values())
            letters = {**CYRILLIC_OF_LATIN, **{c: v for c, v in LATIN_OF_CYRILLIC.items() if c not in own}}
            letters |= {g: CYRILLIC_OF_LATIN.get(v, v) for g, v in LATIN_OF_GREEK.items()}
        self.table: dict[str, str] = {}
        for c in letters:
            self._add(c, letters[c])
        for c in SPACES:
            self._add(c, " ")
        for c in INVISIBLE:
            self._add(c, "")
        for code in range(0xFF01, 0xFF5F):
            narrow = chr(code - 0xFEE0)
            self._add(chr(code), letters.get(narrow, narrow))
        for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
            base, *marks = unicodedata.normalize("NFD", chr(code))
            if marks and base in letters:
                self._add(chr(code), unicodedata.normalize("NFC", letters[base] + "".join(marks)))
        marks = [chr(code) for code in range(0x300, 0x370)]
        for base in {*string.ascii_letters, *map(chr, range(0x410, 0x450)), *self.table} - {*INVISIBLE, *SPACES}:
            for mark in marks:
                if len(whole := unicodedata.normalize("NFC", self.table.get(base, base) + mark)) == 1:
                    self._add(base + mark, whole)
        joins, alone = _unicode()
        for c, whole in alone.items():
            self.table.setdefault(c, "".join(self.table.get(x, x) for x in whole))
        self._joins, self._unseen, self._kept = joins | set(INVISIBLE), frozenset(INVISIBLE), 0
        self._start = {k: _State(k, "", v) for k, v in self.table.items() if len(k) == 1 and k not in self._joins}
        for key, value in self.table.items():
            if self(key) != value or self(value) != value:
                raise ValueError(f"{key!r} gives {value!r}, which is not in consistent form")

    def _add(self, key: str, value: str) -> None:
        if self.table.setdefault(key, value) != value:
            raise ValueError(f"{key!r} has two outputs, {self.table[key]!r} and {value!r}")

    def _step(self, state: _State, c: str) -> _State:
        """The state after one more character of the cluster; it is made when it is first needed."""
        if c in self._unseen:
            # a joiner after a picture waits for another picture; a sign that is not seen is kept only inside such a chain
            if c == JOINER and state.base and _is_picture(state.base[-1 if state.base[-1] != "\ufe0f" else -2 :][0]) and not state.marks:
                after = _State(state.base, "", state.out, True)
            elif c == "\ufe0f" and not state.open and not state.marks and JOINER in state.base and state.base[-1] != c:
                after = _State(state.base + c, "", state.base + c)
            elif c == "\ufe0f" and not state.open and not state.marks and state.base and _is_picture(state.base):
                after = _State(state.base + c, "", state.out)
            else:
                return state
        elif state.open and _is_picture(c):
            base = state.base + JOINER + c
            after = _State(base, "", base)
        else:
            base = state.base if JOINER in state.base else state.base.removesuffix("\ufe0f")
            marks = state.marks + c
            after = _State(base, marks, unicodedata.normalize("NFC", self.table.get(base, base) + marks))
        if self._kept < self.MOST_STATES and len(after.base) + len(after.marks) < 8:
            self._kept += 1
            state.after[c] = after
        return after

    def __call__(self, text: str) -> str:
        joins, start, out = self._joins, self._start.get, []
        state, last = None, ""
        for c in text:
            if c in joins:
                if state is None:
                    # kept in the table of starts, so that the next text finds it
                    state = self._start[last] = _State(last, "", last) if len(self._start) < self.MOST_STATES else _State(last, "", last)
                state = state.after.get(c) or self._step(state, c)
            elif state is not None and state.open and _is_picture(c):
                state = self._step(state, c)
            else:
                out.append(last if state is None else state.out)
                state, last = start(c), c
        out.append(last if state is None else state.out)
        return "".join(out)


@lru_cache(maxsize=2)
def transducer(script: str) -> Transducer:
    return Transducer(script)


def script_of(lang: str | None) -> str:
    return "cyr" if lang == "ru" else "lat"


def consistent_str(text: str | None, lang: str | None) -> str | None:
    """The same for one string."""
    return None if text is None else transducer(script_of(lang))(text)


_ODD = {k: re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), v)).search for k, v in ODD.items()}


def form(text: str, russian: bool) -> str:
    """The consistent form of a text; one without odd characters is its own."""
    script = "cyr" if russian else "lat"
    return transducer(script)(text) if _ODD[script](text) else text


_RUNS, _EXACT = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*").findall, regex.compile(WORD).findall


def words_of(text: str, russian: bool) -> list[str]:
    """The words of a text, in consistent form and lower case; the same as ``words`` of ``consistent``."""
    low = form(text, russian).lower()
    out = _RUNS(low)
    # numbers that are no digits (roman ones, fractions) are in Python's class, but are no letters
    return out if "".join(out).replace("-", "").isalpha() else _EXACT(low)


@F.pandas_udf(T.StringType())
def _rewrite(text: pd.Series, russian: pd.Series) -> pd.Series:
    cyr, lat = transducer("cyr"), transducer("lat")
    return pd.Series([None if t is None else cyr(t) if r else lat(t) for t, r in zip(text, russian)], dtype=object)


def consistent(text: Column, lang: Column) -> Column:
    """``text`` in the consistent form of its language."""
    russian = F.coalesce(lang == "ru", F.lit(False))
    odd = F.when(russian, text.rlike(ODD["cyr"])).otherwise(text.rlike(ODD["lat"]))
    return F.coalesce(_rewrite(F.when(odd, text), russian), text)


def words(text: Column) -> Column:
    """The words of a text that is in consistent form; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def with_words(df, text: str = "text", lang: str = "lang", out: str = "words"):
    """``df`` with the words of its texts; the consistent text stays a column of its own so that it is made once."""
    tmp = f"__{out}_text"
    return df.withColumn(tmp, consistent(F.col(text), F.col(lang))).withColumn(out, words(F.col(tmp))).drop(tmp)


def _digests(parts: Iterator[bytes]) -> np.ndarray:
    """128 bits of hash of each part, as two columns."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), "<i8").reshape(-1, 2)


_LETTER = re.compile(r"[^\W\d_]").search


def _form_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tab, lang, id, text) -> (tab, id, raw, k1, k2): hashes of the text and of its consistent form in its table and language; texts with a letter only."""
    for batch in batches:
        tabs, langs, texts = (batch.column(i).to_pylist() for i in (0, 1, 3))
        forms = [form(t, l == "ru") for t, l in zip(texts, langs)]
        kept = [i for i, f in enumerate(forms) if _LETTER(f) and any(map(str.isalpha, f))]
        raw = _digests(texts[i].encode("utf-8", "surrogatepass") for i in kept)
        keys = _digests(f"{tabs[i]}\0{langs[i]}\0{forms[i]}".encode("utf-8", "surrogatepass") for i in kept)
        own = batch.take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), *(pa.array(np.ascontiguousarray(x)) for x in (raw[:, 0], keys[:, 0], keys[:, 1]))], names=["tab", "id", "raw", "k1", "k2"])


def look_alikes(df, id_col: str, text: str, lang: str, group: str = "tab"):
    """Pairs of rows of one ``group`` and ``lang`` whose texts look the same but are different strings.

    Rows are keyed by 128 bits of hash of their consistent form, once; the keys, narrow rows, are written (checkpoint) and
    read from there.  Keys that hold one string only, exact copies however many, leave in an aggregation that combines before it
    shuffles; the joins see the rest.
    Left out: null ids and texts, texts without a letter, pairs of one id.  A null lang is a language of its own.
    """
    ready(df.sparkSession)
    read = df.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(group).alias("tab"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    keyed = read.mapInArrow(_form_keys, "tab string, id long, raw long, k1 long, k2 long").checkpoint()
    several = keyed.groupBy("tab", "k1", "k2").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("tab", "k1", "k2")
    key = ["tab", "k1", "k2"]
    rows = keyed.join(several, key, "left_semi").distinct().checkpoint()  # narrow, and read four times
    # Different strings of a key meet first, then the rows of each: the work is the number of pairs, however many copies a string has.
    strings = rows.select(*key, "raw").distinct()
    met = strings.withColumnRenamed("raw", "raw_a").join(strings.withColumnRenamed("raw", "raw_b"), key).where("raw_a < raw_b")
    side = lambda x: rows.select(*key, F.col("raw").alias(f"raw_{x}"), F.col("id").alias(f"id_{x}"))
    both = met.join(side("a"), [*key, "raw_a"]).join(side("b"), [*key, "raw_b"]).where("id_a <> id_b")
    return both.select("tab", F.least("id_a", "id_b").alias("a_id"), F.greatest("id_a", "id_b").alias("b_id"))
