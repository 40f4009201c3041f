"""Encoding of whole texts by a public byte-level BPE vocabulary.

A text is cut by the vocabulary's pattern; each piece starts as a doubly linked list of its bytes, a priority
queue holds the rank of every neighbouring pair, the lowest rank (then the leftmost pair) is merged, and entries
whose symbols have changed since are skipped when they surface.  Pieces repeat, so a bounded memo keeps their
ids.  The vocabulary file (fixed size, under 1 MB) is read once by the driver and broadcast.

Defined cases: null and empty texts give an empty list; strings that look like special tokens are ordinary text;
every row gives one row, whatever its id; there is no limit on the length of a text.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that cuts a text into pieces for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBPE:
    """Encoder and decoder; ``vocabulary`` holds lines of base64 bytes and rank."""

    MEMO, LONGEST = 1 << 18, 96

    def __init__(self, vocabulary: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.strings = {b: a for a, b in self.ranks.items()}
        self.pieces = regex.compile(PATTERN).findall
        self.memo: dict[str, list[int]] = {}

    def piece(self, data: bytes) -> list[int]:
        rank, n = self.ranks.get, len(data)
        right, left, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapify(queue)
        while queue:
            _, i, stop = heappop(queue)
            j = right[i]
            if not end[i] or j == n or end[j] != stop:
                continue  # one of the two symbols has grown or gone
            end[i], end[j], after, before = stop, 0, right[j], left[i]
            right[i] = after
            if after < n:
                left[after] = i
                if (r := rank(data[i : end[after]])) is not None:
                    heappush(queue, (r, i, end[after]))
            if before >= 0 and (r := rank(data[before:stop])) is not None:
                heappush(queue, (r, before, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = right[i]
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        memo = self.memo
        for piece in self.pieces(text):
            if (ids := memo.get(piece)) is None:
                ids = self.piece(piece.encode())
                if len(piece) <= self.LONGEST:
                    if len(memo) >= self.MEMO:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode()


_LOADED: dict[str, ByteBPE] = {}


def loaded(vocabulary: bytes) -> ByteBPE:
    """One encoder per Python worker and vocabulary."""
    key = hashlib.sha1(vocabulary).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = ByteBPE(vocabulary)
    return _LOADED[key]


def read_vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return f.read()


def _mapped(df: DataFrame, id_col: str, text: str, name: str, folder: str, schema: str, make) -> DataFrame:
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary.value)
        for batch in batches:
            texts = batch.column(1)
            for start in range(0, batch.num_rows, 500):  # bounds what is held as Python objects
                yield make(bpe, batch.slice(start, 500), texts.slice(start, 500).to_pylist())

    return df.select(F.col(id_col), F.col(text)).mapInArrow(run, schema)


def encode(df: DataFrame, id_col: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids): one row per row of ``df``."""

    def make(bpe: ByteBPE, batch: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
        flat: list[int] = []
        offsets = [0]
        for t in texts:
            if t:
                flat += bpe.encode(t)
            offsets.append(len(flat))
        ids = pa.ListArray.from_arrays(pa.array(np.asarray(offsets, np.int32)), pa.array(np.asarray(flat, np.int32)))
        return pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    return _mapped(df, id_col, text, name, folder, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>", make)


def token_counts(df: DataFrame, id_col: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, n_tokens): one row per row of ``df``."""

    def make(bpe: ByteBPE, batch: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(bpe.encode(t)) if t else 0 for t in texts], pa.int64())], names=[id_col, "n_tokens"])

    return _mapped(df, id_col, text, name, folder, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_tokens long", make)


def decode(df: DataFrame, id_col: str = "doc_id", ids: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, text): ids back to text; an empty list gives an empty text, null gives null."""
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary.value)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, text string")
