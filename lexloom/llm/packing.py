"""Laying items of varying length into containers of a fixed capacity.

First-fit decreasing with a tournament tree over the room left in the containers, in groups of about
``group_size`` items drawn by hash, so that every group fits one task at any number of items and the room lost
to a group's last containers stays small.  Only ids and sizes are shuffled.

Defined cases: an item longer than the capacity is cut into full containers and one rest; an item of size 0 (or
null) takes no room and lies in the first container of its group; equal sizes go in order of id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item, in the given order; every item goes to the first container with room."""
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    out = []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        out.append(node - leaves)
        tree[node] -= size
        node //= 2
        while node:
            best = tree[2 * node] if tree[2 * node] >= tree[2 * node + 1] else tree[2 * node + 1]
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return out


def pack(df: DataFrame, id_col: str = "doc_id", size: str = "n_tokens", capacity: int = 2048, group_size: int = 5000, seed: int = 0, items: int | None = None) -> DataFrame:
    """(id, part, n_parts, size, grp, bin): each part of each item with its container (grp, bin).

    ``items`` is how many rows there are, where the caller knows it more cheaply than by counting ``df``.
    """
    groups = max(1, math.ceil((df.count() if items is None else items) / group_size))
    kind = df.schema[id_col].dataType.simpleString()

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        total = pdf["n"].to_numpy(np.int64)
        full, rest = total // capacity, total % capacity
        parts = np.maximum(1, full + (rest > 0))
        owner = np.repeat(np.arange(len(pdf)), parts)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        sizes = np.where(part < full[owner], capacity, rest[owner])
        order = np.lexsort((part, pdf["id"].to_numpy()[owner] if not pdf["id"].isna().any() else owner, -sizes))
        bins = np.empty(len(owner), np.int64)
        bins[order] = first_fit(sizes[order].tolist(), capacity)
        bins[sizes == 0] = 0
        return pd.DataFrame({id_col: pdf["id"].to_numpy()[owner], "part": part, "n_parts": parts[owner], "size": sizes, "grp": pdf["grp"].to_numpy()[owner], "bin": bins})

    drawn = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n"), F.pmod(F.xxhash64(F.lit(seed), id_col, size), F.lit(groups)).alias("grp"))
    return drawn.groupBy("grp").applyInPandas(lay, f"`{id_col}` {kind}, part int, n_parts int, size long, grp long, bin long")


def pack_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row per group: containers, the fewest there could be, tokens, share of the room that is used."""
    bins = packed.groupBy("grp", "bin").agg(F.sum("size").alias("used"))
    per = bins.groupBy("grp").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return per.select("grp", "containers", F.ceil(F.col("tokens") / capacity).alias("at_least"), "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("fill"))
