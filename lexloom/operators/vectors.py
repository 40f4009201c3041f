"""Vectors and sequence models: clustering, low-rank pair models, Kneser-Ney, small transformers.

Clusters come from Spark's own library.  Networks run as numpy in Pandas functions, their weights broadcast (a
stated, small size) and their last results kept in a bounded cache per worker.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kmeans(vectors: DataFrame, k: int, vec: str = "vec", seed: int = 7, rounds: int = 30) -> DataFrame:
    """(id, cluster): spherical k-means with distributed seeding."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = vectors.select("id", array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, distanceMeasure="cosine").fit(x)
    return model.transform(x).select("id", F.col("prediction").alias("cluster"))


def low_rank(pairs: DataFrame, rank: int = 16, seed: int = 7, rounds: int = 4, most_rows: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """Left vectors and singular values of a sparse matrix (i, j, v) by subspace iteration; products are aggregations over its entries.

    Only the dense blocks of at most ``most_rows`` x rank come to the driver.
    """
    n = pairs.agg(F.greatest(F.max("i"), F.max("j"))).first()[0] + 1
    if n > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(n, rank)))[0]

    def times(m: np.ndarray, row: str, col: str) -> np.ndarray:
        held = pairs.sparkSession.sparkContext.broadcast(m)

        def part(frames):
            out = np.zeros((n, rank))
            for pdf in frames:
                np.add.at(out, pdf[row].to_numpy(), pdf["v"].to_numpy()[:, None] * held.value[pdf[col].to_numpy()])
            rows = np.flatnonzero(out.any(1))
            yield pd.DataFrame({"r": rows, "x": list(out[rows])})

        sums = [F.sum(F.col("x")[k]).alias(f"x{k}") for k in range(rank)]
        got = pairs.select("i", "j", "v").mapInPandas(part, "r long, x array<double>").groupBy("r").agg(*sums).toPandas()
        out = np.zeros((n, rank))
        out[got["r"].to_numpy()] = got.drop(columns="r").to_numpy()
        return out

    for _ in range(rounds):
        q = np.linalg.qr(times(np.linalg.qr(times(q, "j", "i"))[0], "i", "j"))[0]
    b = times(q, "j", "i")
    u, s, _ = np.linalg.svd(b.T, full_matrices=False)
    return q @ u, s


def kneser_ney(pairs: DataFrame, discount: float = 0.75) -> DataFrame:
    """(lang, prev, word, logp): interpolated bigrams of counts (lang, prev, word, n)."""
    cont = pairs.groupBy("lang", "word").agg(F.count("*").alias("before"))
    kinds = pairs.groupBy("lang").agg(F.count("*").alias("kinds"))
    left = pairs.groupBy("lang", "prev").agg(F.sum("n").alias("total"), F.count("*").alias("after"))
    j = pairs.join(left, ["lang", "prev"]).join(cont, ["lang", "word"]).join(F.broadcast(kinds), "lang")
    p = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total") + discount * F.col("after") / F.col("total") * F.col("before") / F.col("kinds")
    return j.select("lang", "prev", "word", F.round(F.ln(p), 6).alias("logp"))


def bits_per_word(scored: DataFrame) -> DataFrame:
    """(lang, bits) of words with a probability (lang, logp, n)."""
    return scored.groupBy("lang").agg(F.round(-F.sum(F.col("logp") * F.col("n")) / F.sum("n") / float(np.log(2)), 6).alias("bits"))


class LRU:
    """The last results of a function, a bounded number of them."""

    def __init__(self, size: int = 16):
        self.size, self.kept = size, OrderedDict()

    def get(self, key, make):
        if key in self.kept:
            self.kept.move_to_end(key)
        else:
            self.kept[key] = make()
            if len(self.kept) > self.size:
                self.kept.popitem(last=False)
        return self.kept[key]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def norm(x: np.ndarray, gain: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5) * gain + bias


class Encoder:
    """A small transformer over word ids: whole sentences at once, or a word at a time with its keys and values kept.

    Weights: emb (v, d), pos (n, d), and per layer qkv (d, 3d), out (d, d), up (d, h), down (h, d), g1 b1 g2 b2; heads
    from ``head`` (d, d) against a root, relations from ``rel`` (2d, r).
    """

    def __init__(self, weights: dict[str, np.ndarray], heads: int = 2, causal: bool = True):
        self.w, self.heads, self.causal = weights, heads, causal
        self.layers = sum(k.endswith(".qkv") for k in weights)
        self.cache = LRU(8)

    def _attend(self, q, k, v, mask):
        n, d = q.shape
        split = lambda x: x.reshape(len(x), self.heads, -1).transpose(1, 0, 2)
        a = split(q) @ split(k).transpose(0, 2, 1) / np.sqrt(d / self.heads)
        return (softmax(np.where(mask, a, -1e30)) @ split(v)).transpose(1, 0, 2).reshape(n, d)

    def whole(self, ids: list[int]) -> np.ndarray:
        return self._run(ids, None)

    def _run(self, ids: list[int], past: list | None) -> np.ndarray:
        at = len(past[0][0]) if past and past[0] else 0
        x = self.w["emb"][ids] + self.w["pos"][at : at + len(ids)]
        for i in range(self.layers):
            w = lambda name: self.w[f"{i}.{name}"]  # noqa: B023, E731
            q, k, v = np.split(norm(x, w("g1"), w("b1")) @ w("qkv"), 3, -1)
            if past is not None:
                if past[i]:
                    k, v = np.concatenate([past[i][0], k]), np.concatenate([past[i][1], v])
                past[i] = (k, v)
            mask = np.arange(len(k))[None] <= at + np.arange(len(q))[:, None] if self.causal else np.ones((len(q), len(k)), bool)
            x = x + self._attend(q, k, v, mask) @ w("out")
            x = x + np.maximum(norm(x, w("g2"), w("b2")) @ w("up"), 0) @ w("down")
        return x

    def step(self, ids: list[int]) -> np.ndarray:
        """The states of a sentence, reusing those of the longest beginning that was read before."""
        key, past, states = tuple(ids), [None] * self.layers, np.zeros((0, self.w["emb"].shape[1]))
        for n in range(len(ids), 0, -1):
            if key[:n] in self.cache.kept:
                states, past = self.cache.kept[key[:n]][0], list(self.cache.kept[key[:n]][1])
                break
        if len(states) < len(ids):
            states = np.concatenate([states, self._run(list(ids[len(states) :]), past)])
        return self.cache.get(key, lambda: (states, past))[0]

    def head_chances(self, x: np.ndarray) -> np.ndarray:
        """For each word the chances of the root and each word as its head."""
        with_root = np.concatenate([self.w["root"], x])
        score = x @ self.w["head"] @ with_root.T
        score[np.arange(len(x)), np.arange(len(x)) + 1] = -1e30
        return softmax(score)

    def relation_chances(self, x: np.ndarray, heads: np.ndarray) -> np.ndarray:
        with_root = np.concatenate([self.w["root"], x])
        return softmax(np.concatenate([x, with_root[heads]], 1) @ self.w["rel"])


def parse(sents: DataFrame, weights: dict[str, np.ndarray], ids: str = "ids", id_col: str = "sent_id", heads: int = 2) -> DataFrame:
    """(id, heads, rels, chances): the likeliest head and relation of each word of a sentence of word ids."""
    held = sents.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("struct<heads:array<int>,rels:array<int>,chances:array<double>>")
    def run(rows: pd.Series) -> pd.DataFrame:
        net = Encoder(held.value, heads, causal=False)
        out = []
        for row in rows:
            if row is None or not len(row):
                out.append(([], [], []))
                continue
            x = net.whole([int(i) for i in row])
            chance = net.head_chances(x)
            best = chance.argmax(1)
            rel = net.relation_chances(x, best)
            out.append((best.tolist(), rel.argmax(1).tolist(), (chance.max(1) * rel.max(1)).round(9).tolist()))
        return pd.DataFrame(out, columns=["heads", "rels", "chances"])

    return sents.select(F.col(id_col).alias("id"), run(ids).alias("z")).select("id", "z.heads", "z.rels", "z.chances")


def random_weights(vocabulary: int, d: int = 16, hidden: int = 32, layers: int = 2, relations: int = 5, longest: int = 64, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    m = lambda *s: rng.normal(size=s) / np.sqrt(s[0])
    w = {"emb": m(vocabulary, d), "pos": m(longest, d), "head": m(d, d), "rel": m(2 * d, relations), "root": m(1, d)}
    for i in range(layers):
        w |= {f"{i}.qkv": m(d, 3 * d), f"{i}.out": m(d, d), f"{i}.up": m(d, hidden), f"{i}.down": m(hidden, d), f"{i}.g1": np.ones(d), f"{i}.b1": np.zeros(d), f"{i}.g2": np.ones(d), f"{i}.b2": np.zeros(d)}
    return w


def quantise(weights: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Weights as bytes with a scale per row."""
    out = {}
    for k, w in weights.items():
        scale = np.maximum(np.abs(w).max(-1, keepdims=True), 1e-12) / 127
        out[k] = (np.round(w / scale).astype(np.int8), scale)
    return out


def choose(cands: DataFrame, chosen: str = "logit", clamp: float = 2.0, weight: float = 1.0, temperature: float = 1.0) -> DataFrame:
    """(qid, word, shift): a chooser's say on each candidate, bounded either way; ``logit`` is its score."""
    return cands.withColumn("shift", -F.greatest(F.lit(-clamp), F.least(F.lit(clamp), weight * F.col(chosen) / temperature)))


def top_lemmas(scores: DataFrame, forms: DataFrame, lemmas: int = 16, per_lemma: int = 12) -> DataFrame:
    """(qid, word, lrk, frk): the likeliest lemmas of a place (qid, lemma, logp) and the commonest forms of each (lemma, word, count)."""
    l = scores.withColumn("lrk", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("logp"), "lemma"))).where(F.col("lrk") <= lemmas)
    f = forms.withColumn("frk", F.row_number().over(Window.partitionBy("lemma").orderBy(F.desc("count"), "word"))).where(F.col("frk") <= per_lemma)
    return l.join(f, "lemma").select("qid", "lemma", "word", "lrk", "frk")
