"""Lexical queries over a table of typed strings: corrections, completions, predictions, splits.

Corrections compare blocks of typed strings with all words of their language.  A bound from below on the price of a pair,
read from the letters the two don't share (a matrix product per block), says which pairs the channel must price at all; their
words are priced along a tree of letters, each beginning once and no further than the budget goes.  A string is priced step by
step up to the budget it needs, so nothing within the budget is lost.
``suggest_exhaustive`` prices every pair; it is for tests.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..data import ABOVE_SPACE, MISSING_SPACE, ONE_LETTER_WORDS, SPACE_AS_LETTER
from ..functions import text as X
from .channel import ALPHABET, CODE, CYRILLIC_FINGERS, LATIN_FINGERS, _align, codes, edit_costs, keyboard, typed_costs

#: Readings compared with the words at once, strings of a block where the cores would idle and at most (each block holds all words), and pairs or beginnings priced at once.
AT_ONCE, LEAST_BLOCK, BLOCK, PRICED = 64, 300, 20_000, 100_000


def _holes(word: str, most: int) -> list[str]:
    n = len(word)
    most = min(most, n if n < 4 else most)
    out = {word}
    for k in range(1, most + 1):
        for cut in combinations(range(n), k):
            out.add("".join(c for i, c in enumerate(word) if i not in cut))
    return list(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def cut_keys(word: pd.Series) -> pd.Series:
    """What is left of a word with up to two letters cut out."""
    return pd.Series([_holes(w, 2) if w else [] for w in word])


@lru_cache(maxsize=8)
def _bags(cfg: Config, home: bool) -> tuple[np.ndarray, float, float]:
    """The class of each letter (-1: may come and go freely), the least price of a class that differs, and of a doubled letter left out.

    Letters that the channel confuses for little (accents, ё, on the home row those of a finger) are one class; ь, ъ,
    apostrophes and hyphens are in none.  ``bound`` sees to words with a letter that is written as two, and to ь and ъ on the home row.
    """
    kb, plain = keyboard(cfg), {**dict(zip(X.ACCENTED, X.UNACCENTED)), "ё": "е"}
    name = [None if c in "ьъ'-" else plain.get(c, c) for c in ALPHABET]
    if home:
        rows = [(g, r, f) for g, (rows, fingers) in enumerate(((X.LATIN_ROWS, LATIN_FINGERS), (X.CYRILLIC_ROWS, CYRILLIC_FINGERS))) for r, f in zip(rows, fingers)]
        finger = {c: (g, f) for g, r, fs in rows for c, f in zip(r, fs)}
        name = [n and finger.get(n, n) for n in name]
    kinds = {n: k for k, n in enumerate(dict.fromkeys(n for n in name if n is not None))}
    cls = np.array([-1 if n is None else kinds[n] for n in name])
    table, held = kb.home if home else kb.sub, cls >= 0
    differ = (cls[:, None] != cls[None]) & (kb.two[:, 0] < 0)[None] & (held | (not home))[None]
    least = min(table[differ].min(), kb.delete[held].min(), kb.insert[held].min(), cfg.ins_repeat, cfg.ins_neighbor)
    return cls, float(least), float(min(least, cfg.del_double))


def _counts(x: np.ndarray, lengths: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """How often each class stands in each row of codes."""
    c = np.where(np.arange(x.shape[1])[None] < lengths[:, None], cls[x], -1)
    return np.stack([(c == k).sum(1) for k in range(cls.max() + 1)], 1)


class _Lexicon:
    """The words of a language as a tree of their letters, by depth: letter, children and words of each node; and bounds on the price of typed strings against the words in the tree's order."""

    def __init__(self, words: list[str], cfg: Config):
        self.cfg, self.words = cfg, len(words)
        self.lengths = np.array([len(w) for w in words])
        self.codes = codes(words, int(self.lengths.max()))
        width = self.codes.shape[1]
        held = np.where(np.arange(width)[None] < self.lengths[:, None], self.codes + 1, 0)
        order = np.lexsort(held.T[::-1])
        held, lengths = held[order], self.lengths[order]
        fresh = np.ones(held.shape, bool)
        fresh[1:] = np.logical_or.accumulate(held[1:] != held[:-1], axis=1)
        above, self.letter, self.child, self.ends, self.reach = np.zeros(len(words), int), [], [np.zeros(2, int)], [], []
        for d in range(width):
            inside = lengths > d
            own = np.cumsum(fresh[:, d] & inside) - 1
            first = np.flatnonzero(fresh[:, d] & inside)
            self.letter.append(held[first, d] - 1)
            self.reach.append((first, first + np.bincount(own[inside], minlength=len(first))))
            parents = len(self.child[d]) - 1
            self.child[d] = np.searchsorted(above[first], np.arange(parents + 1)) if d else np.array([0, len(first)])
            self.child.append(np.zeros(len(first) + 1, int))
            here = np.flatnonzero(lengths == d + 1)
            self.ends.append((np.searchsorted(own[here], np.arange(len(first) + 1)), order[here]))
            above = own
        self.order, x = order, self.codes[order]
        inside = np.arange(1, width)[None] < lengths[:, None]
        self.doubled = ((x[:, 1:] == x[:, :-1]) & inside).sum(1)
        self.free = (lengths - _counts(x, lengths, _bags(cfg, False)[0]).sum(1)).astype(np.float32)
        self.any = ((keyboard(cfg).two[x, 0] >= 0) & (np.arange(width)[None] < lengths[:, None])).any(1)
        self.bags = {}
        for home in (False, True):
            n = _counts(x, lengths, _bags(cfg, home)[0])
            self.bags[home] = n.sum(1), int(n.max(initial=1)), self._unary(n, int(n.max(initial=1)))

    @staticmethod
    def _unary(n: np.ndarray, most: int) -> np.ndarray:
        return np.concatenate([n > k for k in range(most)], 1).astype(np.float32)

    def bound(self, x: np.ndarray, lengths: np.ndarray, home: bool, words: slice | np.ndarray = slice(None)) -> np.ndarray:
        """No pair of a typed string and a word (in the tree's order; all, or some) costs less.

        A letter more on either side takes a change of its own, and one change settles one letter on each side at most.
        """
        cls, least, double = _bags(self.cfg, home)
        total, most, held = self.bags[home]
        n = _counts(x, lengths, cls)
        shared = self._unary(n, most) @ held[words].T
        more, less = n.sum(1)[:, None] - shared, total[words][None] - shared
        if home:
            more = np.maximum(more - self.free[words][None], 0)
        low = least * np.maximum(more, less) - (least - double) * np.minimum(self.doubled[words][None], np.maximum(less - more, 0))
        low[:, self.any[words]] = 0
        return low - 1e-3

    def within(self, x: np.ndarray, most: np.ndarray, home: bool, may: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(reading, word, price) of all words that cost a reading (rows of ``x``, of one length) no more than ``most``, of those that ``may`` (in the tree's order).

        The rows of the alignment are worked out once for a beginning that words share, from the root; a beginning of which every
        cell costs more ends there, as no step gives anything back.
        """
        kb, cfg, m, n = keyboard(self.cfg), self.cfg, x.shape[1], len(ALPHABET)
        table = (kb.home if home else kb.sub).ravel()
        soft, t, s = CODE["ь"], CODE["т"], CODE["с"]
        insert, swap = (a.T.copy() for a in typed_costs(x, cfg))
        xs, row = x.T.astype(np.int64), np.concatenate([np.zeros((1, len(x))), np.cumsum(insert, 0)])
        out, least = [(np.empty(0, int), np.empty(0, int), np.empty(0))], min(cfg.trans, cfg.trans_cross)
        before = np.zeros((len(x), self.words + 1), np.int32)
        np.cumsum(may, 1, out=before[:, 1:])
        stack = [(0, np.arange(len(x)), np.zeros(len(x), int), np.zeros(len(x), int), row, np.full_like(row, np.inf))]
        while stack:
            d, r, node, last, cur, prev = stack.pop()
            start = self.child[d][node]
            count = self.child[d][node + 1] - start
            if count.sum() > PRICED and len(r) > 1:
                h = max(1, min(len(r) - 1, int(np.searchsorted(np.cumsum(count), PRICED))))
                stack += [(d, r[c], node[c], last[c], cur[:, c], prev[:, c]) for c in (slice(h, None), slice(0, h))]
                continue
            i = np.repeat(np.arange(len(r)), count)
            if not len(i):
                continue
            node = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + start[i]
            low, high = self.reach[d]
            held = np.flatnonzero(before[r[i], high[node]] > before[r[i], low[node]])
            if not len(held):
                continue
            i, node = i[held], node[held]
            r, last, cur, prev, c = r[i], last[i], cur[:, i], prev[:, i], self.letter[d][node]
            on, ins, drop = xs[:, r], insert[:, r], kb.delete[c]
            drop = np.where(c == last, np.minimum(drop, cfg.del_double), drop)
            softens, doubles = (c == soft) & (last == t), kb.two[c, 0] >= 0
            softens, doubles = softens if softens.any() else None, doubles if doubles.any() else None
            at = lambda j: drop if softens is None or j >= m else np.where(softens & (on[j] == s), np.minimum(drop, cfg.tsya), drop)  # noqa: B023, E731
            new = np.empty_like(cur)
            new[0] = cur[0] + at(0)
            for j in range(1, m + 1):
                best = np.minimum(cur[j - 1] + table.take(on[j - 1] * n + c), cur[j] + at(j))
                np.minimum(best, new[j - 1] + ins[j - 1], out=best)
                if d and j >= 2:
                    crossed = np.flatnonzero((c == on[j - 2]) & (last == on[j - 1]))
                    if len(crossed):
                        best[crossed] = np.minimum(best[crossed], prev[j - 2, crossed] + swap[j, r[crossed]])
                if j >= 2 and doubles is not None:
                    double = (kb.two[c, 0] == on[j - 2]) & (kb.two[c, 1] == on[j - 1])
                    best = np.where(double, np.minimum(best, cur[j - 2] + cfg.accent), best)
                new[j] = best
            first, words = self.ends[d]
            done = np.flatnonzero((new[m] <= most[r]) & (first[node + 1] > first[node]))
            if len(done):
                k = first[node[done] + 1] - first[node[done]]
                z = np.repeat(done, k)
                w = words[np.arange(len(z)) - np.repeat(np.cumsum(k) - k, k) + first[node[z]]]
                out.append((r[z], w, new[m, z]))
            if d + 1 < self.codes.shape[1]:
                go = np.flatnonzero(np.minimum(new.min(0), cur.min(0) + least) <= most[r])
                if len(go):
                    stack.append((d + 1, r[go], node[go], c[go], new[:, go], cur[:, go]))
        return tuple(np.concatenate(z) for z in zip(*out))

    def price(self, x: np.ndarray, lengths: np.ndarray, r: np.ndarray, w: np.ndarray, home: np.ndarray) -> np.ndarray:
        """The price of each pair of a reading and a word."""
        out = np.empty(len(r))
        key = (lengths[r] * 100_000 + self.lengths[w]) * 2 + home[r]
        order = np.argsort(key, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(order) else []:
            m, n = lengths[r[own[0]]], self.lengths[w[own[0]]]
            for a in range(0, len(own), PRICED):
                part = own[a : a + PRICED]
                out[part] = _align(x[r[part], :m], self.codes[w[part], :n], self.cfg, bool(home[r[own[0]]]))
        return out


def _steps(cfg: Config) -> list[float]:
    steps = [cfg.max_cost]
    while steps[-1] + cfg.widen_step <= cfg.ceiling:
        steps.append(steps[-1] + cfg.widen_step)
    return steps


def _within_budget(reads: pd.DataFrame, lex: _Lexicon, cfg: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(reading, word, edit): all that ``_ranked`` needs of some strings' readings, each string up to the budget it comes to."""
    q = pd.factorize(reads["qid"])[0]
    hyp, lengths = reads["hyp"].to_numpy(), reads["read"].str.len().to_numpy()
    x, home = codes(reads["read"].tolist(), int(lengths.max())), hyp == "home"
    low = np.empty((len(reads), lex.words), np.float32)
    for h in (False, True):
        if (home == h).any():
            low[home == h] = lex.bound(x[home == h], lengths[home == h], h)
    low *= cfg.w_ch
    cap = np.where(hyp == "flip", cfg.layout_max_cost, cfg.rescue)
    done = np.full(len(reads), -np.inf)
    R, W, E = np.empty(0, int), np.empty(0, int), np.empty(0)

    def extend(rows: np.ndarray, to: np.ndarray) -> None:
        nonlocal R, W, E
        to = np.minimum(to, cap[rows])
        rows, to = rows[to > done[rows]], to[to > done[rows]]
        key = lengths[rows] * 2 + home[rows]
        for k in np.unique(key):
            own = rows[key == k]
            r, w, e = lex.within(x[own, : k // 2], to[key == k] / cfg.w_ch + 1e-9, bool(k % 2), low[own] <= to[key == k][:, None])
            keep = (e * cfg.w_ch <= to[key == k][r]) & (e * cfg.w_ch > done[own[r]])
            R, W, E = np.r_[R, own[r[keep]]], np.r_[W, w[keep]], np.r_[E, e[keep]]
        done[rows] = to

    # The home row counts only where nothing that was typed convinces, so that is settled first.
    steps, typed, use = _steps(cfg), hyp == "typed", np.ones(len(reads), bool)
    limit = np.where(typed & np.isin(q, q[home]), cfg.home_row_trigger * lengths, -1.0)
    for b in (*steps, cfg.rescue):
        rows = np.flatnonzero((limit >= 0) & (done < limit * cfg.w_ch) & (done < cap))
        if len(rows):
            extend(rows, np.minimum(b, limit[rows] * cfg.w_ch))
            sure = np.unique(R[(E / lengths[R] <= cfg.home_row_trigger) & (limit[R] >= 0)])
            use[home & np.isin(q, q[sure])] = False
            limit[sure] = -1.0

    budget = np.full(q.max() + 1, np.nan)
    for b in (*steps, cfg.rescue):
        rows = np.flatnonzero(np.isnan(budget[q]) & use)
        if not len(rows):
            break
        extend(rows, np.full(len(rows), b))
        fit = use[R] & (E * cfg.w_ch <= b)
        found = np.bincount(np.unique(q[R[fit]] * lex.words + W[fit]) // lex.words, minlength=len(budget))
        enough = found >= (cfg.min_results if b < steps[-1] else 1) if b != cfg.rescue else np.ones(len(budget), bool)
        budget[np.isnan(budget) & enough] = b
    # What another reading finds may cost less as typed, with no penalty.
    fit = use[R] & (E * cfg.w_ch <= budget[q[R]])
    as_typed = np.full(len(budget), -1)
    as_typed[q[typed]] = np.flatnonzero(typed)
    h = fit & ~typed[R]
    again = np.unique(np.stack([as_typed[q[R[h]]], W[h]], 1)[as_typed[q[R[h]]] >= 0], axis=0)
    e = lex.price(x, lengths, again[:, 0], again[:, 1], home) if len(again) else np.empty(0)
    keep = (e * cfg.w_ch <= cfg.rescue) & (e * cfg.w_ch > budget[q[again[:, 0]]])
    return np.r_[R[fit], again[keep, 0]], np.r_[W[fit], again[keep, 1]], np.r_[E[fit], e[keep]]


def hypotheses(typed: DataFrame, cfg: Config, *more: str) -> DataFrame:
    """(qid, lang, typed, read, hyp): as typed, on the other layout, and each home-row key for its finger's keys; ``more`` columns are kept."""
    t = typed.select("qid", "lang", "typed", *more, F.lower(F.trim("typed")).alias("read")).where((F.length("read") > 0) & (F.length("read") <= cfg.max_input))
    home = "".join(c for c, i in CODE.items() if keyboard(cfg).on_home[i])
    as_read = lambda read, hyp: F.struct(read.alias("read"), F.lit(hyp).alias("hyp"))
    flipped, read = X.flip_layout(F.col("read")), F.col("read")
    reads = [as_read(read, "typed")]
    if cfg.layout_flip:
        reads.append(F.when(flipped != read, as_read(flipped, "flip")))
    if cfg.home_row:
        reads.append(F.when((F.length(read) >= 3) & read.rlike(f"^[{home}]+$"), as_read(read, "home")))
    return t.select("qid", "lang", "typed", *more, F.explode(F.array_compact(F.array(*reads))).alias("z")).select("qid", "lang", "typed", *more, "z.read", "z.hyp")


def suggest(typed: DataFrame, lexicon: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(qid, typed, word, edit, cost, rk): the ``top_k`` cheapest words of each typed string (qid, lang, typed), ties in order of the words.

    ``lexicon`` (lang, word, prior_milli).  The budget of a string is the smallest step at which ``min_results`` words
    fit; a word found by several readings keeps its cheapest.  A flipped layout must fit within its own cap, the
    home row counts only where the reading as typed finds nothing convincing.  A qid has one language.
    """
    reads = hypotheses(typed, cfg).dropDuplicates(["qid", "lang", "hyp"])
    n = typed.count()
    blocks = max(1, -(-n // BLOCK), min(-(-n // LEAST_BLOCK), typed.sparkSession.sparkContext.defaultParallelism))
    asked = reads.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    words = lexicon.select("lang", "word", "prior_milli").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    kind = typed.schema["qid"].dataType.simpleString()
    names = ["qid", "typed", "lang", "word", "prior_milli", "read", "hyp", "edit"]

    def compare(asked: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(words):
            lex = _Lexicon(words["word"].tolist(), cfg)
            asked = asked.sort_values("qid", ignore_index=True)
            group = pd.factorize(asked["qid"])[0] // AT_ONCE
            for k in range(group.max() + 1):
                own = asked[group == k].reset_index(drop=True)
                r, w, edit = _within_budget(own, lex, cfg)
                said, meant = own.iloc[r].reset_index(drop=True), words.iloc[w].reset_index(drop=True)
                out.append(said.assign(word=meant["word"], prior_milli=meant["prior_milli"], edit=edit)[names])
        return pd.concat(out) if out else pd.DataFrame(columns=names)

    apart = lambda df: df.repartition(4 * blocks, "lang", "block").groupBy("lang", "block")  # noqa: E731 - by work, where AQE goes by bytes
    found = apart(asked).cogroup(apart(words)).applyInPandas(compare, f"qid {kind}, typed string, lang string, word string, prior_milli int, read string, hyp string, edit double")
    return _ranked(found, cfg)


def _ranked(found: DataFrame, cfg: Config) -> DataFrame:
    steps = _steps(cfg)
    per = Window.partitionBy("qid")
    convincing = F.min(F.when(F.col("hyp") == "typed", F.col("edit") / F.length("read"))).over(per)
    real = found.withColumn("best", convincing).where((F.col("hyp") != "home") | F.col("best").isNull() | (F.col("best") > cfg.home_row_trigger))
    price = F.col("edit") + F.when(F.col("hyp") == "flip", cfg.layout_switch).when(F.col("hyp") == "home", cfg.home_row_penalty).otherwise(0.0)
    each = real.groupBy("qid", "typed", "lang", "word", "prior_milli").agg(F.min(cfg.w_ch * F.col("edit")).alias("raw"), F.min(price).alias("edit"))
    counts = [F.sum((F.col("raw") <= b).cast("int")).over(per) for b in steps]
    budget = F.lit(None).cast("double")
    for b, c in reversed([*zip(steps, counts)]):
        budget = F.when(c >= cfg.min_results, b).otherwise(budget)
    budget = F.coalesce(budget, F.when(counts[-1] > 0, steps[-1]).otherwise(cfg.rescue))
    priced = each.withColumn("budget", budget).where("raw <= budget").withColumn("cost", F.round(cfg.w_ch * F.col("edit") + cfg.w_lm * F.col("prior_milli") / 1000, 6)).withColumn("edit", F.round("edit", 6))
    rk = F.row_number().over(Window.partitionBy("qid").orderBy("cost", "word"))
    return priced.withColumn("rk", rk).where(F.col("rk") <= cfg.top_k).select("qid", "typed", "lang", "word", "edit", "cost", "rk")


def suggest_exhaustive(typed: DataFrame, lexicon: DataFrame, cfg: Config = Config(), most: int = 5000) -> DataFrame:
    """The same against every word of the language: a stated set of at most ``most`` strings, every pair priced."""
    reads = hypotheses(typed, cfg).limit(3 * most + 1).toPandas()
    if len(reads) > 3 * most:
        raise ValueError(f"more than {most} typed strings")
    held = typed.sparkSession.sparkContext.broadcast({k: v.to_dict("records") for k, v in reads.groupby("lang")})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for lang, words in pdf.groupby("lang"):
                for q in held.value.get(lang, []):
                    edit = edit_costs([q["read"]] * len(words), words["word"].tolist(), cfg, q["hyp"] == "home")
                    out = words.assign(edit=edit, **{k: q[k] for k in ("qid", "typed", "read", "hyp")})
                    yield out[(out["edit"] * cfg.w_ch <= cfg.rescue) & ~((q["hyp"] == "flip") & (out["edit"] * cfg.w_ch > cfg.layout_max_cost))][["qid", "typed", "lang", "word", "prior_milli", "read", "hyp", "edit"]]

    found = lexicon.select("lang", "word", "prior_milli").mapInPandas(run, "qid long, typed string, lang string, word string, prior_milli int, read string, hyp string, edit double")
    return _ranked(found, cfg)


def complete(prefixes: DataFrame, lexicon: DataFrame, cfg: Config = Config(), longest: int = 8) -> DataFrame:
    """(lang, prefix, word, cost_milli, rk): the cheapest words that begin so; each letter still to type costs.

    An equi join on the prefix, or its first ``longest`` letters where it is longer.
    """
    heads = lexicon.select("lang", "word", "prior_milli", F.explode(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(longest)))).alias("n")).withColumn("head", F.expr("substring(word, 1, n)"))
    p = prefixes.select("lang", "prefix", F.substring("prefix", 1, longest).alias("head")).where("length(prefix) > 0").distinct()
    fits = p.join(heads, ["lang", "head"]).where(F.expr("startswith(word, prefix)"))
    cost = F.bround(F.round(cfg.w_lm * F.col("prior_milli") + 1000 * cfg.complete_char * (F.length("word") - F.length("prefix")), 6), 0).cast("int")
    rk = F.row_number().over(Window.partitionBy("lang", "prefix").orderBy("cost_milli", "word"))
    return fits.withColumn("cost_milli", cost).withColumn("rk", rk).where(F.col("rk") <= cfg.top_k).select("lang", "prefix", "word", "cost_milli", "rk")


def predict(left: DataFrame, pairs: DataFrame, k: int = 3) -> DataFrame:
    """(lang, prev, word, nats_milli, rk): the likeliest words after ``prev`` (lang, prev)."""
    j = left.distinct().join(pairs.select("lang", "prev", "word", "nats_milli"), ["lang", "prev"])
    return j.withColumn("rk", F.row_number().over(Window.partitionBy("lang", "prev").orderBy("nats_milli", "word"))).where(F.col("rk") <= k)


def complete_after(left: DataFrame, pairs: DataFrame, k: int = 3) -> DataFrame:
    """The same of words that begin with what is typed (lang, prev, prefix)."""
    j = left.distinct().join(pairs.select("lang", "prev", "word", "nats_milli"), ["lang", "prev"]).where(F.expr("startswith(word, prefix)"))
    return j.withColumn("rk", F.row_number().over(Window.partitionBy("lang", "prev", "prefix").orderBy("nats_milli", "word"))).where(F.col("rk") <= k).select("lang", "prev", "prefix", "word", "nats_milli", "rk")


def is_prefix(prefixes: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(lang, prefix, known): whether some word begins so; the heads of words are a distinct set that meets by equality."""
    heads = lexicon.select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda n: F.substring("word", F.lit(1), n))).alias("prefix")).distinct().withColumn("hit", F.lit(True))
    return prefixes.distinct().join(heads, ["lang", "prefix"], "left").select("lang", "prefix", F.coalesce("hit", F.lit(False)).alias("known"))


def split_in_two(typed: DataFrame, lexicon: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(lang, typed, left, right, cost_milli): the cheapest cut of a string (lang, typed) into two known words.

    A space was missed, or hit as a letter above it, which is then left out.  A part of one letter must be a word of the language; known words and
    strings under four letters stay whole.  Ties: the shorter left part, then the missed space.
    """
    unknown = typed.select("lang", "typed").distinct().where(F.length("typed") >= 4).join(lexicon.select("lang", F.col("word").alias("typed")), ["lang", "typed"], "left_anti")
    one = reduce(lambda acc, kv: F.when(F.col("lang") == kv[0], F.lit(kv[1])).otherwise(acc), ONE_LETTER_WORDS.items(), F.lit(""))
    at = unknown.select("lang", "typed", F.explode(F.sequence(F.lit(1), F.length("typed") - 1)).alias("i"))
    above = F.expr("substring(typed, i + 1, 1)").isin(*ABOVE_SPACE) & (F.col("i") + 1 < F.length("typed"))
    cuts = at.select("lang", "typed", "i", F.explode(F.when(above, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("over"))
    parts = cuts.select("lang", "typed", "i", "over", F.expr("substring(typed, 1, i)").alias("left"), F.expr("substring(typed, i + 1 + over)").alias("right"))
    fits = lambda c: (F.length(c) >= 2) | F.contains(one, F.col(c))
    word = lambda name, cost: lexicon.select("lang", F.col("word").alias(name), F.col("prior_milli").alias(cost))
    j = parts.where(fits("left") & fits("right")).join(word("left", "pl"), ["lang", "left"]).join(word("right", "pr"), ["lang", "right"])
    cost = F.bround(F.round(cfg.w_lm * (F.col("pl") + F.col("pr")) + 1000 * F.when(F.col("over") == 1, SPACE_AS_LETTER).otherwise(MISSING_SPACE), 6), 0).cast("int")
    best = j.withColumn("cost_milli", cost).groupBy("lang", "typed").agg(F.min(F.struct("cost_milli", "i", "over", "left", "right")).alias("b"))
    return best.select("lang", "typed", "b.left", "b.right", "b.cost_milli")


def hyphen_joins(pairs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(lang, prev, word, joined, prior_milli): neighbours that the lexicon has as one word with a hyphen."""
    made = pairs.select("lang", "prev", "word").distinct().withColumn("joined", F.concat_ws("-", "prev", "word"))
    return made.join(lexicon.select("lang", F.col("word").alias("joined"), "prior_milli"), ["lang", "joined"]).select("lang", "prev", "word", "joined", "prior_milli")


def merges(pairs: DataFrame, lexicon: DataFrame, slips: str = "cvbnmсмить") -> DataFrame:
    """(lang, prev, word, joined): neighbours that are one word, together or with a letter above the space between."""
    between = F.explode(F.array(F.lit(""), *[F.lit(c) for c in slips]))
    made = pairs.select("lang", "prev", "word").distinct().select("lang", "prev", "word", between.alias("mid")).withColumn("joined", F.concat("prev", "mid", "word"))
    return made.join(lexicon.select("lang", F.col("word").alias("joined"), "prior_milli"), ["lang", "joined"]).select("lang", "prev", "word", "joined", "prior_milli")


def word_costs(words: DataFrame, lexicon: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(lang, word, cost_milli): null for unknown words."""
    return words.distinct().join(lexicon.select("lang", "word", "prior_milli"), ["lang", "word"], "left").select("lang", "word", F.bround(F.round(cfg.w_lm * F.col("prior_milli"), 6), 0).cast("int").alias("cost_milli"))


def nearest_by_levenshtein(typed: DataFrame, lexicon: DataFrame, most: int = 2, k: int = 3) -> DataFrame:
    """(qid, typed, word, dist, rk): the control query with plain edit distance, by the same keys."""
    spread = lambda df, c: df.withColumn("key", F.explode(cut_keys(F.col(c))))
    j = spread(typed.select("qid", "lang", "typed"), "typed").join(spread(lexicon.select("lang", "word"), "word"), ["lang", "key"]).select("qid", "typed", "word").distinct()
    d = j.withColumn("dist", F.levenshtein("typed", "word")).where(F.col("dist") <= most)
    return d.withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "word"))).where(F.col("rk") <= k)


def without_blocked(cands: DataFrame, offensive: DataFrame) -> DataFrame:
    """Candidates (lang, typed, word, ...) without offensive words (lang, word), unless one is exactly what was typed."""
    bad = offensive.select("lang", "word", F.lit(True).alias("__bad")).distinct()
    return cands.join(bad, ["lang", "word"], "left").where(F.col("__bad").isNull() | (F.col("word") == F.col("typed"))).select(*cands.columns)
