"""Paths drawn over keys, matched with words.

Blocks of gestures are compared with all words of their language.  A gesture knows, per letter, the first point of its
path from each place on at which the letter's key is near, so all words at once take one step per letter with array lookups;
the few whose letters lie along the path in order are priced by how the path runs to each key, and the
best of them by where the whole path runs and by its shape.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config

# Points of a resampled path, how near a key must lie (keys), the wider reach, and when it is tried.
POINTS, NEAR, NEAR_WIDE, RETRY_BEYOND = 40, 1.1, 1.5, 0.6
# Points at either end in which the first and the last letter may lie, and the same in keys.
END_POINTS, END_KEYS = 4, 1.0
# A stop is this much longer than the usual pace, a quick pass this part of it, the most either costs, and the reach of a letter's own stop.
PAUSE, QUICK, PACE_MAX, PAUSE_REACH = 2.0, 0.6, 1.5, 2
# Words kept for the full comparison, and how near the dictionary's floor (thousandths) a word was hardly ever seen.
KEEP, UNSEEN_SPAN = 60, 1700
#: How far a word that was never counted lies above one that was counted once, the rarest here: ln 3.
UNSEEN_FLOOR = 1099
#: Gestures of one block.
BLOCK = 300


def resample(path: np.ndarray, points: int = POINTS) -> np.ndarray:
    """Points evenly spaced along a path (n, 2)."""
    if len(path) == 0:
        return np.zeros((points, 2))
    length = np.r_[0.0, np.cumsum(np.hypot(*np.diff(path, axis=0).T))]
    if length[-1] <= 1e-9:
        return np.repeat(path[:1], points, 0)
    at = np.linspace(0, length[-1], points)
    return np.stack([np.interp(at, length, path[:, k]) for k in (0, 1)], 1)


def resample_all(corners: np.ndarray, points: int = POINTS) -> np.ndarray:
    """The same for many paths at once (w, n, 2); a short path repeats its last corner."""
    step = np.hypot(*np.moveaxis(np.diff(corners, axis=1), 2, 0))
    length = np.concatenate([np.zeros((len(corners), 1)), np.cumsum(step, 1)], 1)
    at = np.linspace(0, 1, points)[None] * length[:, -1:]
    k = np.clip((length[:, None, :] <= at[:, :, None]).sum(2) - 1, 0, max(0, corners.shape[1] - 2))
    if corners.shape[1] == 1:
        return np.repeat(corners, points, 1)
    row = np.arange(len(corners))[:, None]
    part = np.clip((at - length[row, k]) / np.maximum(step[row, k], 1e-12), 0, 1)[..., None]
    return corners[row, k] + part * (corners[row, k + 1] - corners[row, k])


def shape(points: np.ndarray) -> np.ndarray:
    """Centred, and in units of the larger half of its box; (..., n, 2)."""
    moved = points - points.mean(-2, keepdims=True)
    return moved / np.maximum(np.abs(moved).max((-1, -2), keepdims=True), 1e-3)


def mean_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.hypot(d[..., 0], d[..., 1]).mean(-1)


def smooth(path: np.ndarray, reach: int = 3) -> np.ndarray:
    """Moving average over ``reach`` points either way."""
    sums = np.vstack([np.zeros((1, 2)), np.cumsum(path, 0)])
    lo = np.maximum(0, np.arange(len(path)) - reach)
    hi = np.minimum(len(path), np.arange(len(path)) + reach + 1)
    return (sums[hi] - sums[lo]) / (hi - lo)[:, None]


def pace(path: np.ndarray, times: np.ndarray, points: int = POINTS) -> tuple[np.ndarray, np.ndarray] | None:
    """(costs of the stops before each point, cost of a letter at each point), or None where time says nothing.

    A point's pace is the time spent around it per length, over the median of the inner ones.  A stop is a peak well above
    it; a letter on a quick pass costs by how quick.
    """
    if len(path) < 2 or len(times) != len(path):
        return None
    step = np.hypot(*np.diff(path, axis=0).T)
    total = step.sum()
    if total <= 1e-7 or times[-1] <= times[0]:
        return None
    spent = np.r_[0.0, np.cumsum(np.maximum(np.diff(times), 0.0))]
    length = np.r_[0.0, np.cumsum(step)]
    each = total / (points - 1)
    # a finger that stands still spends its time at one length: the time before a length is that of the first point there
    moved = np.r_[True, np.diff(length) > 0]
    bounds = np.interp((np.arange(1, points) - 0.5) * each, length[moved], spent[moved])
    bounds = np.r_[0.0, bounds, spent[-1]]
    width = np.full(points, each)
    width[[0, -1]] = each / 2
    rate = np.diff(bounds) / width
    usual = np.sort(rate[1:-1])[(points - 2) // 2]
    if usual <= 0:
        return None
    slow = rate / usual
    peak = np.zeros(points, bool)
    peak[1:-1] = (slow[1:-1] >= slow[:-2]) & (slow[1:-1] >= slow[2:])
    with np.errstate(divide="ignore"):
        stops = np.where(peak, np.clip(np.log(slow / PAUSE), 0.0, PACE_MAX), 0.0)
        quick = np.clip(np.log(QUICK / np.maximum(slow, 1e-3)), 0.0, PACE_MAX)
    return np.r_[0.0, np.cumsum(stops)], quick


def point_to_segment(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of points (..., 2) to segments."""
    d = b - a
    t = np.clip(((p - a) * d).sum(-1) / np.maximum((d * d).sum(-1), 1e-12), 0, 1)[..., None]
    q = p - a - t * d
    return np.hypot(q[..., 0], q[..., 1])


class Words:
    """The words of a language as arrays of keys: letters without a key are not drawn, a doubled letter is one."""

    def __init__(self, words: list[str], priors: np.ndarray, keys: dict[str, tuple[float, float]], key_width: float = 1.0):
        places = list(dict.fromkeys(keys.values()))
        number = {c: places.index(xy) for c, xy in keys.items()}
        self.centres = np.array(places, float) / key_width
        rows, kept = [], []
        for i, w in enumerate(words):
            drawn = w.replace("-", "").replace("'", "")
            if len(w) > 1 and drawn and all(c in number for c in drawn):
                ks = [number[c] for c in drawn]
                rows.append([k for j, k in enumerate(ks) if j == 0 or k != ks[j - 1]])
                kept.append(i)
        self.of, self.priors = np.array(kept, int), priors[kept] if kept else np.zeros(0)
        self.lengths = np.array([len(r) for r in rows], int)
        self.keys = np.zeros((len(rows), max(self.lengths, default=1)), int)
        for i, r in enumerate(rows):
            self.keys[i, : len(r)] = r
        self.first = self.keys[:, 0] if len(rows) else np.zeros(0, int)

    def walk(self, points: np.ndarray, paced, near: float, cfg: Config) -> tuple[np.ndarray, np.ndarray]:
        """(words, pace): the ``KEEP`` cheapest words along a path, each letter near its key in order.

        A letter sits at the point nearest its key from the first near one on.  It costs that distance squared, and the
        square of how far the path strays from the straight line on its way there; the end, how far the path then leaves its key.
        """
        d = np.hypot(*np.moveaxis(points[None] - self.centres[:, None], 2, 0))
        ahead = np.where(d <= near, np.arange(POINTS), POINTS)
        ahead = np.minimum.accumulate(ahead[:, ::-1], 1)[:, ::-1]
        settled = np.tile(np.arange(POINTS), (len(d), 1))
        for j in range(POINTS - 2, -1, -1):
            on = d[:, j + 1] < d[:, j]
            settled[on, j] = settled[on, j + 1]
        step = np.hypot(*np.diff(points, axis=0).T).sum() / (POINTS - 1)
        slack = int(np.clip(np.ceil(END_KEYS / max(step, 1e-3)), END_POINTS, POINTS // 3))

        w = np.flatnonzero(ahead[self.first, 0] <= slack)
        where = np.full((len(w), self.keys.shape[1]), POINTS, int)
        where[:, 0] = settled[self.first[w], ahead[self.first[w], 0]]
        last = where[:, 0].copy()
        for t in range(1, self.keys.shape[1]):
            more = np.flatnonzero((self.lengths[w] > t) & (last < POINTS))
            if not len(more):
                break
            c = self.keys[w[more], t]
            at = ahead[c, last[more]]
            at = np.where(at < POINTS, settled[c, np.minimum(at, POINTS - 1)], POINTS)
            where[more, t] = last[more] = at
        fits = (last < POINTS) & (last + slack >= POINTS - 1)
        w, where, last = w[fits], where[fits], last[fits]
        if not len(w):
            return w, np.zeros(0)

        place = np.arange(POINTS)[None]
        geo, time = np.zeros(len(w)), np.zeros(len(w))
        before = np.zeros(len(w), int)
        for t in range(int(self.lengths[w].max())):
            own = np.flatnonzero(self.lengths[w] > t)
            c, at, j = self.keys[w[own], t], where[own, t], before[own]
            if t == 0:
                away = d[c]
            else:
                away = point_to_segment(points[None], self.centres[self.keys[w[own], t - 1]][:, None], self.centres[c][:, None])
                if paced is not None:
                    stops, quick = paced
                    lo, hi = j + PAUSE_REACH + 1, np.maximum(at - PAUSE_REACH, 0)
                    time[own] += np.where(lo < hi, stops[hi] - stops[np.minimum(lo, POINTS)], 0.0) + quick[at]
            stray = np.where((place >= j[:, None]) & (place < at[:, None]), away, 0.0).max(1)
            geo[own] += d[c, at] ** 2 + stray**2
            before[own] = at
        end = self.keys[w, self.lengths[w] - 1]
        geo += np.where(place >= last[:, None], d[end], 0.0).max(1) ** 2
        cost = cfg.gesture_walk * geo + cfg.gesture_pace * time + cfg.w_lm * self.priors[w] / 1000
        best = np.lexsort((w, cost))[:KEEP]
        return w[best], time[best]

    def decode(self, path: np.ndarray, times: np.ndarray | None, floor: float, cfg: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, edit, cost) of one path in key widths.

        Where no word that was ever counted fits closely, keys farther from the path are tried too.  How closely the best word
        fits says how far geometry is trusted.
        """
        points = resample(path)
        paced = pace(path, times) if times is not None and cfg.gesture_pace > 0 else None
        form = shape(points)

        def measured(near: float) -> tuple[np.ndarray, ...]:
            w, time = self.walk(points, paced, near, cfg)
            keys = np.where(np.arange(self.keys.shape[1])[None] < self.lengths[w][:, None], self.keys[w], self.keys[w, self.lengths[w] - 1][:, None]) if len(w) else np.zeros((0, 1), int)
            ideal = resample_all(self.centres[keys])
            return w, time, mean_distance(points[None], ideal), mean_distance(form[None], shape(ideal))

        w, time, loc, form_off = measured(NEAR)
        unseen = self.priors[w] + UNSEEN_SPAN >= floor
        if loc[~unseen].min(initial=np.inf) > RETRY_BEYOND:
            more = measured(NEAR_WIDE)
            new = ~np.isin(more[0], w)
            w, time, loc, form_off = (np.r_[a, b[new]] for a, b in zip((w, time, loc, form_off), more))
            unseen = self.priors[w] + UNSEEN_SPAN >= floor
        trust = (cfg.gesture_trust / max(loc.min(initial=np.inf), cfg.gesture_trust)) ** 2 if cfg.gesture_trust > 0 and len(w) else 1.0
        edit = trust * (cfg.gesture_location * loc**2 + cfg.gesture_shape * form_off**2) + cfg.gesture_pace * time + cfg.gesture_rare * unseen
        return self.of[w], edit, edit + cfg.w_lm * self.priors[w] / 1000


def match(gestures: DataFrame, lexicon: DataFrame, keys: dict[str, tuple[float, float]] | None = None, key_width: float = 1.0, cfg: Config = Config()) -> DataFrame:
    """(gid, lang, word, edit, cost, rk): the ``top_k`` cheapest words of gestures (gid, lang, path array<struct<x,y[,t]>>), ties in order of the words.

    ``lexicon`` (lang, word, prior_milli).  Without ``keys`` each language has its own.  Hyphens and apostrophes aren't drawn, a doubled letter is one key.  Paths of
    fewer than two points and null ones match nothing; times (ms) may be left out.  A task holds the words of a language.
    """
    asked = gestures.select("gid", "lang", "path").where(F.size("path") >= 2)
    timed = "t" in gestures.schema["path"].dataType.elementType.names
    blocks = max(1, -(-gestures.count() // BLOCK))
    words = lexicon.select("lang", "word", F.col("prior_milli").cast("int").alias("prior_milli")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    kind = gestures.schema["gid"].dataType.simpleString()
    names = ["gid", "lang", "word", "edit", "cost", "rk"]

    def compare(drawn: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(drawn) and len(words):
            lang = drawn["lang"].iloc[0]
            words = words.sort_values("word", ignore_index=True)
            held = Words(words["word"].tolist(), words["prior_milli"].to_numpy(float), keys or phone_keys(lang), key_width)
            floor = words["prior_milli"].max() + UNSEEN_FLOOR
            for gid, path in zip(drawn["gid"], drawn["path"]):
                xy = np.array([[p["x"], p["y"]] for p in path], float) / key_width
                times = np.array([p["t"] for p in path], float) if timed and all(p["t"] is not None for p in path) else None
                w, edit, cost = held.decode(xy, times, floor, cfg)
                cost = np.round(cost, 6)
                best = np.lexsort((w, cost))[: cfg.top_k]
                out.append(pd.DataFrame({"gid": gid, "lang": lang, "word": words["word"].to_numpy()[w[best]], "edit": np.round(edit[best], 6), "cost": cost[best], "rk": np.arange(1, len(best) + 1)}))
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names)

    apart = lambda df: df.repartition(4 * blocks, "lang", "block").groupBy("lang", "block")  # noqa: E731 - by work, where AQE goes by bytes
    blocked = asked.withColumn("block", F.pmod(F.xxhash64("gid"), F.lit(blocks)))
    return apart(blocked).cogroup(apart(words)).applyInPandas(compare, f"gid {kind}, lang string, word string, edit double, cost double, rk int")


def path_of(word: Column, keys: dict[str, tuple[float, float]]) -> Column:
    """The path straight through a word's keys, as points."""
    at = F.create_map(*[x for c, (a, b) in keys.items() for x in (F.lit(c), F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")))])
    return F.filter(F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: at[c]), lambda p: p.isNotNull())


def phone_keys(lang: str) -> dict[str, tuple[float, float]]:
    """Key centres in key widths; accented letters lie on their plain ones."""
    from ..functions.text import ACCENTED, UNACCENTED
    from .context import KEYS

    rows, shift = KEYS["cyr" if lang == "ru" else "lat"]
    out = {c: (shift[r] + i + 0.5, (r + 0.5) * 1.35) for r, row in enumerate(rows) for i, c in enumerate(row)}
    if lang == "ru":
        return out | {"ё": out["е"], "ъ": out["ь"]}
    return out | {a: out[b] for a, b in zip(ACCENTED, UNACCENTED)}
