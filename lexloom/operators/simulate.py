"""Seeded simulators: taps, drawn words, and typed sessions as touch events."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MASK = (1 << 64) - 1


class Xorshift:
    """xorshift64*: the same numbers on every machine."""

    def __init__(self, seed: int):
        self.x = (seed * 0x9E3779B97F4A7C15 + 1) & MASK or 1

    def next(self) -> int:
        x = self.x
        x ^= x >> 12
        x ^= (x << 25) & MASK
        x ^= x >> 27
        self.x = x
        return (x * 0x2545F4914F6CDD1D) & MASK

    def uniform(self) -> float:
        return (self.next() >> 11) / (1 << 53)

    def normal(self) -> float:
        return math.sqrt(-2 * math.log(max(self.uniform(), 1e-300))) * math.cos(2 * math.pi * self.uniform())


def seed_of(word: str, seed: int) -> int:
    h = seed & MASK
    for b in word.encode():
        h = ((h ^ b) * 0x100000001B3) & MASK
    return h


def taps(word: str, keys: dict[str, tuple[float, float]], sigma: float = 0.3, seed: int = 0) -> str:
    """What a noisy hand types: each tap lands around its key, and the nearest key counts."""
    r = Xorshift(seed_of(word, seed))
    names, at = list(keys), np.array(list(keys.values()))
    out = ""
    for c in word:
        if c in keys:
            p = np.array(keys[c]) + sigma * np.array([r.normal(), r.normal()])
            c = names[int(((at - p) ** 2).sum(1).argmin())]
        out += c
    return out


def stroke(a: np.ndarray, b: np.ndarray, points: int) -> np.ndarray:
    """Minimum-jerk movement between two places."""
    t = np.linspace(0, 1, points)[:, None]
    return a + (b - a) * (10 * t**3 - 15 * t**4 + 6 * t**5)


def duration(distance: float, width: float = 1.0, a: float = 60.0, b: float = 90.0) -> float:
    """Milliseconds of a movement by its distance."""
    return a + b * math.log2(distance / width + 1)


def swipe(word: str, keys: dict[str, tuple[float, float]], sigma: float = 0.2, seed: int = 0) -> list[tuple[float, float, float]]:
    """(x, y, t) of a drawn word with corners around its keys."""
    r = Xorshift(seed_of(word, seed))
    corners = [np.array(keys[c]) + sigma * np.array([r.normal(), r.normal()]) for c in word if c in keys]
    out: list[tuple[float, float, float]] = []
    t = 0.0
    for a, b in zip(corners, corners[1:]):
        d = float(np.hypot(*(b - a)))
        n, ms = max(3, int(d * 4)), duration(d)
        for k, p in enumerate(stroke(a, b, n)):
            out.append((float(p[0]), float(p[1]), t + ms * k / (n - 1)))
        t += ms
    return out


def align(typed: str, meant: str, gap: float = 1.0, swap: float = 0.8, cost=lambda a, b: 0.0 if a == b else 1.0) -> list[tuple[int, int]]:
    """Pairs of places (typed, meant) of the cheapest alignment with gaps and swaps."""
    n, m = len(typed), len(meant)
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 0] = 0
    back = {}
    for i in range(n + 1):
        for j in range(m + 1):
            options = []
            if i and j:
                options.append((d[i - 1, j - 1] + cost(typed[i - 1], meant[j - 1]), (1, 1)))
            if i:
                options.append((d[i - 1, j] + gap, (1, 0)))
            if j:
                options.append((d[i, j - 1] + gap, (0, 1)))
            if i > 1 and j > 1 and typed[i - 1] == meant[j - 2] and typed[i - 2] == meant[j - 1]:
                options.append((d[i - 2, j - 2] + swap, (2, 2)))
            if options:
                d[i, j], back[i, j] = min(options)
    out, i, j = [], n, m
    while i or j:
        a, b = back[i, j]
        if a and b:
            out += [(i - 1, j - 1)] if a == 1 else [(i - 1, j - 2), (i - 2, j - 1)]
        i, j = i - a, j - b
    return sorted(out)


def augment(sentence: str, kind: str, seed: int = 0) -> str:
    """Chat-like sentences for training: lower case, no end mark, or no commas; or the first clause alone."""
    if kind == "chat":
        out = sentence.rstrip(".!?…").lower()
        return out.replace(",", "") if Xorshift(seed_of(sentence, seed)).uniform() < 0.5 else out
    if kind == "clause":
        return sentence.split(",")[0]
    raise ValueError(kind)


def held_for_validation(sentence: str, one_in: int = 20) -> bool:
    return seed_of(sentence, 1) % one_in == 0


def typed_sessions(texts: DataFrame, seed: int = 0) -> DataFrame:
    """(session, ts_ms, action, key): each text (session, text) as presses and releases of its keys."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for session, text in zip(pdf["session"], pdf["text"]):
                r, t = Xorshift(seed_of(session or "", seed)), 0
                for c in text or "":
                    t += 120 + int(80 * r.uniform())
                    out += [(session, t, "down", c), (session, t + 50, "up", c)]
            yield pd.DataFrame(out, columns=["session", "ts_ms", "action", "key"])

    return texts.select("session", "text").mapInPandas(run, "session string, ts_ms long, action string, key string")
