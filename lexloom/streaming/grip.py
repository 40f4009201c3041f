"""How a phone is held, guessed from a stream of tilts and taps: smoothing, fading scores, and a guess that is slow to change."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Weight of the new tilt, what is kept of a score, how sure a first and a new guess must be.
NEW_TILT, KEPT, FIRST_SURE, NEW_SURE, EVERY = 0.2, 0.85, 0.6, 0.75, 8

OUT = "session string, ts_ms long, grip string, chance double"


def fresh() -> dict:
    return {"tilt": None, "seen": 0, "scores": {}, "last": None, "shown": None}


def _unit(v: list[float]) -> list[float] | None:
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n > 1e-6 else None


def chances(scores: dict[str, float]) -> dict[str, float]:
    top = max(scores.values(), default=0.0)
    e = {k: math.exp(v - top) for k, v in scores.items()}
    total = sum(e.values())
    return {k: v / total for k, v in e.items()}


def step(state: dict, ts: int, tilt: list[float] | None, tap: float | None, overlap: bool, grips: dict[str, dict]) -> tuple[str, float] | None:
    """The new guess where it changes.  ``grips``: name -> tilt (unit vector), spread, and where its taps lie (u, u_spread)."""
    weight = touch = None
    if tilt is not None and (unit := _unit(tilt)):
        old = state["tilt"]
        state["tilt"] = unit if old is None else _unit([(1 - NEW_TILT) * a + NEW_TILT * b for a, b in zip(old, unit)])
        state["seen"] += 1
        if state["seen"] % EVERY == 0:
            weight = 0.25
    if tap is not None:
        weight, touch = 0.5, tap
        if overlap and "both" in grips:
            state["scores"]["both"] = state["scores"].get("both", 0.0) + 2.0  # one thumb can't overlap itself
        state["last"] = [tap, ts]
    if weight is None or state["tilt"] is None or not grips:
        return None
    for name, g in grips.items():
        fit = -sum((a - b) ** 2 for a, b in zip(state["tilt"], g["tilt"])) / (2 * g["spread"] ** 2)
        if touch is not None:
            fit -= (touch - g["u"]) ** 2 / (2 * g["u_spread"] ** 2)
        state["scores"][name] = KEPT * state["scores"].get(name, 0.0) + weight * max(fit, -12.0)
    p = chances(state["scores"])
    best = max(sorted(p), key=p.get)
    if best != state["shown"] and p[best] >= (FIRST_SURE if state["shown"] is None else NEW_SURE):
        state["shown"] = best
        return best, round(p[best], 6)
    return None


def stream(samples: DataFrame, grips: dict[str, dict], idle_ms: int | None = None) -> DataFrame:
    """(session, ts_ms, grip, chance) whenever the guess changes; samples (session, ts_ms, tilt array<double>, tap double, overlap boolean), streaming.

    With ``idle_ms`` the state of a session that is idle for so long, by processing time, is dropped.  That is for streams that run on:
    a trigger that ends when all input is read never ends with it, as time goes on.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        state = json.loads(kept.get[0]) if kept.exists else fresh()
        out = _replay(state, key[0], pd.concat(list(frames)).sort_values("ts_ms", kind="stable"), grips)
        kept.update((json.dumps(state),))
        if idle_ms:
            kept.setTimeoutDuration(idle_ms)
        yield out

    return samples.groupBy("session").applyInPandasWithState(run, OUT, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def batch(samples: DataFrame, grips: dict[str, dict]) -> DataFrame:
    """The same of a table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state = None, fresh()
        for pdf in frames:
            for s, own in pdf.groupby("session", sort=False):
                if s != session:
                    session, state = s, fresh()
                yield _replay(state, s, own, grips)

    return samples.select("session", "ts_ms", "tilt", "tap", "overlap").repartition("session").sortWithinPartitions("session", "ts_ms").mapInPandas(run, OUT)


def _replay(state: dict, session: str, rows: pd.DataFrame, grips: dict[str, dict]) -> pd.DataFrame:
    out = []
    for ts, tilt, tap, overlap in zip(rows["ts_ms"], rows["tilt"], rows["tap"], rows["overlap"]):
        got = step(state, int(ts), None if tilt is None else list(tilt), None if tap is None or tap != tap else float(tap), bool(overlap), grips)
        if got:
            out.append((session, int(ts), *got))
    return pd.DataFrame(out, columns=["session", "ts_ms", "grip", "chance"])


def smoothed(samples: DataFrame, value: str, alpha: float = 0.2) -> DataFrame:
    """(session, ts_ms, value): exponential smoothing over each session in order of time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, level = None, 0.0
        for pdf in frames:
            out = []
            for s, x in zip(pdf["session"], pdf["value"]):
                session, level = s, x if s != session else (1 - alpha) * level + alpha * x
                out.append(level)
            yield pd.DataFrame({"session": pdf["session"], "ts_ms": pdf["ts_ms"], "value": out})

    clean = samples.select("session", "ts_ms", samples[value].cast("double").alias("value")).where("session IS NOT NULL AND value IS NOT NULL")
    return clean.repartition("session").sortWithinPartitions("session", "ts_ms").mapInPandas(run, "session string, ts_ms long, value double")
