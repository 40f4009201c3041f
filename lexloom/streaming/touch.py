"""Touches of a session to editor operations.

One pure function reads an event and a small state and gives operations; a stream runs it in
``applyInPandasWithState`` keyed by session, a batch runs it over partitions sorted by session and time without
holding a session in memory.  Both give (session, seq, op, text).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Milliseconds of the timers.
LONG_PRESS, REPEAT_FIRST, REPEAT_LEAST, ROLL_OVER, BRUSHED_ENTER, ENTER_AFTER_ERASE, CLIP_LIVES = 350, 400, 60, 90, 100, 600, 90_000
#: Written words and clips that are remembered.
WORDS, CLIPS, TEXT = 64, 12, 400

EVENTS = "session string, ts_ms long, action string, key string"
OPS = "session string, seq long, op string, text string"


def fresh() -> dict:
    return {"seq": 0, "word": "", "words": [], "undo": None, "rejected": [], "down": None, "last_down": -(10**9), "erased": -(10**9), "clips": [], "gaps": []}


def step(state: dict, ts: int, action: str, key: str, fixes: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """Operations of one event; ``state`` is changed in place and stays bounded.

    Actions: down and up of a key (a letter, " ", "\\b", "\\n"), field (another field), move (the cursor), copy, paste.
    ``fixes`` says what a space makes of a typed word; erasing right after gives the word back, and that fix does not come again.
    Copied texts are forgotten when their time is over.
    """
    ops: list[tuple[str, str]] = []
    if state["clips"]:
        state["clips"] = [c for c in state["clips"] if ts - c[0] <= CLIP_LIVES]
    if action == "field":
        kept = state["clips"], state["seq"]
        state.clear()
        state.update(fresh(), clips=kept[0], seq=kept[1])
        ops.append(("clear", ""))
    elif action == "move":
        if state["word"]:
            ops.append(("finish", state["word"]))
        state["word"], state["undo"] = "", None
    elif action == "copy":
        state["clips"] = [*state["clips"], [ts, key]][-CLIPS:]
    elif action == "paste":
        if state["clips"]:
            ops.append(("commit", state["clips"][-1][1][-TEXT:]))
    elif action == "down":
        if state["down"] and ts - state["last_down"] <= ROLL_OVER:
            ops += _press(state, state["down"][0], state["down"][1], ts, False, fixes)  # rolled over: the first key counts now
            state["down"] = None
        state["down"], state["last_down"] = [key, ts], ts
    elif action == "up" and state["down"] and state["down"][0] == key:
        pressed = state["down"][1]
        state["down"] = None
        ops += _press(state, key, pressed, ts, ts - pressed >= LONG_PRESS, fixes)
    return ops


def _press(state: dict, key: str, pressed: int, now: int, held: bool, fixes: dict[str, str] | None) -> list[tuple[str, str]]:
    if key == "\b":
        times = 1 if now - pressed < REPEAT_FIRST else 1 + (now - pressed - REPEAT_FIRST) // REPEAT_LEAST
        state["erased"] = now
        if state["undo"]:
            typed, chosen = state["undo"]
            state["undo"], state["rejected"] = None, [*state["rejected"], [typed, chosen]][-WORDS:]
            state["words"] = [*state["words"][:-1], typed]
            return [("replace", typed + " ")]
        state["word"] = state["word"][:-times]
        return [("delete", str(times)), ("composing", state["word"])] if state["word"] else [("delete", str(times))]
    if key == "\n":
        if now - pressed > 10 * BRUSHED_ENTER or now - state["erased"] < ENTER_AFTER_ERASE:
            return []  # leaning on it, or brushed while erasing
        word, state["word"] = state["word"], ""
        return ([("finish", word)] if word else []) + [("enter", "")]
    if key == " ":
        word, state["word"] = state["word"], ""
        if not word:
            return [("commit", " ")]
        chosen = (fixes or {}).get(word, word)
        if chosen != word and [word, chosen] not in state["rejected"]:
            state["undo"], word = [word, chosen], chosen
        state["words"] = [*state["words"], word][-WORDS:]
        return [("commit", word + " ")]
    state["word"] = (state["word"] + (key.upper() if held else key))[-TEXT:]
    state["undo"] = None
    return [("composing", state["word"])]


def _run(state: dict, session: str, rows: Iterator[tuple[int, str, str]], fixes: dict[str, str] | None) -> Iterator[tuple[str, int, str, str]]:
    for ts, action, key in rows:
        for op, text in step(state, ts, action, key, fixes):
            state["seq"] += 1
            yield session, state["seq"], op, text


def batch(events: DataFrame, fixes: dict[str, str] | None = None) -> DataFrame:
    """The operations of events (session, ts_ms, action, key); ties in time go by action and key."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state = None, fresh()
        for pdf in frames:
            out = []
            for s, ts, action, key in zip(pdf["session"], pdf["ts_ms"], pdf["action"], pdf["key"]):
                if s != session:
                    session, state = s, fresh()
                out += _run(state, s, iter([(ts, action, key)]), fixes)
            yield pd.DataFrame(out, columns=["session", "seq", "op", "text"])

    clean = events.where("session IS NOT NULL AND ts_ms IS NOT NULL AND action IS NOT NULL AND key IS NOT NULL").select("session", F.col("ts_ms").cast("long").alias("ts_ms"), "action", "key")
    return clean.repartition("session").sortWithinPartitions("session", "ts_ms", "action", "key").mapInPandas(run, OPS)


def stream(events: DataFrame, fixes: dict[str, str] | None = None, idle_ms: int | None = None) -> DataFrame:
    """The same of a stream; each trigger's events of a session are taken in order of time, the state is kept as JSON.

    With ``idle_ms`` the state of a session that is idle for so long, by processing time, is dropped.  That is for streams that run on:
    a trigger that ends when all input is read never ends with it, as time goes on.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        state = json.loads(kept.get[0]) if kept.exists else fresh()
        pdf = pd.concat(list(frames)).sort_values(["ts_ms", "action", "key"], kind="stable")  # one trigger's events of one session
        out = list(_run(state, key[0], zip(pdf["ts_ms"].tolist(), pdf["action"], pdf["key"]), fixes))
        kept.update((json.dumps(state),))
        if idle_ms:
            kept.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["session", "seq", "op", "text"])

    clean = events.where("session IS NOT NULL AND ts_ms IS NOT NULL AND action IS NOT NULL AND key IS NOT NULL").select("session", F.col("ts_ms").cast("long").alias("ts_ms"), "action", "key")
    return clean.groupBy("session").applyInPandasWithState(run, OPS, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def pressed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, action, n) of a stream or a batch of events (ts, action): event time with a watermark."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    return w.groupBy(F.window("ts", every), "action").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "action", "n")
