"""Queries over gestures, parses and event streams."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..data import ASKING, QUESTION
from ..operators import gesture, graph, lexicon, marks
from ..streaming import touch
from ..tables import ready, shared_folder, table
from . import base as B

KEYS = "etaoinshr"


def touches(ev: DataFrame) -> DataFrame:
    """Touch events made of the events table: a session is a user's day, the type is the action, the id names the key."""
    key = F.element_at(F.array(*[F.lit(c) for c in [*KEYS, " ", "\b", "\n"]]), (F.pmod(F.col("event_id"), F.lit(len(KEYS) + 3)) + 1).cast("int"))
    ts = F.col("ts").cast("timestamp")
    base = ev.select(F.concat_ws(":", "user_id", F.to_date(ts)).alias("session"), F.unix_millis(ts).alias("ms"), "event_type", "event_id", key.alias("key"))
    press = base.select("session", "key", F.explode(F.array(F.struct(F.col("ms").alias("ts_ms"), F.lit("down").alias("action")), F.struct((F.col("ms") + 40 + F.pmod(F.col("event_id"), F.lit(500))).alias("ts_ms"), F.lit("up").alias("action")))).alias("z"))
    return press.select("session", "z.ts_ms", "z.action", "key").union(base.where("event_type = 'error'").select("session", "ms", F.lit("field"), F.lit("")))


def t01_sessions(s, d):
    return touch.batch(touches(table(s, d, "events")))


def t01_stream(s, d):
    """The same rows through a stream that reads the table file by file and writes into the folder for checkpoints."""
    ev = s.readStream.schema(table(s, d, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    folder = f"{shared_folder(s)}/touch-{uuid.uuid4().hex}"
    run = touch.stream(touches(ev)).writeStream.outputMode("append").format("parquet").trigger(availableNow=True).option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log").start()
    run.awaitTermination()
    return s.read.schema(touch.OPS).parquet(f"{folder}/rows")


def t12_hourly(s, d):
    ev = table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("action"))
    return touch.pressed_counts(ev)


LANGS = ("de", "en", "es", "fr", "pt", "ru")


def _drawn(s, d) -> DataFrame:
    """The word of every lexicon row whose id is divisible by 20, drawn on the keys of its language."""
    rows = table(s, d, "lexicon").where("word_id % 20 = 0").select("lang", F.lower("w").alias("word"))
    asked = B.words(s, d).join(rows, ["lang", "word"], "left_semi").select("lang", "word")
    path = reduce(lambda acc, lang: F.when(F.col("lang") == lang, gesture.path_of(F.col("word"), gesture.phone_keys(lang))).otherwise(acc), LANGS, gesture.path_of(F.col("word"), gesture.phone_keys("en")))
    return asked.select(F.xxhash64("lang", "word").alias("gid"), "lang", "word", path.alias("path"))


def l11_gesture(s, d):
    """Drawn words matched with all words of their language, in all six."""
    return gesture.match(_drawn(s, d).select("gid", "lang", "path"), lexicon.priors(B.words(s, d)))


def _edges(s, d) -> DataFrame:
    return graph.shallow(B.sentences(s, d))


def l23_marks(s, d):
    return marks.of_sentences(graph.shallow_sentences(B.sentences(s, d)))


def l24_end_marks(s, d):
    return marks.end_marks(_edges(s, d))


def g03_parts(s, d):
    return graph.parts(_edges(s, d))


def a28_link_kinds(s, d):
    e = _edges(s, d)
    tags = e.groupBy("word").agg(F.array_sort(F.collect_set("upos")).alias("tags"))  # a word has one tag here
    return graph.link_kinds(e, tags)


def g08_text_links(s, d):
    return graph.text_links(_edges(s, d)).groupBy("event", "role", "word").agg(F.count("*").alias("n"))


def u03_u06_bounds(s, d):
    """Part bounds against the commas of the texts."""
    e = _edges(ready(s), d).checkpoint()
    p = graph.parts(e)
    nxt = p.select("id", (F.col("pos") - 1).alias("pos"), F.col("part").alias("then"))
    found = p.join(nxt, ["id", "pos"]).where("part <> then").select("id", (F.col("pos") + 1).alias("at"))
    return graph.bound_scores(found, e.where("comma").select("id", F.col("pos").alias("at")))


NAMES = (t01_sessions, t01_stream, t12_hourly, l11_gesture, l23_marks, l24_end_marks, g03_parts, a28_link_kinds, g08_text_links, u03_u06_bounds)


def edges_sql() -> str:
    """The shallow parse: ``e`` (id, pos, word, head, rel, upos, comma)."""
    listed = lambda ws: "(" + ", ".join(B.q(w) for w in sorted(set(ws))) + ")"
    return f"""{B.S}, sw AS (SELECT DISTINCT sent_id AS id, text, list_filter(t, lambda x: NOT regexp_matches(x, '^\\s+$')) AS t FROM s),
      wi AS (SELECT id, i, t[i] AS word, coalesce(i > 1 AND t[i - 1] = ',', false) AS comma FROM (SELECT id, t, CAST(unnest(range(1, len(t) + 1)) AS INTEGER) AS i FROM sw) WHERE {B.is_word('t[i]')}),
      wt AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) AS INTEGER) AS pos, word, comma, CASE WHEN word IN {listed(graph.COORDINATING)} THEN 'CCONJ' WHEN word IN {listed(graph.JOINERS)} THEN 'SCONJ' WHEN word IN {listed(graph.ADPOSITIONS)} THEN 'ADP' WHEN word IN {listed(graph.SUBJECTS)} THEN 'PRON'
        WHEN regexp_matches(word, '{graph.VERB_ENDS}') THEN 'VERB' WHEN regexp_matches(word, '{graph.ADJECTIVE_ENDS}') THEN 'ADJ' ELSE 'NOUN' END AS upos FROM wi),
      wr AS (SELECT *, lag(upos) OVER (PARTITION BY id ORDER BY pos) AS prev, count(*) OVER (PARTITION BY id) AS n, coalesce(min(pos) FILTER (upos = 'VERB') OVER (PARTITION BY id), 1) AS root FROM wt),
      e AS (SELECT id, pos, word, comma, upos, CAST(CASE WHEN pos = root THEN 0 WHEN upos IN ('ADP', 'ADJ', 'CCONJ', 'SCONJ') AND pos < n THEN pos + 1 ELSE root END AS INTEGER) AS head,
        CASE WHEN pos = root THEN 'root' WHEN upos = 'ADP' THEN 'case' WHEN upos = 'ADJ' THEN 'amod' WHEN upos = 'CCONJ' THEN 'cc' WHEN upos = 'SCONJ' THEN 'mark' WHEN upos = 'VERB' THEN CASE WHEN prev = 'CCONJ' THEN 'conj' WHEN prev = 'SCONJ' THEN 'advcl' ELSE 'parataxis' END
          WHEN pos < root THEN 'nsubj' WHEN prev = 'ADP' THEN 'obl' ELSE 'obj' END AS rel FROM wr)"""


def sql() -> dict[str, str]:
    e = edges_sql()
    words = lambda ws: "(" + ", ".join(B.q(w) for w in ws) + ")"
    starts = f"rel IN {words(graph.PART_STARTS)} OR head = 0"
    climbed = f"""WITH RECURSIVE {e}, up AS (SELECT id, pos, pos AS at FROM e UNION ALL SELECT up.id, up.pos, e.head FROM up JOIN e ON e.id = up.id AND e.pos = up.at WHERE NOT ({starts})),
      pt AS (SELECT up.id, up.pos, up.at AS part FROM up JOIN e ON e.id = up.id AND e.pos = up.at WHERE {starts})"""
    asking = f"c.word IN {words(ASKING)} AND c.rel NOT IN ('mark', 'cc', 'fixed')"
    return {
        "t12_hourly": "SELECT date_trunc('hour', ts) AS start, event_type AS action, count(*) AS n FROM events GROUP BY ALL",
        "l24_end_marks": f"""WITH {e}, r AS (SELECT id, pos AS root FROM e WHERE head = 0) SELECT c.id, CASE WHEN bool_or(coalesce(((c.pos = root OR c.head = root) AND c.word IN {words(QUESTION)}) OR (c.head = root AND {asking}) OR (u.head = root AND u.rel IN ('obl', 'obj', 'nsubj', 'advmod', 'nmod', 'iobj') AND {asking})
          OR (c.pos = root AND c.pos = 1 AND {asking}), false)) THEN '?' ELSE '.' END AS mark FROM e c JOIN r USING (id) LEFT JOIN e u ON u.id = c.id AND u.pos = c.head GROUP BY c.id""",
        "g03_parts": f"{climbed} SELECT id, pos, part FROM pt",
        "a28_link_kinds": f"WITH {e} SELECT d.upos AS ltag, h.upos AS htag, d.rel, CASE WHEN d.pos < d.head THEN 'before' ELSE 'after' END AS side, CAST(least(abs(d.pos - d.head), 4) AS INTEGER) AS far, CAST(count(*) AS DOUBLE) AS share FROM e d JOIN e h ON h.id = d.id AND h.pos = d.head GROUP BY ALL",
        "g08_text_links": f"WITH {e} SELECT h.word AS event, CASE d.rel WHEN 'nsubj' THEN 'who' WHEN 'obj' THEN 'what' WHEN 'iobj' THEN 'whom' WHEN 'obl' THEN 'where' ELSE 'how' END AS role, d.word, count(*) AS n FROM e d JOIN e h ON h.id = d.id AND h.pos = d.head WHERE h.upos = 'VERB' AND d.rel IN ('nsubj', 'obj', 'iobj', 'obl', 'advmod') GROUP BY ALL",
        "u03_u06_bounds": f"""{climbed}, f AS (SELECT a.id, b.pos AS place FROM pt a JOIN pt b ON b.id = a.id AND b.pos = a.pos + 1 AND b.part <> a.part), g AS (SELECT id, pos AS place FROM e WHERE comma), c AS (SELECT (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM g) AS gold, (SELECT count(*) FROM f JOIN g USING (id, place)) AS right_n)
          SELECT found, gold, right_n, round(right_n / greatest(found, 1), 6) AS precision, round(right_n / greatest(gold, 1), 6) AS recall FROM c""",
    }
