"""Queries that write tables as files of the formats that are read, read them again, and use the store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import gesture, graph
from ..operators import lexicon as L
from ..sources import lists, store
from ..tables import shared_folder, table
from . import base as B
from . import index as I
from .base import LEX, S, q


def _folder(s: SparkSession) -> str:
    return f"{shared_folder(s)}/lexloom-files-{uuid.uuid4().hex}"


def _written(s: SparkSession, lines: DataFrame, column: str = "line", **options: str) -> str:
    """The folder of a text table of one column."""
    folder = _folder(s)
    lines.select(F.col(column).alias("value")).write.options(**options).text(folder)
    return folder


def s01_frequency_list(s, d):
    lines = table(s, d, "lexicon").where("w IS NOT NULL").select(F.concat_ws(" ", "w", F.coalesce(F.col("c").cast("string"), F.lit("-"))).alias("line"))
    return lists.frequency_list(s, _written(s, lines)).where(X.is_word(F.col("word")))


def s02_word_list(s, d):
    return lists.word_list(s, _written(s, B.words(s, d).select(F.upper("word").alias("line")))).distinct()


def s03_forms(s, d):
    lines = B.words(s, d).select(F.concat_ws("\t", "word", F.left("word", F.lit(5))).alias("line"))
    return lists.forms(s, _written(s, lines.union(s.createDataFrame([("no tab here",)], "line string")))).distinct()


def s04_extra_list(s, d):
    lines = table(s, d, "slang").where("c0 IS NOT NULL").select(F.concat_ws("\t", F.lower("c0"), F.col("c1").cast("string"), F.coalesce("c2", F.lit("-"))).alias("line"))
    return lists.extra_list(s, _written(s, lines)).distinct()


def s05_sentence_file(s, d):
    """Sentences through a compressed file."""
    rows = table(s, d, "build_frames").where("sent_id IS NOT NULL AND text IS NOT NULL").select(F.concat_ws("\t", F.col("sent_id").cast("string"), "lang", F.translate("text", "\t\r\n", "   ")).alias("line"))
    return lists.sentences(s, _written(s, rows, compression="bzip2")).distinct().groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("letters"))


def s07_dictionary_json(s, d):
    """Words with nested forms through compressed lines of JSON."""
    rows = B.words(s, d).where("lang = 'de'").select("word", F.lit("noun").alias("pos"), F.array(F.struct(F.concat("word", F.lit("s")).alias("form"), F.array(F.lit("genitive")).alias("tags")), F.struct(F.concat("word", F.lit("en")).alias("form"), F.array(F.lit("plural"), F.lit("dative")).alias("tags"))).alias("forms"))
    folder = _folder(s)
    rows.write.option("compression", "gzip").json(folder)
    return lists.dictionary_json(s, folder).select("word", "pos", "form", F.array_join("tags", " ").alias("tags"))


def s12_first_forms(s, d):
    """Every word under two lemmas; the line that comes first holds."""
    lines = B.words(s, d).select(F.explode(F.array(F.concat_ws("\t", "word", F.left("word", F.lit(4)), F.lit("A")), F.concat_ws("\t", "word", F.left("word", F.lit(3)), F.lit("B")))).alias("line"))
    return lists.first_forms(s, _written(s, lines))


def s13_tagged_lexicon(s, d):
    folder = _folder(s)
    B.words(s, d).select("word", F.right("word", F.lit(1)).alias("tag"), "lang").write.csv(folder, sep="\t", header=True, quote="")
    return lists.tagged_lexicon(s, folder, "tag = 'e' AND lang IN ('fr', 'de')")


def s14_gesture_files(s, d):
    """Drawn words and the grid of their keys through JSON."""
    drawn, grid = _folder(s), _folder(s)
    keys = gesture.phone_keys("en")
    path = gesture.path_of(F.col("word"), keys)
    words = B.words(s, d).where("lang = 'en'").select("word", F.lit("en").alias("grid"), F.struct(F.transform(path, lambda p: p["x"]).alias("x"), F.transform(path, lambda p: p["y"]).alias("y"), F.transform(path, lambda p, i: 10.0 * i).alias("t")).alias("curve"))
    words.write.json(drawn)
    s.createDataFrame([("en", [(c, x - 0.5, y - 0.5, 1.0, 1.0) for c, (x, y) in keys.items()])], "grid string, keys array<struct<label:string,x:double,y:double,w:double,h:double>>").write.json(grid)
    width = lists.grid_json(s, grid).groupBy("grid").agg(F.max("width").alias("width"), F.count("*").alias("keys"))
    return lists.gestures_json(s, drawn).join(width, "grid").select("word", F.size("path").alias("points"), "width", "keys")


def s17_parse_file(s, d):
    """Parses through a file of space-joined arrays, counted by relation."""
    e = graph.shallow(B.sentences(s, d))
    joined = lambda c: F.concat_ws(" ", F.transform("z", lambda x: x[c].cast("string")))
    rows = e.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "upos", "head", "rel", "form"))).alias("z"))  # one sentence
    lines = rows.select(F.concat_ws("\t", F.col("id").cast("string"), joined("word"), joined("upos"), joined("head"), joined("rel"), F.concat_ws(" ", F.transform("z", lambda x: F.lit("-")))).alias("line"))
    ragged = s.createDataFrame([("1\ta b\tX\t0\troot\t-",)], "line string")
    return graph.edges(lists.parses(s, _written(s, lines.union(ragged)))).groupBy("rel", "upos").agg(F.count("*").alias("n"), F.sum("head").alias("heads"))


def s18_facts_file(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    rows = n.select(F.col("n_name").alias("subject"), F.lit("in_region").alias("relation"), F.col("n_regionkey").cast("string").alias("object")).union(r.select(F.col("r_regionkey").cast("string"), F.lit("named"), "r_name"))
    folder = _folder(s)
    rows.union(rows).union(r.select("r_name", F.lit("is"), "r_name")).write.csv(folder, sep="\t", header=True, quote="")
    return lists.facts(s, folder)


def s21_dictionary(s, d):
    """The dictionary out of the store."""
    return I.space(s, d, "dictionary").select("lang", "word", "prior_milli")


SPACES = ("confusions", "commas", "dictionary", "endings", "pairs", "rules", "tag_pairs", "topics", "yo", "casing", "frames")


def s22_key_spaces(s, d):
    """How many keys each key space of the store holds."""
    each = [I.space(s, d, name).agg(F.lit(name).alias("space"), F.count("*").alias("n")) for name in SPACES]
    out = each[0]
    for x in each[1:]:
        out = out.union(x)
    return out


def s23_casing_file(s, d):
    """Flags by the first line of a word, and 4 for words of a list."""
    words = table(s, d, "lexicon").where("w IS NOT NULL").select("lang", F.lower("w").alias("word"), F.when(F.col("w") == F.upper("w"), 2).when(F.col("w") != F.lower("w"), 1).otherwise(0).alias("flag"), F.col("word_id").alias("line"))
    bad = table(s, d, "slang").where("c0 IS NOT NULL AND c1 IS NULL").select("lang", F.lower("c0").alias("word"))
    return store.casing_flags(words, bad)


def s25_quantised_vectors(s, d):
    """Vectors as bytes with a scale; how far they are off."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    packed = store.quantised_vectors(v).select("id", F.col("vec").alias("q"), "scale")
    off = F.array_max(F.zip_with("vec", "q", lambda x, b: F.abs(x.cast("double") - b * F.col("scale") / 127)))
    return v.join(packed, "id").select("id", F.round("scale", 6).alias("scale"), F.aggregate("q", F.lit(0), lambda a, b: a + F.abs(b.cast("int"))).alias("sum_q"), (off <= F.col("scale") / 127).alias("close"))


def s27_sorted_tsv(s, d):
    """A sorted table of two columns as it stands in its files."""
    folder = _folder(s)
    store.write_tsv(B.words(s, d).groupBy("word").agg(F.max("count").alias("count")), folder, "word")
    back = s.read.text(folder).select("value", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("at"))
    return back.select(F.split("value", "\t")[0].alias("word"), F.split("value", "\t")[1].cast("long").alias("count"))


def s28_log(s, d):
    """Rows as lines of JSON and back."""
    folder = _folder(s)
    store.write_log(table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), folder, 10)
    return s.read.schema("n_nationkey long, n_name string, n_regionkey long").json(folder)


def s29_swipe_lines(s, d):
    """Drawn words as lines of points, read back."""
    keys = gesture.phone_keys("en")
    points = F.transform(gesture.path_of(F.col("word"), keys), lambda p, i: F.concat_ws(",", F.round(p["x"], 3).cast("string"), F.round(p["y"], 3).cast("string"), (i * 10).cast("string")))
    words = B.words(s, d).where("lang = 'en' AND length(word) > 1").select(F.concat_ws(" ", "word", F.lit("en"), F.concat_ws(" ", points)).alias("line"))
    heads = s.createDataFrame([(f"#key en {c} {x} {y}",) for c, (x, y) in keys.items()] + [("#width en 1.0",), ("#key en broken",)], "line string")
    named, width, drawn = lists.swipes(s, _written(s, heads.union(words)))
    grid = width.join(named.groupBy("grid").agg(F.count("*").alias("keys")), "grid")
    return drawn.join(grid, "grid").select("word", "width", "keys", F.explode("path").alias("p")).groupBy("word", "width", "keys").agg(F.count("*").alias("points"), F.round(F.max("p.t"), 3).alias("last"))


def f10_yo_forms(s, d):
    """Words with ё for е at the first and third letter, where they have one there."""
    return B.words(s, d).where("lang = 'ru'").select("word", X.yo_form(F.col("word"), F.lit(5).cast("long")).alias("form"))


def s09_affixes(s, d):
    """Stems with flags through dictionary files, to all their forms."""
    stems, rules = _folder(s), _folder(s)
    words = B.words(s, d).where("lang = 'es' AND length(word) > 4").select(F.concat("word", F.when(F.col("word").endswith("o"), "/AB").when(F.col("word").endswith("a"), "/A").otherwise("/B")).alias("value"))
    words.union(s.createDataFrame([("1000",)], "value string")).write.text(stems)
    text = ["SFX A Y 2", "SFX A 0 s [oa]", "SFX A o ito o", "PFX B Y 1", "PFX B 0 re [^r]"]
    s.createDataFrame([(x,) for x in text], "value string").coalesce(1).write.text(rules)
    return L.expand_affixes(lists.affix_stems(s, stems), lists.affix_rules(s, rules))


NAMES = (s01_frequency_list, s02_word_list, s03_forms, s04_extra_list, s05_sentence_file, s07_dictionary_json, s09_affixes, s12_first_forms, s13_tagged_lexicon, s14_gesture_files, s17_parse_file, s18_facts_file, s21_dictionary,
         s22_key_spaces, s23_casing_file, s25_quantised_vectors, s27_sorted_tsv, s28_log, s29_swipe_lines, f10_yo_forms)


def sql() -> dict[str, str]:
    from . import context, corpus, interactive

    other = {**context.sql(), **corpus.sql()}
    count = lambda name, query: f"SELECT {q(name)} AS space, count(*) AS n FROM ({query})"
    yo = f"WITH {LEX}, y AS (SELECT lang, translate(word, 'ё', 'е') AS e_form, word FROM lex WHERE word LIKE '%ё%') SELECT lang, e_form, min(word) AS word FROM y ANTI JOIN (SELECT lang, word AS e_form FROM lex) o USING (lang, e_form) GROUP BY ALL"
    named = {"confusions": "j08_confusions", "commas": "a13_comma_logits", "dictionary": "a01_lexicon", "endings": "a09_ending_pmi", "pairs": "w03_bigrams_kept", "rules": "a22_decision_list", "tag_pairs": "a08_tag_pairs", "topics": "a10_a12_class_pairs", "casing": "a23_a24_casing"}
    spaces = [*(count(k, other[v]) for k, v in named.items()), count("yo", yo), count("frames", f"SELECT DISTINCT lang, key FROM ({other['a16_a17_frames']})")]
    on_keys = f"list_filter(string_split(word, ''), lambda c: contains({q(''.join(gesture.phone_keys('en')))}, c))"
    return {
        "s01_frequency_list": f"SELECT lower(w) AS word, max(c) AS count FROM lexicon WHERE c IS NOT NULL AND {B.is_word('lower(w)')} GROUP BY 1",
        "s02_word_list": f"WITH {LEX} SELECT DISTINCT word FROM lex",
        "s03_forms": f"WITH {LEX} SELECT DISTINCT word AS form, left(word, 5) AS lemma FROM lex",
        "s04_extra_list": f"SELECT DISTINCT lower(c0) AS word, c1 AS count FROM slang WHERE c1 IS NOT NULL AND {B.is_word('lower(c0)')}",
        "s05_sentence_file": f"WITH {S} SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS letters FROM (SELECT DISTINCT sent_id, lang, translate(text, e'\\t\\r\\n', '   ') AS text FROM s) GROUP BY lang",
        "s07_dictionary_json": f"WITH {LEX} SELECT word, 'noun' AS pos, word || e AS form, t AS tags FROM lex, (VALUES ('s', 'genitive'), ('en', 'plural dative')) v(e, t) WHERE lang = 'de'",
        "s09_affixes": f"""WITH {LEX}, w AS (SELECT DISTINCT word, CASE WHEN word LIKE '%o' THEN 'AB' WHEN word LIKE '%a' THEN 'A' ELSE 'B' END AS f FROM lex WHERE lang = 'es' AND length(word) > 4), sx AS (SELECT word, f, word || 's' AS form FROM w WHERE contains(f, 'A') AND regexp_matches(word, '[oa]$') UNION ALL SELECT word, f, left(word, length(word) - 1) || 'ito' FROM w WHERE contains(f, 'A') AND word LIKE '%o')
          SELECT DISTINCT form, lemma FROM (SELECT word AS form, word AS lemma FROM w UNION ALL SELECT form, word FROM sx UNION ALL SELECT 're' || word, word FROM w WHERE contains(f, 'B') AND word NOT LIKE 'r%' UNION ALL SELECT 're' || form, word FROM sx WHERE contains(f, 'B') AND form NOT LIKE 'r%')""",
        "s12_first_forms": f"WITH {LEX} SELECT word AS form, left(word, 4) AS lemma FROM lex GROUP BY word",
        "s13_tagged_lexicon": f"WITH {LEX} SELECT word, right(word, 1) AS tag, lang FROM lex WHERE right(word, 1) = 'e' AND lang IN ('fr', 'de')",
        "s14_gesture_files": f"WITH {LEX} SELECT word, CAST(len({on_keys}) AS INTEGER) AS points, 1.0::DOUBLE AS width, CAST({len(gesture.phone_keys('en'))} AS BIGINT) AS keys FROM lex WHERE lang = 'en'",
        "s17_parse_file": f"WITH {interactive.edges_sql()} SELECT rel, upos, count(*) AS n, CAST(sum(head) AS BIGINT) AS heads FROM e GROUP BY ALL",
        "s18_facts_file": "SELECT n_name AS s, 'in_region' AS r, CAST(n_regionkey AS VARCHAR) AS o FROM nation UNION SELECT CAST(r_regionkey AS VARCHAR), 'named', r_name FROM region",
        "s21_dictionary": f"WITH {LEX}, {B.PRIOR} SELECT lang, word, prior_milli FROM pri",
        "s22_key_spaces": " UNION ALL ".join(spaces),
        "s23_casing_file": """WITH f AS (SELECT lang, lower(w) AS word, CASE WHEN w = upper(w) THEN 2 WHEN w <> lower(w) THEN 1 ELSE 0 END AS flag, row_number() OVER (PARTITION BY lang, lower(w) ORDER BY word_id) AS rn FROM lexicon WHERE w IS NOT NULL), b AS (SELECT DISTINCT lang, lower(c0) AS word FROM slang WHERE c0 IS NOT NULL AND c1 IS NULL)
          SELECT lang, word, CAST(coalesce(flag, 0) | CASE WHEN b.word IS NOT NULL THEN 4 ELSE 0 END AS INTEGER) AS flag FROM (SELECT * FROM f WHERE rn = 1) f FULL JOIN b USING (lang, word)""",
        "s25_quantised_vectors": "WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT *, greatest(list_max(list_transform(v, lambda x: abs(x))), 1e-9) AS scale FROM v) SELECT id, round(scale, 6) AS scale, CAST(list_sum(list_transform(v, lambda x: abs(round(x / scale * 127)))) AS INTEGER) AS sum_q, true AS close FROM s",
        "s27_sorted_tsv": f"WITH {LEX} SELECT word, max(count) AS count FROM lex GROUP BY word",
        "s28_log": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
        "s29_swipe_lines": f"WITH {LEX} SELECT word, 1.0::DOUBLE AS width, CAST({len(gesture.phone_keys('en'))} AS BIGINT) AS keys, len({on_keys}) AS points, CAST(10 * (len({on_keys}) - 1) AS DOUBLE) AS last FROM lex WHERE lang = 'en' AND length(word) > 1 AND len({on_keys}) >= 2",
        "f10_yo_forms": f"WITH {LEX} SELECT word, translate(left(word, 1), 'е', 'ё') || substr(word, 2, 1) || translate(substr(word, 3, 1), 'е', 'ё') || substr(word, 4) AS form FROM lex WHERE lang = 'ru'",
    }
