"""The pN_ queries over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import ready, table
from . import consistent as C
from . import cooccur, encode, frequency, langid, mixing, overlap, packing


def _mix(spark: SparkSession, d: str, *keep: str) -> tuple[DataFrame, DataFrame, int]:
    """(records, plan, number of targets, from the file's footer)."""
    frames, targets = table(spark, d, "build_frames"), table(spark, d, "mix_targets")
    return mixing.records(frames, keep=keep), mixing.mix_plan(mixing.records(frames), targets), targets.count()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1].where("short").select("source")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    recs, plan, targets = _mix(spark, d)
    return mixing.mix_report(recs, plan, targets=targets)


def p1_mix(spark: SparkSession, d: str) -> DataFrame:
    recs, plan, targets = _mix(spark, d, "lang", "text")
    return mixing.mix_emit(recs, plan, targets=targets).withColumnRenamed("id", "sent_id")


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    counts = frequency.term_counts(table(ready(spark), d, "build_frames")).checkpoint()  # a row per distinct term, read twice
    return frequency.term_usefulness(counts, frequency.lexicon_terms(table(spark, d, "lexicon")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_terms(spark, d).where("mark IS NOT NULL").select("lang", "term", "mark")


def _all_texts(spark: SparkSession, d: str) -> DataFrame:
    of = (("build_frames", "sent_id", "text"), ("lexicon", "word_id", "w"), ("slang", "slang_id", "c0"))
    return reduce(DataFrame.union, [table(spark, d, t).select(F.lit(t).alias("tab"), F.col(i).alias("id"), "lang", F.col(x).alias("text")) for t, i, x in of])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return C.look_alikes(_all_texts(spark, d), "id", "text", "lang")


def p3_consistent(spark: SparkSession, d: str) -> DataFrame:
    return _all_texts(spark, d).select("tab", "id", C.consistent(F.col("text"), F.col("lang")).alias("text")).distinct()


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    frames = table(ready(spark), d, "build_frames")
    return overlap.overlaps(overlap.records(frames), rows=frames.count())  # from the files' footers


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select(F.least("held_id", "train_id").alias("a_id"), F.greatest("held_id", "train_id").alias("b_id"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    frames = table(ready(spark), d, "build_frames")
    return overlap.overlap_classes(overlap.records(frames), rows=frames.count()).select(F.col("id").alias("sent_id"), "class_id", "links")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "build_frames"), _overlaps(spark, d))


def _together(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.together(table(spark, d, "build_frames"), frequency.lexicon_terms(table(spark, d, "lexicon")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _together(spark, d).select("lang", "w_a", "w_b")


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _together(spark, d)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    back = encode.decode(encode.encode(docs)).withColumnRenamed("text", "back")
    return docs.select("doc_id", "text").join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return packing.pack(encode.token_counts(docs), items=docs.count())  # from the files' footers


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_pack(spark, d).where("n_parts > 1 AND part = 0").select("doc_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_report(p7_pack(spark, d))


def p8_stretches(spark: SparkSession, d: str) -> DataFrame:
    return langid.stretches(table(spark, d, "documents"), langid.sample_sentences(table(spark, d, "build_frames")))


def p8_labels(spark: SparkSession, d: str) -> DataFrame:
    return langid.mislabelled(table(spark, d, "documents"), langid.sample_sentences(table(spark, d, "build_frames")))


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    return langid.document_languages(table(spark, d, "documents"), p8_stretches(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_labels(spark, d).select("doc_id", "lang")


def queries() -> dict:
    return {f.__name__: f for f in (
        p1_found, p1_report, p1_mix, p2_found, p2_terms, p3_found, p3_consistent, p4_found, p4_classes, p4_report, p5_found, p5_pairs,
        p6_ids, p6_roundtrip, p7_found, p7_pack, p7_report, p8_found, p8_labels, p8_stretches, p8_documents,
    )}


def _form(text: str, lang: str) -> str:
    """The consistent form in SQL: characters one by one, then NFC."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    spaces, quote = C.SPACES, lambda s: "'" + s.replace("'", "''") + "'"
    plain = f"translate({text}, {quote(wide + spaces + C.INVISIBLE)}, {quote(narrow + ' ' * len(spaces))})"
    each = {}
    for script in ("cyr", "lat"):
        one = {k: v for k, v in C.transducer(script).table.items() if len(k) == len(v) == 1 and k not in wide + spaces}
        each[script] = f"translate({plain}, {quote(''.join(one))}, {quote(''.join(one.values()))})"
    return f"nfc_normalize(CASE WHEN {lang} = 'ru' THEN {each['cyr']} ELSE {each['lat']} END)"


def oracle_sql() -> dict[str, str]:
    src = "lower(trim(source, e' \\t\\r\\n\\u00a0'))"
    recs = f"recs AS (SELECT sent_id AS id, max({src}) AS source, max(coalesce(length(text), 0)) AS size, max(lang) AS lang, max(text) AS text FROM build_frames WHERE sent_id IS NOT NULL GROUP BY sent_id)"
    plan = f"""{recs}, sized AS (SELECT t.source, t.weight, t.max_repeat, count(r.id) AS records, CAST(coalesce(sum(r.size), 0) AS BIGINT) AS size FROM mix_targets t LEFT JOIN recs r ON r.source = t.source GROUP BY ALL),
      plan AS (SELECT *, CASE WHEN size > 0 THEN least(weight * mix / size, max_repeat) ELSE 0 END AS rate, weight * mix > max_repeat * size AS short FROM (SELECT *, (SELECT CAST(sum(size) AS BIGINT) FROM sized) AS mix FROM sized))"""
    mix = f"""{plan}, drawn AS (SELECT r.*, p.rate, CAST(CAST('0x' || substr(md5('0:' || r.id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS u FROM recs r JOIN plan p USING (source)),
      mixed AS (SELECT id, source, size, lang, text, CAST(unnest(range(1, 1 + CAST(floor(rate) AS BIGINT) + (u < rate - floor(rate))::BIGINT)) AS INTEGER) AS copy FROM drawn)"""
    frames = f"frames AS (SELECT DISTINCT sent_id, lang, regexp_extract_all(lower({_form('text', 'lang')}), '{C.WORD}') AS ws FROM build_frames WHERE sent_id IS NOT NULL AND text IS NOT NULL)"
    toks = f"{frames}, n AS (SELECT lang, count(*) AS n FROM frames WHERE len(ws) > 0 GROUP BY lang), toks AS (SELECT lang, sent_id, unnest(ws) AS term FROM frames)"
    terms = f"terms AS (SELECT lang, term, max(c) AS c FROM (SELECT lang, lower({_form('w', 'lang')}) AS term, coalesce(c, 0) AS c FROM lexicon WHERE w IS NOT NULL) WHERE regexp_full_match(term, '{C.WORD}') GROUP BY ALL)"
    freq = f"""WITH {toks}, {terms}, cnt AS (SELECT lang, term, count(*) AS occurrences, count(DISTINCT sent_id) AS records FROM toks GROUP BY ALL),
      res AS (SELECT lang, term, coalesce(occurrences, 0) AS occurrences, coalesce(records, 0) AS records, c, CASE WHEN 100 * coalesce(records, 0) > 20 * coalesce(n, 0) THEN 'common' WHEN coalesce(records, 0) <= 2 AND c < 20 THEN 'rare' END AS mark
        FROM terms LEFT JOIN cnt USING (lang, term) LEFT JOIN n USING (lang))"""
    texts = f"""texts AS (SELECT DISTINCT tab, id, lang, text, {_form('text', 'lang')} AS form FROM (SELECT 'build_frames' AS tab, sent_id AS id, lang, text FROM build_frames
      UNION ALL SELECT 'lexicon', word_id, lang, w FROM lexicon UNION ALL SELECT 'slang', slang_id, lang, c0 FROM slang))"""
    over = f"""WITH {frames}, sets AS (SELECT f.sent_id, s.split, list_distinct(ws) AS ws FROM frames f JOIN (SELECT sent_id, max(split) AS split FROM build_frames GROUP BY 1) s USING (sent_id) WHERE len(ws) > 0),
      w AS (SELECT sent_id, split, len(ws) AS k, unnest(ws) AS word FROM sets),
      pairs AS (SELECT h.sent_id AS held_id, t.sent_id AS train_id FROM w h JOIN w t USING (word) WHERE h.split <> 'train' AND t.split = 'train' GROUP BY 1, 2 HAVING 10 * count(*) >= 7 * (max(h.k) + max(t.k) - count(*)))"""
    both = f"""WITH {toks}, {terms}, inn AS (SELECT DISTINCT lang, sent_id, term FROM toks SEMI JOIN terms USING (lang, term)), own AS (SELECT lang, term, count(*) AS k FROM inn GROUP BY ALL),
      ab AS (SELECT a.lang, a.term AS w_a, b.term AS w_b, count(*) AS n_ab FROM inn a JOIN inn b ON a.sent_id = b.sent_id AND a.lang = b.lang AND a.term < b.term GROUP BY ALL HAVING count(*) >= 5),
      res AS (SELECT ab.lang, w_a, w_b, n, x.k AS n_a, y.k AS n_b, n_ab, round(CAST(n_ab AS DOUBLE) * n / (CAST(x.k AS DOUBLE) * y.k), 6) AS lift FROM ab JOIN n USING (lang) JOIN own x ON x.lang = ab.lang AND x.term = w_a JOIN own y ON y.lang = ab.lang AND y.term = w_b
        WHERE 1000 * n_ab >= 3 * n AND n_ab * n >= 5 * x.k * y.k)"""
    return {
        "p1_found": f"WITH {plan} SELECT source FROM plan WHERE short",
        "p1_report": f"""WITH {mix}, got AS (SELECT source, count(*) AS emitted, CAST(sum(size) AS BIGINT) AS emitted_size FROM mixed GROUP BY 1)
          SELECT source, weight, max_repeat, records, size, round(rate, 6) AS rate, coalesce(emitted, 0) AS emitted, coalesce(emitted_size, 0) AS emitted_size, round(coalesce(emitted_size, 0) / (SELECT sum(emitted_size) FROM got), 6) AS share, short FROM plan LEFT JOIN got USING (source)""",
        "p1_mix": f"WITH {mix} SELECT id AS sent_id, source, size, lang, text, copy FROM mixed",
        "p2_found": f"{freq} SELECT lang, term, mark FROM res WHERE mark IS NOT NULL",
        "p2_terms": f"{freq} SELECT lang, term, occurrences, records, c, mark FROM res",
        "p3_found": f"WITH {texts} SELECT a.tab, a.id AS a_id, b.id AS b_id FROM texts a JOIN texts b ON a.tab = b.tab AND a.lang = b.lang AND a.form = b.form AND a.id < b.id AND a.text <> b.text WHERE regexp_matches(a.form, '\\p{{L}}')",
        "p3_consistent": f"WITH {texts} SELECT DISTINCT tab, id, form AS text FROM texts",
        "p4_found": f"{over} SELECT least(held_id, train_id) AS a_id, greatest(held_id, train_id) AS b_id FROM pairs",
        "p4_classes": f"""{over}, n AS (SELECT held_id AS sent_id, count(*) AS k FROM pairs GROUP BY 1 UNION ALL SELECT train_id, count(*) FROM pairs GROUP BY 1)
          SELECT sent_id, min(sent_id) OVER (PARTITION BY list_sort(ws)) AS class_id, coalesce(k, 0) AS links FROM sets LEFT JOIN n USING (sent_id)""",
        "p4_report": f"""{over}, links AS (SELECT held_id AS id, count(*) AS links FROM pairs GROUP BY 1), r AS (SELECT sent_id AS id, max(split) AS split, max({src}) AS source FROM build_frames WHERE split <> 'train' GROUP BY 1)
          SELECT split, source, count(*) AS records, count(links) AS overlapping, CAST(coalesce(sum(links), 0) AS BIGINT) AS links FROM r LEFT JOIN links USING (id) GROUP BY split, source""",
        "p5_found": f"{both} SELECT lang, w_a, w_b FROM res",
        "p5_pairs": f"{both} SELECT * FROM res",
    }
