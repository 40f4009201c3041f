import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import encode, langid, packing
from lexloom.tables import table
from tests.conftest import DATA


@pytest.fixture(scope="module")
def bpe():
    return encode.ByteBPE(encode.read_vocabulary())


@pytest.fixture(scope="module")
def judge():
    import tiktoken

    own = encode.ByteBPE(encode.read_vocabulary())
    return tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_encoding_equals_the_library(text):
    own = encode.loaded(encode.read_vocabulary())
    import tiktoken

    judge = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    ids = own.encode(text)
    assert ids == judge.encode_ordinary(text)
    assert own.decode(ids) == text


def test_encoding_of_the_documents(spark, judge):
    docs = {r.doc_id: r.text for r in table(spark, DATA, "documents").collect()}
    got = {r.doc_id: r.ids for r in encode.encode(table(spark, DATA, "documents")).collect()}
    assert got == {k: judge.encode_ordinary(t) if t else [] for k, t in docs.items()}


def test_encoding_edge_cases(spark, judge):
    texts = [None, "", "<|endoftext|>", "a" * 30_000, "  \n\t ", "ё́" * 10, "x"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(None, "x", 7)], "doc_id long, text string, ids int")
    got = [(r.doc_id, r.ids) for r in encode.encode(df).collect()]
    assert len(got) == 8
    assert dict(got) == {**{i: judge.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}, None: judge.encode_ordinary("x")}
    assert encode.encode(df.limit(0)).count() == 0
    back = {r.doc_id: r.text for r in encode.decode(encode.encode(df.where("doc_id IS NOT NULL"))).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in encode.token_counts(df).collect()} == {k: len(v) for k, v in dict(got).items()}


def test_first_fit_against_brute_force():
    rng = random.Random(1)
    for _ in range(50):
        sizes = sorted((rng.randrange(1, 101) for _ in range(rng.randrange(1, 60))), reverse=True)
        room, want = [], []
        for s in sizes:
            k = next((i for i, r in enumerate(room) if r >= s), len(room))
            if k == len(room):
                room.append(100)
            room[k] -= s
            want.append(k)
        assert packing.first_fit(sizes, 100) == want


def test_pack(spark):
    rng = random.Random(2)
    items = [(i, rng.choice([0, 5, 90, 100, 250, rng.randrange(1, 400)])) for i in range(500)] + [(None, 50), (None, None), (900, 200)]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in items], "doc_id long, n_tokens long, bin int, grp int")
    out = packing.pack(df, capacity=100, group_size=120).toPandas()
    used = out.groupby(["grp", "bin"])["size"].sum()
    assert used.max() <= 100 and out["grp"].nunique() > 1
    whole = out.dropna(subset=["doc_id"]).groupby("doc_id")["size"].agg(["sum", "count"])
    for i, n in items:
        if i is not None:
            assert whole.loc[i, "sum"] == n and whole.loc[i, "count"] == max(1, -(-n // 100))
    assert out["doc_id"].isna().sum() == 2
    report = packing.pack_report(packing.pack(df, capacity=100, group_size=10_000), 100).collect()[0]
    assert report.containers <= 11 / 9 * report.at_least + 1
    assert packing.pack(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def sample(spark):
    return langid.sample_sentences(table(spark, DATA, "build_frames"), 150)


def test_held_out_accuracy(spark, sample):
    frames = table(spark, "/root/testdata/sf0.01", "build_frames").where("length(text) > 40 AND sent_id > 2000").selectExpr("sent_id AS doc_id", "lang", "text").dropDuplicates(["doc_id"])
    got = langid.stretches(frames, sample).groupBy("doc_id").agg({"words": "max"}).count()
    best = {r.doc_id: r.lang for r in langid.stretches(frames, sample).orderBy("words").collect()}
    truth = {r.doc_id: r.lang for r in frames.collect()}
    assert got == len(best)
    assert np.mean([best.get(k) == v for k, v in truth.items()]) > 0.98


def test_mislabelled(spark, sample):
    by = {}
    for lang, text in sample:
        if len(text.split()) > 9:
            by.setdefault(lang, []).append(text)
    ru, en, de = by["ru"], by["en"], by["de"]
    docs = [
        (1, "ru", " ".join(ru[:3])), (2, "ru-RU", ru[0]), (3, "RUS", ru[0]), (4, "en", ru[0]), (5, None, ru[0]), (6, "", en[0]), (7, "xx", de[0]), (8, "en", en[0] + " " + ru[1]), (9, "und", "12 34"), (10, None, None), (11, None, ""),
        (12, "en", en[0] + " клавиша " + en[1]), (13, "ru", ru[0] + "\n#key grid x 1.5 2.5\ngerund\t" + ru[1]), (14, "de", de[0] + " " + en[0] + " " + ru[0]),
    ]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, lang string, text string, words int, confidence string")
    got = sorted((r.doc_id, r.lang) for r in langid.mislabelled(df, sample).collect())
    assert got == [(4, "ru"), (5, "ru"), (6, "en"), (7, "de"), (8, "en"), (8, "ru"), (14, "de"), (14, "en"), (14, "ru")]
    places = [(r.start, r.stop, r.lang) for r in langid.stretches(df.where("doc_id = 8"), sample).orderBy("start").collect()]
    assert [p[2] for p in places] == ["en", "ru"] and places[1][0] >= len(en[0]) - 2
    assert langid.mislabelled(df.limit(0), sample).count() == 0


def test_short_sentences(spark):
    """Sentences of three to six words from a part of the corpus that the model has not seen, alone and inside another language."""
    frames = table(spark, "/root/testdata/sf0.01", "build_frames")
    sample = langid.sample_sentences(frames.where("sent_id <= 8000"))
    frames = frames.where("length(text) > 60 AND sent_id > 8000").select("sent_id", "lang", "text").orderBy("sent_id").dropDuplicates(["sent_id"]).collect()
    rng, by, docs, truth = random.Random(5), {}, [], {}
    for r in frames:
        by.setdefault(r.lang, []).append(r.text)
    for words in (3, 4, 5, 6):
        for lang in langid.LANGS:
            other = by[rng.choice([x for x in langid.LANGS if x != lang])]
            for text in rng.sample(by[lang], 20):
                short = " ".join(text.split()[:words]).rstrip(".!?») ") + "."
                if len(langid.tokens(short)) < words:
                    continue
                a, b = len(docs), len(docs) + 1
                docs += [(a, short), (b, f"{rng.choice(other)} {short} {rng.choice(other)}")]
                truth |= {a: lang, b: lang}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.lang) for r in langid.whole_languages(langid.stretches(df, sample)).collect()}
    hits = {k: [(i, truth[i]) in got for i in truth if i % 2 == k] for k in (0, 1)}
    assert np.mean(hits[0]) >= 0.95 and np.mean(hits[1]) >= 0.95, (np.mean(hits[0]), np.mean(hits[1]))
    assert not [(i, lang) for i, lang in got if i % 2 == 0 and lang != truth[i]]


def test_labels_are_no_sentences(spark, sample):
    ru = [t for lang, t in sample if lang == "ru" and len(t.split()) > 9][:3]
    text = "gerund\t" + ru[0] + "\n#key grid п 34.9 78.5\nwishbone:0.4:1.0 relative\t" + ru[1] + "\nparenthetically\tthoroughbred\t412\n" + ru[2]
    got = langid.whole_languages(langid.stretches(spark.createDataFrame([(1, text)], "doc_id long, text string"), sample)).collect()
    assert [r.lang for r in got] == ["ru"]


def test_document_languages(spark, sample):
    ru, en = (next(t for lang, t in sample if lang == want and len(t.split()) > 9) for want in ("ru", "en"))
    docs = [(1, "ru", ru), (2, "en-GB", en), (3, None, ru), (4, "en", f"{ru} {ru} {en}"), (5, "de", None), (6, "de", ""), (7, "xx", "12 !"), (7, "xx", "12 !"), (None, "ru", ru)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, lang string, text string, said string, words int")
    got = {r.doc_id: r for r in langid.document_languages(df, langid.stretches(df, sample)).collect()}
    assert {k: (r.said, r.lang, r.langs) for k, r in got.items()} == {1: ("ru", "ru", 1), 2: ("en", "en", 1), 3: (None, "ru", 1), 4: ("en", "ru", 2), 5: ("de", None, 0), 6: ("de", None, 0), 7: (None, None, 0), None: ("ru", None, 0)}
    assert got[1].confidence > 0.99 and got[1].share == 1.0 and 0.5 < got[4].share < 0.8 and got[5].confidence == 0.0
    assert langid.document_languages(df, langid.stretches(df, sample)).count() == len(docs)


def test_best_paths_against_brute_force():
    from itertools import product

    rng = np.random.default_rng(0)
    lengths = np.array([5, 4, 4, 1])
    scores = rng.normal(size=(lengths.sum(), 6)) * 3
    change = rng.choice([0.5, 2.0], len(scores))
    got, at = langid.best_paths(scores, lengths, change), 0
    for n in lengths:
        own, price = scores[at : at + n], change[at : at + n]
        value = lambda p: sum(own[i, l] for i, l in enumerate(p)) - sum(price[i] for i in range(1, len(p)) if p[i] != p[i - 1])  # noqa: B023, E731
        assert np.isclose(value(tuple(got[at : at + n])), max(map(value, product(range(6), repeat=int(n)))))
        at += n


def test_very_long_text(spark, sample):
    ru = next(t for lang, t in sample if lang == "ru" and len(t.split()) > 9)
    df = spark.createDataFrame([(1, "ru", (ru + " ") * 3000)], "doc_id long, lang string, text string")
    assert [r.lang for r in langid.stretches(df, sample).collect()] == ["ru"]
