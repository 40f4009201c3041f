import numpy as np
from pyspark.sql import functions as F

from lexloom.operators import grammar as G
from lexloom.operators import simulate, vectors
from lexloom.operators.gesture import phone_keys


def words(spark, rows):
    df = spark.createDataFrame(rows, "id int, tags array<string>")
    return {r.id: r.b for r in df.select("id", F.transform("tags", G.bits_of).alias("b")).collect()}


WORDS = {
    "новый": ["ADJF,masc,sing,nomn", "ADJF,masc,sing,accs,inan"], "новую": ["ADJF,femn,sing,accs"], "дом": ["NOUN,inan,masc,sing,nomn", "NOUN,inan,masc,sing,accs"], "дому": ["NOUN,inan,masc,sing,datv"],
    "книга": ["NOUN,inan,femn,sing,nomn"], "книгу": ["NOUN,inan,femn,sing,accs"], "читает": ["VERB,sing,3per,pres"], "читали": ["VERB,plur,past"], "читал": ["VERB,masc,sing,past"], "быстро": ["ADVB"], "к": ["PREP"], "она": ["NPRO,femn,3per,sing,nomn"], "читай": ["VERB,sing"],
}


def phrases(spark, rows):
    bits = {w: words(spark, [(0, t)])[0] for w, t in WORDS.items()}
    return spark.createDataFrame([(i, [(w, bits[w]) for w in p.split()], bits.get(n, [])) for i, (p, n) in enumerate(rows)], "id int, phrase array<struct<word:string,readings:array<bigint>>>, readings array<bigint>")


def test_misfits(spark):
    cases = [("к", "дому", False), ("к", "дом", True), ("новую", "книгу", False), ("новую", "дом", True), ("новый", "дом", False), ("она", "читает", False), ("она", "читали", True), ("она", "читал", True), ("быстро", "дом", False), ("", "дом", False), ("к", "", False), ("она", "читай", True)]
    got = {r.id: r.misfit for r in G.misfits(phrases(spark, [c[:2] for c in cases])).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}


def test_phrase_scores(spark):
    frames = spark.createDataFrame([("к", [-1.0, -2.0, -2.0, 2.5, -2.0, -2.0, -2.0, -1.0])], "key string, values array<double>")
    got = {r.id: r.score for r in G.phrase_scores(phrases(spark, [("к", "дому"), ("к", "дом"), ("она", "читает"), ("она", "читали"), ("новую", "дом")]), frames).collect()}
    assert got == {0: 2.5, 1: -2.0, 2: 0.5, 3: -2.5, 4: -2.0}


def test_kinds_and_classes(spark):
    r = spark.createDataFrame([("ru", w, words(spark, [(0, t)])[0]) for w, t in list(WORDS.items())[:4]], "lang string, word string, readings array<bigint>")
    got = {x.word: x.k for x in r.select("word", G.comma_kind(F.col("readings")).alias("k")).collect()}
    assert got == {"новый": "MIX", "новую": "OBL", "дом": "MIX", "дому": "OBL"}
    assert G.classes(r).count() == 4
    pairs = spark.createDataFrame([("ru", "к", "дому", 3), ("ru", "к", "дом", 2)], "lang string, prev string, word string, n long")
    assert {(x.outcome, x.weight) for x in G.governed_outcomes(pairs, r).collect()} == {(3, 3.0), (1, 1.0), (4, 1.0)}


def test_incremental_states_equal_whole_ones():
    w = vectors.random_weights(30)
    net = vectors.Encoder(w)
    ids = [3, 7, 1, 9, 4]
    for n in range(1, 6):
        assert np.allclose(net.step(ids[:n]), vectors.Encoder(w).whole(ids[:n]))
    assert np.allclose(net.step([3, 7, 2]), vectors.Encoder(w).whole([3, 7, 2]))


def test_parse(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, None)], "sent_id int, ids array<int>")
    got = {r.id: r for r in vectors.parse(df, vectors.random_weights(10)).collect()}
    assert len(got[1].heads) == 3 and all(0 <= h <= 3 and h != i + 1 for i, h in enumerate(got[1].heads)) and got[2].heads == [] == got[3].heads


def test_low_rank(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(30, 3)) @ rng.normal(size=(3, 30))
    df = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i in range(30) for j in range(30)], "i long, j long, v double")
    u, s = vectors.low_rank(df, 4)
    assert np.allclose(s[:3], np.linalg.svd(m)[1][:3]) and s[3] < 1e-6


def test_kneser_ney_sums_to_one(spark):
    pairs = spark.createDataFrame([("en", a, b, n) for a, b, n in (("a", "b", 3), ("a", "c", 1), ("b", "c", 2), ("c", "a", 1))], "lang string, prev string, word string, n long")
    kn = vectors.kneser_ney(pairs)
    seen = sum(np.exp(r.logp) for r in kn.where("prev = 'a'").collect())
    assert seen < 1.0 and abs(seen + 0.75 * 2 / 4 * (1 / 4) - 1) < 1e-4


def test_lru():
    c, made = vectors.LRU(2), []
    for k in (1, 2, 1, 3, 2):
        c.get(k, lambda: made.append(k))  # noqa: B023
    assert made == [1, 2, 3, 2]


def test_quantised_weights():
    w = vectors.random_weights(10)
    q, s = vectors.quantise(w)["emb"]
    assert np.abs(q * s - w["emb"]).max() <= s.max()


def test_simulators(spark):
    keys = phone_keys("en")
    assert simulate.taps("hello", keys, 0.0) == "hello" and simulate.taps("hello", keys, 0.5, 3) == simulate.taps("hello", keys, 0.5, 3)
    path = simulate.swipe("hello", keys, 0.0)
    assert path[0][:2] == keys["h"] and abs(path[-1][0] - keys["o"][0]) < 1e-9 and all(a[2] <= b[2] for a, b in zip(path, path[1:]))
    assert simulate.align("helo", "hello") == [(0, 0), (1, 1), (2, 2), (3, 4)] or len(simulate.align("helo", "hello")) == 4
    assert simulate.align("ehllo", "hello")[:2] == [(0, 1), (1, 0)]
    assert simulate.augment("Он пришёл, и всё.", "clause") == "Он пришёл"
    s = simulate.typed_sessions(spark.createDataFrame([("s", "ab"), ("t", None)], "session string, text string"))
    assert s.count() == 4
