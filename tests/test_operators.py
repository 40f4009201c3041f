import random

import numpy as np
import pytest

from lexloom.config import Config, preset, settings
from lexloom.operators import channel, context, corpus, decode, evaluate, gesture, graph, lexicon, marks, rerank
from lexloom.streaming import touch


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_config():
    assert preset("accurate").max_cost == 9.0
    c = Config().with_values(**settings("# weights\nsigma = 0.6\nlayout_flip = false\nsigma=0.5"))
    assert c.sigma == 0.5 and c.layout_flip is False
    with pytest.raises(ValueError):
        Config().with_values(nonsense=1)


def plain_edit(typed, word, cfg):
    """Brute force, one cell at a time."""
    kb = channel.keyboard(cfg)
    x, w = [channel.CODE.get(c, 0) for c in typed], [channel.CODE.get(c, 0) for c in word]

    def ins(j):
        cost = kb.insert[x[j]]
        if j and x[j] == x[j - 1]:
            cost = min(cost, cfg.ins_repeat)
        if any(0 <= k < len(x) and kb.near[x[j], x[k]] for k in (j - 1, j + 1)):
            cost = min(cost, cfg.ins_neighbor)
        if 0 < j < len(x) - 2 and typed[j - 1 : j + 3] == "ться":
            cost = min(cost, cfg.tsya)
        return cost

    d = np.full((len(w) + 1, len(x) + 1), np.inf)
    d[0, 0] = 0
    for i in range(len(w) + 1):
        for j in range(len(x) + 1):
            if i:
                cost = kb.delete[w[i - 1]]
                if i > 1 and w[i - 1] == w[i - 2]:
                    cost = min(cost, cfg.del_double)
                if word[i - 1] == "ь" and i > 1 and word[i - 2] == "т" and typed[j : j + 1] == "с":
                    cost = min(cost, cfg.tsya)
                d[i, j] = min(d[i, j], d[i - 1, j] + cost)
            if j:
                d[i, j] = min(d[i, j], d[i, j - 1] + ins(j - 1))
            if i and j:
                d[i, j] = min(d[i, j], d[i - 1, j - 1] + kb.sub[x[j - 1], w[i - 1]])
            if i > 1 and j > 1 and w[i - 1] == x[j - 2] and w[i - 2] == x[j - 1]:
                a, b = kb.hand[x[j - 2]], kb.hand[x[j - 1]]
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + (cfg.trans_cross if a != b and a < 2 and b < 2 else cfg.trans))
            if i and j > 1 and channel.TWO.get(word[i - 1]) == typed[j - 2 : j]:
                d[i, j] = min(d[i, j], d[i - 1, j - 2] + cfg.accent)
    return d[-1, -1]


def test_channel_against_brute_force():
    rng, cfg = random.Random(3), Config()
    words = ["учиться", "straße", "привет", "hello", "ёлка", "été", "coeur", "cœur", "aaa", "об", "x"]
    pairs = [(w, v) for w in words for v in words]
    for w in words:
        for _ in range(6):
            i = rng.randrange(len(w))
            pairs += [(w[:i] + w[i + 1 :], w), (w[:i] + rng.choice("абвxyz") + w[i:], w), (w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :], w)]
    got = channel.edit_costs([p[0] for p in pairs], [p[1] for p in pairs], cfg)
    assert np.allclose(got, [plain_edit(a, b, cfg) for a, b in pairs])


LEX = [("ru", w, c) for w, c in (("привет", 900), ("приветы", 20), ("принят", 50), ("ёлка", 30), ("елка", 5), ("не", 5000), ("небо", 300), ("дом", 800), ("том", 400))] + [("en", w, c) for w, c in (("hello", 500), ("help", 300), ("hell", 40), ("the", 9000), ("then", 900))]


def lex(spark):
    return lexicon.priors(spark.createDataFrame(LEX, "lang string, word string, count long"))


def test_suggest(spark):
    typed = spark.createDataFrame([(1, "ru", "првиет"), (2, "ru", "ghbdtn"), (3, "en", "helo"), (4, "ru", "елка"), (5, "en", ""), (6, "en", None)], "qid long, lang string, typed string")
    best = {r.qid: r.word for r in decode.suggest(typed, lex(spark)).where("rk = 1").collect()}
    assert best == {1: "привет", 2: "привет", 3: "hello", 4: best[4]} and best[4] in ("ёлка", "елка")


def test_suggest_meets_what_all_words_give(spark):
    typed = spark.createDataFrame([(1, "ru", "првиет"), (2, "en", "helo"), (3, "en", "tehn")], "qid long, lang string, typed string")
    fast = {r.qid: (r.word, r.cost) for r in decode.suggest(typed, lex(spark)).where("rk = 1").collect()}
    slow = {r.qid: (r.word, r.cost) for r in decode.suggest_exhaustive(typed, lex(spark)).where("rk = 1").collect()}
    assert fast == slow


def test_suggest_loses_no_word_within_the_budget(spark):
    words = "bookkeeper committee keeper booker strasse straße œuvre well-known ill don't lasagne hadfkj".split()
    ru = "боялся бояться подъезд объём ёлка сыновья длинный ввод вводный аддон".split()
    many = lexicon.priors(spark.createDataFrame([(lang, w, 10 + i) for lang, ws in (("en", words), ("ru", ru)) for i, w in enumerate(ws)], "lang string, word string, count long"))
    typed = [("en", t) for t in ("bokeper", "obkoeekpre", "comite", "oeuvre", "strase", "wellknwon", "zzzzzz", "q", "asdfghjkl", "hadfkj", "dsll", "щззлуузук", "œil", "a1b")]
    typed += [("ru", t) for t in ("баялься", "подезд", "обьем", "елка", "дленый", "вод", "ъ", "фывапролдж", "ффоло", "gjl]tpl", "сынавя")]
    asked = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(typed)], "qid long, lang string, typed string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = rows(decode.suggest(asked, many))
    assert got == rows(decode.suggest_exhaustive(asked, many))
    assert "bookkeeper" in [r[3] for r in got if r[1] == "bokeper"]


def test_no_pair_costs_less_than_its_bound():
    rng = np.random.default_rng(1)
    cfg, letters = decode.Config(), [c for c in channel.ALPHABET if c != "\0"]
    for alphabet in (letters, list("asdfgtyhn'-ß"), list("фывапьътсяеёж-"), list("oeœaæsßé")):
        words, typed = (["".join(rng.choice(alphabet, rng.integers(1, 9))) for _ in range(60)] for _ in range(2))
        known = decode._Lexicon(words, cfg)
        x, n = channel.codes(typed, max(map(len, typed))), np.array(list(map(len, typed)))
        for home in (False, True):
            true = np.array([channel.edit_costs([t] * len(words), words, cfg, home) for t in typed])
            assert (known.bound(x, n, home) <= true).all()


def test_complete_and_split(spark):
    p = spark.createDataFrame([("en", "he"), ("en", "zz"), ("en", "")], "lang string, prefix string")
    assert [r.word for r in decode.complete(p, lex(spark)).orderBy("rk").collect()][0] in ("help", "hello", "hell")
    t = spark.createDataFrame([("ru", "небодом"), ("ru", "x")], "lang string, typed string")
    assert rows(decode.split_in_two(t, lex(spark)), "left", "right") == [("небо", "дом")]


def test_forms_share(spark):
    counts = spark.createDataFrame([("ru", "стол", 100), ("ru", "столы", 0)], "lang string, word string, count long")
    forms = spark.createDataFrame([("ru", "стол", "стол"), ("ru", "столы", "стол"), ("ru", "столам", "стол"), ("ru", "миг", "миг")], "lang string, form string, lemma string")
    assert rows(lexicon.with_forms(counts, forms), "word", "count") == [("миг", 1), ("стол", 100), ("столам", 2), ("столы", 2)]


def test_keep_words_glued(spark):
    counts = spark.createDataFrame([("ru", w, 500) for w in ("незнать", "знать", "ктото", "вобщем", "дом-", "слово")], "lang string, word string, count long")
    verbs = spark.createDataFrame([("ru", "знать")], "lang string, word string")
    assert rows(lexicon.keep_words(counts, verbs.limit(0), verbs, 100), "word") == [("знать",), ("слово",)]


def test_affixes(spark):
    stems = spark.createDataFrame([("try", ["A", "B"])], "word string, flags array<string>")
    rules = spark.createDataFrame([("A", "SFX", "y", "ied", "[^aeiou]y", True, []), ("B", "PFX", "", "re", ".", True, [])], "flag string, kind string, strip string, add string, condition string, cross boolean, next array<string>")
    assert rows(lexicon.expand_affixes(stems, rules), "form") == [("retried",), ("retry",), ("tried",), ("try",)]


def test_slang_and_compounds(spark):
    new = spark.createDataFrame([("ru", "кринж", "этаж", 5)], "lang string, word string, model string, count long")
    paradigm = spark.createDataFrame([("ru", "этаж", f) for f in ("этаж", "этажа", "этажом")], "lang string, lemma string, form string")
    assert rows(lexicon.inflect_by_analogy(new, paradigm), "form") == [("кринж",), ("кринжа",), ("кринжом",)]
    w = spark.createDataFrame([("de", "arbeitszimmer")], "lang string, word string")
    h = spark.createDataFrame([("de", "arbeit"), ("de", "zimmer")], "lang string, word string")
    assert rows(lexicon.compounds(w, h), "modifier", "head") == [("arbeit", "zimmer")]


def test_neighbours_break_at_signs(spark):
    s = spark.createDataFrame([(1, "en", "a b, c  d e")], "sent_id long, lang string, text string")
    assert rows(corpus.neighbours(s), "prev", "word") == [("a", "b"), ("d", "e")]


def test_comma_state(spark):
    s = spark.createDataFrame([(1, "ru", "и ветер, и град. он спит")], "sent_id long, lang string, text string")
    g = {(r.a, r.b): (r.comma, r["first"], r.and_before) for r in context.gaps(s).collect()}
    assert g == {("и", "ветер"): (False, True, False), ("ветер", "и"): (True, False, True), ("и", "град"): (False, False, False), ("он", "спит"): (False, True, False)}


def test_decision_list(spark):
    obs = spark.createDataFrame([("ru", "к", "ко", t, ["w+1=" + n]) for t, n, k in (("к", "дому", 12), ("ко", "мне", 12), ("к", "мне", 1)) for _ in range(k)], "lang string, a string, b string, truth string, features array<string>")
    got = {(r.feature, r.word) for r in context.decision_list(obs).collect()}
    assert got == {("w+1=дому", "к"), ("w+1=мне", "ко")}


def test_typos_are_drawn_once(spark):
    w = spark.createDataFrame([("en", "hello"), ("ru", "привет"), ("en", "a")], "lang string, word string")
    assert rows(evaluate.typos(w), "word", "kind", "typed") == rows(evaluate.typos(w.repartition(3)), "word", "kind", "typed")
    assert ("привет", "layout", "ghbdtn") in rows(evaluate.typos(w), "word", "kind", "typed")


def test_rules_and_closure(spark):
    facts = spark.createDataFrame([(f"c{i}", "lives", f"t{i % 3}") for i in range(30)] + [(f"t{j}", "in", "land") for j in range(3)] + [(f"c{i}", "of", "land") for i in range(25)], "s string, r string, o string")
    rules = {(r.head, r.body) for r in graph.mine_rules(facts).collect()}
    assert ("of", "lives in") in rules
    assert ("of", "lives in") not in {(r.head, r.body) for r in graph.mine_rules(facts, two=False).collect()}
    closed = graph.closure(facts, [("of", "lives in", 0.9)])
    assert rows(closed.where("s = 'c29' AND r = 'of'"), "o", "credence") == [("land", 0.9)]


def test_tree():
    score = np.full((4, 4), -5.0)
    for h, d in ((0, 2), (2, 1), (2, 3)):
        score[h, d] = 5.0
    assert graph.best_tree(score)[1:] == [2, 0, 2]
    assert graph.cut_long(["a", ";", "b", "c"], 2) == [(0, 2), (2, 4)]


def test_gesture(spark):
    keys = gesture.phone_keys("en")
    g = spark.createDataFrame([(1, "en", [(keys[c][0] + 0.1, keys[c][1] - 0.1) for c in "helo"])], "gid long, lang string, path array<struct<x:double,y:double>>")
    assert gesture.match(g, lex(spark), keys).where("rk = 1").first()["word"] == "hello"
    assert len(gesture.resample(np.zeros((0, 2)))) == gesture.POINTS


def test_marks(spark):
    e = marks.parse_rows(spark, [(1, "он/2/nsubj/PRON спал/0/root/VERB/fin когда/5/mark/SCONJ она/5/nsubj/PRON пришла/2/advcl/VERB/fin")])
    e = marks.with_reach(e, graph.spans(e))
    assert rows(marks.place(e), "before", "rule") == [(3, "subordinate")]


def test_auto_correct(spark):
    c = spark.createDataFrame([(1, "en", "helo", "hello", 1.5, 3.0, 1), (1, "en", "helo", "help", 3.0, 5.0, 2), (2, "en", "hell", "hell", 0.0, 2.0, 1), (3, "en", "Helo", "hello", 1.5, 3.0, 1)], "qid long, lang string, typed string, word string, edit double, cost double, rk int")
    assert rows(rerank.auto_correct(c, lex(spark)), "qid", "chosen") == [(1, "hello"), (2, "hell"), (3, "Hello")]


def test_empty_tables(spark):
    s = spark.createDataFrame([], "sent_id long, lang string, text string, source string")
    for df in (corpus.unigrams(s), corpus.pair_counts(s), corpus.token_totals(s), context.gaps(s), context.comma_table(context.gaps(s)), corpus.casing_counts(s)):
        assert df.count() == 0


EVENTS = [("s", t, a, k) for t, a, k in ((0, "down", "h"), (50, "up", "h"), (200, "down", "i"), (240, "down", "x"), (300, "up", "x"), (900, "down", " "), (950, "up", " "), (2000, "down", "a"), (2400, "up", "a"), (2500, "down", "\b"), (2550, "up", "\b"), (3000, "field", ""))]


def test_touch_machine(spark):
    df = spark.createDataFrame(EVENTS, "session string, ts_ms long, action string, key string")
    ops = [(r.op, r.text) for r in touch.batch(df).orderBy("seq").collect()]
    assert ops == [("composing", "h"), ("composing", "hi"), ("composing", "hix"), ("commit", "hix "), ("composing", "A"), ("delete", "1"), ("clear", "")]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(EVENTS + [("t", *e[1:]) for e in EVENTS], "session string, ts_ms long, action string, key string")
    df.write.parquet(str(tmp_path / "in"))
    q = touch.stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("ops").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert rows(spark.table("ops"), "session", "seq", "op", "text") == rows(touch.batch(df), "session", "seq", "op", "text")


def test_antecedents(spark):
    n = spark.createDataFrame([(1, 1, "f", "s"), (1, 2, "f", "s"), (1, 3, "m", "s")], "id int, pos int, gender string, number string")
    p = spark.createDataFrame([(1, 5, "f", "s")], "id int, pos int, gender string, number string")
    assert rows(graph.antecedents(n, p), "noun_pos", "p") == [(1, 0.5), (2, 0.5)]


def test_suite(spark):
    e = spark.createDataFrame([("k", "c1", "a"), ("k", "c2", "b")], "kind string, case string, answer string")
    got = spark.createDataFrame([("c1", "a"), ("c2", "x")], "case string, answer string")
    known = spark.createDataFrame([("c2",)], "case string")
    assert rows(evaluate.suite(e, got, known), "n", "right_n", "new_failures") == [(2, 1, 0)]
