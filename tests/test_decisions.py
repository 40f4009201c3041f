"""Decisions over candidates, rules over facts, drawn words, marks, and what the store and SQL offer, on small fixtures."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.config import Config
from lexloom.functions import sql as Q
from lexloom.operators import context, decode, gesture, graph, lexicon, marks, rerank
from lexloom.operators import vectors as V
from lexloom.operators.channel import codes, edit_costs
from lexloom.sources import store
from lexloom.tables import rank_all


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


CANDS = "qid long, lang string, typed string, word string, edit double, cost double"
WORDS = [("en", "hell"), ("en", "hello"), ("en", "help"), ("en", "walk"), ("en", "walked")]


def corrected(spark, cands, strength="normal", **more):
    known = spark.createDataFrame(WORDS, "lang string, word string")
    return {r.qid: r.chosen for r in rerank.auto_correct(spark.createDataFrame(cands, CANDS), known, strength, **more).collect()}


def test_limits_of_each_strength(spark):
    # five letters, 6.0 for the typing: 1.2 a letter; 0.9 ahead of the next
    c = [(1, "en", "heloo", "hello", 6.0, 7.0), (1, "en", "heloo", "help", 6.5, 7.9)]
    assert {s: corrected(spark, c, s)[1] for s in ("careful", "normal", "bold", "always")} == {"careful": "heloo", "normal": "hello", "bold": "hello", "always": "hello"}
    near = [(1, "en", "heloo", "hello", 3.0, 7.0), (1, "en", "heloo", "help", 3.0, 7.5)]
    assert {s: corrected(spark, near, s)[1] for s in ("careful", "normal", "bold", "always")} == {"careful": "heloo", "normal": "heloo", "bold": "hello", "always": "hello"}


def test_a_known_word_is_guarded(spark):
    slip = lambda edit, lead: [(1, "en", "hell", "hell", 0.0, 5.0), (1, "en", "hell", "hello", edit, 5.0 - lead)]
    assert corrected(spark, slip(1.5, 2.0)) == {1: "hello"} and corrected(spark, slip(1.5, 1.2)) == {1: "hell"} and corrected(spark, slip(3.0, 2.0)) == {1: "hell"}
    assert corrected(spark, slip(3.0, 2.0), "always") == {1: "hello"}
    no_own = [(1, "en", "hell", "hello", 1.0, 1.0)]
    assert corrected(spark, no_own) == {1: "hell"}


def test_shapes_that_are_left_alone(spark):
    one = lambda typed, word="hello", edit=1.0: [(1, "en", typed, word, edit, 2.0)]
    assert corrected(spark, one("HeLlo")) == {1: "HeLlo"} and corrected(spark, one("helllo")) == {1: "helllo"} and corrected(spark, one("h")) == {1: "h"}
    assert corrected(spark, one("hlp", "help", 3.0)) == {1: "help"} and corrected(spark, one("hlp", "help", 3.6)) == {1: "hlp"}
    assert corrected(spark, one("Helo")) == {1: "Hello"}


def test_completions_rejections_and_forms(spark):
    c = [(1, "en", "walke", "walk", 2.0, 6.0), (2, "en", "walk", "walk", 0.0, 5.0)]
    more = spark.createDataFrame([(1, "walked", 0.7, 4.0), (1, "walkedxyz", 2.8, 1.0), (2, "walked", 1.4, 1.0)], "qid long, word string, edit double, cost double")
    assert corrected(spark, c, completions=more) == {1: "walked", 2: "walk"}
    rejected = spark.createDataFrame([("walke", "walked")], "typed string, word string")
    assert corrected(spark, c, completions=more, rejected=rejected)[1] == "walk"
    fits = spark.createDataFrame([(2, "walk", -2.0), (2, "walked", 1.0)], "qid long, word string, fit double")
    assert corrected(spark, c, completions=more, fits=fits)[2] == "walked"
    assert corrected(spark, c[:0]) == {}


def test_split_with_a_slipped_space(spark):
    lex = lexicon.priors(spark.createDataFrame([("ru", w, 100) for w in ("привет", "как", "я", "дом", "приветкак2")] + [("de", w, 50) for w in ("a", "haus")], "lang string, word string, count long"))
    typed = spark.createDataFrame([("ru", t) for t in ("приветькак", "приветкак", "ядом", "дом", "фдом", "привет")] + [("de", "ahaus"), (None, "x"), ("ru", None), ("ru", "")], "lang string, typed string")
    got = {r.typed: (r.left, r.right) for r in decode.split_in_two(typed, lex).collect()}
    assert got == {"приветькак": ("привет", "как"), "приветкак": ("привет", "как"), "ядом": ("я", "дом")}


def test_blocked_words_stay_when_typed(spark):
    c = spark.createDataFrame([("en", "bad", "bad", 1), ("en", "bed", "bad", 2), ("en", "bed", "bed", 3)], "lang string, typed string, word string, n int")
    assert rows(decode.without_blocked(c, spark.createDataFrame([("en", "bad")], "lang string, word string")), "n") == [(1,), (3,)]


def test_rules_against_brute_force(spark):
    """Relations with one and with several objects, self-loops on the way, and paths that end where they began."""
    rng = random.Random(4)
    facts = {(f"a{rng.randrange(12)}", r, f"{o}{rng.randrange(6)}") for r, o in (("p", "a"), ("q", "b"), ("p", "b")) for _ in range(25)}
    facts |= {(f"a{i}", "one", f"b{i % 3}") for i in range(12)} | {(f"b{i}", "up", "c") for i in range(6)} | {(f"a{i}", "to", "c") for i in range(9)}
    step = {}
    for s, r, o in facts:
        step.setdefault(r, set()).add((s, o))
        step.setdefault("~" + r, set()).add((o, s))
    body = {name: set(pairs) for name, pairs in step.items()}
    for x, y in product(step, repeat=2):
        if pairs := {(a, d) for a, b in step[x] for c, d in step[y] if b == c and a != d}:
            body[f"{x} {y}"] = pairs
    heads = {r: {(s, o) for s, k, o in facts if k == r} for _, r, _ in facts}
    size, pca, support = graph._body_counts(spark.createDataFrame(sorted(facts), "s string, r string, o string"), True)
    assert dict(rows(size)) == {k: len(v) for k, v in body.items()}
    want = {(h, k): (len([p for p in v if p[0] in {s for s, _ in hs}]), len(v & hs)) for h, hs in heads.items() for k, v in body.items()}
    assert {(h, k): n for h, k, n in rows(pca)} == {k: n for k, (n, _) in want.items() if n}
    assert {(h, k): n for h, k, n in rows(support)} == {k: n for k, (_, n) in want.items() if n}


def test_exceptions_by_code_length(spark):
    birds = [(f"b{i}", "is", "bird") for i in range(40)] + [("bird", "does", "fly")]
    flies = [(f"b{i}", "can", "fly") for i in range(30)] + [(f"b{i}", "can", "swim") for i in range(30, 40)]
    odd = [(f"b{i}", "lives", "ice") for i in range(30, 40)]
    facts = spark.createDataFrame(birds + flies + odd, "s string, r string, o string")
    e = graph.exceptions(facts, [("can", "is does")]).first()
    assert (e.side, e.how, e.rel, e.n, e.k, e.rest_n, e.rest_k, e.pays) == ("X", "has", "lives", 10, 0, 30, 30, True)
    assert abs(e.base - graph.code_bits(40, 30)) < 1e-6
    kept = graph.closure(facts.where("r <> 'can'"), [("can", "is does", 0.9, ("X", "has", "lives"))]).where("r = 'can'")
    assert kept.count() == 30 and graph.closure(facts.where("r <> 'can'"), [("can", "is does", 0.9)]).where("r = 'can'").count() == 40


def test_closure_follows_long_chains_and_keeps_what_was_given(spark):
    facts = spark.createDataFrame([(f"n{i}", "next", f"n{i + 1}") for i in range(9)] + [("n0", "before", "n2")], "s string, r string, o string")
    got = {(r.s, r.o): r.credence for r in graph.closure(facts, [("before", "next", 0.5), ("before", "before next", 0.5)]).where("r = 'before'").collect()}
    assert len(got) == 45 and got["n0", "n2"] == 1.0 and got["n0", "n1"] == 0.5 and got["n0", "n3"] == 0.5 and abs(got["n1", "n9"] - 0.5**8) < 1e-9


def test_parts_of_deep_and_circular_parses(spark):
    deep = [(1, i, f"w{i}", i - 1, "root" if i == 1 else "obl") for i in range(1, 101)]
    circle = [(2, 1, "a", 0, "root"), (2, 2, "b", 3, "obl"), (2, 3, "c", 2, "obl"), (2, 4, "d", 1, "conj"), (2, 5, "e", 4, "obj")]
    e = spark.createDataFrame(deep + circle, "id long, pos int, word string, head int, rel string")
    got = {(r.id, r.pos): r.part for r in graph.parts(e).collect()}
    assert all(got[1, i] == 1 for i in range(1, 101)) and [got[2, i] for i in range(1, 6)] == [1, 0, 0, 4, 4]


def test_ranks_of_a_hot_group(spark):
    rng = random.Random(1)
    data = [("hot", rng.randrange(50), f"w{i}") for i in range(3000)] + [("cold", 1, "a"), ("cold", 2, "b"), (None, 7, "z")]
    df = spark.createDataFrame(data, "g string, n int, word string").repartition(7)
    got = {(r.g, r.word): r.rk for r in rank_all(df, F.desc("n"), F.asc("word"), by=("g",), first=1).collect()}
    order = sorted((r for r in data if r[0] == "hot"), key=lambda r: (-r[1], r[2]))
    assert all(got["hot", r[2]] == i for i, r in enumerate(order, 1)) and got["cold", "b"] == 1 and got["cold", "a"] == 2
    assert rank_all(df.limit(0), F.desc("n"), by=("g",)).count() == 0


def plain_walk(held, w, points, paced, near, cfg):
    """One word along a path, letter by letter."""
    ks = held.centres[held.keys[w, : held.lengths[w]]]
    away = lambda p, q: float(np.hypot(*(p - q)))
    slack = int(np.clip(np.ceil(1.0 / max(np.hypot(*np.diff(points, axis=0).T).sum() / 39, 1e-3)), 4, 13))
    j = geo = time = 0
    for t, key in enumerate(ks):
        at = next((k for k in range(j, 40) if away(points[k], key) <= near), None)
        if at is None or (t == 0 and at > slack):
            return None
        while at < 39 and away(points[at + 1], key) < away(points[at], key):
            at += 1
        stray = max([away(points[k], key) if t == 0 else float(gesture.point_to_segment(points[k], ks[t - 1], key)) for k in range(j, at)], default=0.0)
        geo += away(points[at], key) ** 2 + stray**2
        if paced is not None and t:
            lo, hi = j + 3, max(at - 2, 0)
            time += (paced[0][hi] - paced[0][lo] if lo < hi else 0.0) + paced[1][at]
        j = at
    if j + slack < 39:
        return None
    geo += max(away(points[k], ks[-1]) for k in range(j, 40)) ** 2
    return cfg.gesture_walk * geo + cfg.gesture_pace * time + cfg.w_lm * held.priors[w] / 1000, time


def test_walk_against_one_word_at_a_time():
    rng, cfg, keys = np.random.default_rng(2), Config(), gesture.phone_keys("en")
    words = ["".join(rng.choice(list("aeinorst"), rng.integers(2, 8))) for _ in range(400)]
    held = gesture.Words(words, rng.integers(0, 9000, 400).astype(float), keys)
    found = 0
    for _ in range(25):
        corners = np.array([keys[c] for c in words[rng.integers(400)]]) + rng.normal(0, 0.25, (1, 2))
        path = gesture.resample(corners, 60) + rng.normal(0, 0.05, (60, 2))
        paced = gesture.pace(path, np.cumsum(rng.integers(5, 40, 60)).astype(float))
        points = gesture.resample(path)
        for near in (gesture.NEAR, gesture.NEAR_WIDE):
            w, time = held.walk(points, paced, near, cfg)
            all_ = {i: x for i in range(len(held.of)) if (x := plain_walk(held, i, points, paced, near, cfg))}
            best = sorted(all_, key=lambda i: (all_[i][0], i))[: gesture.KEEP]
            assert w.tolist() == best and np.allclose(time, [all_[i][1] for i in best])
            found += len(best)
    assert found > 100


def test_a_stop_on_the_way_is_a_letter():
    """Two words along one straight way; a finger that stops at the letter between means the longer one."""
    keys = {"a": (0.0, 0.0), "b": (3.0, 0.0), "c": (6.0, 0.0)}
    held = gesture.Words(["ac", "abc"], np.array([5000.0, 5000.0]), keys)
    x = np.linspace(0, 6, 61)
    even, stop = np.arange(61) * 10.0, np.arange(61) * 10.0 + 400.0 * (np.arange(61) > 30)
    path = np.stack([x, np.zeros(61)], 1)
    best = lambda times: held.decode(path, times, 1e9, Config())
    cost = lambda times: dict(zip(best(times)[0].tolist(), best(times)[2].tolist()))
    assert cost(stop)[0] - cost(stop)[1] > 1.0 > abs(cost(even)[0] - cost(even)[1])


def test_tree_of_words_prices_all_within_and_no_beginning_twice():
    cfg = Config()
    words = ["cœur", "coeur", "cour", "cours", "court", "courte", "cou", "été", "ete", "a", "тся", "тьс", "мыться", "моется", "þa", "xþ"]
    lex, said = decode._Lexicon(words, cfg), ["coeru", "courr", "ctoue", "étée", "мытся", "мытьс"]
    for t in said:
        for home in (False, True):
            x, every = codes([t], len(t)), edit_costs([t] * len(words), words, cfg, home)
            for most in (3.0, 7.0, 30.0):
                _, w, e = lex.within(x, np.array([most]), home, np.ones((1, len(words)), bool))
                assert dict(zip(w.tolist(), e.tolist())) == {i: v for i, v in enumerate(every.tolist()) if v <= most}
    assert sum(map(len, lex.letter)) == len({w[:k] if "þ" not in w else (w, k) for w in words for k in range(1, len(w) + 1)})


def test_paths_that_match_nothing(spark):
    g = spark.createDataFrame([(1, "en", []), (2, "en", None), (3, "en", [(1.0, 1.0)]), (4, "xx", [(1.0, 1.0), (2.0, 2.0)]), (5, "en", [(0.0, 0.0), (0.0, 0.0)])], "gid long, lang string, path array<struct<x:double,y:double>>")
    lex = lexicon.priors(spark.createDataFrame([("en", "hello", 5)], "lang string, word string, count long"))
    assert gesture.match(g, lex).count() == 0 == gesture.match(g.limit(0), lex).count() == gesture.match(g, lex.limit(0)).count()


def put(spark, *sentences):
    e = marks.parse_rows(spark, list(enumerate(sentences)))
    return {(r.id, r.before): r.rule for r in marks.place(marks.with_reach(e, graph.spans(e))).collect()}


def test_mark_rules(spark):
    got = put(
        spark,
        "кстати/2/advmod/ADV пришёл/0/root/VERB/fin брат/2/nsubj/NOUN",
        "ура/2/discourse/INTJ мы/3/nsubj/PRON победили/0/root/VERB/fin",
        "он/2/nsubj/PRON сидел/0/root/VERB/fin сложа/2/advcl/VERB/conv руки/3/obj/NOUN",
        "он/2/nsubj/PRON ушёл/0/root/VERB/fin хлопнув/2/advcl/VERB/conv дверью/3/obl/NOUN",
        "дождь/2/nsubj/NOUN будет/0/root/VERB/fin сказал/2/parataxis/VERB/fin дед/3/nsubj/NOUN",
        "это/3/nsubj/PRON честно/4/advmod/ADV говоря/4/advcl/VERB странно/0/root/ADV",
        "по/2/case/ADP данным/4/obl/NOUN погоды/2/nmod/NOUN идёт/0/root/VERB/fin дождь/4/nsubj/NOUN",
        "он/2/nsubj/PRON пришёл/0/root/VERB/fin но/4/cc/CCONJ ушёл/2/conj/VERB/fin",
    )
    want = {(0, 2): "aside first", (1, 2): "interjection first", (3, 3): "gerund", (4, 3): "said", (5, 2): "set aside", (6, 4): "set phrase", (7, 3): "adversative"}
    assert {k: got.get(k) for k in want} == want and not [k for k in got if k[0] == 2]


def test_marks_are_found_within_their_sentences(spark):
    """A row for each sentence gives what its edges give, without a join and with the one shuffle that drops repeated sentences."""
    sents = spark.createDataFrame([(1, "он пришёл но ушёл"), (2, "дождь будет сказал дед"), (3, "по данным погоды идёт дождь"), (4, "..."), (5, ""), (1, "он пришёл но ушёл")], "sent_id long, text string")
    e = graph.shallow(sents)
    e = marks.with_reach(e, graph.spans(e))
    got = marks.of_sentences(graph.shallow_sentences(sents))
    assert rows(got) == rows(marks.place(e).union(marks.dashes(e))) and (3, 3) in {(r.id, r.before) for r in got.collect()}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1


def test_end_marks(spark):
    e = marks.parse_rows(spark, [(1, "где/2/advmod/ADV живёт/0/root/VERB"), (2, "он/2/nsubj/PRON живёт/0/root/VERB"), (3, "с/2/case/ADP другом/4/obl/NOUN каким/2/det/DET идёт/0/root/VERB"), (4, "разве/2/advmod/PART придёт/0/root/VERB"), (5, "знает/0/root/VERB что/3/mark/SCONJ придёт/1/ccomp/VERB")])
    assert rows(marks.end_marks(e)) == [(1, "?"), (2, "."), (3, "?"), (4, "?"), (5, ".")]


def test_evidence_by_sound_and_ties(spark):
    typed = spark.createDataFrame([(1, "ru", "о", "об", "этом"), (2, "ru", "о", "об", "доме"), (3, "ru", "об", "о", "этом"), (4, "en", "then", "than", "you"), (5, "en", "then", "than", None)], "id int, lang string, typed string, alt string, next string")
    rules = spark.createDataFrame([("en", "than", "then", "w+1=you", "than", 900), ("en", "than", "then", "w+1=you", "then", 900)], "lang string, a string, b string, feature string, word string, strength_milli int")
    assert rows(context.evidence(typed, rules)) == [(1, 6000), (4, 900)]


def test_store_and_user_words(spark, tmp_path):
    p = spark.createDataFrame([("en", i, 1000 + (i * 37) % 500) for i in range(5000)], "lang string, place int, prior_milli int")
    got = {(r.block, r.level): r.least for r in store.prior_blocks(p).collect()}
    assert len([k for k in got if k[1] == 0]) == 79 and len([k for k in got if k[1] == 1]) == 2 and got[0, 0] == min(1000 + (i * 37) % 500 for i in range(64))
    w = V.random_weights(20)
    store.write_weights(spark, w, str(tmp_path / "w"))
    back = store.read_weights(spark, str(tmp_path / "w"))
    assert back.keys() == w.keys() and all(back[k].shape == w[k].shape and np.abs(back[k] - w[k]).max() <= np.abs(w[k]).max() / 127 for k in w)
    own = spark.createDataFrame([("ok",), ("old",)], "word string")
    changes = spark.createDataFrame([("new", 1, True), ("old", 2, False), ("12", 3, True), ("x" * 40, 4, True), ("gone", 5, True), ("gone", 6, False)], "word string, at int, add boolean")
    assert rows(store.user_words(own, changes)) == [("new",), ("ok",)]


def test_sql_functions(spark):
    Q.register(spark)
    spark.createDataFrame([("Hello, мир", "helo", "hello"), (None, None, "x"), ("", "", "x")], "t string, a string, b string").createOrReplaceTempView("sql_fixture")
    got = spark.sql("SELECT edit_cost(a, b) AS e, left_class(b) AS l FROM sql_fixture ORDER BY t NULLS LAST").collect()
    assert got[0].e is None and got[1].e > 0 and got[2].e is None and got[1].l == "*lo"
    assert [r.token for r in spark.sql("SELECT token FROM sql_fixture, LATERAL tokenize(t) ORDER BY pos").collect()] == ["hello", ",", " ", "мир"]


def test_a_cluster_needs_a_named_folder(spark):
    from lexloom import tables

    class Far:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://far:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(Far)


def test_an_undone_fix_does_not_come_again():
    from lexloom.streaming import touch

    state, fixes = touch.fresh(), {"helo": "hello"}

    def press(keys, at):
        out = []
        for i, k in enumerate(keys):
            out += touch.step(state, at + 200 * i, "down", k, fixes) + touch.step(state, at + 200 * i + 50, "up", k, fixes)
        return [o for o in out if o[0] != "composing"]

    assert press("helo ", 0) == [("commit", "hello ")] and press("\b", 5000) == [("replace", "helo ")]
    assert press("helo ", 9000) == [("commit", "helo ")] and state["words"] == ["helo", "helo"] and state["rejected"] == [["helo", "hello"]]
    touch.step(state, 20_000, "copy", "text", fixes)
    assert touch.step(state, 100_000, "paste", "") == [("commit", "text")] and touch.step(state, 200_000, "paste", "") == [] and state["clips"] == []
