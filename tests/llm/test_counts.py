import random
from collections import Counter, defaultdict

from lexloom.llm import cooccur, frequency, mixing, overlap

SENT = "sent_id long, lang string, text string, source string, split string"


def test_mix(spark):
    rows = [(1, "en", "aaaa", "A "), (1, "en", "aaaa", "a"), (2, "en", None, "a"), (3, "en", "bb", "B"), (4, "en", "cc", None), (5, "en", "dddd", "other"), (None, "en", "zzz", "a"), (6, "en", "", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "sent_id long, lang string, text string, source string, rate int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1), ("none", None, None)], "source string, weight double, max_repeat long")
    recs = mixing.records(df)
    plan = mixing.mix_plan(recs, targets)
    got = {r.source: (r.records, r["size"], r.mix, r.rate, r.short) for r in plan.collect()}
    assert got == {"a": (2, 4, 6, 0.75, False), "b": (2, 2, 6, 1.0, True), "none": (0, 0, 6, 0.0, False)}
    emitted = mixing.mix_emit(recs, plan)
    assert {r.id for r in emitted.collect()} <= {1, 2, 3, 6} and emitted.where("source = 'b'").count() == 2


def test_mix_repeats_within_the_cap_and_meets_its_shares(spark):
    df = spark.createDataFrame([(i, "x" * 10, "big" if i < 3000 else "small") for i in range(3600)], "sent_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3)], "source string, weight double, max_repeat long")
    recs = mixing.records(df)
    plan = mixing.mix_plan(recs, targets)
    out = mixing.mix_emit(recs, plan, seed=1)
    assert out.groupBy("id").count().agg({"count": "max"}).first()[0] <= 3
    share = {r.source: r.share for r in mixing.mix_report(recs, plan, seed=1).collect()}
    assert abs(share["small"] - 0.4) < 0.03 and abs(share["big"] - 0.6) < 0.03
    again = mixing.mix_emit(recs.repartition(7), plan, seed=1)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_mix_carries_the_texts(spark):
    rows = [(i, f"text {i}", "a" if i % 3 else "b", i) for i in range(60)] * 2
    df = spark.createDataFrame(rows, "sent_id long, text string, source string, copy int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 4)], "source string, weight double, max_repeat long")
    recs = mixing.records(df, keep=("text",))
    out = mixing.mix_emit(recs, mixing.mix_plan(mixing.records(df), targets), targets=2).collect()
    assert all(r.text == f"text {r.id}" for r in out) and len({(r.id, r.copy) for r in out}) == len(out)


def test_mix_refilled(spark):
    """What a source at its cap leaves is shared by weight, step by step; a mix that no caps can fill stays short."""
    sizes = {"a": 100, "b": 300, "c": 50, "d": 550}
    weights = {"a": (0.4, 2), "b": (0.3, 1), "c": (0.1, 1), "d": (0.2, 2)}
    df = spark.createDataFrame([(f"{s}{i}", "x", s) for s, n in sizes.items() for i in range(n)], "sent_id string, text string, source string")
    targets = spark.createDataFrame([(s, *w) for s, w in weights.items()], "source string, weight double, max_repeat long")
    caps, left, level = {s: sizes[s] * weights[s][1] for s in sizes}, dict(weights), 1000.0
    while True:  # brute force: cap, share out, again
        level = (1000 - sum(caps[s] for s in sizes if s not in left)) / sum(w for w, _ in left.values())
        full = [s for s, (w, _) in left.items() if w * level > caps[s]]
        if not full:
            break
        for s in full:
            del left[s]
    got = {r.source: r.rate for r in mixing.mix_plan(mixing.records(df), targets, refill=True).collect()}
    assert all(abs(got[s] - min(weights[s][0] * level, caps[s]) / sizes[s]) < 1e-9 for s in sizes) and abs(sum(got[s] * sizes[s] for s in sizes) - 1000) < 1e-6
    low = targets.withColumn("max_repeat", F_one())
    assert {r.source: r.rate for r in mixing.mix_plan(mixing.records(df), low, refill=True).collect()} == dict.fromkeys(sizes, 1.0)


def F_one():
    from pyspark.sql import functions as F

    return F.lit(1).cast("long")


def test_mix_of_empty_tables(spark):
    df = spark.createDataFrame([], "sent_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeat long")
    recs = mixing.records(df)
    assert [r.short for r in mixing.mix_plan(recs, targets).collect()] == [False]
    assert mixing.mix_emit(recs, mixing.mix_plan(recs, targets.limit(0))).count() == 0


def invented(n, seed=0):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "re", "tu", "sa") for b in ("na", "bo", "di", "fe")]
    out = []
    for i in range(n):
        text = " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randrange(0, 9)))
        out.append((i, rng.choice(["en", "de"]), text if rng.random() > 0.05 else None, "s", "test" if i % 10 == 0 else "train"))
    return out + [r for r in out if r[0] % 7 == 0]


def test_frequencies_against_brute_force(spark):
    rows = invented(400)
    once = {r[0]: r for r in rows if r[2]}
    occ, recs = Counter(), Counter()
    for _, lang, text, *_ in once.values():
        words = text.split()
        occ.update((lang, w) for w in words)
        recs.update({(lang, w) for w in words} | ({(lang, "")} if words else set()))
    df = spark.createDataFrame(rows, SENT).repartition(5)
    got = {(r.lang, r.term): (r.occurrences, r.records) for r in frequency.term_counts(df).collect()}
    assert {k: v for k, v in got.items() if k[1]} == {k: (occ[k], recs[k]) for k in recs if k[1]}
    assert {k: v[1] for k, v in got.items() if not k[1]} == {k: recs[k] for k in recs if not k[1]}


def test_runs_cut_by_partitions_and_batches_add_up(spark):
    """A term of every record, over more partitions than terms and batches of three rows."""
    rows = [(i, "en", "all" + " all" * (i % 3) + (" some" if i % 4 == 0 else ""), "s", "train") for i in range(300)] * 2
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        got = {r.term: (r.occurrences, r.records) for r in frequency.term_counts(spark.createDataFrame(rows, SENT).repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    assert got == {"": (300, 300), "all": (600, 300), "some": (75, 75)}


def test_range_bounds_split_a_hot_term(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, "en", "hot " + ("cold" if i % 9 else "mild")) for i in range(2000)], "record long, lang string, text string")
    keys, records = frequency.range_bounds(df, 2000, 8)
    assert len(keys) == 7 and keys.count("hot\ten") >= 2
    rows = df.mapInArrow(frequency._rows(spark.sparkContext.broadcast((keys, records))), frequency.ROWS)
    sizes = {r.part: r.n for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) < 2 * 6000 / 8


def test_marks_of_terms(spark):
    df = spark.createDataFrame([(i, "en", "the " + ("odd" if i == 0 else "and") + (" many" * i if i < 5 else ""), "s", "train") for i in range(10)], SENT)
    lex = spark.createDataFrame([("en", "The", 5), ("en", "odd", 3), ("en", "odd", 50), ("en", "never", None), ("en", "two words", 1), ("en", None, 1), ("en", "", 1), ("en", "o​dd", 1), (None, "odd", 1)], "lang string, w string, c long")
    got = {(r.lang, r.term): r.mark for r in frequency.term_usefulness(frequency.term_counts(df), frequency.lexicon_terms(lex)).collect()}
    assert got == {("en", "the"): "common", ("en", "odd"): None, ("en", "never"): "rare", ("", "odd"): "rare"}
    assert frequency.term_counts(df.limit(0)).count() == 0


def test_overlaps_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" + "x" * (i % 5) for i in range(120)]
    rows = []
    for i in range(300):
        words = rng.sample(vocabulary, rng.randrange(1, 16))
        rows.append((i, "en", " ".join(words), "s", "train"))
    for i in range(300, 420):
        words = rows[rng.randrange(300)][2].split()
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, "ru" if False else "de", " ".join(words).upper() + "!", "s", rng.choice(["test", "valid"])))
    rows += [(500, "en", " ".join(vocabulary[:70]), "s", "train"), (501, "en", " ".join(vocabulary[:62]), "s", "test"), (502, "en", " ".join(vocabulary[:64]), "s", "valid"), (503, "en", "... 12", "s", "test"), (504, "en", None, "s", "test"), (505, "en", "", "s", "train"), (506, "en", "one", "s", "test"), (507, "en", "One.", "s", "train"), (506, "en", "one", "s", "test"), (None, "en", "one", "s", "test")]
    sets = {r[0]: set(r[2].lower().replace("!", "").replace(".", "").split()) for r in rows if r[0] is not None and r[2] and r[2] != "... 12"}
    held = {r[0] for r in rows if r[4] != "train" and r[0] in sets}
    want = {(a, b) for a in held for b in sets.keys() - held if 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, SENT)
    for bound in (2_000_000, 0):
        got = [(r.held_id, r.train_id) for r in overlap.overlaps(overlap.records(df), most_kept=bound).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 60
    least = {}
    for i in sorted(sets):
        least.setdefault(frozenset(sets[i]), i)
    links = Counter(a for a, _ in want) + Counter(b for _, b in want)
    got = {(r.id, r.held): (r.class_id, r.links) for r in overlap.overlap_classes(overlap.records(df)).collect()}
    assert got == {(i, i in held): (least[frozenset(sets[i])], links[i]) for i in sets}
    report = overlap.overlap_report(df, spark.createDataFrame(sorted(want), "held_id long, train_id long"))
    assert sum(r.links for r in report.collect()) == len(want)
    assert overlap.overlaps(overlap.records(df.limit(0))).count() == 0


def test_signatures_meet_at_every_size():
    """Two sets of any sizes with the least overlap, their words in the worst of many orders, share a signature."""
    rng = random.Random(3)

    def signatures(words, order):
        ws = sorted(words, key=order.__getitem__)[: overlap.first_words(len(words), 7, 10)]
        return {frozenset(words)} | {(ws[i], ws[j]) for i in range(len(ws)) for j in range(i + 1, min(len(ws), i + 1 + overlap.REACH))}

    for n in [*range(1, 40), 60, 64, 65, 90, 150, 400]:
        for m in {-(-7 * n // 10), n, (8 * n + 9) // 10, 10 * n // 7}:
            o = -(-7 * (n + m) // 17)
            if o > min(n, m) or 10 * o < 7 * (n + m - o):
                continue
            both, a, b = range(o), range(o, n), range(n, n + m - o)
            for k in range(30 if n < 100 else 5):
                rank = list(range(n + m - o))
                rng.shuffle(rank)
                if k == 0:
                    rank.sort(key=lambda w: w < o)  # words of one side only come first
                if k == 1 and o < n + m - o:  # they are spread between the shared words
                    rank.sort(key=lambda w: w * (n + m - o) / o if w < o else (w - o) * (n + m - o) / (n + m - 2 * o))
                order = {w: i for i, w in enumerate(rank)}
                assert signatures({*both, *a}, order) & signatures({*both, *b}, order), (n, m, k)


def test_hot_copies_and_a_long_text(spark):
    long = [f"w{i:05d}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(3000)]
    rows = [(i, "en", "the same five words here", "s", "train") for i in range(3000)] + [(5000 + i, "en", "The same five words HERE!", "s", "test") for i in range(3)]
    rows += [(6000, "en", " ".join(long), "s", "train"), (6001, "en", " ".join(long[300:]), "s", "test"), (6002, "en", " ".join(long[1000:]), "s", "valid")]
    got = overlap.overlaps(overlap.records(spark.createDataFrame(rows, SENT).repartition(4)))
    assert got.where("held_id < 6000").count() == 9000 and {(r.held_id, r.train_id) for r in got.where("held_id >= 6000").collect()} == {(6001, 6000)}


def test_together_against_brute_force(spark):
    rows = invented(600, 1)
    bags = defaultdict(dict)
    for i, lang, text, *_ in rows:
        if text:
            bags[lang][i] = set(text.split())
    terms = {w for b in bags.values() for s in b.values() for w in s if w != "kana"}
    want = set()
    for lang, recs in bags.items():
        recs = [s for s in recs.values() if s]
        n, own = len(recs), Counter(w for s in recs for w in s)
        both = Counter((a, b) for s in recs for a in s for b in s if a < b and {a, b} <= terms)
        want |= {(lang, a, b, n, own[a], own[b], k) for (a, b), k in both.items() if k >= 5 and 1000 * k >= 3 * n and 10 * k * n >= 11 * own[a] * own[b]}
    df = spark.createDataFrame(rows, SENT)
    lex = spark.createDataFrame([(lang, t) for lang in bags for t in terms], "lang string, term string")
    got = cooccur.together(df, lex, lift=1).collect()
    assert {(r.lang, r.w_a, r.w_b, r.n, r.n_a, r.n_b, r.n_ab) for r in got if 10 * r.n_ab * r.n >= 11 * r.n_a * r.n_b} == want and want
    assert cooccur.together(df.limit(0), lex).count() == 0
    assert sorted(map(tuple, cooccur.together(df, lex, lift=1, most_items=3).collect())) == sorted(map(tuple, got))


def test_gram_by_blocks(monkeypatch):
    import numpy as np

    rng = random.Random(2)
    rows = [sorted(rng.sample(range(40), rng.randrange(0, 12))) for _ in range(200)]
    want = Counter((a, b) for r in rows for i, a in enumerate(r) for b in r[i:])
    for cells, held, pairs in ((1 << 22, 1 << 25, 1 << 20), (120, 1000, 1 << 20), (120, 1000, 7), (1 << 22, 100, 50)):
        for name, value in (("BLOCK_CELLS", cells), ("MOST_BYTES", held), ("PAIRS", pairs)):
            monkeypatch.setattr(cooccur, name, value)
        g, got = cooccur.Gram(40), Counter()
        given = [*g.add(np.cumsum([0, *map(len, rows)]), np.array([x for r in rows for x in r])), *g.cells()]
        for part in given:
            for a, b, n in zip(*part):
                got[int(a), int(b)] += int(n)
        assert got == want and (held > 1000 or len(given) > 1)


def test_gram_of_many_items_stays_small():
    """20,000 items that all meet, 1.6 million pairs a block of records: what a task holds stays under its bound and a block's work."""
    import tracemalloc

    import numpy as np

    rng, g, pairs = np.random.default_rng(0), cooccur.Gram(20_000), 0
    tracemalloc.start()
    for _ in range(6):
        rows = [np.unique(rng.integers(0, 20_000, 20)) for _ in range(cooccur.BLOCK_ROWS)]
        for _, _, n in g.add(np.cumsum([0, *map(len, rows)]), np.concatenate(rows)):
            pairs += int(n.sum())
        pairs -= sum(len(r) * (len(r) + 1) // 2 for r in rows)
    pairs += sum(int(n.sum()) for _, _, n in g.cells())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs == 0 and peak < 500e6, peak
