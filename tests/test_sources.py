import bz2
import io
import json
import struct
import tarfile

import pytest

from lexloom.operators import lexicon
from lexloom.sources import lists, store


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols or df.columns).collect())


def put(tmp_path, name, data):
    p = tmp_path / name
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(p)


def test_lists(spark, tmp_path):
    assert rows(lists.frequency_list(spark, put(tmp_path, "f.txt", "Дом 5\nдом 9\nx\nтом many\n"))) == [("дом", 9)]
    put(tmp_path, "a.lst", "été\n Mer \n\n".encode("latin-1"))
    assert rows(lists.word_list(spark, str(tmp_path / "a.lst"))) == [("mer",), ("été",)]
    assert rows(lists.unmunched(spark, put(tmp_path, "k.txt", "Дом\nкот\n".encode("koi8-r")))) == [("дом",), ("кот",)]
    assert rows(lists.forms(spark, put(tmp_path, "forms.tsv", "дома\tдом\nброк\n"))) == [("дома", "дом")]
    assert rows(lists.extra_list(spark, put(tmp_path, "e.tsv", "# c\nлол\t5\tx\n1\t2\nok\tno\n"))) == [("лол", 5)]
    assert rows(lists.first_forms(spark, put(tmp_path, "d.tsv", "стали\tстать\tV\nстали\tсталь\tN\n"))) == [("стали", "стать")]
    assert rows(lists.tagged_lexicon(spark, put(tmp_path, "t.tsv", "ortho\tcat\nchat\tNOM\nva\tVER\n"), "cat = 'NOM'")) == [("chat", "NOM")]


def test_corpora(spark, tmp_path):
    p = put(tmp_path, "s.tsv.bz2", bz2.compress("1\tru\tОн идёт\n50\tru\tнет\n2\tru\tТом идёт\nx\ty\tz\n".encode()))
    assert rows(lists.sentences(spark, p)) == [(1, "ru", "Он идёт")]
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as tar:
        for name, text in (("x-words.txt", "1\tDas\t5\n2\tHaus\t3\n3\tzz\t1\n"), ("x-co_n.txt", "1\t2\t4\t9.9\n1\t3\t1\t1\n"), ("x-sentences.txt", "1\tDas Haus.\n")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    w, p, s = lists.leipzig(spark, put(tmp_path, "x.tar.gz", buf.getvalue()))
    uni, pairs = lists.leipzig_counts(w, p, spark.createDataFrame([("das",), ("haus",)], "word string"))
    assert rows(uni) == [("das", 5), ("haus", 3)] and rows(pairs) == [("das", "haus", 4)] and rows(s) == [("Das Haus.",)]
    j = put(tmp_path, "w.json", json.dumps({"word": "gehen", "pos": "verb", "forms": [{"form": "ging", "tags": ["past"]}]}) + "\n" + json.dumps({"word": "ab", "pos": "adv"}))
    assert rows(lists.dictionary_json(spark, j), "word", "form") == [("ab", None), ("gehen", "ging")] or lists.dictionary_json(spark, j).count() == 2


def test_automaton(spark, tmp_path):
    nodes, at = [], 8
    entry = b"ab+Bx+V"
    for i, c in enumerate(entry):
        last = i == len(entry) - 1
        nodes.append(struct.pack(">BBI", c, (1 if last else 0) | 2, 0 if last else at + 6 * (i + 1)))
    data = b"LXA1" + struct.pack(">I", at) + b"".join(nodes)
    assert rows(lists.suffix_automaton(spark, put(tmp_path, "a.bin", data))) == [("ab", "ax", "V")]


def test_affix_files(spark, tmp_path):
    rules = lists.affix_rules(spark, put(tmp_path, "x.aff", "SFX A Y 1\nSFX A y ied [^aeiou]y\nPFX B Y 1\nPFX B 0 re .\n"))
    stems = lists.affix_stems(spark, put(tmp_path, "x.dic", "2\ntry/AB\ncat\n"))
    assert [r[0] for r in rows(lexicon.expand_affixes(stems, rules), "form")] == ["cat", "retried", "retry", "tried", "try"]


def test_gestures_and_emoji(spark, tmp_path):
    keys, width, drawn = lists.swipes(spark, put(tmp_path, "s.txt", "#key q a 1.5 2\n#width q 1.0\nab q 1,2,0 3,4,10\nbad\n"))
    assert rows(keys) == [("q", "a", 1.5, 2.0)] and rows(width) == [("q", 1.0)] and drawn.first().path[1].t == 10.0
    g = lists.grid_json(spark, put(tmp_path, "g.json", json.dumps({"grid": "q", "keys": [{"label": "a", "x": 0, "y": 0, "w": 10, "h": 20}]})))
    assert rows(g) == [("q", "a", 5.0, 10.0, 10.0)]
    c = lists.gestures_json(spark, put(tmp_path, "c.json", json.dumps({"word": "a", "grid": "q", "curve": {"x": [1], "y": [2], "t": [0]}})))
    assert c.first().path[0].x == 1.0
    e = lists.emoji_list(spark, put(tmp_path, "e.txt", "# group: Smileys\n1F600 ; fully-qualified # x\n1F601 ; unqualified\n"))
    assert rows(e) == [("😀", "Smileys")]
    n = lists.emoji_names(spark, put(tmp_path, "n.xml", '<annotation cp="😀">face | grin</annotation>\n<annotation cp="😀" type="tts">grinning face</annotation>\n'))
    found = lists.find_emoji(n, spark.createDataFrame([("grin",), ("fa",), ("zz",)], "query string"))
    assert rows(found, "query", "score") == [("fa", 2), ("grin", 0)]


def test_parses_and_facts(spark, tmp_path):
    p = lists.parses(spark, put(tmp_path, "p.tsv", "1\ta b\tX Y\t2 0\tr root\t_ _\n2\ta\tX Y\t0\tr\t_\n"))
    assert rows(p, "sent_id") == [(1,)]
    f = lists.facts(spark, put(tmp_path, "f.tsv", "subject\trelation\tobject\na\tr\tb\na\tr\tb\na\tr\ta\n"))
    assert rows(f) == [("a", "r", "b")]


def test_store(spark, tmp_path):
    d = spark.createDataFrame([("ru", "дом", 5, 1), ("en", "cat", 7, 1)], "lang string, word string, prior_milli int, count long")
    store.write(d, str(tmp_path / "st"), "dictionary")
    assert rows(store.read(spark, str(tmp_path / "st"), "dictionary"), "lang", "word") == [("en", "cat"), ("ru", "дом")]
    with pytest.raises(ValueError):
        store.write(d.drop("count"), str(tmp_path / "st"), "dictionary")
    proper = spark.createDataFrame([("ru", "иван", 1, 1), ("ru", "иван", 2, 2)], "lang string, word string, flag int, line int")
    bad = spark.createDataFrame([("ru", "иван"), ("ru", "бяка")], "lang string, word string")
    assert rows(store.casing_flags(proper, bad)) == [("ru", "бяка", 4), ("ru", "иван", 5)]
    yo = spark.createDataFrame([("ru", "ёлка", 3), ("ru", "все", 9), ("ru", "всё", 9)], "lang string, word string, count long")
    assert rows(store.yo_masks(yo)) == [("ru", "елка", 1)]
    v = store.quantised_vectors(spark.createDataFrame([(1, [1.0, -2.0])], "id int, vec array<float>")).first()
    assert list(v.vec) == [64, -127] and v.scale == 2.0
    store.write_tsv(d.select("word", "count"), str(tmp_path / "out"), "word")
    store.write_log(d, str(tmp_path / "log"), 1)
    assert spark.read.json(str(tmp_path / "log")).count() == 2
