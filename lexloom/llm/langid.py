"""Languages of documents and of each stretch of them.

A character model per language gives the likelihood of a word from its n-grams (up to 4, with word bounds,
interpolated); it is fitted on at most ``sample`` labelled sentences per language.  With a small probability a word
is an outlier, a name, a label or a foreign word that says nothing of the language around it; so one word speaks for
a language by the logarithm of that probability at most.  A document's words are cut into stretches of one language
by the best path, where a change costs little between sentences (end marks, line ends, tabs, numbers) and much inside
one.  Expectation-maximisation over the stretches estimates the document's proportions for each nested set of
languages; the set with the largest likelihood less a price per language is taken, and each stretch gets its language
and posterior.

A word of one letter, as often the name of a key or a variable, says nothing.  A stretch holds a whole sentence if some
words of it between two bounds are, taken together, by ``least_evidence`` nats likelier than in every other language.
That is more than any one word can say, so that single foreign words and labels do not count, whatever their length.

Defined cases: null and empty texts, and texts without a word, have no stretch; a null label is a missing one.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .consistent import INVISIBLE, consistent_str, transducer

LANGS = ("ru", "en", "de", "fr", "es", "pt")
# Three-letter codes of the six languages.
THREE = {"rus": "ru", "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt"}
MISSING = ("", "und", "xx")

ORDER = 4
#: Minus the logarithm of the probability that a word is an outlier, in nats: the most by which one word speaks for a language.
OUTLIER = 6.0
#: Nats that a whole sentence needs, odds of 3,000 to 1: more than any single word says.
SENTENCE = OUTLIER + 2.0
#: What stands between two sentences, lines or fields.
_BOUND = re.compile(r"[.!?…\t\r\n\d]")
_INNER = re.escape(INVISIBLE) + "̀-ͯ"
_RUN = rf"[^\W\d_]+(?:[{_INNER}]+[^\W\d_]+)*[{_INNER}]*"
_WORD = re.compile(rf"{_RUN}(?:-{_RUN})*")
_CYRILLIC, _LATIN = re.compile("[Ѐ-ӿ]"), re.compile("[A-Za-zÀ-ɏ]")
_ONLY_CYRILLIC, _ONLY_LATIN = re.compile("[бвгджзийклмнптфцчшщъыьэюяёБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯЁ]"), re.compile("[bdfghijklmnqrstuvwzDFGIJLNQRSUVWZÀ-ɏ]")


def sample_sentences(frames: DataFrame, sample: int = 2000, id_col: str = "sent_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """At most ``sample`` sentences of each language, those with the least hash: few enough for the driver.

    Counts per language first say which hashes can be among them, so that hardly more rows than wanted are ranked.
    """
    drawn = frames.where(F.col(lang).isin(*LANGS) & (F.length(text) > 20)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(id_col, text).alias("h"))
    n = {r.lang: r.n for r in drawn.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not n:
        return []
    below = {k: min(2**63 - 1, round((min(1.0, (1.5 * sample + 200) / v) - 0.5) * 2**64)) for k, v in n.items()}
    least = F.create_map(*[F.lit(x) for k, v in below.items() for x in (k, v)])
    ranked = drawn.where(F.col("h") <= least[F.col("lang")]).withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rn") <= sample)
    return [(r.lang, r.text) for r in ranked.select("lang", "text").collect()]


class Model:
    """Interpolated character n-gram likelihoods of words, a vector over the languages at once."""

    def __init__(self, sentences: list[tuple[str, str]], bare: float = 0.25):
        counts: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.zeros(len(LANGS))) for _ in range(ORDER)]
        for i, lang in enumerate(LANGS):
            tally: Counter[str] = Counter()
            for l, text in sentences:
                if l == lang:
                    tally.update(w.lower() for w in _WORD.findall(consistent_str(text, lang)))
            forms: Counter[str] = Counter()
            for word, n in tally.items():
                forms[word] += n
                plain = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
                if plain != word:
                    forms[plain] += bare * n  # texts with their accents left out
            for word, n in forms.items():
                padded = f"^{word}$"
                for k in range(ORDER):
                    for at in range(1, len(padded)):
                        if at >= k:
                            counts[k][padded[at - k : at + 1]][i] += n
        self.tables: list[dict[str, np.ndarray]] = []
        letters = max(1, len(counts[0])) + 50
        lower: dict[str, np.ndarray] = {}
        unseen = np.full(len(LANGS), 1 / letters)
        for k in range(ORDER):
            total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGS)))
            kinds: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGS)))
            for gram, n in counts[k].items():
                total[gram[:-1]] += n
                kinds[gram[:-1]] += n > 0
            table = {}
            for gram, n in counts[k].items():
                t, d = total[gram[:-1]], kinds[gram[:-1]]
                back = lower.get(gram[1:], unseen) if k else unseen
                table[gram] = np.where(t > 0, (n + d * back) / np.maximum(t + d, 1e-9), back)  # Witten-Bell
            lower = table
            self.tables.append({g: np.log(p) for g, p in table.items()})
        self.unseen = np.log(unseen)
        self.memo: dict[str, np.ndarray] = {}

    def _plain(self, token: str) -> str:
        if token.isascii():
            return token.lower()
        script = "cyr" if _CYRILLIC.search(token) else "lat"
        if script == "cyr" and _LATIN.search(token):
            cyr, lat = len(_ONLY_CYRILLIC.findall(token)), len(_ONLY_LATIN.findall(token))
            if cyr == lat:
                cyr, lat = len(_CYRILLIC.findall(token)), len(_LATIN.findall(token))
            script = "cyr" if cyr >= lat else "lat"
        elif script == "lat" and not any("Ͱ" <= c <= "Ͽ" or c >= "̀" for c in token):
            return token.replace("­", "").lower()
        return transducer(script)(token).lower()

    def word(self, token: str) -> np.ndarray:
        """Log likelihood of a word as it stands in a text, for each language."""
        if (v := self.memo.get(token)) is None:
            padded = f"^{self._plain(token)}$"
            v = np.zeros(len(LANGS))
            for at in range(1, len(padded)):
                for k in range(min(ORDER - 1, at), -1, -1):
                    if (p := self.tables[k].get(padded[at - k : at + 1])) is not None:
                        v += p
                        break
                else:
                    v += self.unseen
            if len(self.memo) >= 1 << 18:
                self.memo.clear()
            # an outlier is as likely as in its best language, so a word says OUTLIER nats at most (and a hundredth); a lone letter may be a sign and says nothing
            self.memo[token] = v = (np.logaddexp(v, v.max() - OUTLIER) * (len(padded) > 3)).astype(np.float32)
        return v

    def __getstate__(self):
        return {"tables": self.tables, "unseen": self.unseen, "memo": {}}


def tokens(text: str) -> list[tuple[str, int, int, bool]]:
    """The words of a text with their places, and whether one begins a sentence, a line or a field."""
    out, last = [], None
    for m in _WORD.finditer(text):
        out.append((m.group(), *m.span(), last is None or _BOUND.search(text, last, m.start()) is not None))
        last = m.end()
    return out


def best_paths(scores: np.ndarray, lengths: np.ndarray, change: np.ndarray) -> np.ndarray:
    """The language of each word; all documents take a step at once.

    ``scores`` holds the documents one after another, longest first; ``change`` is the price of another language from a word on.
    """
    starts = np.cumsum(lengths) - lengths
    out = np.zeros(len(scores), np.int8)
    if not len(scores):
        return out
    came = np.zeros(scores.shape, np.int8)
    value = scores[starts].copy()
    own = np.arange(len(LANGS), dtype=np.int8)
    live = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")  # documents with more than t words
    for t in range(1, lengths[0]):
        n = live[t]
        v = value[:n]
        best = v.argmax(1)
        at = starts[:n] + t
        moved = v[np.arange(n), best] - change[at]
        stay = v >= moved[:, None]
        came[at] = np.where(stay, own, best[:, None])
        value[:n] = np.where(stay, v, moved[:, None]) + scores[at]
    state = value.argmax(1)
    for t in range(lengths[0] - 1, -1, -1):
        n = live[t]
        at = starts[:n] + t
        out[at] = state[:n]
        if t:
            state[:n] = came[at, state[:n]]
    return out


def mixtures(units: np.ndarray, doc: np.ndarray, docs: int, price: float, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """EM over the units of each document, for the nested sets of its likeliest languages; (posterior of units, chosen set of documents)."""
    k = units.shape[1]
    top = units.max(1, keepdims=True)
    like = np.exp(units - top)

    def fit(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        share = allowed / allowed.sum(1, keepdims=True)
        for _ in range(rounds):
            joint = share[doc] * like + 1e-300 * allowed[doc]
            post = joint / joint.sum(1, keepdims=True)
            sums = np.zeros((docs, k))
            np.add.at(sums, doc, post)
            share = (sums + 1e-6) * allowed
            share /= share.sum(1, keepdims=True)
        joint = share[doc] * like + 1e-300 * allowed[doc]
        total = np.zeros(docs)
        np.add.at(total, doc, np.log(joint.sum(1)) + top[:, 0])
        return share, joint / joint.sum(1, keepdims=True), total

    share, post, total = fit(np.ones((docs, k)))
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
    best, chosen = np.full(docs, -np.inf), np.ones((docs, k), bool)
    kept = post
    for size in range(1, k + 1):
        allowed = rank < size
        _, post, total = fit(allowed.astype(float))
        better = total - price * size > best
        best = np.where(better, total - price * size, best)
        chosen[better] = allowed[better]
        kept = np.where(better[doc][:, None], post, kept)
    return kept, chosen


STRETCH = "`{id}` {kind}, start int, stop int, words int, lang string, confidence double, evidence double"


def stretches(docs: DataFrame, sentences: list[tuple[str, str]], id_col: str = "doc_id", text: str = "text", change: float = 14.0, change_between: float = 4.0, price: float = 8.0) -> DataFrame:
    """(id, start, stop, words, lang, confidence, evidence): stretches of one language, by places in the raw text.

    ``evidence`` is that of the stretch's clearest sentence: by how many nats its words are likelier than in the next language.
    """
    model = docs.sparkSession.sparkContext.broadcast(Model(sentences))
    names = np.array(LANGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [(i, tokens(t)) for i, t in enumerate(part.column(1).to_pylist()) if t]
                found = sorted((x for x in found if x[1]), key=lambda x: -len(x[1]))
                if not found:
                    continue
                lengths = np.array([len(x[1]) for x in found])
                scores = np.array([m.word(w[0]) for _, ws in found for w in ws], np.float64)
                begins = np.array([w[3] for _, ws in found for w in ws])
                doc = np.repeat(np.arange(len(found)), lengths)
                path = best_paths(scores, lengths, np.where(begins, change_between, change))
                cut = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])])
                post, _ = mixtures(np.add.reduceat(scores, cut), doc[cut], len(found), price)
                lang = post.argmax(1)
                sure = post[np.arange(len(lang)), lang] * np.diff(np.r_[cut, len(path)])
                # stretches that fall to one language side by side are one; its words weigh their posteriors
                first = np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | (doc[cut][1:] != doc[cut][:-1])])
                lang, cut, sure = lang[first], cut[first], np.add.reduceat(sure, first)
                size = np.diff(np.r_[cut, len(path)])
                opens = begins.copy()
                opens[cut] = True
                sentence = np.flatnonzero(opens)
                owner = np.searchsorted(cut, sentence, side="right") - 1
                each = np.add.reduceat(scores, sentence)
                own = each[np.arange(len(each)), lang[owner]]
                each[np.arange(len(each)), lang[owner]] = -np.inf
                evidence = np.maximum.reduceat(own - each.max(1), np.searchsorted(sentence, cut))
                places = [w[1:3] for _, ws in found for w in ws]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.array([x[0] for x in found])[doc[cut]])),
                        pa.array(np.array([places[c][0] for c in cut], np.int32)),
                        pa.array(np.array([places[c + s - 1][1] for c, s in zip(cut, size)], np.int32)),
                        pa.array(size.astype(np.int32)), pa.array(names[lang].tolist()),
                        pa.array(np.minimum(sure / size, 1.0)), pa.array(evidence),
                    ],
                    names=[id_col, "start", "stop", "words", "lang", "confidence", "evidence"],
                )

    schema = STRETCH.format(id=id_col, kind=docs.schema[id_col].dataType.simpleString())
    return docs.select(F.col(id_col), F.col(text)).where(F.col(text).isNotNull()).mapInArrow(run, schema)


def label(lang: Column) -> Column:
    """A label as a two-letter code: case, region and three letters set aside; null if it is missing."""
    short = F.lower(F.trim(F.split(F.trim(F.coalesce(lang, F.lit(""))), "[-_]")[0]))
    known = F.create_map(*[F.lit(x) for pair in THREE.items() for x in pair])
    return F.when(~short.isin(*MISSING), F.coalesce(known[short], short))


def whole_languages(found: DataFrame, id_col: str = "doc_id", least_evidence: float = SENTENCE, least_confidence: float = 0.9) -> DataFrame:
    """(id, lang, words, confidence): the languages in which a document holds a whole sentence."""
    return (
        found.where((F.col("evidence") >= least_evidence) & (F.col("confidence") >= least_confidence))
        .groupBy(id_col, "lang")
        .agg(F.sum("words").cast("long").alias("words"), F.max("confidence").alias("confidence"))
    )


def document_languages(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(id, said, lang, confidence, share, langs): the language of every document.

    ``lang`` is that of most words (ties: the later by name), ``confidence`` the posterior of those words, ``share`` their share of
    all words, ``langs`` how many languages have words; ``said`` is the label.  A text without a word has a null lang, no
    confidence and no language.  A row per row of ``docs`` whose id has one row; ids of several rows have their words added up.
    """
    per = found.groupBy(id_col, "lang").agg(F.sum("words").alias("n"), F.sum(F.col("words") * F.col("confidence")).alias("sure"))
    best = per.groupBy(id_col).agg(F.max(F.struct("n", "lang", "sure")).alias("top"), F.sum("n").alias("all"), F.count("*").cast("int").alias("langs"))
    said = docs.select(F.col(id_col), label(F.col(lang)).alias("said"))
    none = F.lit(0.0)
    return said.join(best, id_col, "left").select(
        id_col, "said", F.col("top.lang").alias("lang"), F.coalesce(F.col("top.sure") / F.col("top.n"), none).alias("confidence"),
        F.coalesce(F.col("top.n") / F.col("all"), none).alias("share"), F.coalesce("langs", F.lit(0)).alias("langs"),
    )


def mislabelled(docs: DataFrame, sentences: list[tuple[str, str]], id_col: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """(id, lang, words, confidence): the languages of documents whose label is missing or wrong, or that hold several."""
    held = whole_languages(stretches(docs, sentences, id_col, text), id_col, **options)
    sets = held.groupBy(id_col).agg(F.collect_list(F.struct("lang", "words", "confidence")).alias("held"))  # at most six
    said = docs.select(F.col(id_col), label(F.col(lang)).alias("said"))
    wrong = F.col("said").isNull() | (F.size("held") > 1) | (F.col("said") != F.col("held")[0]["lang"])
    return sets.join(said, id_col).where(wrong).select(id_col, F.explode("held").alias("h")).select(id_col, "h.lang", "h.words", "h.confidence")
