"""Marks of a sentence from its links, as rules over an edge table.

Each rule is a test of a word that yields places, read within its sentence; where several speak of a place the earliest word's, then the
rule that stands first in ``ORDER``, holds.  Edges (id, pos, word, head, rel, upos, form, chance) come with the
reach of each subtree (lo, hi); forms are conv (gerund), part (participle), fin, inf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..data import ADVERSATIVE, APART_MORE, ASIDE_FIRST, ASIDE_PHRASES, ASKING, GERUND_IDIOMS, INTERJECTIONS, JOINING, PAREN_PHRASES, PARENTHETICAL, QUESTION, SAYING, SUBORDINATING
from .graph import reach_of

ORDER = (
    "aside first", "interjection first", "gerund idiom", "gerund", "participle after", "relative", "subordinate first", "subordinate", "advcl", "ccomp", "address",
    "parenthetical", "apart word", "interjection", "apart at the start", "said", "aside", "despite", "adversative", "listed", "clauses", "repeated", "set phrase", "set aside",
)


def with_reach(e: DataFrame, reach: DataFrame) -> DataFrame:
    return e.join(reach.select("id", "pos", "lo", "hi"), ["id", "pos"])


#: Set phrases by their first word.
PHRASES: dict[str, list[tuple[list[str], str]]] = {}
for _phrases, _rule in ((PAREN_PHRASES, "set phrase"), (ASIDE_PHRASES, "set aside")):
    for _p in _phrases:
        PHRASES.setdefault(_p.split(" ")[0], []).append((_p.split(" "), _rule))
RANK = {r: k for k, r in enumerate(ORDER)}
IDIOMS, ADVERSE, SAID = {*GERUND_IDIOMS}, {*ADVERSATIVE} - {*JOINING}, (*SAYING,)
FIRST, SUBORDINATE, PAREN, APART, CRIES = (frozenset(x) for x in (ASIDE_FIRST, SUBORDINATING, PARENTHETICAL, APART_MORE, INTERJECTIONS))
STILL = {"nsubj", "cc", "punct", "mark"}


class Sentence:
    """The words of one sentence in their order, as lists, and the words that hang on each; what is missing is empty."""

    def __init__(self, pos: list[int], word: list[str], head: list[int], rel: list[str], upos: list[str], form: list[str], lo: list[int], hi: list[int]):
        self.pos, self.word, self.head, self.rel, self.upos, self.form, self.lo, self.hi = pos, word, head, rel, upos, form, lo, hi
        self.kids: dict[int, list[int]] = {}
        for i, h in enumerate(head):
            if h > 0:
                self.kids.setdefault(h, []).append(i)

    def rule(self, i: int) -> tuple[str, tuple[int, ...]] | None:
        """The first rule that fits a word, and where it puts commas."""
        pos, word, head, rel, form = self.pos[i], self.word[i], self.head[i], self.rel[i], self.form[i]
        lo, kids = self.lo[i], self.kids.get(pos, ())
        around = (lo, self.hi[i] + 1)
        if pos == 1 and self.pos[-1] > 1 and not kids and rel not in ("case", "det", "amod", "nummod", "fixed", "flat", "compound"):
            if word in FIRST:
                return "aside first", (2,)
            if word in CRIES:
                return "interjection first", (2,)
        if rel not in RULED:
            return None
        rels = [self.rel[k] for k in kids]
        clause = form == "fin" or "nsubj" in rels or "cop" in rels
        if rel == "advcl":
            if form == "conv" or any(self.rel[k] == "cop" and self.form[k] == "conv" for k in kids):
                idiom = i + 1 < len(self.pos) and self.pos[i + 1] == pos + 1 and (word, self.word[i + 1]) in IDIOMS
                return ("gerund idiom", ()) if idiom else ("gerund", around)
            if clause:
                joined = any(self.rel[k] == "mark" and self.word[k] in SUBORDINATE for k in kids)
                return ("advcl" if not joined else "subordinate first" if lo == 1 else "subordinate"), around
        if rel == "acl" and form == "part":
            return "participle after", around if lo > head else ()
        if rel in ("acl", "acl:relcl") and form != "part" and clause:
            return "relative", around
        if rel == "ccomp" and clause:
            return "ccomp", around
        if rel == "vocative":
            return "address", around
        if rel == "parataxis" and word in PAREN:
            return "parenthetical", around
        if (rel == "discourse" and word in CRIES) or (rel == "parataxis" and word in APART):
            return "apart word", around
        if not kids and rel in ("discourse", "parataxis") and self.upos[i] == "INTJ":
            return "interjection", around
        if rel == "parataxis":
            if not kids and lo == 1 and head > 1:
                return "apart at the start", around
            if lo > head and word.startswith(SAID):
                return "said", around
        if rel in ("parataxis", "appos"):
            return "aside", ()  # dash, colon or brackets as often: the writer's
        if rel in ("obl", "advcl") and any(self.word[k] == "несмотря" for k in kids):
            return "despite", around
        if rel == "conj":
            cc = next((k for k in kids if self.rel[k] == "cc" and self.pos[k] < pos), None)
            start = (lo if cc is None else self.pos[cc],)
            if cc is None:
                return "listed", start
            if self.word[cc] in ADVERSE:
                return "adversative", start
            sisters = self.kids.get(head, ())
            before = [k for k in sisters if self.pos[k] < head]
            if clause and "nsubj" in rels and any(self.rel[k] == "nsubj" for k in sisters) and all(self.rel[k] in STILL for k in before):
                return "clauses", start
            if any(self.rel[k] == "cc" and self.word[k] == self.word[cc] for k in before):
                return "repeated", start
        return None

    def commas(self) -> list[tuple[int, str, str, int]]:
        """(before, mark, rule, index of the word that put it); single words speak before set phrases, earlier words before later ones."""
        n, best = self.pos[-1], {}

        def put(at: int, *key) -> None:
            if 2 <= at <= n and (at not in best or key < best[at]):
                best[at] = key

        for i, w in enumerate(self.word):
            if (i == 0 or self.rel[i] in RULED) and (found := self.rule(i)):
                for at in found[1]:
                    put(at, False, i, RANK[found[0]], found[0])
            for phrase, rule in PHRASES.get(w, ()):
                if self.word[i : i + len(phrase)] == phrase:
                    # one of «по» and a noun with all that hangs on the noun
                    last = i + len(phrase) - 1
                    end = max(self.hi[last], self.pos[last]) if w == "по" and len(phrase) == 2 else self.pos[last]
                    put(self.pos[i], True, last, RANK[rule], rule)
                    put(end + 1, True, last, RANK[rule], rule)
        return [(at, ",", rule, i) for at, (_, i, _, rule) in best.items()]

    def dashes(self) -> list[tuple[int, str, str, int]]:
        out = []
        for i, pos in enumerate(self.pos):
            kids = self.kids.get(pos, ())
            if not kids or any(self.rel[k] in ("cop", "aux") for k in kids):
                continue
            for k in kids:
                if self.rel[k] == "nsubj" and self.pos[k] < pos:
                    nouns = self.upos[i] in ("NOUN", "PROPN", "NUM") and self.upos[k] in ("NOUN", "PROPN")
                    if nouns or (self.form[i] == "inf" and self.form[k] == "inf"):
                        at = min([self.lo[i], *(self.pos[x] for x in kids if self.word[x] == "это")])
                        at = at if at > self.hi[k] else max(self.hi[k] + 1, at)
                        if at >= 2:
                            out.append((at, "—", "zero copula" if nouns else "infinitives", i))
        return out


#: The relations that a rule speaks of, besides those of the first word.
RULED = {"advcl", "acl", "acl:relcl", "ccomp", "vocative", "parataxis", "discourse", "appos", "obl", "conj"}
PARTS = ("pos", "word", "head", "rel", "upos", "form", "lo", "hi")


#: Words by which one that stands first, a phrase, or «несмотря» on another word may put commas; relations that may.
SPEAKING, SPEAKING_RELS = pa.array(sorted({*PHRASES, *FIRST, *CRIES, "несмотря"})), pa.array(sorted(RULED - {"obl"}))


def _may_speak(flat: dict[str, pa.Array], cuts: np.ndarray) -> np.ndarray:
    """Which sentences hold a word that a rule or a dash could speak of; no mark stands in the others."""
    of = lambda c, held: pc.is_in(flat[c], value_set=held).to_numpy(zero_copy_only=False)
    speaks, subject = of("word", SPEAKING) | of("rel", SPEAKING_RELS), of("rel", pa.array(["nsubj"]))
    if "pos" not in flat and len(subject):
        sizes = np.diff(cuts)
        head, size = flat["head"].fill_null(0).to_numpy(), np.repeat(sizes, sizes)
        inside = subject & (head > 0) & (head <= size)
        above = np.where(inside, np.repeat(cuts[:-1], sizes) + head - 1, 0)
        subject = inside & (of("upos", pa.array(["NOUN", "PROPN", "NUM"])) | of("form", pa.array(["inf"])))[above]
    return np.diff(np.r_[0, np.cumsum(speaks | subject)][cuts]) > 0


def _of_sentences(rows: DataFrame, commas: bool, dashes: bool) -> DataFrame:
    """(id, before, mark, rule, by, chance) of a row for each sentence: arrays of its words' columns.  Without ``pos`` words count from 1, without ``lo`` and ``hi`` reaches are those of the heads."""
    names = [c for c in (*PARTS, "chance") if c in rows.columns]

    def parted(b: pa.RecordBatch) -> tuple[dict[str, pa.Array], np.ndarray]:
        offsets = b.column("word").offsets.to_numpy()
        return {c: b.column(c).flatten() for c in names}, offsets - offsets[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, cuts = parted(b)
            flat, cuts = parted(b := b.filter(pa.array(_may_speak(flat, cuts))))
            cuts = cuts.tolist()
            held = {c: (v.fill_null("") if pa.types.is_string(v.type) else v).to_pylist() for c, v in flat.items() if c != "chance"}
            out: list[tuple] = []
            for r, (a, z) in enumerate(zip(cuts, cuts[1:])):
                if z > a:
                    own = {c: v[a:z] for c, v in held.items()}
                    own.setdefault("pos", [*range(1, z - a + 1)])
                    if "lo" not in own:
                        lo, hi = reach_of(own["head"])
                        own["lo"], own["hi"] = lo[1:], hi[1:]
                    s = Sentence(**own)
                    out += [(r, a + i, at, mark, rule, own["pos"][i]) for at, mark, rule, i in (s.commas() if commas else []) + (s.dashes() if dashes else [])]
            r, i, at, mark, rule, by = zip(*out) if out else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(r, pa.int64())), pa.array(at, pa.int32()), pa.array(mark, pa.string()), pa.array(rule, pa.string()), pa.array(by, pa.int32()), flat["chance"].take(pa.array(i, pa.int64()))], ["id", "before", "mark", "rule", "by", "chance"]
            )

    return rows.select("id", *names).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, before int, mark string, rule string, by int, chance double")


def _gathered(e: DataFrame) -> DataFrame:
    rows = e.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*PARTS, "chance"))).alias("w"))  # one sentence
    return rows.select("id", *[F.col("w")[c].alias(c) for c in (*PARTS, "chance")])


def of_sentences(rows: DataFrame) -> DataFrame:
    """(id, before, mark, rule, by, chance): commas and dashes of parsed sentences (id, word, head, rel, upos, form, chance), a row and arrays for each.

    All that a mark depends on stands in its sentence, so nothing is shuffled.
    """
    return _of_sentences(rows, True, True)


def place(e: DataFrame) -> DataFrame:
    """(id, before, mark, rule, by, chance): commas before the words at ``before`` (from 1), each with the rule and the word that put it."""
    return _of_sentences(_gathered(e), True, False)


def dashes(e: DataFrame) -> DataFrame:
    """(id, before, mark, rule, by, chance): dashes between a subject noun and a predicate noun, or two infinitives, without a copula."""
    return _of_sentences(_gathered(e), False, True)


def end_marks(e: DataFrame) -> DataFrame:
    """(id, mark): ? where the main clause asks, by a word of its own or one that hangs on a part of it, else a period."""
    root = e.where("head = 0").groupBy("id").agg(F.min("pos").alias("root"))
    asking = F.col("word").isin(*ASKING) & ~F.col("rel").isin("mark", "cc", "fixed")
    up = e.select("id", F.col("pos").alias("head"), F.col("head").alias("above"), F.col("rel").alias("up"))
    j = e.join(root, "id").join(up, ["id", "head"], "left")
    at_root, in_clause = F.col("pos") == F.col("root"), F.col("head") == F.col("root")
    of_part = (F.col("above") == F.col("root")) & F.col("up").isin("obl", "obj", "nsubj", "advmod", "nmod", "iobj")
    asks = ((at_root | in_clause) & F.col("word").isin(*QUESTION)) | (in_clause & asking) | (of_part & asking) | (at_root & (F.col("pos") == 1) & asking)
    return j.groupBy("id").agg(F.when(F.max(F.coalesce(asks, F.lit(False)).cast("int")) == 1, "?").otherwise(".").alias("mark"))


def parse_rows(spark, rows: list[tuple[int, str]]) -> DataFrame:
    """Edges from compact text, one ``word/head/rel/upos/form`` per word."""
    out = []
    for sid, line in rows:
        for i, w in enumerate(line.split(" "), 1):
            word, head, rel, upos, *form = w.split("/")
            out.append((sid, i, word, int(head), rel, upos, form[0] if form else "", 0.9))
    return spark.createDataFrame(out, "id long, pos int, word string, head int, rel string, upos string, form string, chance double")
