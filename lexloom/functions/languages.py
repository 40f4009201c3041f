"""Analysers of single languages, as regular expressions and small tables; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_accents

# Spanish pronouns that stick to verbs, diminutive endings, French words that hyphens may join.
CLITICS = "(me|te|se|nos|os|lo|la|los|las|le|les)"
DIMINUTIVES = (("ecitos", "e"), ("ecitas", "a"), ("ecito", "e"), ("ecita", "a"), ("citos", ""), ("citas", ""), ("cito", ""), ("cita", ""), ("itos", "os"), ("itas", "as"), ("ito", "o"), ("ita", "a"))
FRENCH_TAILS = "(je|tu|il|elle|on|nous|vous|ils|elles|moi|toi|lui|leur|eux|y|en|le|la|les|ce|ci|là|même|mêmes)"


def without_clitics(word: Column) -> Column:
    """A Spanish verb with up to two pronouns cut off and its accent dropped; null where none stick to it."""
    bare = F.regexp_replace(word, rf"(?<=(?:[aeiáéí]r|[áéí]ndo|[aeáéí])){CLITICS}{CLITICS}?$", "")
    return F.when((bare != word) & (F.length(bare) > 2), fold_accents(bare))


def base_of_diminutive(word: Column) -> Column:
    """The word a Spanish diminutive is of; null where it is none."""
    out = F.lit(None).cast("string")
    for end, base in reversed(DIMINUTIVES):
        out = F.when(word.endswith(end) & (F.length(word) > len(end) + 2), F.concat(word.substr(F.lit(1), F.length(word) - len(end)), F.lit(base))).otherwise(out)
    return out


def french_hyphens_ok(word: Column) -> Column:
    """A hyphenated form a French text may hold: verb and pronouns, -là, -ci, -même, or parts of two letters and more."""
    parts = F.split(word, "-")
    return word.rlike(rf"^\p{{L}}{{2,}}(-t)?(-{FRENCH_TAILS})+$") | ((F.size(parts) > 1) & F.forall(parts, lambda p: p.rlike(r"^\p{L}{2,}$")))


def name_spans(text: Column) -> Column:
    """Runs of capitalised words inside a sentence, joined by small particles."""
    return F.regexp_extract_all(text, F.lit(r"(?<=[\p{Ll},] )\p{Lu}[\p{L}'’-]+(?:(?: (?:de|von|van|der|la|ди|фон|де))? \p{Lu}[\p{L}'’-]+)*"), F.lit(0))


def relation_table(json: Column) -> Column:
    """A table of relation by case (or head tag) as rows: array<struct<key,rel,n>> from a JSON object of objects."""
    m = F.from_json(json, "map<string,map<string,double>>")
    return F.flatten(F.transform(F.map_entries(m), lambda e: F.transform(F.map_entries(e["value"]), lambda r: F.struct(e["key"].alias("key"), r["key"].alias("rel"), r["value"].alias("n")))))
