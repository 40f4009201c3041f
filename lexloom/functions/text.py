"""Column functions over words, tokens and sentences.  All are built-in expressions and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters of a word, and the tokens of a lower-case text (words, blanks, single signs).
LETTER = "a-zß-öø-ÿœа-яё"
WORD = f"[{LETTER}'-]*[{LETTER}][{LETTER}'-]*"
TOKEN = rf"{WORD}|\s+|."
# Names that stock sentences repeat.
STOCK = r"(^|[^\p{L}\p{N}_])(Том|Тома|Тому|Томом|Томе|Мэри|Бостон[\p{L}\p{N}_]*|Tom|Tom's|Tomás|Mary|Mary's|Maria|Marias|María|Marie|Boston)($|[^\p{L}\p{N}_])"
# Accented Latin letters and the letters they are typed as.
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøœùúûüýÿß"
UNACCENTED = "aaaaaaaceeeeiiiinooooooouuuuyys"
# The two layouts by place, row after row, and the home key of each letter's finger.
LATIN_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
CYRILLIC_ROWS = ("йцукенгшщзхъ", "фывапролджэ", "ячсмитьбю")
LATIN_HOMES = ("asdffjjkl;", "asdffjjkl", "asdffjj")
CYRILLIC_HOMES = ("фываапролджж", "фывааоолджж", "фывааоолд")
# Other dashes and quotes, and the signs they stand for.
DASHES, QUOTES = "–―−", "“”„«»‟"


def tokens(text: Column) -> Column:
    """Tokenizer A: words, runs of blanks, and any other character, of the text in lower case."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def is_word(token: Column) -> Column:
    return token.rlike(f"^({WORD})$")


def words_and_marks(text: Column) -> Column:
    """Tokenizer B: words and marks without blanks."""
    return F.filter(tokens(text), lambda t: ~t.rlike(r"^\s+$"))


def spoken_words(text: Column) -> Column:
    """Tokenizer C: runs of letters and digits joined by inner hyphens and apostrophes."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+(?:[-'’][\p{L}\p{N}]+)*"), F.lit(0))


def graph_words(text: Column) -> Column:
    """Tokenizer D: lower case, ё as е, numbers blanked to 0."""
    return F.transform(spoken_words(text), lambda w: F.regexp_replace(fold_yo(F.lower(w)), r"\p{N}+", "0"))


def sentences(text: Column) -> Column:
    """A text cut after end marks before a capital, not after initials and one-letter shortenings."""
    marked = F.regexp_replace(text, r"(?<=[\p{L}\p{N}»”\")]{2}[.!?…]{1,3}[»”\")]?)\s+(?=[«“\"(—–-]?\s?\p{Lu})", "\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def fold_yo(word: Column) -> Column:
    return F.translate(word, "ёЁ", "еЕ")


def fold_accents(word: Column) -> Column:
    return F.translate(word, ACCENTED, UNACCENTED)


def script(word: Column) -> Column:
    return F.when(word.rlike("[а-яё]"), "cyr").otherwise("lat")


def left_class(word: Column) -> Column:
    """Ending class of a word on the left of a pair: short words whole, else the last two letters."""
    return F.when(F.length(word) <= 3, F.concat(F.lit("="), word)).otherwise(F.concat(F.lit("*"), F.right(word, F.lit(2))))


def right_class(word: Column) -> Column:
    return F.when(F.length(word) <= 2, F.concat(F.lit("="), word)).otherwise(F.concat(F.lit("*"), F.right(word, F.lit(2))))


def casing_class(word: Column) -> Column:
    """lower, cap, upper, compound (a capital after a hyphen or apostrophe) or mixed."""
    first, rest = F.substring(word, 1, 1), word.substr(F.lit(2), F.length(word))
    return (
        F.when(word == F.lower(word), "lower")
        .when((word == F.upper(word)) & (F.length(word) > 1), "upper")
        .when((first == F.upper(first)) & (rest == F.lower(rest)), "cap")
        .when(word.rlike(r"^\p{Lu}[\p{Ll}]*([-'’]\p{Lu}?[\p{Ll}]*)+$"), "compound")
        .otherwise("mixed")
    )


def like_typed(word: Column, typed: Column) -> Column:
    """``word`` with the capitals of what was typed: all of them, the first, or none."""
    return (
        F.when((F.length(typed) > 1) & (typed == F.upper(typed)) & (typed != F.lower(typed)), F.upper(word))
        .when(F.substring(typed, 1, 1) != F.lower(F.substring(typed, 1, 1)), F.concat(F.upper(F.substring(word, 1, 1)), word.substr(F.lit(2), F.length(word))))
        .otherwise(word)
    )


def flip_layout(word: Column) -> Column:
    """The same keys on the other layout."""
    pairs = [(a, b) for l, c in zip(LATIN_ROWS, CYRILLIC_ROWS) for a, b in zip(l, c)]
    return F.translate(word, "".join(a + b for a, b in pairs), "".join(b + a for a, b in pairs))


def home_row(word: Column) -> Column:
    """Each letter as the home key of its finger."""
    rows = [*zip(LATIN_ROWS, LATIN_HOMES), *zip(CYRILLIC_ROWS, CYRILLIC_HOMES)]
    pairs = [(a, b) for letters, homes in rows for a, b in zip(letters, homes) if b != ";"]
    return F.translate(word, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def yo_form(word: Column, mask: Column) -> Column:
    """``word`` with ё for е at the letters whose bits are set."""
    chars = F.split(word, "")
    return F.array_join(F.transform(chars, lambda c, i: F.when((c == "е") & (mask.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0), "ё").otherwise(c)), "")


def is_artifact(word: Column) -> Column:
    """Clipped tokens and stutters."""
    return word.rlike(r"^['-]|['-]$|^([\p{L}\p{N}_]{1,2})-\1")


def is_drawn_out(word: Column) -> Column:
    """A letter three times in a row."""
    return word.rlike(r"(.)\1\1")


def is_stretched(word: Column) -> Column:
    """A letter three times in a row, or nothing but one letter twice."""
    return is_drawn_out(word) | word.rlike(r"^(.)\1$")


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading letters two words share."""
    same = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b)))), lambda i: (a.substr(F.lit(1), i) == b.substr(F.lit(1), i)).cast("int"))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x)


def same_stem(a: Column, b: Column, least: int = 2, tail: int = 2) -> Column:
    """Two forms of one word as far as their letters tell: the shorter is the other's start but for its last ``tail`` letters at most."""
    return (common_prefix(a, b) >= least) & (common_prefix(a, b) + tail >= F.least(F.length(a), F.length(b)))


def split_elisions(word: Column) -> Column:
    """French clitics cut off: l'homme -> l', homme; curly apostrophes made straight."""
    straight = F.translate(word, "’ʼ", "''")
    return F.split(F.regexp_replace(straight, r"^((?:[cdjlmnst]|qu|lorsqu|puisqu|quoiqu|jusqu)')(?=\p{L})", "$1\u0001"), "\u0001")


def german_variants(word: Column) -> Column:
    """Other spellings of a German word: ss and ß, ae oe ue and their umlauts."""
    made = [F.replace(word, F.lit(a), F.lit(b)) for a, b in (("ss", "ß"), ("ß", "ss"), ("ae", "ä"), ("oe", "ö"), ("ue", "ü"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue"))]
    return F.array_distinct(F.filter(F.array(*made), lambda v: v != word))


def last_cluster_length(text: Column) -> Column:
    """Characters of the last grapheme cluster."""
    return F.length(F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0))), -1))


def one_line(text: Column, width: int = 40) -> Column:
    """A preview: blanks folded, cut to ``width`` with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 1), F.lit("…"))).otherwise(flat)


def is_active_participle(word: Column) -> Column:
    return F.regexp_replace(fold_yo(word), "(ся|сь)$", "").rlike("(ущ|ющ|ащ|ящ|вш)(ий|ая|ее|ие|его|ей|их|ему|им|ую|ими|ем)$|(ш)(ий|ая|ее|ие)$")


def plain_marks(text: Column) -> Column:
    """Dashes and quotes in one form."""
    return F.translate(text, DASHES + QUOTES, "—" * len(DASHES) + '"' * len(QUOTES))


def mark_bits(marks: Column) -> Column:
    """A bitset of the marks before a word: , . ! ? : ; — " ( )"""
    order = ',.!?:;—"()'
    return sum((F.when(F.contains(plain_marks(marks), F.lit(m)), 1 << i).otherwise(0) for i, m in enumerate(order)), F.lit(0))


def ends_sentence(before: Column) -> Column:
    """Whether a word after this text begins a sentence: nothing, or an end mark that isn't a shortening's."""
    text = F.rtrim(before)
    return (text == "") | (text.rlike(r"[.!?…][»”\")]*$") & ~text.rlike(r"(^|[\s(])\p{L}\.$|(^|\s)(т|д|п|e|z|i|u|s|g|p)\.\s?(е|к|н|п|g|B|d|a|ex)\.$"))


def vowelless(word: Column) -> Column:
    return ~F.lower(word).rlike("[aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿаеёиоуыэюя]")
