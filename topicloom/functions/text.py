"""Column expressions on text, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = r"[^\p{L}\p{N}_\s]"


def _icu(method: str, text: Column) -> Column:
    """A compatibility form by Spark's own copy of ICU; plain ASCII text is its own form and null stays null."""
    plain = text.isNull() | (F.octet_length(text) == F.char_length(text))
    return F.when(plain, text).otherwise(F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), text, F.lit(True)))


def nfkc(text: Column) -> Column:
    return _icu("compose", text)


def strip_accents(text: Column) -> Column:
    """NFKD form without combining marks."""
    return F.regexp_replace(_icu("decompose", text), r"\p{Mn}+", "")


def clean(text: Column, lowercase: bool = True, punctuation: bool = True) -> Column:
    """NFKC form, lower case, punctuation to spaces, white space collapsed and trimmed; null stays null."""
    text = nfkc(text)
    if lowercase:
        text = F.lower(text)
    if punctuation:
        text = F.regexp_replace(text, PUNCTUATION, " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_missing(value: Column, kind: str = "string") -> Column:
    return value.isNull() | F.isnan(value) if kind in ("float", "double") else value.isNull()


def is_real(text: Column) -> Column:
    """Neither missing nor blank."""
    return text.isNotNull() & (F.trim(text) != "")


def char_trigrams(word: Column) -> Column:
    """Distinct trigrams of a word; a word shorter than three characters is its own."""
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 2, F.lit(1))), lambda i: F.substring(word, i, F.lit(3)))
    return F.array_distinct(F.when(F.length(word) < 3, F.array(word)).otherwise(many))


def trigram_jaccard(a: Column, b: Column) -> Column:
    x, y = char_trigrams(a), char_trigrams(b)
    return F.size(F.array_intersect(x, y)).cast("double") / F.size(F.array_union(x, y)).cast("double")


def label_word(word: Column) -> Column:
    return F.initcap(word)


#: Verbs of statements, by what they are about; the third person counts as well.
_STEMS = (
    "make create build develop generate implement compute calculate execute run work use apply process handle serve provide support "
    "transform convert update replace reduce decrease increase expand extend improve enhance optimize normalize scale shape vary restore "
    "learn train predict estimate evaluate measure analyze classify identify detect determine define interpret verify validate visualize monitor track represent reveal show cluster filter "
    "organize manage control govern regulate schedule assign distribute integrate combine connect link relate collect store retrieve extract transfer maintain configure deploy automate "
    "affect allow enable ensure require involve include contain remain occur depend drive guide help promote protect prevent limit trigger treat harm exploit expose capture convey remove resolve settle solve add "
).split()


def third_person(verb: str) -> str:
    if verb[-1] == "y" and verb[-2] not in "aeiou":
        return verb[:-1] + "ies"
    return verb + ("es" if verb.endswith(("s", "sh", "ch", "x", "z")) else "s")


VERBS = [*_STEMS, *map(third_person, _STEMS)]
ADJECTIVES = "specific advanced based automated integrated encrypted distributed decentralized optimized reliable scalable sustainable renewable flexible multiple secure collaborative effective adaptive global critical local essential general digital virtual driven common various important efficient robust secondary primary".split()
NOUN_ENDINGS = "al ty acy ery gy ity logy ology ics ure ness ment ance ence sion tion ware work".split()


def label_score(term: Column, score: Column) -> Column:
    """How well a keyword reads as a label: two-word terms and noun endings gain, adjectives lose, verbs are out.

    An ending counts behind three letters at least.
    """
    words = F.split(term, " ")
    n = F.size(words)
    # terms of more than two words are out, so the first and the last word are all that matter
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    verb = first.isin(VERBS) | last.isin(VERBS)
    some = first.isin(ADJECTIVES) | last.isin(ADJECTIVES)
    every = first.isin(ADJECTIVES) & last.isin(ADJECTIVES)
    noun = F.regexp(last, F.lit("...(" + "|".join(NOUN_ENDINGS) + ")$"))
    gain = F.when(n == 2, F.lit(1.55)).otherwise(F.lit(1.0)) * F.when(noun, F.lit(1.35)).otherwise(F.lit(1.0)) * F.when(some, F.lit(0.30)).otherwise(F.lit(1.0))
    return F.when(verb | every | (n > 2), F.lit(0.0)).otherwise(score.cast("double") * gain)
