"""Keys for romanised text: normal form, phonetic key, consonant key, initials.

The rewrites never cross a space, so they run on whole phrases inside generated code instead of
word by word in an interpreted lambda.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PRIMARY, Script, nfc, split_words, strip_accents, words

# The ordered rewrites of the phonetic key.  ("lit", a, b) is a literal replacement,
# ("re", a, b) a pattern, ("map", a, b) single characters.
PHONETIC_RULES = (
    ("lit", "aa", "a"),
    ("re", "ee|ii", "i"),
    ("re", "oo|uu", "u"),
    ("re", "ai|ae", "e"),
    ("lit", "au", "o"),
    ("lit", "chh", "ch"),
    ("lit", "kh", "k"),
    ("lit", "gh", "g"),
    ("lit", "th", "t"),
    ("lit", "dh", "d"),
    ("lit", "ph", "p"),
    ("lit", "bh", "b"),
    ("lit", "jh", "j"),
    ("lit", "sh", "s"),
    ("lit", "ng", "g"),
    ("re", "n(?=[mb])", ""),
    ("map", "wyqx", "vikk"),
    ("re", r"([aeiou])\1+", "$1"),
)
# Fixed value: endings dropped from words of more than three letters.
FINAL = r"(?:ahi|eh|[aeiou])\b(?<=[a-z]{4})"


def roman_normal(value: Column) -> Column:
    """Accents stripped, lower case, ``(x)`` opened, everything but a-z a single space."""
    lowered = F.lower(strip_accents(value))
    opened = F.regexp_replace(lowered, r"\(([a-z])\)", "$1")
    return F.trim(F.regexp_replace(opened, "[^a-z]+", " "))


def phonetic_of_normal(normal: Column) -> Column:
    """Phonetic key of text that is already in roman normal form."""
    for kind, old, new in PHONETIC_RULES:
        if kind == "lit":
            normal = F.replace(normal, F.lit(old), F.lit(new))
        elif kind == "map":
            normal = F.translate(normal, old, new)
        else:
            normal = F.regexp_replace(normal, old, new)
    return F.regexp_replace(normal, FINAL, "")


def phonetic(value: Column) -> Column:
    """Phonetic key of a phrase; a bracketed optional nasal is dropped."""
    bare = F.regexp_replace(value, r"(?i)\(n\)(?=h[aeiou])", " ")
    return phonetic_of_normal(roman_normal(F.regexp_replace(bare, r"(?i)\(n\)", "")))


def consonants(value: Column) -> Column:
    """Phonetic key without vowels; empty words stay as empty slots, as the reader has them."""
    return F.regexp_replace(phonetic(value), "[aeiou]", "")


def nasal_marked(value: Column) -> Column:
    """Without such a mark the phonetic key is the one of the normal form."""
    return value.rlike(r"(?i)\(n\)")


def phonetic_nasal(value: Column) -> Column:
    """Phonetic key with the optional nasals spoken; null where none is marked."""
    return F.when(nasal_marked(value), phonetic(F.regexp_replace(value, r"(?i)\(n\)", "n")))


def phonetic_index(value: Column) -> Column:
    """array<string>: distinct phonetic words, without and with the optional nasals."""
    base = split_words(phonetic(value))
    return F.array_distinct(F.when(nasal_marked(value), F.concat(base, split_words(phonetic_nasal(value)))).otherwise(base))


def consonant_index(phonetic_words: Column) -> Column:
    return F.array_distinct(split_words(F.translate(F.array_join(phonetic_words, " "), "aeiou", "")))


def roman_initials(value: Column) -> Column:
    """Query side: first phonetic letter of each word."""
    return first_letters(phonetic_of_normal(roman_normal(value)))


def first_letters(key: Column) -> Column:
    """First letter of each word of a key."""
    return F.array_join(F.transform(split_words(key), lambda w: F.substring(w, 1, 1)), "")


def primary_initials(value: Column, script: Script = PRIMARY) -> Column:
    """Query side: first letter that is not a mark, of each word; a word is a run of the script's block."""
    marks = f"[{script.marks}]*+" if script.marks else ""
    letter = f"[{script.block}&&[^{script.marks}]]" if script.marks else f"[{script.block}]"
    found = F.regexp_extract_all(nfc(value), F.lit(f"{marks}({letter})(?:{script.letter})?+"), F.lit(1))
    return F.array_join(found, "")


def primary_initials_indexed(value: Column) -> Column:
    """Index side: first code point of each letter run."""
    return F.array_join(F.transform(words(value), lambda w: F.substring(w, 1, 1)), "")


def roman_initials_indexed(value: Column) -> Column:
    """Index side: first letter of each a-z run."""
    runs = F.regexp_extract_all(F.lower(strip_accents(value)), F.lit("[a-z]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.substring(w, 1, 1)), "")


# -- the reader's own fold, which differs from the keys above ---------------------------------------


def reader_fold(value: Column) -> Column:
    """Like the normal form, but doubled vowels collapse."""
    lowered = F.lower(strip_accents(value))
    opened = F.regexp_replace(lowered, r"\(([a-z])\)", "$1")
    spaced = F.regexp_replace(opened, r"[^a-z]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r"([aeiou])\1+", "$1"), " +", " "))


def reader_key(value: Column) -> Column:
    """Folded word key used to pair tokens of the two scripts."""
    keyed = reader_fold(value)
    keyed = F.replace(keyed, F.lit("aa"), F.lit("a"))
    keyed = F.regexp_replace(keyed, "ee|ii", "i")
    keyed = F.regexp_replace(keyed, "oo|uu", "u")
    keyed = F.regexp_replace(keyed, "ai|ae", "e")
    keyed = F.replace(keyed, F.lit("au"), F.lit("o"))
    keyed = F.replace(keyed, F.lit("ng"), F.lit("g"))
    keyed = F.regexp_replace(keyed, r"(?:eai|ahi|ai|ee|[aeiou])(?= |$)", "")
    return F.replace(keyed, F.lit(" "), F.lit(""))
