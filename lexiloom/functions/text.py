"""Column expressions on text: normal forms, tokens, folding, markup.

All functions take and return ``Column``.  Only Unicode normalisation leaves the JVM, and only for
the rows that can need it.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed value: the white-space set of ECMAScript, spelled out because Java's \s is ASCII only.
SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# Fixed value: zero-width characters and byte-order mark dropped by the alignment keys.
ZERO_WIDTH = r"\x{200B}-\x{200D}\x{FEFF}"
# Java decides one range quickly and a class of several slowly: these come first wherever most characters fall under them.
NOT_VISIBLE = "(?![!-~])"
WORD = r"(?:[a-z]++|[\p{L}\p{M}])++"
TOKEN = rf"{WORD}|[\p{{N}}]+|[^{SPACE}]"


@dataclass(frozen=True)
class Script:
    """A primary script: bodies of regex character classes, not whole patterns."""

    block: str
    marks: str
    # one range inside the block that most letters lie in: looked at first, as a class of several ranges is slow
    common: str = ""

    @property
    def letter(self) -> str:
        """Pattern of a run of characters of the block, which never gives one back."""
        return f"(?:[{self.common}]++|[{self.block}])++" if self.common else f"[{self.block}]++"

    @property
    def outside(self) -> str:
        """Pattern of a run of other characters."""
        one = f"(?![{self.common}])[^{self.block}]"
        return f"{one}(?:{one})*+" if self.common else f"[^{self.block}]++"


# Default primary block and the marks its loose key removes.
PRIMARY = Script(
    block=r"\x{0A00}-\x{0A7F}",
    marks=r"\x{0A01}-\x{0A03}\x{0A3C}\x{0A3E}-\x{0A4D}\x{0A51}\x{0A70}-\x{0A71}\x{0A75}",
)
# Latin profile: the loose key drops vowels, as the default one drops vowel signs.
LATIN = Script(
    block=r"A-Za-z\x{00C0}-\x{024F}",
    marks=r"AEIOUaeiou\x{00C0}-\x{00C6}\x{00C8}-\x{00CF}\x{00D2}-\x{00D6}\x{00D9}-\x{00DC}"
    r"\x{00E0}-\x{00E6}\x{00E8}-\x{00EF}\x{00F2}-\x{00F6}\x{00F9}-\x{00FC}",
    common="a-z",
)

# A string made only of these code points, without the listed exceptions, is already in NFC: none of
# them composes with a predecessor, decomposes under NFC or can be reordered (see the test, which
# checks every code point against unicodedata).
NFC_MAYBE = r"[^\x{0000}-\x{02FF}\x{0964}\x{0965}\x{0A00}-\x{0A7F}\x{2010}-\x{2027}]|[\x{0A33}\x{0A36}\x{0A3C}\x{0A59}-\x{0A5B}\x{0A5E}]"
# The same code points as single ranges.  Java decides one range quickly and a union of several an order of magnitude
# slower, so the first test clears rows without any code point above U+02FF, and the others look for one range each.
NFC_ABOVE = r"[\x{0300}-\x{10FFFF}]"
NFC_RANGES = (
    r"[\x{0300}-\x{0963}]", r"[\x{0966}-\x{09FF}]", r"\x{0A33}", r"\x{0A36}", r"\x{0A3C}", r"[\x{0A59}-\x{0A5B}]", r"\x{0A5E}",
    r"[\x{0A80}-\x{200F}]", r"[\x{2028}-\x{10FFFF}]",
)
# NFD leaves ASCII untouched; the ranges below have no canonical decomposition either.
NFD_MAYBE = r"[^\x{0000}-\x{00BF}\x{2010}-\x{2027}]"


def _normalised(form: str, values: pa.Array) -> pa.Array:
    """Batch normalisation (pyarrow's own kernel does not recompose under NFC)."""
    return pa.array([None if v is None else unicodedata.normalize(form, v) for v in values.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _nfc(values: pa.Array) -> pa.Array:
    return _normalised("NFC", values)


@F.arrow_udf(StringType())
def _nfd(values: pa.Array) -> pa.Array:
    return _normalised("NFD", values)


def nfc_maybe(value: Column) -> Column:
    """Whether NFC_MAYBE is found, by ranges."""
    return value.rlike(NFC_ABOVE) & reduce(or_, [value.rlike(one) for one in NFC_RANGES])


def nfc(value: Column) -> Column:
    """NFC.  Rows that are NFC by inspection send a null to the Arrow worker, not their text."""
    return F.coalesce(_nfc(F.when(nfc_maybe(value), value)), value)


@F.arrow_udf(ArrayType(StringType()))
def _nfc_each(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else [unicodedata.normalize("NFC", item) for item in v] for v in values.to_pylist()], pa.list_(pa.string()))


def nfc_each(items: Column, maybe: Column) -> Column:
    """NFC of every item of an array; only arrays of texts that can need it (``nfc_maybe``) go to the worker."""
    return F.coalesce(_nfc_each(F.when(maybe, items)), items)


def nfd(value: Column) -> Column:
    return F.coalesce(_nfd(F.when(value.rlike(NFD_MAYBE), value)), value)


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """(from, to) for ``translate``: every character below U+3000 whose canonical decomposition minus
    U+0300..U+036F is one character, or nothing."""
    single, dropped = [], []
    for code in range(0x80, 0x3000):
        char = chr(code)
        if 0x300 <= code <= 0x36F:
            dropped.append(char)
            continue
        form = unicodedata.normalize("NFD", char)
        bare = "".join(c for c in form if not 0x300 <= ord(c) <= 0x36F)
        if bare != char and len(bare) == 1:
            single.append((char, bare))
    return "".join(c for c, _ in single) + "".join(dropped), "".join(b for _, b in single)


def strip_accents(value: Column) -> Column:
    """NFD minus U+0300..U+036F for alphabetic scripts, in one codegen'd pass."""
    source, target = _accent_table()
    return F.translate(value, source, target)


def fold_space(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, f"{NOT_VISIBLE}[{SPACE}]+", " "))


# -- tokens ---------------------------------------------------------------------------------------


def tokens(value: Column) -> Column:
    """All tokens in order: letter/mark runs, digit runs, single other non-space code points."""
    return F.regexp_extract_all(value, F.lit(TOKEN), F.lit(0))


def words(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(WORD), F.lit(0))


def lexical_words(value: Column, script: Script = PRIMARY) -> Column:
    """Tokens of class ``lexical_primary``: letter runs that lie wholly inside the block."""
    letters = rf"[{script.block}&&[\p{{L}}\p{{M}}]]"
    run = f"(?:[{script.common}]++|{letters})++" if script.common else f"{letters}++"
    inside = rf"(?<![\p{{L}}\p{{M}}]){run}(?![\p{{L}}\p{{M}}])"
    return F.regexp_extract_all(value, F.lit(inside), F.lit(0))


def compare_words(value: Column, script: Script = PRIMARY) -> Column:
    """Compare forms (NFC) of the lexical tokens.

    The whole line is normalised once; inside a block whose marks attach to its own letters this is
    the same as normalising token by token.
    """
    return lexical_words(nfc(value), script)


def token_class(token: Column, script: Script = PRIMARY) -> Column:
    return (
        F.when(token.rlike(f"^{script.letter}$") & token.rlike(r"[\p{L}\p{M}]"), "lexical_primary")
        .when(token.rlike(r"^\p{N}+$"), "numeric_marker")
        .when(token.rlike(r"^\p{P}+$") | token.isin("॥", "।"), "punctuation")
        .when(token.rlike(r"[\p{L}\p{M}]"), "lexical_other_script")
        .otherwise("unclassified")
    )


def pieces(value: Column) -> Column:
    """Tokens together with the white space before them; put together they are the text again."""
    return F.regexp_extract_all(value, F.lit(f"(?:{NOT_VISIBLE}[{SPACE}])*+(?:{TOKEN})"), F.lit(0))


def piece_token(piece: Column) -> Column:
    return F.regexp_replace(piece, f"^[{SPACE}]+", "")


def utf16_length(value: Column) -> Column:
    """Length in UTF-16 units; only text beyond the basic plane is encoded to find out."""
    wide = (F.octet_length(F.encode(value, "UTF-16BE")) / 2).cast("int")
    length = F.length(value)
    return F.when((F.octet_length(value) >= length + 3) & value.rlike(r"[\x{10000}-\x{10FFFF}]"), wide).otherwise(length)


# Fixed value: marks that the loose key leaves out.
SENTENCE_MARKS = "।॥|"


# -- comparison keys ------------------------------------------------------------------------------


def compare_form(value: Column) -> Column:
    return nfc(value)


def whitespace_key(value: Column) -> Column:
    return fold_space(nfc(value))


def align_key(value: Column) -> Column:
    """NFC, no zero-width characters, folded spaces."""
    return fold_space(F.regexp_replace(nfc(value), f"{NOT_VISIBLE}[{ZERO_WIDTH}]", ""))


def compact_key(value: Column) -> Column:
    """NFC, virama written as udaat, no zero-width characters, no spaces at all."""
    swapped = F.replace(nfc(value), F.lit("੍"), F.lit("ੑ"))
    return F.regexp_replace(swapped, f"{NOT_VISIBLE}[{ZERO_WIDTH}{SPACE}]+", "")


def unmarked(key: Column) -> Column:
    """Without sentence marks; a replacement looks for bytes, ``translate`` at every character."""
    return reduce(lambda kept, mark: F.replace(kept, F.lit(mark), F.lit("")), SENTENCE_MARKS, key)


def loose_key(value: Column) -> Column:
    return unmarked(compact_key(value))


def primary_normal(value: Column, script: Script = PRIMARY) -> Column:
    """Only characters of the block, words separated by one space."""
    return F.trim(F.regexp_replace(nfc(value), script.outside, " "))


def primary_loose(value: Column, script: Script = PRIMARY) -> Column:
    """Normal form without vowel signs and other marks."""
    return loose_of_normal(primary_normal(value, script), script)


def loose_of_normal(normal: Column, script: Script = PRIMARY) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(normal, f"[{script.marks}]", ""), " +", " "))


def has_script(value: Column, script: Script = PRIMARY) -> Column:
    return value.rlike(f"[{script.block}]")


def ui_fold(value: Column) -> Column:
    lowered = F.lower(F.regexp_replace(nfd(value), r"[\x{0300}-\x{036F}]", ""))
    return F.regexp_replace(lowered, f"^[{SPACE}]+|[{SPACE}]+$", "")


def split_words(value: Column) -> Column:
    return F.filter(F.split(value, " "), lambda w: w != "")


# -- markup ---------------------------------------------------------------------------------------

# The entities the sources use, in decoding order.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&quot;", '"'))


def decode_entities(value: Column) -> Column:
    for entity, char in ENTITIES:
        value = F.regexp_replace(value, f"(?i){entity}", char)
    return value


def _drop_tags(value: Column, replacement: str) -> Column:
    value = F.regexp_replace(value, r"(?i)<bani:[^>]*>", "")
    value = F.regexp_replace(value, rf"(?i)<br[{SPACE}]*/?[{SPACE}]*>", "\n")
    return F.regexp_replace(value, r"<[^>]+>", replacement)


def _clean_lines(value: Column, script: Script | None) -> Column:
    lines = F.transform(F.split(value, "\r?\n"), fold_space)
    if script is None:
        return F.filter(lines, lambda line: line != "")
    return F.filter(lines, lambda line: (line != "") & has_script(line, script))


def markup_lines_decoded_first(value: Column, script: Script | None = None) -> Column:
    """Entities, then tags (dropped without a gap), then lines; the form of the first alignment."""
    return _clean_lines(_drop_tags(decode_entities(value), ""), script)


def markup_lines(value: Column, script: Script | None = None) -> Column:
    """Tags (each leaving a space), then entities, then lines; the form of the collection alignment."""
    trimmed = F.regexp_replace(value, f"^[{SPACE}]+|[{SPACE}]+$", "")
    return _clean_lines(decode_entities(_drop_tags(trimmed, " ")), script)


def plain_text(value: Column) -> Column:
    """Tags and ``&nbsp;`` to spaces, folded; the reader's form."""
    bare = F.regexp_replace(F.regexp_replace(value, r"<[^>]*>", " "), "&nbsp;", " ")
    return fold_space(bare)


def excerpt(content: Column, terms: Column, before: int = 110, after: int = 260) -> Column:
    """Window around the earliest term, with ellipses where text was left out."""
    lowered = F.lower(content)
    found = F.filter(F.transform(terms, lambda t: F.instr(lowered, t) - 1), lambda p: p >= 0)
    at = F.coalesce(F.array_min(found), F.lit(0))
    start = F.greatest(F.lit(0), at - before)
    end = F.least(F.length(content), at + after)
    body = fold_edges(F.substring(content, start + 1, end - start))
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(end < F.length(content), "…").otherwise(""))


def fold_edges(value: Column) -> Column:
    return F.regexp_replace(value, f"^[{SPACE}]+|[{SPACE}]+$", "")


def contains_term(content: Column, term: Column) -> Column:
    """Whole-word, case-insensitive; hyphen and space stand for each other."""
    quoted = F.regexp_replace(term, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    pattern = F.regexp_replace(quoted, f"[-{SPACE}]+", r"[-\\s]+")
    return F.regexp_like(content, F.concat(F.lit("(?iu)(^|[^a-z])"), pattern, F.lit("([^a-z]|$)")))


# -- small parsers --------------------------------------------------------------------------------


def number_or(value: Column, fallback: Column) -> Column:
    """Whole-string number, else the fallback; text that is not a number never raises."""
    return F.coalesce(value.cast("string").try_cast("double"), fallback)


def leading_int(value: Column) -> Column:
    """Integer at the start of the text (null when there is none)."""
    digits = F.regexp_extract(value.cast("string"), rf"^[{SPACE}]*([+-]?[0-9]+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("bigint")
