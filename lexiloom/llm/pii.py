"""PII replacement by keyed surrogates.

Entities (e-mail addresses, phone numbers, payment cards, bank accounts (IBAN), IP addresses, assigned secrets, titled person names) are found in whole texts
and brought to a canonical form.  Each distinct entity gets one surrogate of its type from a keyed generator: same length and
character classes, valid check digits for cards and accounts, valid octets for addresses, the same script and gender for names.  Surrogates that
two entities share, or that equal an entity of the corpus, are drawn again until all are distinct, so equal entities stay equal in all
documents (coreference) and different ones stay different.  Rendering copies separators and letter case of each mention.

The table of entities is distributed; a document's part of it is joined to its text by digest, so a mention that a third of all
documents share is one row, and what is grouped is bounded by one text.  Patterns take time linear in the text, however long.

Edge cases: a null text stays null, an empty one empty; repeated rows change alike; numbers that fail their check (Luhn, mod 97,
octets above 255) are no entities; an empty table gives no rows; extra columns of any name are kept by ``replace``, save one named
n_entities, which the result's own replaces.  Where a form has no free surrogate left (ATTEMPTS draws), the job fails and says so.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import query, table, unused, whole_text

KEY = b"lexiloom surrogates"
FEMALE = "Mrs Ms Miss Frau Sra Señora Madame Mme Mlle".split()
MALE = "Mr Herr Sr Señor Monsieur".split()
NEUTRAL = "Dr Prof Mx".split()
# Syllables of invented names by script; the last syllable shows the gender.
SYLLABLES = {
    "Latin": ("ba be bo da de di ka ke la le li lo ma me mi na ne ni ra re ri ro sa se ta te ti va ve".split(), {"f": ["na", "ra", "lia", "ta"], "m": ["nor", "ram", "lus", "ton"], "": ["den", "ser", "mel", "rin"]}),
    "Cyrillic": ("ба бе во да де ка ке ла ле ли ма ме ми на не ра ре ри са се та те ти".split(), {"f": ["на", "ра", "лия", "та"], "m": ["нор", "рам", "лус", "тон"], "": ["ден", "сер", "мел", "рин"]}),
    "Greek": ("βα δε δα κα κε λα λε λι μα με μι να νε ρα ρε ρι σα σε τα τε τι".split(), {"f": ["να", "ρα", "λια", "τα"], "m": ["νορ", "ραμ", "λος", "των"], "": ["δεν", "σερ", "μελ", "ριν"]}),
}
# Name parts that are written small between others; they stay as they are.
PARTICLES = "van|von|der|den|de|del|della|di|da|dos|du|la|le|zu"
# A name part: one word, or several joined by hyphens or apostrophes.
NAME = r"(?:\p{Lu}['’])?\p{Lu}[\p{Ll}\p{M}]+(?:[-'’]?\p{Lu}[\p{Ll}\p{M}]+)*"
PART = regex.compile(NAME)
ATTEMPTS = 200
TITLES = "|".join(sorted(FEMALE + MALE + NEUTRAL, key=len, reverse=True))
EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]++@(?:[\w-]++\.)+[A-Za-z]{2,}")  # by the standard engine, which is linear in runs of labels
PATTERN = regex.compile(
    rf"""(?P<secret>(?<![^\W_])(?i:api[_-]?key|access[_-]?key|token|secret(?:[_-]?key)?|passwd|password)\b["']?\s*[:=]\s*(?:(?P<quote>["'])(?P<value>(?:(?!(?P=quote))[^\r\n])+)(?P=quote)
        |["']?(?P<value>[A-Za-z0-9+/_\-]{{16,}}|(?=[A-Za-z+/_\-]*\d)(?=[\d+/_\-]*[A-Za-z])[A-Za-z0-9+/_\-]{{6,}})))
    |(?P<ip>(?<![\d.])(?:\d{{1,3}}\.){{3}}\d{{1,3}}(?![\d.]*\d))
    |(?P<phone>(?<![\w.])(?:\+\d{{1,3}}[ .-]?)?\(\d{{2,4}}\)[ .-]?\d{{3,4}}[ .-]?\d{{3,4}}(?!\w)|(?<![\w.])\+\d{{1,3}}(?:[ .-]\d{{2,4}}){{2,4}}(?!\w)|(?<![\w.])\+\d{{8,15}}(?!\w)|(?<![\w.-])\d{{3}}(?:-\d{{3}}-|\.\d{{3}}\.)\d{{4}}(?![\w-]|\.\d))
    |(?P<iban>(?<!\w)[A-Z]{{2}}\d{{2}}(?:\ ?[A-Z0-9]{{4}}){{2,7}}(?:\ ?[A-Z0-9]{{1,3}})?(?!\w))
    |(?P<card>(?<![\w.])\d(?:[ -]?\d){{12,18}}(?!\w))
    |(?P<person>\b(?P<title>{TITLES})\b\.?\ (?P<names>(?:(?:{PARTICLES})\ ){{0,2}}{NAME}(?:\ (?:(?:{PARTICLES})\ ){{0,2}}{NAME}){{0,3}}))""",
    regex.VERBOSE,
)
HINT = regex.compile(rf"[@\d]|\b(?:{TITLES})\b|(?i:token|secret|passw|key)")


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    kind: str
    canonical: str


def _luhn(digits: str) -> int:
    """The sum that a valid number has as a multiple of ten."""
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))


def _account_rest(account: str) -> int:
    """The rest modulo 97 of an account number with its first four characters moved to the end; 1 for a valid one."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def _script(name: str) -> str:
    return next((s for s in SYLLABLES if regex.search(rf"\p{{{s}}}", name)), "Latin")


def _card_end(found: str) -> int:
    """Where the longest valid number of 13 to 19 digits ends with which the run of digit groups begins; 0 if there is none."""
    for end in (len(found), *(i for i in range(len(found) - 1, 12, -1) if found[i] in " -")):
        digits = "".join(c for c in found[:end] if c.isdecimal())
        if len(digits) >= 13 and len(set(digits)) > 1 and _luhn(digits) % 10 == 0:
            return end
    return 0


def mentions(text: str) -> Iterator[Mention]:
    """Entities from left to right.  A person's names are entities of their own, so that a family shares its surrogate."""
    if not HINT.search(text):
        return
    at, emails, other = 0, EMAIL.finditer(text), PATTERN.search(text)
    email = next(emails, None)
    while True:
        while email and email.start() < at:
            email = next(emails, None)
        if other and other.start() < at:
            other = PATTERN.search(text, at)
        if email and (not other or email.start() <= other.start()):
            at = email.end()
            yield Mention(email.start(), at, "email", email[0].lower())
            continue
        if not other:
            return
        m, at = other, other.end()
        kind = next(k for k in ("secret", "ip", "phone", "iban", "card", "person") if m[k] is not None)
        found = m[kind]
        digits = "".join(c for c in found if c.isdecimal())
        if kind == "secret":
            yield Mention(*m.span("value"), kind, m["value"])
        elif kind == "ip":
            if all(int(x) < 256 for x in found.split(".")):
                yield Mention(m.start(), m.end(), kind, found)
        elif kind == "phone":
            yield Mention(m.start(), m.end(), kind, digits)
        elif kind == "iban":
            account = found.replace(" ", "")
            if 15 <= len(account) <= 34 and _account_rest(account) == 1:
                yield Mention(m.start(), m.end(), kind, account)
            else:
                at = m.start() + 2
        elif kind == "card":
            if size := _card_end(found):
                at = m.start() + size
                yield Mention(m.start(), at, kind, "".join(c for c in found[:size] if c.isdecimal()))
            elif separator := regex.search("[ -]", found):  # a number before the card, or before a phone number
                at = m.start() + separator.end()
        else:
            gender = "f" if m["title"] in FEMALE else "m" if m["title"] in MALE else ""
            parts = list(PART.finditer(text, *m.span("names")))
            for part in parts:
                yield Mention(*part.span(), "family" if part is parts[-1] else "given-" + gender, part[0].lower())


class _Draws:
    """An endless keyed stream of small numbers."""

    def __init__(self, *parts: str):
        self.seed, self.count, self.pool = "\0".join(parts).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool = hashlib.blake2b(self.seed + self.count.to_bytes(4), key=KEY).digest()
            self.count += 1
        value, self.pool = int.from_bytes(self.pool[:4]), self.pool[4:]
        return value % n

    def pick(self, items):
        return items[self.below(len(items))]


def _classwise(text: str, draws: _Draws) -> str:
    out = []
    for c in text:
        if c in "0123456789":
            out.append(str(draws.below(10)))
        elif "a" <= c <= "z":
            out.append(draws.pick("abcdef" if c <= "f" else "ghijklmnopqrstuvwxyz"))
        elif "A" <= c <= "Z":
            out.append(draws.pick("ABCDEF" if c <= "F" else "GHIJKLMNOPQRSTUVWXYZ"))
        elif c.isalpha():
            out.append(draws.pick("abcdefghijklmnopqrstuvwxyz"))
        else:
            out.append(c)
    return "".join(out)


def surrogate(kind: str, canonical: str, attempt: int) -> str:
    """The canonical form of the replacement; another one for each attempt."""
    draws = _Draws(kind, canonical, str(attempt))
    if kind == "email":
        user, _, domain = canonical.rpartition("@")
        name, dot, top = domain.rpartition(".")
        return f"{_classwise(user, draws)}@{_classwise(name, draws)}{dot}{top}"
    if kind == "ip":
        return ".".join(str(1 + draws.below(254)) for _ in range(4))
    if kind == "iban":
        open_account = canonical[:2] + "00" + _classwise(canonical[4:], draws)
        return f"{canonical[:2]}{98 - _account_rest(open_account):02}{open_account[4:]}"
    if kind == "card":
        body = canonical[0] + "".join(str(draws.below(10)) for _ in canonical[2:])
        return body + str(-_luhn(body + "0") % 10)
    if kind == "phone":
        return "".join(c if i < len(canonical) - 10 else str(draws.below(10)) for i, c in enumerate(canonical))
    if kind == "secret":
        # short values have few surrogates of their length, marks alone have none
        drawn = sum(c.isalpha() or c in "0123456789" for c in canonical)
        more = attempt // 4 if drawn < 16 else 0
        return _classwise(canonical if drawn else "x" * len(canonical), draws) + "".join(str(draws.below(10)) for _ in range(more))
    inner, last = SYLLABLES[_script(canonical)]
    gender = kind.removeprefix("given-") if kind.startswith("given-") else ""

    def drawn_name(part: str) -> str:
        return part if len(part) < 2 else "".join(draws.pick(inner) for _ in range(2 + attempt // 4)) + draws.pick(last[gender])

    return "".join(part if part in "-'’" else drawn_name(part) for part in re.split("([-'’])", canonical) if part)


def rendered(mention: str, replacement: str) -> str:
    """The replacement in the shape of the mention: its separators, its case."""
    digits = [c for c in replacement if c.isdecimal()]
    if len(digits) == len(replacement) == sum(c.isdecimal() for c in mention):
        rest = iter(digits)
        return "".join(next(rest) if c.isdecimal() else c for c in mention)
    if " " in mention and len(replacement) == len(mention.replace(" ", "")):
        rest = iter(replacement)
        return "".join(" " if c == " " else next(rest) for c in mention)
    if mention.isupper() and any(c.isalpha() for c in replacement):
        return replacement.upper()
    if mention[:1].isupper() and PART.fullmatch(mention):
        return "".join(part.capitalize() for part in re.split("([-'’])", replacement))
    return replacement


def _entities(docs: DataFrame) -> DataFrame:
    """(digest, kind, canonical) of every text with entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                if found := {(m.kind, m.canonical) for m in mentions(text)}:
                    digest = hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()
                    rows += [(digest, *f) for f in sorted(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["digest", "kind", "canonical"])

    found = docs.select(whole_text().alias("text")).mapInArrow(run, "digest string, kind string, canonical string")
    return cut_lineage(found.distinct(), "entities")


def _drawn(entities: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [surrogate(*row.values()) for row in batch.to_pylist()]
            yield batch.append_column("surrogate", pa.array(made, pa.string()))

    return entities.select("kind", "canonical", "attempt").mapInArrow(run, "kind string, canonical string, attempt int, surrogate string")


def assign(entities: DataFrame) -> DataFrame:
    """(kind, canonical, surrogate), one row per entity, all surrogates of a kind distinct and none an entity of the corpus."""
    real = cut_lineage(entities.select("kind", "canonical").distinct(), "real")
    drawn = cut_lineage(_drawn(real.withColumn("attempt", F.lit(0))), "drawn")
    for _ in range(ATTEMPTS):
        taken = real.select("kind", F.col("canonical").alias("surrogate"), F.lit(True).alias("is_real"))
        first = drawn.groupBy("kind", "surrogate").agg(F.count("*").alias("sharers"), F.min(F.struct("attempt", "canonical")).alias("first"))
        clashes = first.join(taken, ["kind", "surrogate"], "left").where("sharers > 1 or is_real")
        marked = drawn.join(clashes, ["kind", "surrogate"], "left").withColumn("again", F.col("sharers").isNotNull() & (F.col("is_real").isNotNull() | (F.col("first.canonical") != F.col("canonical"))))
        if not marked.where("again").limit(1).count():
            return drawn.select("kind", "canonical", "surrogate")
        kept = marked.where("not again").select("kind", "canonical", "attempt", "surrogate")
        again = _drawn(marked.where("again").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt")))
        drawn = cut_lineage(kept.union(again), "drawn")
    raise ValueError(f"no distinct surrogates after {ATTEMPTS} draws: some form of entity has more entities than surrogates")


def replace(docs: DataFrame, length: str | None = None) -> DataFrame:
    """The documents with ``text`` replaced; other columns as they are, plus n_entities as the last one.

    ``length`` names a column that holds the text's code points and is kept in step.
    """
    docs = docs.drop("n_entities")
    entities = _entities(docs)
    pairs = F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\0", "kind", "canonical"), "surrogate"))).alias(unused("names", docs.columns))
    own_digest = unused("digest", docs.columns)
    names = entities.join(assign(entities), ["kind", "canonical"]).groupBy(F.col("digest").alias(own_digest)).agg(pairs)
    joined = docs.join(cut_lineage(names, "surrogates"), F.md5(whole_text()) == F.col(own_digest), "left").drop(own_digest)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, names in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1), strict=True):
                count, parts, done = 0, [], 0
                if names.is_valid:
                    held = dict(names.as_py())
                    for m in mentions(text):
                        new = held[f"{m.kind}\0{m.canonical}"]
                        parts += [text[done : m.start], new if m.kind == "secret" else rendered(text[m.start : m.end], new)]
                        count, done = count + 1, m.end
                texts.append("".join([*parts, text[done:]]) if count else text)
                counts.append(count)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], "n_entities"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    replaced = joined.mapInArrow(run, f"{kinds}, n_entities long")
    if length is None:
        return replaced
    own = F.when(F.col("n_entities") > 0, F.char_length("text")).otherwise(F.col(length)).cast(docs.schema[length].dataType)
    return replaced.withColumn(length, own)


@query("op4_surrogates")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after replacement."""
    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"))
