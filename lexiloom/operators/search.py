"""Tolerant search as a batch: a table of queries against the line table.

Everything about a pair of a query and a line is decided in the row of the line.  A line meets the queries whose rarest
word opens like one of its words; what the query needs is small, and is brought to the lines.  Neither texts nor pairs move.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.roman import (
    consonant_index,
    phonetic_index,
    phonetic_nasal,
    phonetic_of_normal,
    primary_initials_indexed,
    roman_initials_indexed,
    roman_normal,
)
from ..functions.scoring import CANDIDATE_KEYS, OMISSION_FROM, with_candidate_keys, with_query_keys
from ..functions.text import PRIMARY, Script, has_script, loose_of_normal, nfc, primary_normal, split_words
from ..session import cut_lineage
from .containment import substring_join
from .word_match import score_pairs

# Fixed values of the search: acceptance, first-letter scores.
MINIMUM_SCORE = 575.0
INITIALS_START, INITIALS_INSIDE = 790.0, 690.0
# What hits are ordered and shown by.
PLACE = ("line_id", "text_unit_id", "source_work_id", "page_no", "line_order")
# The texts of an index are read many times: packed tightly, and in groups small enough to deal out.
PACKED = {"compression": "zstd", "parquet.block.size": str(8 << 20)}
INITIALS = ("initials_primary", "initials_roman")
# Query words meet the words of a line by equality of up to this many opening characters.
HEAD = 4


@dataclass(frozen=True)
class SearchIndex:
    """strings: one row per line with its keys as strings.  Words are read off them, in which they take a fraction of the room."""

    strings: DataFrame
    script: Script

    @property
    def keys(self) -> DataFrame:
        return with_words(self.strings)


def line_strings(lines: DataFrame, script: Script = PRIMARY) -> DataFrame:
    """Search keys of every line as strings: what it is found by and what it is compared by."""
    filled = lines.withColumn("romanised", F.coalesce("romanised", F.lit(""))).select(*PLACE, "text", "romanised")
    return with_candidate_keys(filled, "text", "romanised", script).withColumns(
        {
            "roman_nasal": phonetic_nasal(F.col("romanised")),
            "initials_primary": nfc(primary_initials_indexed(F.col("text"))),
            "initials_roman": roman_initials_indexed(F.col("romanised")),
        }
    )


def with_words(strings: DataFrame) -> DataFrame:
    """Adds the word arrays of the five fields."""
    spoken = F.concat_ws(" ", "roman_key", "roman_nasal")
    return strings.withColumns(
        {
            "roman": split_words(F.col("roman_text")),
            "roman_phonetic": F.array_distinct(split_words(spoken)),
            "primary": split_words(F.col("primary_text")),
            "primary_loose": split_words(F.col("primary_key")),
        }
    ).withColumn("roman_consonants", consonant_index(F.col("roman_phonetic")))


def line_keys(lines: DataFrame, script: Script = PRIMARY) -> DataFrame:
    """Search keys of every line with its words."""
    return with_words(line_strings(lines, script))


def build_index(lines: DataFrame, script: Script = PRIMARY, stored: bool = True) -> SearchIndex:
    """With ``stored`` the strings are written once, because every step of a search reads some of them; the texts they were
    made from are not."""
    strings = line_strings(lines, script).drop("text", "romanised")
    return SearchIndex(cut_lineage(strings, "search-strings", **PACKED) if stored else strings, script)


def within(index: SearchIndex, lines: DataFrame) -> SearchIndex:
    """The index over the given lines only: a hit elsewhere is none, also where one word may be missing."""
    kept = index.strings.join(lines.select("line_id"), "line_id", "left_semi").select(*index.strings.columns)
    return replace(index, strings=cut_lineage(kept, "search-strings", **PACKED))


def query_words(queries: DataFrame, script: Script = PRIMARY) -> DataFrame:
    """Adds ``words``: array of (exact, second, third) prefixes, one entry per query word."""
    raw = F.col("query")
    primary = has_script(raw, script)
    normal = F.when(primary, primary_normal(raw, script)).otherwise(roman_normal(raw))
    words = split_words(normal)

    def options(word: Column) -> Column:
        keyed = phonetic_of_normal(word)
        return F.struct(
            word.alias("exact"),
            F.when(primary, loose_of_normal(word, script)).otherwise(keyed).alias("second"),
            F.when(primary, F.lit("")).otherwise(F.regexp_replace(keyed, "[aeiou]", "")).alias("third"),
        )

    return queries.withColumns({"is_primary": primary, "words": F.transform(words, options)})


# The fields a query word is looked for in, by its three prefixes; the place of a field marks its openings.
FIELDS = ("roman", "roman_phonetic", "roman_consonants", "primary", "primary_loose")
PREFIXES = {"roman": "exact", "roman_phonetic": "second", "roman_consonants": "third", "primary": "exact", "primary_loose": "second"}
# The widest prefix of a word, by which it is weighed.
WIDEST = ("roman_consonants", "primary_loose")


def _spaced(strings: DataFrame, *columns: str) -> DataFrame:
    """``columns``, and the words of a line by field with a space before each; once, not for each word that is looked for."""
    spoken = F.concat(F.lit(" "), F.concat_ws(" ", "roman_key", "roman_nasal"))
    words = {
        "roman": F.concat(F.lit(" "), F.col("roman_text")),
        "roman_phonetic": spoken,
        "roman_consonants": F.translate(spoken, "aeiou", ""),
        "primary": F.concat(F.lit(" "), F.col("primary_text")),
        "primary_loose": F.concat(F.lit(" "), F.col("primary_key")),
    }
    return strings.select(*columns, *[F.coalesce(words[f], F.lit("")).alias(f"in_{f}") for f in FIELDS])


def _holds(field: str, word: Column) -> Column:
    """Some word of the line's field begins with the word's prefix for it."""
    prefix = word[PREFIXES[field]]
    return (prefix != "") & F.contains(F.col(f"in_{field}"), F.concat(F.lit(" "), prefix))


def _matched(word: Column) -> Column:
    """The query word prefix-matches some word of the line."""
    roman = _holds("roman", word) | _holds("roman_phonetic", word) | _holds("roman_consonants", word)
    return F.when(F.col("is_primary"), _holds("primary", word) | _holds("primary_loose", word)).otherwise(roman)


def _lacking(words: Column) -> Column:
    return F.size(F.filter(words, lambda word: ~_matched(word)))


def _options(words: DataFrame, *fields: str) -> DataFrame:
    """One row per prefix that a query word is looked for by: the number of its field and what a word of the line opens with then."""
    named = lambda n, field: F.struct(F.lit(n).alias("field"), F.col("word")[PREFIXES[field]].alias("prefix"))
    sides = [F.array(*[named(n, f) for n, f in enumerate(FIELDS) if f.startswith(side) and f in fields]) for side in ("primary", "roman")]
    options = words.select("*", F.inline(F.when(F.col("is_primary"), sides[0]).otherwise(sides[1]))).filter("prefix <> ''")
    return options.withColumn("opening", F.concat(F.col("field").cast("string"), F.substring("prefix", 1, HEAD))).drop("prefix")


def _met(spaced: DataFrame, asked: DataFrame) -> DataFrame:
    """Lines by the distinct openings of their words, joined with ``asked`` by its ``opening``."""
    kind = F.concat(F.substring("opening", 1, 1), F.length("opening").cast("string"))
    found = []
    for number, *length in sorted(r[0] for r in asked.select(kind).distinct().collect()):
        marked = F.replace(F.col(f"in_{FIELDS[int(number)]}"), F.lit(" "), F.lit(f" {number}"))
        pattern = f" ({number}[^ ]{{{int(''.join(length)) - 1}}})"
        found.append(F.array_distinct(F.regexp_extract_all(marked, F.lit(pattern), F.lit(1))))
    # the outer form, as Spark would cut every line once more to ask whether it has any
    opened = spaced.select("*", F.explode_outer(F.concat(*found) if found else F.array(F.lit(""))).alias("begun"))
    # numbers meet faster than strings; the strings decide
    keyed = opened.withColumn("key", F.xxhash64("begun")).join(asked.withColumn("key", F.xxhash64("opening")), "key")
    return keyed.filter(F.startswith("begun", F.col("opening")) & F.startswith("opening", F.col("begun"))).drop("key", "begun")


def _asked(queries: DataFrame, index: SearchIndex) -> DataFrame:
    """Queries with their keys, one row each: ``query_no``, the words from rare to frequent, the letters of the initials;
    ``missing``: how many words a line lacks, 0 so far."""
    keyed = query_words(with_query_keys(queries.select("query_id", "query"), "query", index.script), index.script)
    letters = F.replace("wanted", F.lit(" "), F.lit("")).alias("letters")
    # small next to the corpus and read by every step below: kept, not recomputed, and of known size
    rows = cut_lineage(
        keyed.filter(F.size("words") > 0).select(
            F.monotonically_increasing_id().alias("query_no"), "query_id", "is_primary", "words", "wanted", "wanted_key", letters, F.lit(0).alias("missing")
        ),
        "queries",
    )
    words = rows.select("query_no", "is_primary", F.posexplode("words").alias("word_no", "word"))
    options = _options(words, *WIDEST).select("query_no", "word_no", "opening")
    openings = cut_lineage(options.select("opening").distinct(), "query-openings")
    counted = _met(_spaced(index.strings), openings).groupBy("opening").agg(F.count("*").alias("df"))
    counted = cut_lineage(counted, "query-weights")
    # only an order to look at words in: by lines that open the widest prefix; last the words without one, which are all vowels
    weighed = words.join(options, ["query_no", "word_no"], "left").join(counted, "opening", "left")
    place = F.struct(F.col("opening").isNull().alias("bare"), F.coalesce("df", F.lit(0)).alias("df"), "word_no", "word")
    ranked = weighed.groupBy("query_no").agg(F.sort_array(F.collect_list(place)).alias("w"))
    return cut_lineage(rows.drop("words").join(ranked.select("query_no", F.col("w.word").alias("words")), "query_no"), "query-words")


def _retrieved() -> Column:
    """All words match but as many as are ``missing``; the rarest words leave little for a look at all."""
    rarest = F.slice("words", F.lit(1), F.lit(OMISSION_FROM))
    return (_lacking(rarest) <= F.col("missing")) & (_lacking(F.col("words")) == F.col("missing"))


def _pairs(asked: DataFrame, index: SearchIndex, *columns: str) -> DataFrame:
    """Lines and the queries that they hold all words but ``missing`` of, each pair once: all of ``asked`` and ``columns`` of the line.

    A line with all words holds the rarest one, and a line with one word missing holds one of the two rarest, so a line is
    looked at for the queries of which it opens one of these words, by the first of them and of their prefixes that it holds.
    """
    rare = F.posexplode(F.slice("words", F.lit(1), F.col("missing") + 1)).alias("rank", "word")
    words = asked.select("query_no", "is_primary", F.col("words")[0].alias("rarest"), rare)
    seeds = cut_lineage(_options(words, *FIELDS), "query-seeds")
    met = _met(_spaced(index.strings, *columns), seeds)
    # one prefix after another: a pair comes once, whatever else of the word the line holds
    by_prefix, before = F.lit(False), F.lit(False)
    for number, field in enumerate(FIELDS):
        held = (F.col("is_primary") == field.startswith("primary")) & _holds(field, F.col("word"))
        by_prefix = F.when(F.col("field") == number, held & ~before).otherwise(by_prefix)
        before = before | held
    met = met.filter(by_prefix).filter((F.col("rank") == 0) | ~_matched(F.col("rarest")))
    full = met.drop("is_primary", "rarest", "rank", "word", "field", "opening").join(asked, "query_no")
    return full.filter(_retrieved()).drop(*[f"in_{f}" for f in FIELDS])


def _planned(queries: DataFrame, index: SearchIndex) -> DataFrame:
    """``_asked`` with ``missing`` 1 for the queries of at least four words that no line holds all words of."""
    asked = _asked(queries, index)
    many = asked.filter(F.size("words") >= OMISSION_FROM)
    whole = _pairs(many, index).select("query_no").distinct()
    open_queries = many.select("query_no").join(whole, "query_no", "left_anti").withColumn("open", F.lit(1))
    plan = asked.drop("missing").join(open_queries, "query_no", "left").withColumn("missing", F.coalesce("open", F.lit(0)))
    return cut_lineage(plan.drop("open"), "query-plan")


def retrieved(queries: DataFrame, index: SearchIndex, *columns: str) -> DataFrame:
    """Retrieved pairs with the keys of the query and ``columns`` of the line."""
    return _pairs(_planned(queries, index), index, *columns)


def _counted(pairs: DataFrame) -> DataFrame:
    n = F.size("words")
    return pairs.select("query_id", "line_id", (n - F.col("missing")).alias("matched_words"), n.alias("n_words"))


def retrieve(queries: DataFrame, index: SearchIndex) -> DataFrame:
    """(query_id, line_id, matched_words, n_words) of the lines a query retrieves.

    All words must match; when nothing does and the query has at least four words, one may be missing.
    """
    return _counted(retrieved(queries, index, "line_id"))


def retrieve_whole(queries: DataFrame, index: SearchIndex) -> DataFrame:
    """Only the lines that hold all words."""
    return _counted(_pairs(_asked(queries, index), index, "line_id"))


def retrieve_omitted(queries: DataFrame, index: SearchIndex) -> DataFrame:
    """Only the lines that a word is missing from, of queries that no line holds all words of."""
    return _counted(_pairs(_planned(queries, index).filter("missing = 1"), index, "line_id"))


def initials_hits(queries: DataFrame, index: SearchIndex) -> DataFrame:
    """First-letter matches: the query's letters inside the line's initials; 790 at the start, else 690."""
    raw = F.col("query")
    primary = has_script(raw, index.script)
    normal = F.when(primary, primary_normal(raw, index.script)).otherwise(roman_normal(raw))
    asked = queries.select("query_id", primary.alias("is_primary"), F.replace(normal, F.lit(" "), F.lit("")).alias("letters"))
    hits = None
    for flag, column in ((True, "initials_primary"), (False, "initials_roman")):
        side = asked.filter(F.col("is_primary") == flag).drop("is_primary")
        first = F.col("primary_first" if flag else "roman_first")
        held = index.strings.select("line_id", F.col(column).alias("initials"), first.alias("first"))
        found = substring_join(side, held, "letters", "initials", "line_id", stored=True)
        scored = found.select(
            "query_id",
            "line_id",
            F.when(F.startswith("first", F.col("letters")), INITIALS_START).otherwise(INITIALS_INSIDE).alias("score"),
            F.lit("first-letters").alias("match_kind"),
        )
        hits = scored if hits is None else hits.unionByName(scored)
    return hits


def _by_letters(initials: Column, first: Column) -> Column:
    """Score of the query's letters in the line's initials; null without."""
    letters = F.col("letters")
    found = (letters != "") & F.contains(initials, letters)
    return F.when(found, F.when(F.startswith(first, letters), INITIALS_START).otherwise(INITIALS_INSIDE))


def line_hits(queries: DataFrame, index: SearchIndex, columns: tuple[str, ...] = PLACE) -> DataFrame:
    """Scores of lines over text and first-letter paths, at least the minimum, with ``columns`` of the line: one row for
    each row of ``queries`` and line."""
    plan = _planned(queries, index)
    out = ("query_id", *columns, "score", "match_kind")
    kept = F.struct("query_id", *columns).alias("kept")
    initials = F.when(F.col("is_primary"), F.col("initials_primary")).otherwise(F.col("initials_roman")).alias("initials")
    pairs = _pairs(plan, index, *columns, *CANDIDATE_KEYS, *INITIALS)
    scored = score_pairs(pairs.select(kept, "is_primary", "wanted", "wanted_key", "letters", *CANDIDATE_KEYS, initials), index.script)
    # text wins a tie: it is looked at first
    by_letters = _by_letters(F.col("initials"), F.col("first"))
    better = F.coalesce(by_letters > F.col("score"), F.lit(False))
    hits = scored.select(
        "kept.*", F.when(better, by_letters).otherwise(F.col("score")).alias("score"),
        F.when(better, "first-letters").otherwise(F.col("match_kind")).alias("match_kind"),
    )
    for flag, side in ((True, "primary"), (False, "roman")):
        asked = plan.filter(F.col("is_primary") == flag)
        texts = _spaced(index.strings, *columns, f"initials_{side}", f"{side}_first")
        found = substring_join(asked.select("query_no", "letters"), texts, "letters", f"initials_{side}", "line_id").drop("letters").join(asked, "query_no")
        # lines that the words retrieve have both scores above
        found = found.filter(~_retrieved()).withColumns(
            {"score": _by_letters(F.col(f"initials_{side}"), F.col(f"{side}_first")), "match_kind": F.lit("first-letters")}
        )
        hits = hits.unionByName(found.select(*out))
    return hits.filter(F.col("score") >= MINIMUM_SCORE)


def scored_lines(queries: DataFrame, index: SearchIndex, columns: tuple[str, ...] = PLACE) -> DataFrame:
    """Best score per (query, line) over text and first-letter paths, at least the minimum."""
    asked = queries.select("query_id", "query").distinct()
    hits = line_hits(asked, index, columns)
    if asked.groupBy("query_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return hits
    # an id of several texts: the best of them, text before first letters
    preference = F.struct("score", F.when(F.col("match_kind") == "first-letters", 0).otherwise(1))
    return hits.groupBy("query_id", *columns).agg(F.max("score").alias("score"), F.max_by("match_kind", preference).alias("match_kind"))


def first_per_unit(hits: DataFrame, preferred_work: str = "") -> DataFrame:
    """One hit per (query, unit): score, preferred work, reading order.  A partial aggregate, so a
    query that hits a large share of the corpus is reduced before it is shuffled."""
    order = F.struct(
        -F.col("score"), F.when(F.col("source_work_id") == preferred_work, 0).otherwise(1), "page_no", "line_order", "line_id"
    )
    kept = [c for c in hits.columns if c not in ("query_id", "text_unit_id")]
    best = hits.groupBy("query_id", "text_unit_id").agg(F.min_by(F.struct(*kept), order).alias("hit"))
    return best.select("query_id", "text_unit_id", "hit.*")


def top_per_query(hits: DataFrame, limit: int, preferred_work: str = "") -> DataFrame:
    """The result list of each query; Spark keeps only ``limit`` rows per task before the shuffle."""
    order = W.partitionBy("query_id").orderBy(
        F.col("score").desc(),
        F.when(F.col("source_work_id") == preferred_work, 0).otherwise(1),
        "page_no",
        "line_order",
        "line_id",
    )
    return hits.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)


def search(queries: DataFrame, index: SearchIndex, limit: int = 60, preferred_work: str = "") -> DataFrame:
    """Ranked units for every query."""
    return top_per_query(first_per_unit(scored_lines(queries, index), preferred_work), limit, preferred_work)


def aligned_forms(hits: DataFrame, fold, key) -> DataFrame:
    """Primary-script tokens opposite the romanised tokens equal to the query, when both counts agree.

    ``hits``: query, text, romanised; ``fold`` and ``key`` are the reader's folds.  A token is keyed once, not wherever it
    stands: the distinct ones that answer a query are few, stored, and met by equality.
    """
    from ..functions.text import words

    latin = split_words(fold(F.col("romanised")))
    # stored, or Spark would key every token to leave out nulls before it takes the distinct ones
    distinct = cut_lineage(hits.select(F.explode_outer(latin).alias("form")).distinct(), "aligned-words")
    keyed = distinct.select(F.col("form").alias("romanised"), key(F.col("form")).alias("wanted"))
    asked = hits.select("query_id", "query").distinct().select("query_id", "query", key(F.col("query")).alias("wanted"))
    wanted = cut_lineage(keyed.join(asked, "wanted").select("query_id", "query", "romanised"), "aligned-tokens")
    # steps of their own, and the outer form: words are cut once, not again for each condition on them
    paired = hits.select("query_id", "query", "line_id", words(F.col("text")).alias("a"), latin.alias("b"))
    zipped = paired.select("query_id", "query", "line_id", F.when(F.size("a") == F.size("b"), F.arrays_zip("a", "b")).alias("pairs"))
    rows = zipped.select("query_id", "query", "line_id", F.posexplode_outer("pairs").alias("position", "p"))
    rows = rows.select("query_id", "query", "line_id", "position", F.col("p.a").alias("form"), F.col("p.b").alias("romanised"))
    return rows.join(wanted, ["query_id", "query", "romanised"]).select("query_id", "line_id", "position", "form", "romanised")


def all_families(units: DataFrame, families: list[DataFrame]) -> DataFrame:
    """Unit hits (family 0), and analysis hits of units that are none of them (families from 1).

    Every input: query_id, text_unit_id, result_id, score, position.
    """
    shown = units.select("query_id", "text_unit_id").distinct()
    out = units.withColumn("family", F.lit(0))
    for number, family in enumerate(families, 1):
        unseen = family.join(shown, ["query_id", "text_unit_id"], "left_anti")
        out = out.unionByName(unseen.withColumn("family", F.lit(number)))
    return out


def with_families(units: DataFrame, families: list[DataFrame], limit: int) -> DataFrame:
    """All families in order, cut at ``limit`` per query."""
    order = W.partitionBy("query_id").orderBy("family", "position", "result_id")
    ranked = all_families(units, families).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= limit)


def response_mode(results: DataFrame, queries: DataFrame, script: Script = PRIMARY) -> DataFrame:
    """Label per query: 'primary' for one in the primary script, 'english' when analysis hits outnumber unit hits, else 'latin'.

    ``results``: all hits, before any cut.  ``queries``: query_id, query.
    """
    counted = results.groupBy("query_id").agg(
        F.count_if(F.col("family") == 0).alias("unit_hits"), F.count_if(F.col("family") > 0).alias("analysis_hits")
    )
    asked = queries.select("query_id", has_script(F.col("query"), script).alias("is_primary"))
    label = F.when(F.col("is_primary"), "primary").when(F.col("analysis_hits") > F.col("unit_hits"), "english").otherwise("latin")
    return counted.join(asked, "query_id").withColumn("mode", label).drop("is_primary")


def merge_alternatives(hits: DataFrame, limit: int, key: tuple[str, ...]) -> DataFrame:
    """Results of all alternatives of a session, best per ``key``, ``limit`` kept per session."""
    order = F.struct(-F.col("score"), "query_id", "position")
    kept = [c for c in hits.columns if c not in ("session_id", *key)]
    best = hits.groupBy("session_id", *key).agg(F.min_by(F.struct(*kept), order).alias("h"))
    flat = best.select("session_id", *key, "h.*")
    ranked = W.partitionBy("session_id").orderBy(F.col("score").desc(), "query_id", F.col("position"), *key)
    return flat.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= limit)
