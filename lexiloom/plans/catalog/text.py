"""Text functions as columns over the lines and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import roman as rm
from ...functions import text as tx
from ...functions.text import LATIN
from ...operators.alignment import is_citation, is_heading
from ...sources import driver_tables as src
from .. import oracle as o
from ..oracle import BLOCK, LINES, SPACE, ZERO_WIDTH, with_
from ..registry import query

HEADS = ("The", "Der", "La", "Le")


def _column(name, expression, sql, alias="value"):
    """A query that is one expression over every line."""

    @query(name, with_(LINES) + f"SELECT line_id, {sql} AS {alias} FROM lines")
    def run(spark, sf):
        return src.lines(spark, sf).select("line_id", expression(F.col("text")).alias(alias))


T = "text"
NASAL = lambda c: F.replace(c, F.lit("on"), F.lit("o(n)"))
NASAL_SQL = "replace(text, 'on', 'o(n)')"
_DISTINCT = "list_distinct({0})"

_column("X4_whitespace_key", tx.whitespace_key, o.fold_space("nfc_normalize(text)"))
_column("X5_align_key", tx.align_key, o.fold_space(f"regexp_replace(nfc_normalize(text), '[{ZERO_WIDTH}]', '', 'g')"))
_COMPACT = f"regexp_replace(replace(nfc_normalize(text), '੍', 'ੑ'), '[{ZERO_WIDTH}{SPACE}]', '', 'g')"
_column("X6_compact_key", tx.compact_key, _COMPACT)
_column("X6_loose_key", tx.loose_key, f"translate({_COMPACT}, '।॥|', '')")
_column("X7_roman_normal", lambda c: rm.roman_normal(NASAL(c)), o.roman_normal(NASAL_SQL))
_column(
    "X8_phonetic_word",
    lambda c: rm.phonetic_of_normal(F.regexp_extract(rm.roman_normal(c), "[a-z]+$", 0)),
    o.phonetic_of_normal(f"regexp_extract({o.roman_normal(T)}, '[a-z]+$')"),
)
_column("X9_phonetic_phrase", lambda c: rm.phonetic(NASAL(c)), o.phonetic(NASAL_SQL))
_column("X10_consonant_phrase", lambda c: rm.consonants(NASAL(c)), f"regexp_replace({o.phonetic(NASAL_SQL)}, '[aeiou]', '', 'g')")


def _joined(values):
    return F.array_join(F.array_sort(values), " ")


_BASE = o.split_words(o.phonetic(NASAL_SQL))
_WITH = o.split_words(o.phonetic(f"regexp_replace({NASAL_SQL}, '\\(n\\)', 'n', 'gi')"))
_INDEX = f"list_distinct(list_concat({_BASE}, {_WITH}))"
_column("X11_phonetic_index", lambda c: _joined(rm.phonetic_index(NASAL(c))), f"array_to_string(list_sort({_INDEX}), ' ')")
_column(
    "X11_consonant_index",
    lambda c: _joined(rm.consonant_index(rm.phonetic_index(NASAL(c)))),
    f"array_to_string(list_sort(list_distinct(list_filter(list_transform({_INDEX}, lambda w: regexp_replace(w, '[aeiou]', '', 'g')), lambda w: w <> ''))), ' ')",
)
_column("X12_primary_normal", lambda c: tx.primary_normal(c, LATIN), o.primary_normal(T))
_column("X12_primary_loose", lambda c: tx.primary_loose(c, LATIN), o.loose_of_normal(o.primary_normal(T)))
_first = "array_to_string(list_transform({0}, lambda w: {1}), '')"
_column(
    "X13_initials_query_side",
    lambda c: F.concat_ws("|", rm.primary_initials(c, LATIN), rm.roman_initials(c)),
    _first.format(o.split_words(o.primary_normal(T)), f"substr({o.loose_of_normal('w')}, 1, 1)")
    + " || '|' || "
    + _first.format(o.split_words(o.phonetic_of_normal(o.roman_normal(T))), "substr(w, 1, 1)"),
)
_column(
    "X14_initials_index_side",
    lambda c: F.concat_ws("|", rm.primary_initials_indexed(c), rm.roman_initials_indexed(c)),
    _first.format("regexp_extract_all(text, '[\\p{L}\\p{M}]+')", "substr(w, 1, 1)")
    + " || '|' || "
    + _first.format("regexp_extract_all(lower(strip_accents(text)), '[a-z]+')", "substr(w, 1, 1)"),
)
_column("X15_script_test", lambda c: tx.has_script(c, tx.Script(r"\x{00C0}-\x{024F}", "")), "regexp_matches(text, '[\\x{00C0}-\\x{024F}]')")


def _reader_fold(x):
    value = f"regexp_replace(lower(strip_accents({x})), '\\(([a-z])\\)', '\\1', 'g')"
    value = f"regexp_replace({value}, '[^a-z]', ' ', 'g')"
    for v in "aeiou":
        value = f"regexp_replace({value}, '{v}{{2,}}', '{v}', 'g')"
    return f"trim(regexp_replace({value}, ' +', ' ', 'g'))"


def _reader_key(x):
    value = _reader_fold(x)
    for a, b in (("aa", "a"), ("ee|ii", "i"), ("oo|uu", "u"), ("ai|ae", "e"), ("au", "o"), ("ng", "g")):
        value = f"regexp_replace({value}, '{a}', '{b}', 'g')"
    words = f"list_transform(string_split({value}, ' '), lambda w: regexp_replace(w, '(?:eai|ahi|ai|ee|[aeiou])$', ''))"
    return f"array_to_string({words}, '')"


_column("X28_reader_fold", rm.reader_fold, _reader_fold(T))
_column("X28_reader_key", rm.reader_key, _reader_key(T))
_column("X29_ui_fold", tx.ui_fold, f"regexp_replace(lower(strip_accents(text)), '^[{SPACE}]+|[{SPACE}]+$', '', 'g')")
_column(
    "X27_line_kind",
    lambda c: F.when(is_heading(c, HEADS), "heading").when(is_citation(c, r"^[-–—]\s*\p{Lu}"), "citation").otherwise("verse"),
    "CASE WHEN regexp_matches(text, '^(The|Der|La|Le)') THEN 'heading' WHEN regexp_matches(text, '^[-–—]\\s*\\p{Lu}') THEN 'citation' ELSE 'verse' END",
)
_column(
    "X25_canonical_digest",
    lambda c: F.sha2(F.to_json(F.struct(F.col("line_id").alias("id"), F.col("line_order").alias("order")), {"ignoreNullFields": "false"}), 256),
    """sha256('{"id":"' || line_id || '","order":' || line_order || '}')""",
)


_W = "regexp_extract_all(text, '[\\p{L}\\p{M}]+')"


@query(
    "X31_array_utilities",
    with_(LINES)
    + f"""SELECT line_id, array_to_string(list_sort(list_distinct(w)), ' ') AS distinct_words,
  array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || '-' || w[i + 1]), ' ') AS pairs FROM (SELECT line_id, {_W} AS w FROM lines)""",
)
def array_utilities(spark, sf):
    w = src.lines(spark, sf).select("line_id", tx.words(F.col("text")).alias("w"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.size("w")),
                       lambda a, b: F.concat_ws("-", a, b))
    return w.select(
        "line_id", F.array_join(F.array_sort(F.array_distinct("w")), " ").alias("distinct_words"), F.array_join(pairs, " ").alias("pairs")
    )


_EDGES = f"'^[{SPACE}]+|[{SPACE}]+$'"


def _decode(x):
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"), ("&quot;", '"')):
        x = f"regexp_replace({x}, '{entity}', '{char}', 'gi')"
    return x


def _tags(x, gap):
    x = f"regexp_replace({x}, '<bani:[^>]*>', '', 'gi')"
    x = f"regexp_replace({x}, '<br[{SPACE}]*/?[{SPACE}]*>', chr(10), 'gi')"
    return f"regexp_replace({x}, '<[^>]+>', '{gap}', 'g')"


def _as_lines(x):
    return f"list_filter(list_transform(regexp_split_to_array({x}, '\\r?\\n'), lambda v: {o.fold_space('v')}), lambda v: v <> '')"


def _markup(name, function, sql):
    @query(
        name,
        f"""SELECT page_id, CAST(i - 1 AS INTEGER) AS line_index, v[i] AS line FROM (
  SELECT page_id, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT page_id, {sql} AS v FROM pages))""",
    )
    def run(spark, sf):
        pages = src.table(spark, sf, "pages")
        return pages.select("page_id", F.posexplode(function(F.col("html"))).alias("line_index", "line"))


_markup("X16_markup_lines", tx.markup_lines, _as_lines(_decode(_tags(f"regexp_replace(html, {_EDGES}, '', 'g')", " "))))
_markup("X16_markup_lines_decoded_first", tx.markup_lines_decoded_first, _as_lines(_tags(_decode("html"), "")))
PLAIN = o.fold_space("regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' ', 'g')")


@query("X16_plain_text", f"SELECT page_id, {PLAIN} AS plain FROM pages")
def plain_text(spark, sf):
    return src.table(spark, sf, "pages").select("page_id", tx.plain_text(F.col("html")).alias("plain"))


_AT = "coalesce(list_min(list_filter([instr(lower(c), 'tion') - 1, instr(lower(c), 'that') - 1], lambda p: p >= 0)), 0)"


@query(
    "X17_excerpt",
    f"""SELECT page_id, CASE WHEN s > 0 THEN '…' ELSE '' END || regexp_replace(substr(c, s + 1, e - s), {_EDGES}, '', 'g')
  || CASE WHEN e < length(c) THEN '…' ELSE '' END AS excerpt FROM (
  SELECT page_id, c, greatest(0, a - 110) AS s, least(length(c), a + 260) AS e FROM (
    SELECT page_id, c, {_AT} AS a FROM (SELECT page_id, {PLAIN} AS c FROM pages)))""",
)
def excerpt(spark, sf):
    plain = src.table(spark, sf, "pages").select("page_id", tx.plain_text(F.col("html")).alias("c"))
    return plain.select("page_id", tx.excerpt(F.col("c"), F.array(F.lit("tion"), F.lit("that"))).alias("excerpt"))


@query(
    "F13_whole_word_term",
    f"""SELECT page_id, regexp_matches(c, '(?i)(^|[^a-z])of[-\\s]+the([^a-z]|$)') AS phrase, regexp_matches(c, '(?i)(^|[^a-z])that([^a-z]|$)') AS word
  FROM (SELECT page_id, {PLAIN} AS c FROM pages)""",
)
def whole_word(spark, sf):
    plain = src.table(spark, sf, "pages").select("page_id", tx.plain_text(F.col("html")).alias("c"))
    c = F.col("c")
    return plain.select(
        "page_id", tx.contains_term(c, F.lit("of-the")).alias("phrase"), tx.contains_term(c, F.lit("that")).alias("word")
    )


@query(
    "X22_numeric_coercion",
    """SELECT p_partkey, COALESCE(TRY_CAST(substr(p_brand, 7) AS DOUBLE), -1) AS whole, COALESCE(TRY_CAST(p_brand AS DOUBLE), p_size) AS fallback,
  CAST(NULLIF(regexp_extract(substr(p_brand, 7) || ' pieces', '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT) AS leading FROM part""",
)
def numeric(spark, sf):
    digits = F.substring("p_brand", 7, 9)
    return src.table(spark, sf, "part").select(
        "p_partkey",
        tx.number_or(digits, F.lit(-1.0)).alias("whole"),
        tx.number_or(F.col("p_brand"), F.col("p_size").cast("double")).alias("fallback"),
        tx.leading_int(F.concat(digits, F.lit(" pieces"))).alias("leading"),
    )


@query(
    "X23_id_parts",
    with_(o.LAYERS)
    + """SELECT layer_id, content_type, substr(layer_id, 1, length(layer_id) - length(content_type) - 1) AS group_id,
  split_part(layer_id, ':', 2) || ' · subsection ' || split_part(layer_id, ':', 3) AS title FROM layers""",
)
def id_parts(spark, sf):
    from ...operators.provider import group_id

    parts = F.split("layer_id", ":")
    return src.layers(spark, sf).select(
        "layer_id",
        "content_type",
        group_id().alias("group_id"),
        F.concat(parts[1], F.lit(" · subsection "), parts[2]).alias("title"),
    )


@query(
    "X24_json_fields",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '{"type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS rebuilt
  FROM events""",
)
def json_fields(spark, sf):
    parsed = src.table(spark, sf, "events").withColumn("p", F.from_json("props", "k int"))
    rebuilt = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("p.k").alias("k")))
    return parsed.select("event_id", F.col("p.k").alias("k"), rebuilt.alias("rebuilt"))


@query("X26_release_date", "SELECT o_orderkey, 'release-' || strftime(o_orderdate, '%Y-%m-%d') AS release_id FROM orders")
def release_date(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return src.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("release-"), day).alias("release_id"))
