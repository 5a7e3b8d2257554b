"""Exact forms: tokens, frequencies, rankings, concordance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.text import LATIN, compare_form, token_class, tokens
from ...operators import lexical as lx
from ...sources import driver_tables as src
from ..oracle import BLOCK, LEX, LINES, TOKEN, with_
from ..registry import query

FORM = "the"
GROUP = ("the", "The", "of", "de", "notawordform")
GROUP_SQL = "('the'), ('The'), ('of'), ('de'), ('notawordform')"

_CLASS = f"""CASE WHEN regexp_full_match(exact_form, '[{BLOCK}]+') AND regexp_matches(exact_form, '[\\p{{L}}\\p{{M}}]') THEN 'lexical_primary'
  WHEN regexp_full_match(exact_form, '[\\p{{N}}]+') THEN 'numeric_marker'
  WHEN regexp_full_match(exact_form, '[\\p{{P}}]+') OR exact_form IN ('॥', '।') THEN 'punctuation'
  WHEN regexp_matches(exact_form, '[\\p{{L}}\\p{{M}}]') THEN 'lexical_other_script' ELSE 'unclassified' END"""
# whole piece (gap and token) and token, positions from running lengths
_PIECES = f"""pieces AS (
  SELECT line_id, text_unit_id, source_work_id,
    unnest(regexp_extract_all(text, '\\s*({TOKEN})', 0)) AS piece,
    unnest(regexp_extract_all(text, '\\s*({TOKEN})', 1)) AS exact_form,
    generate_subscripts(regexp_extract_all(text, '\\s*({TOKEN})', 0), 1) - 1 AS position FROM lines)"""


def _u16(x: str) -> str:
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def _ends(measure, name: str) -> str:
    window = "OVER (PARTITION BY line_id ORDER BY position ROWS UNBOUNDED PRECEDING)"
    end = f"SUM({measure('piece')}) {window}"
    return (
        f"CAST({end} - {measure('exact_form')} AS INTEGER) AS start_{name}, CAST({end} AS INTEGER) AS end_{name}"
    )


@query(
    "W1_token_offsets",
    with_(LINES, _PIECES)
    + f"""SELECT 'occurrence:' || line_id || ':' || position AS occurrence_id, line_id, text_unit_id, source_work_id,
  CAST(position AS INTEGER) AS position, {_ends(_u16, 'utf16')}, {_ends(lambda x: f'length({x})', 'cp')},
  {_ends(lambda x: f'strlen({x})', 'byte')}, exact_form, nfc_normalize(exact_form) AS compare_form,
  {_CLASS} AS token_class, 'analysis' AS analysis_release_id FROM pieces""",
)
def token_offsets(spark, sf):
    return lx.token_occurrences(src.lines(spark, sf), LATIN, "analysis")


@query("X1_compare_form", with_(LINES) + "SELECT line_id, nfc_normalize(text) AS compare_text FROM lines")
def compare_text(spark, sf):
    return src.lines(spark, sf).select("line_id", compare_form(F.col("text")).alias("compare_text"))


@query(
    "X2_token_pattern",
    with_(LINES)
    + f"""SELECT token, CAST(COUNT(*) AS BIGINT) AS n FROM (
  SELECT unnest(regexp_extract_all(text, '{TOKEN}')) AS token FROM lines) GROUP BY token""",
)
def token_pattern(spark, sf):
    found = src.lines(spark, sf).select(F.explode(tokens(F.col("text"))).alias("token"))
    return found.groupBy("token").agg(F.count("*").alias("n"))


@query(
    "X3_token_class",
    with_(LINES)
    + f"""SELECT token_class, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT {_CLASS} AS token_class FROM (
  SELECT unnest(regexp_extract_all(text, '{TOKEN}')) AS exact_form FROM lines)) GROUP BY token_class""",
)
def token_classes(spark, sf):
    found = src.lines(spark, sf).select(F.explode(tokens(F.col("text"))).alias("token"))
    return found.groupBy(token_class(F.col("token"), LATIN).alias("token_class")).agg(F.count("*").alias("n"))


_COUNTS = f"""SELECT '{FORM}' AS form, CAST(COUNT(*) FILTER (form = '{FORM}') AS BIGINT) AS raw_frequency,
  COUNT(DISTINCT CASE WHEN form = '{FORM}' THEN line_id END) AS distinct_lines,
  COUNT(DISTINCT CASE WHEN form = '{FORM}' THEN text_unit_id END) AS distinct_units,
  CAST(COUNT(*) AS BIGINT) AS eligible_tokens,
  COUNT(*) FILTER (form = '{FORM}') / COUNT(*) * 10000 AS per_ten_thousand FROM lex"""


@query("A1_exact_frequency", with_(LINES, LEX) + _COUNTS)
def exact_frequency(spark, sf):
    return lx.exact_frequency(src.lines(spark, sf), FORM, LATIN)


@query("A1_exact_frequency_scoped", with_(LINES, LEX) + _COUNTS + " WHERE source_work_id = 'source:en'")
def exact_frequency_scoped(spark, sf):
    scoped = src.lines(spark, sf).filter(F.col("source_work_id") == "source:en")
    return lx.exact_frequency(scoped, FORM, LATIN)


@query(
    "A1_exact_occurrences",
    with_(LINES, _PIECES)
    + f"""SELECT 'occurrence:' || line_id || ':' || position AS occurrence_id, line_id, text_unit_id
  FROM pieces WHERE exact_form = '{FORM}'""",
)
def exact_occurrences(spark, sf):
    return lx.exact_occurrences(src.lines(spark, sf), FORM, LATIN).select("occurrence_id", "line_id", "text_unit_id")


@query(
    "X30_rate_zero_as_null",
    with_(LINES, LEX)
    + """SELECT 'notawordform' AS form, NULLIF(COUNT(*) FILTER (form = 'notawordform'), 0)::BIGINT AS raw_frequency,
  NULLIF(COUNT(DISTINCT CASE WHEN form = 'notawordform' THEN line_id END), 0) AS distinct_lines,
  NULLIF(COUNT(DISTINCT CASE WHEN form = 'notawordform' THEN text_unit_id END), 0) AS distinct_units,
  NULLIF(COUNT(*) FILTER (form = 'notawordform'), 0) / COUNT(*) * 10000 AS per_ten_thousand FROM lex""",
)
def rate_zero_as_null(spark, sf):
    return lx.exact_frequency(src.lines(spark, sf), "notawordform", LATIN, zero_as_null=True)


@query(
    "A2_related_form_frequency",
    with_(LINES, LEX)
    + f"""SELECT g.form, CAST(COUNT(l.form) AS BIGINT) AS raw_frequency, COUNT(DISTINCT l.line_id) AS distinct_lines,
  COUNT(DISTINCT l.text_unit_id) AS distinct_units,
  (SELECT CAST(COUNT(*) AS BIGINT) FROM lex WHERE form IN (SELECT col0 FROM (VALUES {GROUP_SQL}))) AS combined_raw_frequency
  FROM (VALUES {GROUP_SQL}) g(form) LEFT JOIN lex l ON l.form = g.form GROUP BY g.form""",
)
def related_frequency(spark, sf):
    return lx.related_form_frequency(src.lines(spark, sf), GROUP, LATIN)


_RANK = """SELECT form, CAST(COUNT(*) AS BIGINT) AS frequency, COUNT(DISTINCT line_id) AS distinct_lines,
  COUNT(DISTINCT text_unit_id) AS distinct_units FROM lex GROUP BY form"""


@query("A3_ranked_forms", with_(LINES, LEX) + _RANK)
def ranked_forms(spark, sf):
    return lx.ranked_forms(src.lines(spark, sf), LATIN)


@query("T2_top_forms", with_(LINES, LEX) + _RANK + " ORDER BY frequency DESC, form LIMIT 30")
def top_forms(spark, sf):
    return lx.ranked_forms(src.lines(spark, sf), LATIN, limit=30)


@query("T9_collated_ranking", with_(LINES, LEX) + _RANK)
def collated_ranking(spark, sf):
    return lx.ranked_forms(src.lines(spark, sf), LATIN, collation="pa")


@query(
    "A5_grouped_frequency",
    with_(LINES, LEX)
    + f"""SELECT 'form' AS row_kind, g.form, CAST(COUNT(l.form) AS BIGINT) AS frequency,
  CAST(NULL AS BIGINT) AS distinct_lines, CAST(NULL AS BIGINT) AS distinct_units
  FROM (VALUES {GROUP_SQL}) g(form) LEFT JOIN lex l ON l.form = g.form GROUP BY g.form
  UNION ALL SELECT 'group', NULL, COUNT(*), COUNT(DISTINCT line_id), COUNT(DISTINCT text_unit_id) FROM lex
  WHERE form IN (SELECT col0 FROM (VALUES {GROUP_SQL}))""",
)
def grouped_frequency(spark, sf):
    return lx.grouped_frequency(src.lines(spark, sf), GROUP, LATIN)


_PAGE = """counted AS (SELECT exact AS form, CAST(COUNT(*) AS BIGINT) AS frequency, COUNT(DISTINCT line_id) AS distinct_lines
  FROM lex WHERE starts_with(exact, 'e') GROUP BY exact)"""


@query(
    "A6_ranked_forms_page",
    with_(LINES, LEX, _PAGE)
    + """SELECT form, frequency, distinct_lines, (SELECT COUNT(*) FROM counted) AS total FROM counted
  ORDER BY frequency DESC, form LIMIT 100 OFFSET 100""",
)
def ranked_page(spark, sf):
    return lx.ranked_forms_page(src.lines(spark, sf), LATIN, letter="e", limit=100, offset=100)


@query(
    "A7_prefix_forms",
    with_(LINES, LEX)
    + """SELECT form, CAST(COUNT(*) AS BIGINT) AS frequency FROM lex WHERE starts_with(form, 'th') GROUP BY form
  ORDER BY frequency DESC, form LIMIT 12""",
)
def prefix_forms(spark, sf):
    return lx.prefix_forms(src.lines(spark, sf), "th", LATIN)


_HOLD = f"held AS (SELECT * FROM lines WHERE line_id IN (SELECT line_id FROM lex WHERE form = '{FORM}'))"
_LINE_COLUMNS = "line_id, source_work_id, text_unit_id, contributor_id, line_order, page_no, text"


@query("A8_concordance", with_(LINES, LEX, _HOLD) + f"SELECT {_LINE_COLUMNS} FROM held")
def concordance(spark, sf):
    found = lx.concordance(src.lines(spark, sf), FORM, LATIN, limit=None)
    return found.select(*_LINE_COLUMNS.split(", "))


@query("A8_concordance_total", with_(LINES, LEX, _HOLD) + "SELECT COUNT(*) AS total FROM held")
def concordance_total(spark, sf):
    return lx.concordance_total(src.lines(spark, sf), FORM, LATIN)


@query(
    "T3_concordance_page",
    with_(LINES, LEX, _HOLD)
    + f"SELECT {_LINE_COLUMNS} FROM held ORDER BY source_work_id, page_no, line_order, line_id LIMIT 50 OFFSET 50",
)
def concordance_page(spark, sf):
    found = lx.concordance(src.lines(spark, sf), FORM, LATIN, limit=50, offset=50)
    return found.select(*_LINE_COLUMNS.split(", "))


@query(
    "T10_capped_matches",
    with_(LINES, LEX, _HOLD)
    + f"SELECT {_LINE_COLUMNS} FROM held ORDER BY source_work_id, page_no, line_order, line_id LIMIT 200",
)
def capped_matches(spark, sf):
    found = lx.concordance(src.lines(spark, sf), FORM, LATIN, limit=200)
    return found.select(*_LINE_COLUMNS.split(", "))


@query(
    "A23_forms_by_work",
    with_(LINES, LEX) + "SELECT source_work_id, COUNT(DISTINCT exact) AS distinct_forms FROM lex GROUP BY source_work_id",
)
def forms_by_work(spark, sf):
    return lx.forms_by_work(src.lines(spark, sf), LATIN)
