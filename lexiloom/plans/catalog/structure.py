"""Works, units, contributors and headings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.text import LATIN, lexical_words
from ...operators import facets as fc
from ...operators import structure as st
from ...operators import lexical as lx
from ...operators.alignment import attach_terms
from ...sources import driver_tables as src
from ..oracle import (
    ATTRIBUTIONS, CONTRIBUTORS, DICTIONARY, HEADED, LAYERS, LEX, LINES, MEMBERS, REFERENCE, TERMS, UNITS, with_,
)
from ..registry import query

WORKS = "works AS (SELECT DISTINCT 'source:' || lang AS source_work_id, lang AS upstream_id, upper(lang) AS title FROM documents)"
COMBINED = {
    "contributor:src2": ("contributor:combined:src2-3", "src2 and src3"),
    "contributor:src3": ("contributor:combined:src2-3", "src2 and src3"),
}
SEQUENCE = ("contributor:src7", "contributor:src1", "contributor:src12")
LINE = "line_id, source_work_id, text_unit_id, contributor_id, line_order, page_no, text"


def model(spark, sf, headings=True):
    return src.units(spark, sf), src.lines(spark, sf, headings), src.contributors(spark, sf)


def annotations(spark, sf):
    terms = attach_terms(src.lines(spark, sf), src.dictionary(spark, sf))
    return fc.Annotations(src.members(spark, sf), terms.select("line_id"), src.layers(spark, sf).filter("text_unit_id IS NOT NULL"))


@query(
    "A4_contributor_structure",
    with_(LINES, UNITS, CONTRIBUTORS, ATTRIBUTIONS)
    + """SELECT c.contributor_id, c.name, c.contributor_type,
  (SELECT COUNT(DISTINCT u.text_unit_id) FROM attributions a JOIN units u ON u.text_unit_id = a.target_id
    WHERE a.contributor_id = c.contributor_id AND u.unit_type = 'shabad') AS kind_count,
  (SELECT COUNT(DISTINCT u.text_unit_id) FROM attributions a JOIN units u ON u.text_unit_id = a.target_id
    WHERE a.contributor_id = c.contributor_id) AS attributed_unit_count,
  (SELECT COUNT(*) FROM lines l WHERE l.contributor_id = c.contributor_id) AS line_count FROM contributors c""",
)
def contributor_structure(spark, sf):
    units, lines, people = model(spark, sf, False)
    return st.contributor_structure(people, src.attributions(spark, sf), units, lines)


@query(
    "A11_heading_summaries",
    with_(HEADED)
    + """SELECT heading_id, heading, COUNT(DISTINCT text_unit_id) AS unit_count, CAST(COUNT(*) AS BIGINT) AS line_count,
  MIN(page_no) AS first_page FROM lines WHERE heading IS NOT NULL GROUP BY heading_id, heading""",
)
def heading_summaries(spark, sf):
    return st.heading_summaries(src.lines(spark, sf, True))


@query(
    "A12_heading_contributors",
    with_(HEADED, CONTRIBUTORS)
    + """SELECT l.source_work_id, l.heading, c.contributor_id, c.name, COUNT(DISTINCT text_unit_id) AS unit_count
  FROM lines l JOIN contributors c USING (contributor_id) WHERE heading IS NOT NULL GROUP BY ALL""",
)
def heading_contributors(spark, sf):
    return st.heading_contributors(src.lines(spark, sf, True), src.contributors(spark, sf))


_SUMMED = """per AS (SELECT c.contributor_id, c.name, c.contributor_type, COUNT(DISTINCT text_unit_id) AS u, COUNT(*) AS n
  FROM lines l JOIN contributors c USING (contributor_id) GROUP BY ALL)"""


@query(
    "A13_contributor_summaries",
    with_(LINES, CONTRIBUTORS, _SUMMED)
    + """SELECT CASE WHEN m THEN 'contributor:combined:src2-3' ELSE contributor_id END AS contributor_id,
  CASE WHEN m THEN 'src2 and src3' ELSE name END AS name, CASE WHEN m THEN 'author' ELSE contributor_type END AS contributor_type,
  CAST(SUM(u) AS BIGINT) AS unit_count, CAST(SUM(n) AS BIGINT) AS line_count
  FROM (SELECT *, contributor_id IN ('contributor:src2', 'contributor:src3') AS m FROM per) GROUP BY 1, 2, 3""",
)
def contributor_summaries(spark, sf):
    return st.contributor_summaries(src.lines(spark, sf), src.contributors(spark, sf), COMBINED)


_PREVIEW = "(SELECT arg_min(x.text, (x.page_no, x.line_order, x.line_id)) FROM lines x WHERE x.text_unit_id = u.text_unit_id)"
_PREVIEWS = """previews AS (SELECT text_unit_id, arg_min(text, (page_no, line_order, line_id)) AS preview FROM lines GROUP BY 1)"""


def _summary(where: str = "TRUE") -> str:
    return f"""SELECT u.text_unit_id, u.source_work_id, u.unit_order, COALESCE(u.title, 'Unit') AS title,
  COALESCE(MIN(l.contributor_id), '') AS contributor_id, COALESCE(MIN(c.name), 'Unknown contributor') AS contributor_name,
  COALESCE(MIN(l.page_no), 1) AS first_page, COALESCE(MAX(l.page_no), 1) AS last_page, CAST(COUNT(*) AS BIGINT) AS line_count,
  COALESCE(MIN(l.heading), 'Unclassified') AS heading, MIN(p.preview) AS preview
  FROM units u JOIN lines l USING (text_unit_id) JOIN previews p USING (text_unit_id)
  LEFT JOIN contributors c ON c.contributor_id = l.contributor_id
  WHERE {where} GROUP BY u.text_unit_id, u.source_work_id, u.unit_order, u.title"""


@query("A14_unit_summaries", with_(HEADED, UNITS, CONTRIBUTORS, _PREVIEWS) + _summary())
def unit_summaries(spark, sf):
    return st.unit_summaries(*model(spark, sf))


@query("J4_unit_previews", with_(LINES, _PREVIEWS) + "SELECT * FROM previews")
def unit_previews(spark, sf):
    return st.unit_previews(src.lines(spark, sf))


@query(
    "K11_contributor_units",
    with_(HEADED, UNITS, CONTRIBUTORS, _PREVIEWS)
    + _summary("l.contributor_id IN ('contributor:src2', 'contributor:src3') AND u.source_work_id = 'source:en'"),
)
def contributor_units(spark, sf):
    return st.contributor_units(*model(spark, sf), list(COMBINED), "source:en")


@query(
    "K11_heading_units",
    with_(HEADED, UNITS, CONTRIBUTORS, _PREVIEWS)
    + _summary("l.heading = 'Heading 1' AND u.source_work_id = 'source:en' AND l.contributor_id = 'contributor:src5'"),
)
def heading_units(spark, sf):
    return st.heading_units(*model(spark, sf), "Heading 1", "source:en", "contributor:src5")


@query(
    "T3_heading_units_page",
    with_(HEADED, UNITS, CONTRIBUTORS, _PREVIEWS)
    + _summary("l.heading = 'Heading 1'")
    + " ORDER BY first_page, unit_order, u.text_unit_id LIMIT 50 OFFSET 50",
)
def heading_units_page(spark, sf):
    return st.heading_units(*model(spark, sf), "Heading 1").offset(50).limit(50)


@query(
    "F24_summary_defaults",
    with_(HEADED, UNITS)
    + """SELECT u.text_unit_id, COALESCE(u.title, 'Unit') AS title, COALESCE(MIN(l.heading), 'Unclassified') AS heading
  FROM units u JOIN lines l USING (text_unit_id) GROUP BY u.text_unit_id, u.title""",
)
def summary_defaults(spark, sf):
    return st.unit_summaries(*model(spark, sf)).select("text_unit_id", "title", "heading")


@query(
    "A15_work_summaries",
    with_(LINES, WORKS)
    + """SELECT w.source_work_id, w.title, COALESCE(MAX(l.page_no), 1) AS max_page
  FROM works w LEFT JOIN lines l USING (source_work_id) GROUP BY ALL""",
)
def work_summaries(spark, sf):
    return st.work_summaries(src.works(spark, sf), src.lines(spark, sf))


@query(
    "A16_corpus_info",
    with_(LINES, LEX)
    + """SELECT 'release' AS build_kind, 'corpus-' || (SELECT COUNT(*) FROM documents) AS corpus_release_id,
  (SELECT COUNT(*) FROM lines) AS line_count, (SELECT COUNT(*) FROM lex) AS occurrence_count""",
)
def corpus_info(spark, sf):
    docs = src.table(spark, sf, "documents")
    release = docs.agg(F.count("*").cast("string").alias("n")).select(
        F.inline(F.array(
            F.struct(F.lit("build_kind").alias("key"), F.lit("release").alias("value")),
            F.struct(F.lit("corpus_release_id").alias("key"), F.concat(F.lit("corpus-"), "n").alias("value")),
        ))
    )
    return st.corpus_info(src.lines(spark, sf), F.size(lexical_words(F.col("text"), LATIN)), release)


@query(
    "J1_token_line_join",
    with_(HEADED, LEX)
    + """SELECT heading, contributor_id, form, CAST(COUNT(*) AS BIGINT) AS frequency FROM lex
  WHERE heading IS NOT NULL GROUP BY ALL""",
)
def token_line_join(spark, sf):
    lines = src.lines(spark, sf, True).filter(F.col("heading").isNotNull())
    forms = src.lines(spark, sf).select("line_id", F.explode(lexical_words(F.col("text"), LATIN)).alias("form"))
    counted = forms.groupBy("line_id", "form").agg(F.count("*").alias("n"))
    joined = counted.join(lines.select("line_id", "heading", "contributor_id"), "line_id")
    return joined.groupBy("heading", "contributor_id", "form").agg(F.sum("n").alias("frequency"))


@query(
    "J2_left_dimension_join",
    with_(HEADED)
    + """SELECT l.line_id, l.text_unit_id, l.heading, s.s_name AS supplier FROM lines l
  LEFT JOIN supplier s ON l.contributor_id = 'contributor:src' || s.s_suppkey AND s.s_acctbal > 5000""",
)
def left_dimension_join(spark, sf):
    people = src.table(spark, sf, "supplier").filter("s_acctbal > 5000").select(
        F.concat(F.lit("contributor:src"), F.col("s_suppkey").cast("string")).alias("contributor_id"),
        F.col("s_name").alias("supplier"),
    )
    lines = src.lines(spark, sf, True)
    return lines.join(people, "contributor_id", "left").select("line_id", "text_unit_id", "heading", "supplier")


@query(
    "J3_scalar_lookup",
    with_(LINES, CONTRIBUTORS)
    + """SELECT l.line_id, COALESCE((SELECT c.name FROM contributors c WHERE c.contributor_id = l.contributor_id), '')
  AS contributor_name FROM lines l""",
)
def scalar_lookup(spark, sf):
    people = src.contributors(spark, sf).select("contributor_id", "name")
    joined = src.lines(spark, sf).join(people, "contributor_id", "left")
    return joined.select("line_id", F.coalesce("name", F.lit("")).alias("contributor_name"))


@query(
    "J5_correlated_count",
    with_(UNITS, LAYERS)
    + """SELECT u.text_unit_id, (SELECT COUNT(*) FROM layers y WHERE y.text_unit_id = u.text_unit_id) AS layer_count FROM units u""",
)
def correlated_count(spark, sf):
    units = src.units(spark, sf).select("text_unit_id")
    return st.count_per_parent(units, src.layers(spark, sf), "text_unit_id", "layer_count")


@query(
    "J6_semi_join",
    with_(LINES, LAYERS) + f"SELECT {LINE} FROM lines l WHERE EXISTS (SELECT 1 FROM layers y WHERE y.text_unit_id = l.text_unit_id)",
)
def semi_join(spark, sf):
    return src.lines(spark, sf).join(src.layers(spark, sf), "text_unit_id", "left_semi").select(*LINE.split(", "))


_ANY = """l.line_id IN (SELECT line_id FROM members) OR l.line_id IN (SELECT line_id FROM terms)
  OR l.text_unit_id IN (SELECT text_unit_id FROM layers WHERE text_unit_id IS NOT NULL)"""
_FACETS = (LINES, REFERENCE, MEMBERS, DICTIONARY, TERMS, LAYERS)


@query("J7_any_annotation", with_(*_FACETS) + f"SELECT {LINE} FROM lines l WHERE {_ANY}")
def any_annotation(spark, sf):
    return fc.any_annotation(src.lines(spark, sf), annotations(spark, sf)).select(*LINE.split(", "))


@query(
    "J8_orphan_layers",
    with_(UNITS, LAYERS)
    + """SELECT y.layer_id, y.text_unit_id FROM layers y LEFT JOIN (SELECT * FROM units WHERE source_work_id <> 'source:en') u USING (text_unit_id)
  WHERE u.text_unit_id IS NULL AND y.text_unit_id IS NOT NULL""",
)
def orphan_layers(spark, sf):
    """Layers whose unit is none of the release, which here lacks one work."""
    mapped = src.layers(spark, sf).filter("text_unit_id IS NOT NULL")
    held = src.units(spark, sf).filter("source_work_id <> 'source:en'")
    return mapped.join(held, "text_unit_id", "left_anti").select("layer_id", "text_unit_id")


def _facet(name, facets, condition):
    @query(name, with_(HEADED, *_FACETS[1:]) + f"SELECT {LINE} FROM lines l WHERE {condition}")
    def run(spark, sf):
        found = fc.facet_filter(src.lines(spark, sf, True), facets, annotations(spark, sf))
        return found.select(*LINE.split(", "))


_facet(
    "F7_facets_combined",
    fc.Facets(work="source:en", heading="Heading 1", contributors=("contributor:src2", "contributor:src3"), annotated_only=True),
    "source_work_id = 'source:en' AND heading = 'Heading 1' AND contributor_id IN ('contributor:src2', 'contributor:src3') AND "
    f"({_ANY})",
)
_facet(
    "F7_facets_translation",
    fc.Facets(coverage="translation"),
    "line_id IN (SELECT line_id FROM members WHERE has_translation)",
)
_facet("F7_facets_word_analysis", fc.Facets(coverage="word-analysis"), "line_id IN (SELECT line_id FROM terms)")
_facet(
    "F7_facets_layer_types",
    fc.Facets(layer_types=("commentary_en",)),
    "text_unit_id IN (SELECT text_unit_id FROM layers WHERE content_type = 'commentary_en')",
)


@query("F8_optional_scope", with_(LINES) + "SELECT source_work_id, CAST(COUNT(*) AS BIGINT) AS n FROM lines WHERE source_work_id = 'source:de' GROUP BY 1")
def optional_scope(spark, sf):
    return fc.scope(src.lines(spark, sf), "source:de").groupBy("source_work_id").agg(F.count("*").alias("n"))


@query(
    "F9_text_filters",
    with_(LINES)
    + """SELECT line_id, starts_with(text, 'The') AS is_prefix, contains(lower(text), 'that') AS is_inside,
  regexp_matches(text, '.on[.]$') AS is_suffix FROM lines
  WHERE starts_with(text, 'The') OR contains(lower(text), 'that') OR regexp_matches(text, '.on[.]$')""",
)
def text_filters(spark, sf):
    flags = src.lines(spark, sf).select(
        "line_id",
        F.startswith("text", F.lit("The")).alias("is_prefix"),
        F.contains(F.lower("text"), F.lit("that")).alias("is_inside"),
        F.col("text").rlike(".on[.]$").alias("is_suffix"),
    )
    return flags.filter("is_prefix OR is_inside OR is_suffix")


@query(
    "F10_in_list",
    with_(LINES) + f"SELECT {LINE} FROM lines WHERE contributor_id IN ('contributor:src1', 'contributor:src4') AND text_unit_id IN "
    "(SELECT 'unit:' || doc_id FROM labels WHERE toxic = 1)",
)
def in_list(spark, sf):
    wanted = src.table(spark, sf, "labels").filter("toxic = 1").select(
        F.concat(F.lit("unit:"), F.col("doc_id").cast("string")).alias("text_unit_id")
    )
    short = src.lines(spark, sf).filter(F.col("contributor_id").isin("contributor:src1", "contributor:src4"))
    return short.join(wanted, "text_unit_id", "left_semi").select(*LINE.split(", "))


@query("S5_lines_of_page", with_(LINES) + f"SELECT {LINE} FROM lines WHERE source_work_id = 'source:en' AND page_no = 2")
def lines_of_page(spark, sf):
    docs = src.lines(spark, sf).filter((F.col("source_work_id") == "source:en") & (F.col("page_no") == 2))
    return docs.orderBy("text_unit_id", "line_order").select(*LINE.split(", "))


@query(
    "F18_portable_id",
    with_(UNITS)
    + """SELECT text_unit_id, CASE WHEN unit_order % 3 <> 0 THEN source_work_id || ':' || upstream_id ELSE text_unit_id END AS portable
  FROM units""",
)
def portable_ids(spark, sf):
    upstream = F.when(F.col("unit_order") % 3 != 0, F.col("upstream_id"))
    return src.units(spark, sf).select(
        "text_unit_id", st.portable_id(F.col("source_work_id"), upstream, F.col("text_unit_id")).alias("portable")
    )


@query(
    "F21_contributor_groups",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'guru' WHEN 1 THEN 'bhagat' WHEN 2 THEN 'bhatt' ELSE 'other' END AS contributor_group,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 999 END AS curated_rank FROM customer""",
)
def contributor_groups(spark, sf):
    rows = src.table(spark, sf, "customer")
    ranked = st.in_curated_order(rows, "c_mktsegment", ("HOUSEHOLD", "MACHINERY"))
    kinds = F.array(*map(F.lit, ("Sikh Guru", "BHAGAT", "a Bhatt", "poet")))
    kind = F.element_at(kinds, (F.col("c_custkey") % 4 + 1).cast("int"))
    return ranked.select("c_custkey", st.contributor_group(kind).alias("contributor_group"), "curated_rank")


@query(
    "F5_classify_contributor",
    with_(CONTRIBUTORS)
    + """SELECT name, CASE WHEN regexp_matches(who, '(?i)guru') THEN 'guru' WHEN regexp_matches(who, '(?i)bhagat|sheikh|sant') THEN 'bhagat'
  WHEN regexp_matches(who, '(?i)bhatt') THEN 'bhatt' ELSE 'contributor' END AS kind FROM (
  SELECT name, CASE CAST(substr(name, 4) AS INTEGER) % 5 WHEN 0 THEN 'GURU ' WHEN 1 THEN 'Sant ' WHEN 2 THEN 'bhatt ' WHEN 3 THEN 'Bhagat '
  ELSE '' END || name AS who FROM contributors)""",
)
def classify_contributor(spark, sf):
    n = F.substring("name", 4, 9).cast("int") % 5
    prefix = F.when(n == 0, "GURU ").when(n == 1, "Sant ").when(n == 2, "bhatt ").when(n == 3, "Bhagat ").otherwise("")
    people = src.contributors(spark, sf)
    return people.select("name", st.classify_contributor(F.concat(prefix, "name")).alias("kind"))


@query(
    "F22_rekey_work",
    with_(LINES) + "SELECT CASE WHEN source_work_id = 'source:es' THEN 'source:fr' ELSE source_work_id END AS source_work_id, CAST(COUNT(*) AS BIGINT) AS n FROM lines GROUP BY 1",
)
def rekey_work(spark, sf):
    moved = st.rekey_work(src.lines(spark, sf), "source:es", "source:fr")
    return moved.groupBy("source_work_id").agg(F.count("*").alias("n"))


@query(
    "J22_lookup_in_order",
    with_(LINES)
    + """SELECT r.request_id, CAST(r.position AS INTEGER) AS position, l.line_id, l.text FROM (
  SELECT 'doc:' || doc_id AS request_id, unnest(['line:' || doc_id || ':1', 'line:' || doc_id || ':0', 'line:' || doc_id || ':999999',
    'line:' || doc_id || ':1']) AS line_id, unnest([0, 1, 2, 3]) AS position FROM labels) r JOIN lines l USING (line_id)""",
)
def lookup_in_order(spark, sf):
    key = F.col("doc_id").cast("string")
    ids = F.array(*[F.concat(F.lit("line:"), key, F.lit(s)) for s in (":1", ":0", ":999999", ":1")])
    requests = src.table(spark, sf, "labels").select(F.concat(F.lit("doc:"), key).alias("request_id"), ids.alias("ids"))
    return st.lookup_in_order(src.lines(spark, sf).select("line_id", "text"), requests, "line_id")


@query("T1_corpus_sort", with_(LINES) + "SELECT line_id, page_no, line_order FROM lines")
def corpus_sort(spark, sf):
    rows = src.lines(spark, sf).select("line_id", "page_no", "line_order")
    return rows.orderBy(F.coalesce("page_no", F.lit(0)), "line_order", "line_id")


@query(
    "T4_priority_sort",
    with_(UNITS) + "SELECT text_unit_id FROM units ORDER BY CASE source_work_id WHEN 'source:fr' THEN 0 ELSE 1 END, unit_order LIMIT 40",
)
def priority_sort(spark, sf):
    preferred = F.when(F.col("source_work_id") == "source:fr", 0).otherwise(1)
    return src.units(spark, sf).orderBy(preferred, "unit_order").limit(40).select("text_unit_id")


@query("T5_case_insensitive_sort", "SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_name, p_partkey LIMIT 60")
def case_insensitive_sort(spark, sf):
    parts = src.table(spark, sf, "part").select("p_partkey", "p_name")
    return parts.orderBy(F.lower("p_name"), "p_name", "p_partkey").limit(60)


@query(
    "T6_curated_order",
    with_(CONTRIBUTORS)
    + """SELECT contributor_id, CASE contributor_id WHEN 'contributor:src7' THEN 0 WHEN 'contributor:src1' THEN 1
  WHEN 'contributor:src12' THEN 2 ELSE 999 END AS curated_rank FROM contributors ORDER BY 2, 1""",
)
def curated_order(spark, sf):
    ranked = st.in_curated_order(src.contributors(spark, sf), "contributor_id", SEQUENCE)
    return ranked.select("contributor_id", "curated_rank").orderBy("curated_rank", "contributor_id")


@query(
    "A19_line_coverage",
    with_(*_FACETS)
    + """SELECT line_id, line_id IN (SELECT line_id FROM members WHERE has_translation) AS has_translation,
  line_id IN (SELECT line_id FROM terms) AS has_terms, line_id IN (SELECT line_id FROM members WHERE NOT has_translation)
  AS has_second_translation FROM lines""",
)
def line_coverage(spark, sf):
    second = src.members(spark, sf).filter("NOT has_translation")
    return fc.coverage_flags(src.lines(spark, sf), annotations(spark, sf), second)


@query(
    "W13_top_form_probe",
    with_(LINES, LEX)
    + "SELECT form, CAST(COUNT(*) AS BIGINT) AS frequency FROM lex WHERE source_work_id = 'source:de' GROUP BY form ORDER BY 2 DESC, 1 LIMIT 1",
)
def top_form_probe(spark, sf):
    scoped = fc.scope(src.lines(spark, sf), "source:de")
    return lx.ranked_forms(scoped, LATIN, limit=1).select("form", "frequency")
