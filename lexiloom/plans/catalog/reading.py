"""Reading views, glossary, themes, analysis families and the jobs around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.text import LATIN, PRIMARY, Script, plain_text
from ...operators import alignment as al
from ...operators import families as fa
from ...operators import glossary as gl
from ...operators import lexical as lx
from ...operators import provider as pv
from ...operators import reading as rd
from ...operators import release as rl
from ...operators import structure as st
from ...operators import themes as th
from ...operators.containment import substring_join
from ...sources import driver_tables as src
from .. import oracle as o
from ..oracle import ALIGNMENTS, COLLECTIONS, CONTRIBUTORS, DICTIONARY, LAYERS, LEX, LINES, REFERENCE, TERMS, UNITS, with_
from ...session import cut_lineage
from ..registry import query, stored
from .alignment import _ENTRY, _READ, _TYPES, _UNPIVOT, entries, readings
from .text import PLAIN

_SUB = "collection_code, section_id, subsection_id"
_PASSAGES = f"""passages AS (SELECT {_SUB}, MIN(alignment_id) AS passage_id, arg_min(line_id, alignment_id) AS anchor_line_id, arg_min(translation, alignment_id) AS translation
  FROM alignments WHERE scope = 'passage' GROUP BY ALL),
sizes AS (SELECT {_SUB}, COUNT(DISTINCT line_id) AS member_count FROM alignments GROUP BY ALL),
inherited AS (SELECT a.line_id, p.passage_id, p.anchor_line_id, s.member_count, a.collection_code, p.translation, 'passage' AS scope
  FROM alignments a JOIN passages p USING ({_SUB}) JOIN sizes s USING ({_SUB})),
candidates AS (SELECT line_id, alignment_id AS passage_id, line_id AS anchor_line_id, 1::BIGINT AS member_count, collection_code, translation, scope
  FROM alignments WHERE scope <> 'passage' AND translation <> '' UNION ALL SELECT * FROM inherited),
best AS (SELECT line_id, passage_id, anchor_line_id, member_count, collection_code, translation, scope FROM (
  SELECT c.*, row_number() OVER (PARTITION BY line_id ORDER BY CASE WHEN collection_code = 'src4' THEN 0 WHEN collection_type = 'composition' THEN 1 ELSE 2 END,
    collection_order, collection_code, passage_id) AS r FROM candidates c JOIN collections USING (collection_code)) WHERE r = 1)"""
_BEST = (LINES, ALIGNMENTS, COLLECTIONS, _PASSAGES)
_SECOND = """second AS (SELECT line_id, lower(text) AS second_translation FROM lines WHERE line_order % 2 = 1)"""


def second(spark, sf):
    odd = src.lines(spark, sf).filter("line_order % 2 = 1")
    return odd.select("line_id", F.lower("text").alias("second_translation"))


def best(spark, sf):
    return rd.best_translation(rd.translations(src.alignments(spark, sf)), src.collections(spark, sf), "src4")


@query("J10_inherited_passages", with_(*_BEST) + "SELECT * FROM inherited")
def inherited(spark, sf):
    return rd.inherited_passages(src.alignments(spark, sf))


@query("W2_best_translation", with_(*_BEST) + "SELECT * FROM best")
def best_translation(spark, sf):
    return best(spark, sf)


_ENRICHED = "SELECT l.line_id, b.passage_id, b.scope, b.translation, s.second_translation FROM lines l LEFT JOIN best b USING (line_id) LEFT JOIN second s USING (line_id)"


@query("J11_enriched_lines", with_(*_BEST, _SECOND) + _ENRICHED)
def enriched(spark, sf):
    rows = rd.enriched_lines(src.lines(spark, sf), best(spark, sf), second(spark, sf))
    return rows.select("line_id", "passage_id", "scope", "translation", "second_translation")


@query(
    "F19_translation_choice",
    with_(*_BEST, _SECOND)
    + """SELECT l.line_id, s.second_translation AS shown_second, CASE WHEN coalesce(b.translation <> '', false) THEN
  CASE WHEN b.scope <> 'passage' OR l.line_id = b.anchor_line_id THEN b.translation END ELSE s.second_translation END AS shown_first
  FROM lines l LEFT JOIN best b USING (line_id) LEFT JOIN second s USING (line_id)""",
)
def translation_choice(spark, sf):
    rows = rd.enriched_lines(src.lines(spark, sf), best(spark, sf), second(spark, sf))
    return rows.select("line_id", rd.shown_translation("second").alias("shown_second"), rd.shown_translation("first").alias("shown_first"))


def line_terms(spark, sf):
    return stored(
        spark, sf, "line-terms", lambda: cut_lineage(al.attach_terms(src.lines(spark, sf), src.dictionary(spark, sf)), "line-terms")
    )


@query(
    "W10_distinct_terms",
    with_(LINES, DICTIONARY, TERMS) + "SELECT line_id, headword, meaning_en, MIN(term_id) AS term_id FROM terms GROUP BY 1, 2, 3",
)
def distinct_terms(spark, sf):
    return rd.distinct_terms(line_terms(spark, sf)).select("line_id", "headword", "meaning_en", "term_id")


@query(
    "J31_reading_view",
    with_(LINES, CONTRIBUTORS, _READ)
    + """SELECT w.reading_id, w.line_order, coalesce(w.line_id, 'reading-line:' || w.reading_id || ':' || w.line_order) AS line_id, coalesce(l.text_unit_id, '') AS text_unit_id,
  coalesce(l.page_no, 0) AS page_no, r.text, coalesce(c.name, '') AS contributor_name FROM walked w JOIN lines r ON r.line_id = w.line_order
  LEFT JOIN lines l ON l.line_id = w.line_id LEFT JOIN contributors c ON c.contributor_id = l.contributor_id""",
)
def reading_view(spark, sf):
    lines, rows = src.lines(spark, sf), readings(spark, sf)
    return rd.reading_view(rows, al.paragraph_crosswalk(lines, rows), lines, src.contributors(spark, sf))


_VIEW = "view AS (SELECT alignment_id, section_id, subsection_id, a.line_order, line_id, l.text FROM alignments a JOIN lines l USING (line_id) WHERE collection_code = 'en')"


@query("J32_collection_view", with_(LINES, ALIGNMENTS, _VIEW) + "SELECT * FROM view")
def collection_view(spark, sf):
    return rd.collection_view(src.alignments(spark, sf), src.lines(spark, sf), "en")


@query(
    "W6_section_starts",
    with_(LINES, ALIGNMENTS, _VIEW)
    + """SELECT alignment_id, section_id, CASE WHEN row_number() OVER (PARTITION BY section_id ORDER BY subsection_id, line_order, alignment_id) = 1 THEN 2 ELSE 0 END AS header_level FROM view""",
)
def section_starts(spark, sf):
    view = rd.collection_view(src.alignments(spark, sf), src.lines(spark, sf), "en")
    return rd.section_starts(view).select("alignment_id", "section_id", "header_level")


@query(
    "A17_collection_summary",
    with_(LINES, ALIGNMENTS, COLLECTIONS)
    + """SELECT c.*, COUNT(DISTINCT a.section_id) AS section_count, COUNT(DISTINCT CASE WHEN a.translation <> '' THEN a.line_id END) AS translated_line_count
  FROM collections c LEFT JOIN alignments a USING (collection_code) GROUP BY ALL""",
)
def collection_summary(spark, sf):
    return rd.collection_summaries(src.collections(spark, sf), src.alignments(spark, sf))


@query(
    "A24_units_per_section",
    with_(LINES, ALIGNMENTS) + "SELECT collection_code, section_id, COUNT(DISTINCT text_unit_id) AS mapped_unit_count FROM alignments GROUP BY 1, 2",
)
def units_per_section(spark, sf):
    return rd.units_per_section(src.alignments(spark, sf))


@query(
    "A28_reading_summaries",
    with_(LINES, ALIGNMENTS)
    + """SELECT contributor_id AS reading_id, CAST(COUNT(*) AS BIGINT) AS verse_count, CAST(COUNT(*) FILTER (t) AS BIGINT) AS translated_lines, COUNT(*) FILTER (t) > 0 AS available
  FROM (SELECT *, line_id IN (SELECT line_id FROM alignments WHERE translation <> '') AS t FROM lines) GROUP BY 1""",
)
def reading_summaries(spark, sf):
    lines = src.lines(spark, sf).select(F.col("contributor_id").alias("reading_id"), "line_id")
    return rd.reading_summaries(lines, src.alignments(spark, sf).filter("translation <> ''"))


@query(
    "A27_available_analysis",
    with_(LINES, UNITS, LAYERS)
    + """SELECT u.text_unit_id, MIN(l.line_id) AS line_id, MIN(l.page_no) AS first_page, (SELECT array_to_string(list_sort(list(DISTINCT content_type)), ',') FROM layers y
  WHERE y.text_unit_id = u.text_unit_id) AS layer_types FROM units u JOIN lines l USING (text_unit_id) WHERE u.text_unit_id IN (SELECT text_unit_id FROM layers) GROUP BY u.text_unit_id""",
)
def available_analysis(spark, sf):
    first = src.lines(spark, sf).groupBy("text_unit_id").agg(F.min("line_id").alias("line_id"), F.min("page_no").alias("first_page"))
    return first.join(pv.layer_types(src.layers(spark, sf)), "text_unit_id")


# -- analysis search --------------------------------------------------------------------------------

_NEEDLES = o.phrases(2) + ",\nneedles AS (SELECT query_id, lower(query) AS needle FROM phrases)"


def needles(spark, sf):
    return src.phrase_table(spark, sf, 2).select("query_id", F.lower("query").alias("needle"))


@query(
    "J28_layer_text_search",
    with_(REFERENCE, _NEEDLES, LAYERS)
    + """SELECT n.query_id, y.layer_id, y.text_unit_id FROM needles n JOIN layers y ON contains(lower(y.content), n.needle)
  WHERE regexp_matches(y.content_type, '.en$') AND y.text_unit_id IS NOT NULL""",
)
def layer_search(spark, sf):
    return fa.layer_hits(needles(spark, sf), src.layers(spark, sf)).select("query_id", "layer_id", "text_unit_id")


@query(
    "J29_line_translation_search",
    with_(LINES, REFERENCE, _NEEDLES, _SECOND)
    + "SELECT n.query_id, s.line_id FROM needles n JOIN second s ON contains(s.second_translation, n.needle)",
)
def translation_search(spark, sf):
    return fa.translation_hits(needles(spark, sf), second(spark, sf)).select("query_id", "line_id")


_MEANING = """hits AS (SELECT n.query_id, t.line_id, n.needle, t.meaning_en FROM needles n JOIN terms t ON contains(lower(t.meaning_en), n.needle) OR contains(lower(t.etymology_en), n.needle)),
thits AS (SELECT n.query_id, a.line_id, a.translation FROM needles n JOIN alignments a ON contains(lower(a.translation), n.needle))"""


@query(
    "J27_meaning_search",
    with_(LINES, REFERENCE, _NEEDLES, DICTIONARY, TERMS, ALIGNMENTS, _MEANING)
    + """SELECT query_id, line_id, coalesce(MIN(m), MIN(t), '') AS content FROM (
  SELECT query_id, line_id, CASE WHEN contains(lower(meaning_en), needle) THEN meaning_en END AS m, NULL AS t FROM hits
  UNION ALL SELECT query_id, line_id, NULL, translation FROM thits) GROUP BY 1, 2""",
)
def meaning_search(spark, sf):
    return fa.meaning_hits(needles(spark, sf), line_terms(spark, sf), src.alignments(spark, sf))


@query(
    "J26_title_lookup",
    with_(UNITS)
    + "SELECT DISTINCT 'unit ' || p_size AS query, text_unit_id FROM part JOIN units ON contains(lower(title), 'unit ' || p_size)",
)
def title_lookup(spark, sf):
    asked = src.table(spark, sf, "part").select(F.concat(F.lit("unit "), F.col("p_size").cast("string")).alias("query")).distinct()
    titles = src.units(spark, sf).filter("title IS NOT NULL").select("text_unit_id", F.lower("title").alias("hay"))
    return substring_join(asked, titles, "query", "hay", "text_unit_id").select("query", "text_unit_id")


_GLOSS = o.phrases(1) + """,
asked AS (SELECT query_id, lower(query) AS q FROM phrases),
g AS (SELECT query_id, q, headword, meaning_en, grammar_en, etymology_en, MIN(term_id) AS id, MIN(transliteration) AS transliteration, COUNT(DISTINCT line_id) AS frequency
  FROM asked JOIN terms ON contains(lower(transliteration), q) OR contains(lower(meaning_en), q) OR contains(lower(etymology_en), q) GROUP BY ALL)"""


@query(
    "A18_glossary_grouping",
    with_(LINES, REFERENCE, DICTIONARY, TERMS, _ENTRY, _GLOSS)
    + """SELECT query_id, id, headword, transliteration, frequency, CASE WHEN contains(lower(transliteration), q) THEN 'roman' ELSE 'english-concept' END AS match_kind,
  CAST(CASE WHEN lower(headword) = q OR lower(transliteration) = q THEN 0 WHEN starts_with(lower(transliteration), q) THEN 1 ELSE 2 END AS INTEGER) AS relevance FROM g
  UNION ALL SELECT query_id, entry_id, headword, '', 0, CASE WHEN starts_with(lower(headword), q) THEN 'roman' ELSE 'english-concept' END, 3
  FROM asked JOIN entries ON contains(lower(headword), q) OR contains(lower(content), q) WHERE query_id NOT IN (SELECT query_id FROM g)""",
)
def glossary(spark, sf):
    return gl.glossary(src.phrase_table(spark, sf, 1), line_terms(spark, sf), entries(spark, sf))


@query(
    "K9_candidate_resolution",
    with_(REFERENCE, DICTIONARY, o.phrases(1))
    + "SELECT DISTINCT p.query_id, d.headword AS form FROM phrases p JOIN dictionary d ON d.transliteration = lower(p.query)",
)
def candidate_resolution(spark, sf):
    forms = src.dictionary(spark, sf).select("transliteration", F.col("headword").alias("written_form"))
    return gl.resolve_candidates(src.phrase_table(spark, sf, 1), forms)


_SEEDS = "SELECT DISTINCT lower(headword) AS form FROM dictionary WHERE grammar_en = 'system'"


@query(
    "J9_shared_entry_forms",
    with_(DICTIONARY)
    + f"""SELECT DISTINCT s.form AS seed, b.headword AS form FROM ({_SEEDS}) s JOIN dictionary a ON lower(a.headword) = s.form
  JOIN dictionary b ON b.transliteration = a.transliteration WHERE b.headword <> s.form""",
)
def shared_entry(spark, sf):
    words = src.dictionary(spark, sf)
    forms = words.select(F.col("transliteration").alias("entry_id"), F.col("headword").alias("written_form"), F.lower("headword").alias("comparison_form"))
    seeds = words.filter("grammar_en = 'system'").select(F.lower("headword").alias("form"))
    return rd.related_forms(forms, seeds)


_TOPPED = """cur AS (SELECT DISTINCT b.headword AS form FROM dictionary a JOIN dictionary b ON b.transliteration = a.transliteration WHERE a.headword = 'the' AND b.headword <> 'the'),
freq AS (SELECT form, COUNT(*) AS frequency FROM lex WHERE starts_with(form, 'th') AND form <> 'the' GROUP BY 1)"""


@query(
    "U3_curated_and_suggested_forms",
    with_(LINES, LEX, DICTIONARY, _TOPPED)
    + """SELECT * FROM (SELECT form, CAST(0 AS INTEGER) AS tier, CAST(0 AS BIGINT) AS frequency FROM cur UNION ALL SELECT form, 1, frequency FROM freq WHERE form NOT IN (SELECT form FROM cur))
  ORDER BY tier, frequency DESC, form LIMIT 30""",
)
def curated_and_suggested(spark, sf):
    words = src.dictionary(spark, sf)
    forms = words.select(F.col("transliteration").alias("entry_id"), F.col("headword").alias("written_form"), F.col("headword").alias("comparison_form"))
    seed = spark.createDataFrame([("the",)], "form string")
    curated = rd.related_forms(forms, seed).select("form")
    frequent = lx.prefix_forms(src.lines(spark, sf), "th", LATIN, limit=None).filter("form <> 'the'")
    return rd.topped_up_forms(curated, frequent, 30)


@query(
    "K12_word_explorer",
    with_(LINES, LEX)
    + """SELECT 'statistics' AS part, 'the' AS item, CAST(COUNT(*) AS BIGINT) AS n FROM lex WHERE form = 'the'
  UNION ALL SELECT 'lines', line_id, COUNT(*) FROM lex WHERE form = 'the' GROUP BY line_id
  UNION ALL SELECT 'related', form, COUNT(*) FROM lex WHERE starts_with(form, 'th') AND form <> 'the' GROUP BY form""",
)
def word_explorer(spark, sf):
    from ..jobs import word_explorer as explore

    return explore(src.lines(spark, sf), "the", LATIN)


# -- themes -----------------------------------------------------------------------------------------

# themes over the words of the given text, for the same rules
LOCAL_THEMES = (
    ("pointing", ("that", "those-there", "the"), ("that", "of the", "there")),
    ("german", ("der", "die"), ("der", "die", "und")),
    ("french", ("le", "la", "que"), ("que", "des", "une")),
)
_THEMES = """themes(theme, term) AS (VALUES ('pointing', 'that'), ('pointing', 'of the'), ('pointing', 'there'), ('german', 'der'), ('german', 'die'), ('german', 'und'),
  ('french', 'que'), ('french', 'des'), ('french', 'une')),
aliases(theme, alias) AS (VALUES ('pointing', 'that'), ('pointing', 'those-there'), ('pointing', 'the'), ('german', 'der'), ('german', 'die'), ('french', 'le'), ('french', 'la'), ('french', 'que')),
asked AS (SELECT conv_id || ':' || turn AS query_id, regexp_replace(string_split(text, ' ')[1], '[.,]', '', 'g') AS query FROM conversations)"""
_TRIGGER = f"""triggered AS (SELECT a.query_id, a.query, t.theme FROM asked a JOIN aliases t ON t.alias = {o.fold_space('lower(a.query)')}
  WHERE NOT regexp_matches(a.query, '[^A-Za-z\\s-]'))"""


def asked(spark, sf):
    word = F.regexp_replace(F.get(F.split("text", " "), F.lit(0)), "[.,]", "")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return src.table(spark, sf, "conversations").select(key.alias("query_id"), word.alias("query"))


@query("F12_theme_trigger", with_(_THEMES, _TRIGGER) + "SELECT query_id, theme FROM triggered")
def theme_trigger(spark, sf):
    return th.triggered(asked(spark, sf), th.theme_table(spark, LOCAL_THEMES)).select("query_id", "theme")


_EVIDENCE = f"""flat AS (SELECT layer_id, text_unit_id, {PLAIN.replace('html', 'content')} AS plain FROM layers WHERE text_unit_id IS NOT NULL),
evidence AS (SELECT theme, layer_id, text_unit_id, plain, COUNT(*) AS matched FROM themes JOIN flat
  ON regexp_matches(plain, '(?i)(^|[^a-z])' || replace(term, ' ', '[-\\s]+') || '([^a-z]|$)') GROUP BY ALL)"""


@query("A26_theme_evidence", with_(LAYERS, _THEMES, _EVIDENCE) + "SELECT theme, layer_id, CAST(650 + 70 * matched AS INTEGER) AS score FROM evidence")
def theme_evidence(spark, sf):
    found = th.evidence(src.layers(spark, sf), th.theme_table(spark, LOCAL_THEMES))
    return found.select("theme", "layer_id", (F.lit(th.BASE) + F.size("matched") * th.PER_TERM).alias("score"))


_THEME_SEARCH = """scored AS (SELECT t.query_id, t.theme, e.layer_id, e.text_unit_id, CAST(650 + 70 * matched + CASE WHEN regexp_matches(plain,
    '(?i)(^|[^a-z])' || lower(t.query) || '([^a-z]|$)') THEN 120 ELSE 0 END AS INTEGER) AS score, p.first_page
  FROM triggered t JOIN evidence e USING (theme) JOIN (SELECT text_unit_id, MIN(page_no) AS first_page FROM lines GROUP BY 1) p USING (text_unit_id)),
per_unit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, text_unit_id ORDER BY score DESC, first_page, layer_id) AS r FROM scored WHERE score >= 700) WHERE r = 1),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_page, layer_id) AS INTEGER) AS position FROM per_unit)"""


def first_pages(spark, sf):
    return src.lines(spark, sf).groupBy("text_unit_id").agg(F.min("page_no").alias("first_page"))


@query(
    "K8_theme_search",
    with_(LINES, LAYERS, _THEMES, _TRIGGER, _EVIDENCE, _THEME_SEARCH)
    + "SELECT query_id, theme, text_unit_id, layer_id, score, position FROM ranked WHERE position <= 8",
)
def theme_search(spark, sf):
    found = th.theme_search(asked(spark, sf), src.layers(spark, sf), th.theme_table(spark, LOCAL_THEMES), first_pages(spark, sf))
    return found.select("query_id", "theme", "text_unit_id", "layer_id", "score", "position")


@query(
    "Q14_theme_audit",
    with_(LAYERS, _THEMES, _TRIGGER, _EVIDENCE)
    + """SELECT t.theme, (SELECT COUNT(*) FROM triggered x WHERE x.theme = t.theme) AS triggers, (SELECT COUNT(*) FROM evidence e WHERE e.theme = t.theme) AS layers_with_evidence
  FROM (SELECT DISTINCT theme FROM themes) t""",
)
def theme_audit(spark, sf):
    themes = th.theme_table(spark, LOCAL_THEMES)
    hits = th.triggered(asked(spark, sf), themes).groupBy("theme").agg(F.count("*").alias("triggers"))
    layers = th.evidence(src.layers(spark, sf), themes).groupBy("theme").agg(F.count("*").alias("layers_with_evidence"))
    return themes.select("theme").join(hits, "theme", "left").join(layers, "theme", "left").na.fill(0)


# -- composite views --------------------------------------------------------------------------------


@query(
    "K10_text_unit_view",
    with_(*_BEST, _SECOND, UNITS, LAYERS)
    + """SELECT l.text_unit_id, 'line' AS part, l.line_id AS item_id, coalesce(b.translation, s.second_translation, '') AS content FROM lines l
  LEFT JOIN best b USING (line_id) LEFT JOIN second s USING (line_id)
  UNION ALL SELECT y.text_unit_id, 'layer', y.layer_id, y.content FROM layers y WHERE y.text_unit_id IN (SELECT text_unit_id FROM units)
  UNION ALL SELECT u.text_unit_id, 'summary', u.text_unit_id, coalesce(u.title, 'Unit') FROM units u""",
)
def text_unit_view(spark, sf):
    from ..jobs import unit_view

    lines = rd.enriched_lines(src.lines(spark, sf), best(spark, sf), second(spark, sf))
    return unit_view(src.units(spark, sf), lines, src.layers(spark, sf))


@query(
    "K5_collection_alignment",
    with_(LINES, ALIGNMENTS, COLLECTIONS)
    + """SELECT c.collection_code, c.collection_type, COUNT(a.alignment_id) AS alignments, CAST(COUNT(*) FILTER (a.translation <> '') AS BIGINT) AS translated,
  COUNT(DISTINCT a.text_unit_id) AS units FROM collections c LEFT JOIN alignments a USING (collection_code) GROUP BY 1, 2""",
)
def collection_alignment(spark, sf):
    rows = src.alignments(spark, sf)
    per_unit = rows.groupBy("collection_code", "text_unit_id").agg(
        F.count("*").alias("a"), F.count_if(F.col("translation") != "").alias("t")
    )
    counted = per_unit.groupBy("collection_code").agg(F.sum("a").alias("alignments"), F.sum("t").alias("translated"), F.count("*").alias("units"))
    kinds = src.collections(spark, sf).select("collection_code", "collection_type")
    return kinds.join(counted, "collection_code", "left").na.fill(0)


@query(
    "K6_delta_release",
    with_(LINES, REFERENCE)
    + f"""SELECT line_id, CASE WHEN line_order % 4 = 0 THEN text ELSE lower(text) END AS romanised, {o.loose_key('text')} IN (SELECT {o.loose_key('reference_text')} FROM reference) AS selected
  FROM lines""",
)
def delta_release(spark, sf):
    from ..jobs import delta_release as delta

    base = src.lines(spark, sf).withColumn("romanised", F.when(F.col("line_order") % 4 == 0, F.col("text")).otherwise(""))
    updates = src.lines(spark, sf).select("line_id", F.lower("text").alias("romanised"))
    chosen = src.reference_lines(spark, sf).withColumnRenamed("reference_text", "text")
    return delta(base, updates, chosen).select("line_id", "romanised", "selected")


@query(
    "K3_provider_export",
    with_(o.SUBSECTIONS, _UNPIVOT, DICTIONARY, _ENTRY)
    + """SELECT 'layers' AS part, CAST(COUNT(*) AS BIGINT) AS n FROM unpivoted WHERE content_type IS NOT NULL AND trim(content) <> ''
  UNION ALL SELECT 'glossary', COUNT(*) FROM entries UNION ALL SELECT 'term_forms', COUNT(*) FROM dictionary WHERE regexp_matches(headword, '[\\x{00C0}-\\x{024F}]')""",
)
def provider_export(spark, sf):
    parts = {
        "layers": pv.tagged_layers(pv.layer_rows(pv.reference_text(src.subsections(spark, sf))), "p", "r", "a"),
        "glossary": entries(spark, sf),
        "term_forms": pv.term_forms(src.dictionary(spark, sf), Script(r"\x{00C0}-\x{024F}", "")),
    }
    out = None
    for name, rows in parts.items():
        counted = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = counted if out is None else out.unionByName(counted)
    return out
