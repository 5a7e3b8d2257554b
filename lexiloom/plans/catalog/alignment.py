"""Crosswalks, positional alignment, provider layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import roman as rm
from ...functions.text import Script
from ...operators import alignment as al
from ...operators import provider as pv
from ...operators import search as se
from ...sources import driver_tables as src
from .. import oracle as o
from ..oracle import DICTIONARY, LAYERS, LINES, REFERENCE, SUBSECTIONS, TERMS, with_
from ..registry import query

HEADS = ("The", "Der", "La", "Le")
_X = f"""x AS (SELECT r.record_id, nfc_normalize(r.reference_text) AS ek, {o.fold_space('nfc_normalize(r.reference_text)')} AS fk,
  (SELECT COUNT(*) FROM lines l WHERE nfc_normalize(l.text) = nfc_normalize(r.reference_text)) AS en,
  (SELECT MIN(line_id) FROM lines l WHERE nfc_normalize(l.text) = nfc_normalize(r.reference_text)) AS el,
  (SELECT COUNT(*) FROM lines l WHERE {o.fold_space('nfc_normalize(l.text)')} = {o.fold_space('nfc_normalize(r.reference_text)')}) AS fn,
  (SELECT MIN(line_id) FROM lines l WHERE {o.fold_space('nfc_normalize(l.text)')} = {o.fold_space('nfc_normalize(r.reference_text)')}) AS fl
  FROM reference r)"""
_CROSSWALK = """crosswalk AS (SELECT 'crosswalk:' || record_id AS mapping_id, record_id,
  CASE WHEN en = 1 THEN el WHEN en = 0 AND fn = 1 THEN fl END AS line_id,
  CASE WHEN en = 1 THEN 'proposed_exact_text' WHEN en > 1 THEN 'ambiguous_exact_text' WHEN fn = 1 THEN 'proposed_whitespace_normalised'
    WHEN fn > 1 THEN 'ambiguous_whitespace_normalised' ELSE 'unmatched' END AS method,
  CASE WHEN en = 0 AND fn = 0 THEN 'unavailable' ELSE 'review_required' END AS status,
  CASE WHEN en > 1 THEN en WHEN en = 0 AND fn > 1 THEN fn ELSE 0 END AS candidate_count,
  CASE WHEN en > 1 THEN ek WHEN en = 0 AND fn > 1 THEN fk END AS candidate_key FROM x)"""


@query("J12_exact_crosswalk", with_(LINES, REFERENCE, _X, _CROSSWALK) + "SELECT * FROM crosswalk")
def crosswalk(spark, sf):
    return al.crosswalk(src.lines(spark, sf), src.reference_lines(spark, sf))


@query(
    "J12_crosswalk_candidates",
    with_(LINES, REFERENCE, _X, _CROSSWALK)
    + f"""SELECT DISTINCT c.candidate_key, l.line_id FROM crosswalk c JOIN lines l ON
  (c.method = 'ambiguous_exact_text' AND nfc_normalize(l.text) = c.candidate_key) OR
  (c.method = 'ambiguous_whitespace_normalised' AND {o.fold_space('nfc_normalize(l.text)')} = c.candidate_key)""",
)
def crosswalk_candidates(spark, sf):
    lines = src.lines(spark, sf)
    return al.crosswalk_candidates(lines, al.crosswalk(lines, src.reference_lines(spark, sf)))


_ALIGN = lambda x: o.fold_space(f"regexp_replace(nfc_normalize({x}), '[{o.ZERO_WIDTH}]', '', 'g')")
_RANGED = f"""refs AS (SELECT record_id, item_id AS group_id, item_id % 3 + 1 AS expected_page, {_ALIGN('reference_text')} AS form FROM reference),
placed AS (SELECT *, {_ALIGN('text')} AS form FROM lines),
hits AS (SELECT r.record_id, r.group_id, COUNT(p.line_id) AS total, MIN(p.line_id) AS one, MIN(p.text_unit_id) AS unit,
  COUNT(p.line_id) FILTER (p.page_no BETWEEN r.expected_page AND r.expected_page) AS near,
  MIN(p.line_id) FILTER (p.page_no BETWEEN r.expected_page AND r.expected_page) AS near_one,
  MIN(p.text_unit_id) FILTER (p.page_no BETWEEN r.expected_page AND r.expected_page) AS near_unit
  FROM refs r LEFT JOIN placed p USING (form) GROUP BY ALL),
resolved AS (SELECT record_id, group_id, CASE WHEN total = 1 THEN one WHEN total > 1 AND near = 1 THEN near_one END AS line_id,
  CASE WHEN total = 1 THEN unit WHEN total > 1 AND near = 1 THEN near_unit END AS text_unit_id,
  CASE WHEN total = 1 THEN 'exact_unique' WHEN total > 1 AND near = 1 THEN 'exact_by_expected_page' WHEN total > 0 THEN 'ambiguous' ELSE 'unmatched' END AS status,
  CASE WHEN total = 1 OR (total > 1 AND near = 1) THEN 0 ELSE total END AS candidate_count FROM hits),
agreed AS (SELECT group_id, CAST(COUNT(*) AS BIGINT) AS reference_lines,
  CASE WHEN COUNT(DISTINCT text_unit_id) = 1 THEN MIN(text_unit_id) END AS text_unit_id FROM resolved GROUP BY group_id)"""


def resolved(spark, sf):
    refs = src.reference_lines(spark, sf).select(
        "record_id", F.col("item_id").alias("group_id"), "reference_text", (F.col("item_id") % 3 + 1).alias("expected_page")
    )
    return al.range_resolved(src.lines(spark, sf), refs, before=0, after=0)


@query("J13_range_qualified_match", with_(LINES, REFERENCE, _RANGED) + "SELECT * FROM resolved")
def range_match(spark, sf):
    return resolved(spark, sf)


@query("J33_group_to_unit", with_(LINES, REFERENCE, _RANGED) + "SELECT * FROM agreed")
def group_to_unit(spark, sf):
    return al.groups_to_units(resolved(spark, sf))


@query(
    "K4_provider_alignment",
    with_(LINES, REFERENCE, LAYERS, _RANGED)
    + """SELECT status, CAST(COUNT(*) AS BIGINT) AS n FROM resolved GROUP BY status UNION ALL
  SELECT 'layers:' || CASE WHEN a.text_unit_id IS NOT NULL THEN 'mapped_to_canonical_text_unit' ELSE y.mapping_status END, COUNT(*)
  FROM layers y LEFT JOIN agreed a ON a.group_id = CAST(split_part(y.layer_id, ':', 3) AS BIGINT) GROUP BY 1""",
)
def provider_alignment(spark, sf):
    rows = resolved(spark, sf)
    layers = src.layers(spark, sf).withColumn("group_id", F.split("layer_id", ":")[2].cast("bigint"))
    mapped = al.map_layers(layers, al.groups_to_units(rows))
    per_layer = mapped.groupBy(F.concat(F.lit("layers:"), "mapping_status").alias("status")).agg(F.count("*").alias("n"))
    return rows.groupBy("status").agg(F.count("*").alias("n")).unionByName(per_layer)


# each line of a document opens a reference: alone, or with up to four lines after it; every fifth one is in no unit
_REFS = """refs AS (SELECT 'ref:' || doc_id || ':' || i AS record_id, 'unit:' || doc_id AS text_unit_id,
  CASE WHEN (doc_id + i) % 5 = 4 THEN 'no such line' ELSE array_to_string(list_slice(l, i + 1, i + 1 + (doc_id + i) % 5), ' ') END AS reference_text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents))"""


def unit_references(spark, sf):
    split = src.table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    rows = split.select("doc_id", "l", F.explode(F.sequence(F.lit(0), F.size("l") - 1)).alias("i"))
    more = (F.col("doc_id") + F.col("i")) % 5
    text = F.when(more == 4, "no such line").otherwise(F.array_join(F.slice("l", F.col("i") + 1, (more + 1).cast("int")), " "))
    doc = F.col("doc_id").cast("string")
    return rows.select(
        F.concat_ws(":", F.lit("ref"), doc, F.col("i").cast("string")).alias("record_id"),
        F.concat(F.lit("unit:"), doc).alias("text_unit_id"),
        text.alias("reference_text"),
    )


_LEADS = ", ".join(
    f"lead(k, {n}) OVER w AS k{n}, lead(line_id, {n}) OVER w AS l{n}" for n in range(1, 5)
)
_RUNS = f"""keyed AS (SELECT text_unit_id, line_id, {o.compact_key('text')} AS k, line_order FROM lines),
seq AS (SELECT *, {_LEADS} FROM keyed WINDOW w AS (PARTITION BY text_unit_id ORDER BY line_order)),
runs AS (SELECT text_unit_id, line_id AS first_line_id, line_id AS last_line_id, 1 AS length, k AS run_key FROM seq
  UNION ALL SELECT text_unit_id, line_id, l1, 2, k || k1 FROM seq WHERE l1 IS NOT NULL
  UNION ALL SELECT text_unit_id, line_id, l2, 3, k || k1 || k2 FROM seq WHERE l2 IS NOT NULL
  UNION ALL SELECT text_unit_id, line_id, l3, 4, k || k1 || k2 || k3 FROM seq WHERE l3 IS NOT NULL
  UNION ALL SELECT text_unit_id, line_id, l4, 5, k || k1 || k2 || k3 || k4 FROM seq WHERE l4 IS NOT NULL)"""


@query(
    "W8_consecutive_runs",
    with_(LINES, _RUNS) + "SELECT text_unit_id, first_line_id, last_line_id, CAST(length AS INTEGER) AS length, md5(run_key) AS digest FROM runs",
)
def consecutive_runs(spark, sf):
    runs = al.line_runs(src.lines(spark, sf))
    return runs.select("text_unit_id", "first_line_id", "last_line_id", "length", "digest")


_LOOSE = "translate({0}, '।॥|', '')"
_PICK = f"""asked AS (SELECT record_id, text_unit_id, {o.compact_key('reference_text')} AS ek, {o.loose_key('reference_text')} AS lk FROM refs),
found AS (SELECT a.record_id, a.text_unit_id,
  COUNT(*) FILTER (r.length = 1 AND r.run_key = a.ek) AS n1, MIN(r.first_line_id) FILTER (r.length = 1 AND r.run_key = a.ek) AS f1,
  COUNT(*) FILTER (r.length = 1 AND {_LOOSE.format('r.run_key')} = a.lk) AS n2,
  MIN(r.first_line_id) FILTER (r.length = 1 AND {_LOOSE.format('r.run_key')} = a.lk) AS f2,
  COUNT(*) FILTER (r.length > 1 AND (r.run_key = a.ek OR {_LOOSE.format('r.run_key')} = a.lk)) AS n3,
  MIN(r.first_line_id) FILTER (r.length > 1 AND (r.run_key = a.ek OR {_LOOSE.format('r.run_key')} = a.lk)) AS f3,
  MIN(r.last_line_id) FILTER (r.length > 1 AND (r.run_key = a.ek OR {_LOOSE.format('r.run_key')} = a.lk)) AS t3,
  MIN(r.length) FILTER (r.length > 1 AND (r.run_key = a.ek OR {_LOOSE.format('r.run_key')} = a.lk)) AS c3
  FROM asked a JOIN runs r USING (text_unit_id) GROUP BY 1, 2)"""


@query(
    "J14_contiguous_range_match",
    with_(LINES, _RUNS, _REFS, _PICK)
    + """SELECT record_id, text_unit_id, CASE WHEN n1 = 1 THEN f1 WHEN n2 = 1 THEN f2 WHEN n3 = 1 THEN f3 END AS first_line_id,
  CASE WHEN n1 = 1 THEN f1 WHEN n2 = 1 THEN f2 WHEN n3 = 1 THEN t3 END AS last_line_id,
  CAST(CASE WHEN n1 = 1 OR n2 = 1 THEN 1 WHEN n3 = 1 THEN c3 ELSE 0 END AS INTEGER) AS member_count,
  CASE WHEN n1 = 1 OR n2 = 1 THEN 'verified_exact_within_unit' WHEN n3 = 1 THEN 'verified_exact_range_within_unit' ELSE 'unmatched' END AS status
  FROM found""",
)
def contiguous_range(spark, sf):
    return al.within_unit(src.lines(spark, sf), unit_references(spark, sf))


_GROUPS = """groups AS (SELECT d.doc_id || ':' || coalesce(c.turn, 0) AS group_id, string_split(d.text, chr(10)) AS refs, string_split(coalesce(c.text, ''), chr(10)) AS tr0
  FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id),
sized AS (SELECT group_id, refs, CASE WHEN tr0 = [''] THEN []::VARCHAR[] ELSE tr0 END AS tr FROM groups),
shifted AS (SELECT *, CASE WHEN len(tr) = 0 THEN NULL WHEN len(refs) = len(tr) THEN 0
  WHEN len(refs) - len(tr) BETWEEN 1 AND 2 AND len(list_filter(list_slice(refs, 1, len(refs) - len(tr)), lambda v: NOT regexp_matches(v, '^(The|Der|La|Le)'))) = 0
  THEN len(refs) - len(tr) END AS shift FROM sized),
rows AS (SELECT *, unnest(refs) AS reference, generate_subscripts(refs, 1) - 1 AS i FROM shifted)"""


@query(
    "J15_positional_alignment",
    with_(_GROUPS)
    + """SELECT group_id, CAST(i AS INTEGER) AS line_index, reference,
  CASE WHEN fb THEN array_to_string(tr, chr(10)) WHEN shift IS NOT NULL AND i >= shift THEN coalesce(tr[i - shift + 1], '') ELSE '' END AS translation,
  CASE WHEN fb THEN 'passage' WHEN shift IS NOT NULL AND i >= shift AND coalesce(tr[i - shift + 1], '') <> '' THEN 'line' ELSE 'none' END AS scope
  FROM (SELECT *, shift IS NULL AND len(tr) > 0 AND i = len(refs) - 1 AS fb FROM rows)""",
)
def positional(spark, sf):
    turns = src.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.col("text").alias("t"))
    docs = src.table(spark, sf, "documents").join(turns, "doc_id", "left")
    groups = docs.select(
        F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce("turn", F.lit(0)).cast("string")).alias("group_id"),
        F.split("text", "\n").alias("refs"),
        F.filter(F.split(F.coalesce("t", F.lit("")), "\n"), lambda v: v != "").alias("translations"),
    )
    return al.positional(groups, lambda line: al.is_heading(line, HEADS))


@query("J16_containment_terms", with_(LINES, DICTIONARY, TERMS) + "SELECT term_id, line_id, text_unit_id, headword FROM terms")
def containment_terms(spark, sf):
    found = al.attach_terms(src.lines(spark, sf), src.dictionary(spark, sf))
    return found.select("term_id", "line_id", "text_unit_id", "headword")


_READ = f"""readings AS (SELECT contributor_id AS reading_id, text_unit_id AS paragraph, line_id AS line_order, {o.loose_key('text')} AS form FROM lines),
placed AS (SELECT line_id, text_unit_id, {o.loose_key('text')} AS form FROM lines),
fu AS (SELECT form, text_unit_id, COUNT(*) AS n, MIN(line_id) AS line_id FROM placed GROUP BY 1, 2),
votes AS (SELECT r.reading_id, r.paragraph, fu.text_unit_id, SUM(fu.n) AS v FROM readings r JOIN fu USING (form) GROUP BY 1, 2, 3),
best AS (SELECT reading_id, paragraph, MIN(text_unit_id) AS best_unit FROM (
  SELECT *, rank() OVER (PARTITION BY reading_id, paragraph ORDER BY v DESC) AS rk FROM votes) WHERE rk = 1 GROUP BY 1, 2 HAVING COUNT(*) = 1),
tot AS (SELECT form, SUM(n) AS total, MIN(line_id) AS single, arg_min(text_unit_id, line_id) AS single_unit FROM fu GROUP BY 1),
walked AS (SELECT r.reading_id, r.line_order, b.best_unit, coalesce(b.best_unit, CASE WHEN t.total = 1 THEN t.single_unit END) AS text_unit_id, CASE WHEN b.best_unit IS NOT NULL THEN CASE WHEN fu.n = 1 THEN fu.line_id END
  WHEN t.total = 1 THEN t.single END AS line_id FROM readings r LEFT JOIN best b USING (reading_id, paragraph)
  LEFT JOIN fu ON fu.form = r.form AND fu.text_unit_id = b.best_unit LEFT JOIN tot t ON t.form = r.form)"""


def readings(spark, sf):
    return src.lines(spark, sf).select(
        F.col("contributor_id").alias("reading_id"), F.col("line_id").alias("line_order"), F.col("text_unit_id").alias("paragraph"), "text"
    )


@query(
    "J17_paragraph_vote_crosswalk",
    with_(LINES, _READ)
    + """SELECT reading_id, line_order, line_id, text_unit_id, CASE WHEN line_id IS NOT NULL THEN 'verified_exact_within_paragraph_unit'
  WHEN best_unit IS NOT NULL THEN 'unit_only' ELSE 'unmapped' END AS status FROM walked""",
)
def paragraph_vote(spark, sf):
    return al.paragraph_crosswalk(src.lines(spark, sf), readings(spark, sf))


@query(
    "W7_unique_maximum_vote",
    with_(LINES, _READ) + "SELECT reading_id, text_unit_id, CAST(COUNT(*) AS BIGINT) AS n FROM walked WHERE text_unit_id IS NOT NULL GROUP BY 1, 2",
)
def unique_maximum(spark, sf):
    # a low bound sends most forms down the path for heavy ones
    walked = al.paragraph_crosswalk(src.lines(spark, sf), readings(spark, sf), heavy=2)
    return walked.filter("text_unit_id IS NOT NULL").groupBy("reading_id", "text_unit_id").agg(F.count("*").alias("n"))


@query(
    "W9_last_member_anchor",
    with_(LINES)
    + """SELECT text_unit_id AS alignment_id, line_id, line_order AS member_order,
  line_order = MAX(line_order) OVER (PARTITION BY text_unit_id) AS is_anchor FROM lines""",
)
def last_member(spark, sf):
    members = src.lines(spark, sf).select(F.col("text_unit_id").alias("alignment_id"), "line_id", F.col("line_order").alias("member_order"))
    return al.last_members(members)


@query(
    "J20_backfill",
    with_(LINES)
    + """SELECT l.line_id, CASE WHEN l.line_order % 2 = 0 THEN l.text ELSE coalesce(nullif(trim(c.role), ''), '') END AS romanised
  FROM lines l LEFT JOIN conversations c ON c.turn = 0 AND 'unit:' || c.conv_id = l.text_unit_id""",
)
def backfill(spark, sf):
    rows = src.lines(spark, sf).select(
        "line_id", "text_unit_id", F.when(F.col("line_order") % 2 == 0, F.col("text")).otherwise("").alias("romanised")
    )
    updates = src.table(spark, sf, "conversations").filter("turn = 0").select(
        F.concat(F.lit("unit:"), F.col("conv_id").cast("string")).alias("text_unit_id"), F.col("role").alias("romanised")
    )
    return al.backfill(rows, updates, "text_unit_id", "romanised").select("line_id", "romanised")


@query(
    "J21_form_semi_join",
    with_(LINES, REFERENCE)
    + f"SELECT line_id FROM lines WHERE {o.loose_key('text')} IN (SELECT {o.loose_key('reference_text')} FROM reference)",
)
def form_semi_join(spark, sf):
    chosen = src.reference_lines(spark, sf).withColumnRenamed("reference_text", "text")
    return al.form_semi_join(src.lines(spark, sf), chosen).select("line_id")


@query(
    "J30_token_position_zip",
    with_(LINES)
    + f"""SELECT line_id, CAST(i - 1 AS INTEGER) AS position, a[i] AS form, b[i] AS romanised FROM (SELECT line_id, a, b, unnest(range(1, len(a) + 1)) AS i FROM (
  SELECT line_id, regexp_extract_all(text, '[\\p{{L}}\\p{{M}}]+') AS a, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(strip_accents(text)),
    '[^a-z]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda w: w <> '') AS b FROM lines) WHERE len(a) = len(b)) WHERE b[i] IN ('the', 'th')""",
)
def token_zip(spark, sf):
    from ...functions.text import strip_accents

    hits = src.lines(spark, sf).select("line_id", "text", F.col("text").alias("romanised"), F.lit("the").alias("query"), F.lit("q").alias("query_id"))
    plain = lambda c: F.trim(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z]+", " "))
    return se.aligned_forms(hits, plain, rm.reader_key).select("line_id", "position", "form", "romanised")


_TYPES = {"c0": ("transliteration", "reference_primary"), "c1": ("literal_translation_en", "literal_translation_pa"),
          "c2": ("interpretive_transcreation_en", "interpretive_transcreation_pa"), "c3": ("commentary_en", "commentary_pa"),
          "c4": ("poetical_dimension_en", "poetical_dimension_pa"), "c5": ("overview_en", "overview_pa")}
_UNPIVOT = "unpivoted AS (" + " UNION ALL ".join(
    f"""SELECT "BaniCode", "SectionId", "SubSectionId", "BaniLanguage", CASE "BaniLanguage" WHEN 'english' THEN '{en}' WHEN 'panjabi' THEN '{pa}' END AS content_type,
  {c} AS content FROM subsections""" for c, (en, pa) in _TYPES.items()) + ")"
_LAYER_SQL = """SELECT 'x:' || "BaniCode" || ':' || "SectionId" || ':' || "SubSectionId" || ':' || content_type AS layer_id, content_type, content{0}
  FROM unpivoted WHERE content_type IS NOT NULL AND trim(content) <> ''"""


@query("F14_layer_unpivot", with_(SUBSECTIONS, _UNPIVOT) + _LAYER_SQL.format(""))
def layer_unpivot(spark, sf):
    rows = pv.layer_rows(src.subsections(spark, sf))
    return pv.tagged_layers(rows, "p", "r", "a", "x").select("layer_id", "content_type", "content")


@query(
    "F23_release_tagged_rows",
    with_(SUBSECTIONS, _UNPIVOT)
    + _LAYER_SQL.format(", 'Archive' AS provider, 'rel-1' AS provider_release_id, 'By permission' AS attribution_label, 'unmapped_provider_subsection' AS mapping_status"),
)
def release_tagged(spark, sf):
    rows = pv.layer_rows(src.subsections(spark, sf))
    return pv.tagged_layers(rows, "Archive", "rel-1", "By permission", "x").drop("group_id")


@query(
    "J18_language_pairing",
    with_(SUBSECTIONS)
    + """SELECT "SubSectionId", coalesce(a, b) AS body_en, coalesce(b, a) AS body_pa FROM (SELECT "SubSectionId",
  arg_max(c0, "RowID") FILTER ("BaniLanguage" = 'english') AS a, arg_max(c0, "RowID") FILTER ("BaniLanguage" = 'panjabi') AS b FROM subsections GROUP BY 1)
  WHERE a IS NOT NULL OR b IS NOT NULL""",
)
def language_pairing(spark, sf):
    rows = src.subsections(spark, sf).select("SubSectionId", "RowID", F.col("BaniLanguage").alias("language"), F.col("SubSectionContent").alias("body"))
    return pv.pair_languages(rows, "SubSectionId", ["body"], "RowID")


@query(
    "J18_reference_text",
    with_(SUBSECTIONS)
    + """SELECT s."RowID", CASE WHEN s."BaniLanguage" = 'panjabi' THEN s.c0 ELSE (SELECT arg_max(p.c0, p."RowID") FROM subsections p
  WHERE p."BaniLanguage" = 'panjabi' AND p."BaniCode" = s."BaniCode" AND p."SubSectionId" = s."SubSectionId") END AS reference_text FROM subsections s""",
)
def reference_text(spark, sf):
    return pv.reference_text(src.subsections(spark, sf)).select("RowID", "reference_text")


@query(
    "J19_section_metadata",
    """SELECT s_nationkey AS "BaniCode", s_suppkey AS "SectionId", CAST(NULLIF(CAST(s_acctbal AS BIGINT) // 10, 0) AS BIGINT) AS first_page,
  CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'NATION_' || s_nationkey END AS author, CAST(s_nationkey AS VARCHAR) AS heading FROM supplier
  WHERE s_acctbal >= 0""",
)
def section_metadata(spark, sf):
    section = F.struct(
        F.col("s_suppkey").alias("SectionId"),
        F.concat(F.floor(F.round("s_acctbal").cast("bigint") / 10).cast("string"), F.lit(" ff")).alias("PageNumberStart"),
        F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("Author"),
    )
    details = src.table(spark, sf, "supplier").filter("s_acctbal >= 0").select(
        F.col("s_nationkey").alias("BaniCode"),
        F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("Author"),
        F.col("s_nationkey").cast("string").alias("Rag"),
        F.array(section).alias("Sections"),
    )
    return pv.section_metadata(details)


_ENTRY = """entries AS (SELECT 'dictionary:' || language || ':' || term_id AS entry_id, headword, '{"language":' || to_json(language) || ',"meaning":' || to_json(meaning_en)
  || ',"grammar":' || to_json(grammar_en) || ',"etymology":' || to_json(etymology_en) || '}' AS content, 'provider_published' AS review_status FROM dictionary
  UNION ALL SELECT 'significant:part:' || p_partkey, p_name, '{"language":"part","description":' || to_json(p_type) || '}', 'provider_published' FROM part)"""


def entries(spark, sf):
    significant = src.table(spark, sf, "part").select(
        F.lit("part").alias("language"), F.col("p_partkey").cast("string").alias("word_id"), F.col("p_name").alias("headword"), F.col("p_type").alias("description")
    )
    return pv.glossary_entries(src.dictionary(spark, sf), significant)


@query("F15_glossary_projection", with_(DICTIONARY, _ENTRY) + "SELECT * FROM entries")
def glossary_projection(spark, sf):
    return entries(spark, sf)


@query(
    "F16_term_forms",
    with_(DICTIONARY)
    + "SELECT term_id, headword AS written_form, nfc_normalize(headword) AS comparison_form FROM dictionary WHERE regexp_matches(headword, '[\\x{00C0}-\\x{024F}]')",
)
def term_forms(spark, sf):
    return pv.term_forms(src.dictionary(spark, sf), Script(r"\x{00C0}-\x{024F}", ""))


@query(
    "F17_published_details",
    "SELECT ps.c_custkey, ps.c_nationkey FROM customer ps WHERE ps.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
)
def published_details(spark, sf):
    catalogue = src.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") == 1).alias("is_published"))
    details = src.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return pv.published(catalogue, details, "c_nationkey").select("c_custkey", "c_nationkey")


_GROUP = "substr(layer_id, 1, length(layer_id) - length(content_type) - 1)"


@query(
    "A9_mapping_coverage",
    with_(LAYERS)
    + f"""SELECT CAST(COUNT(*) AS BIGINT) AS total_layers, CAST(COUNT(text_unit_id) AS BIGINT) AS mapped_layers,
  CAST(COUNT(*) - COUNT(text_unit_id) AS BIGINT) AS unmapped_layers, COUNT(DISTINCT text_unit_id) AS mapped_units,
  COUNT(DISTINCT CASE WHEN text_unit_id IS NULL THEN {_GROUP} END) AS unmapped_groups FROM layers""",
)
def mapping_coverage(spark, sf):
    return pv.mapping_coverage(src.layers(spark, sf))


@query(
    "A10_unmapped_groups",
    with_(LAYERS)
    + f"""SELECT {_GROUP} AS group_id, layer_id, content_type, g.group_status FROM layers JOIN (SELECT {_GROUP} AS gid, MIN(mapping_status) AS group_status FROM layers
  WHERE text_unit_id IS NULL GROUP BY 1 ORDER BY 1 LIMIT 20 OFFSET 5) g ON g.gid = {_GROUP}""",
)
def unmapped_groups(spark, sf):
    return pv.unmapped_groups(src.layers(spark, sf), 20, 5).select("group_id", "layer_id", "content_type", "group_status")


@query(
    "A20_layer_types",
    with_(LAYERS)
    + "SELECT text_unit_id, array_to_string(list_sort(list(DISTINCT content_type)), ',') AS layer_types FROM layers WHERE text_unit_id IS NOT NULL GROUP BY 1",
)
def layer_types(spark, sf):
    return pv.layer_types(src.layers(spark, sf))


@query(
    "F20_visible_layers",
    with_(LAYERS)
    + """, m AS (SELECT * FROM layers WHERE text_unit_id IS NOT NULL), f AS (SELECT text_unit_id, bool_or(content_type = 'commentary_en') AS anyc,
  arg_min(layer_id, (CASE content_type WHEN 'poetical_dimension_en' THEN 0 WHEN 'literal_translation_en' THEN 1 ELSE 2 END, layer_id)) AS firstl FROM m GROUP BY 1)
  SELECT layer_id, m.text_unit_id FROM m JOIN f USING (text_unit_id) WHERE CASE WHEN anyc THEN content_type = 'commentary_en' ELSE layer_id = firstl END""",
)
def visible_layers(spark, sf):
    mapped = src.layers(spark, sf).filter("text_unit_id IS NOT NULL")
    return pv.visible_layers(mapped, ["commentary_en"], ["poetical_dimension_en", "literal_translation_en"]).select("layer_id", "text_unit_id")
