"""SQL fragments shared by the oracle queries (RE2 dialect for patterns)."""

from __future__ import annotations

SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
ZERO_WIDTH = r"\x{200B}-\x{200D}\x{FEFF}"
BLOCK = r"A-Za-z\x{00C0}-\x{024F}"
MARKS = (
    r"AEIOUaeiou\x{00C0}-\x{00C6}\x{00C8}-\x{00CF}\x{00D2}-\x{00D6}\x{00D9}-\x{00DC}"
    r"\x{00E0}-\x{00E6}\x{00E8}-\x{00EF}\x{00F2}-\x{00F6}\x{00F9}-\x{00FC}"
)
TOKEN = rf"[\p{{L}}\p{{M}}]+|[\p{{N}}]+|[^{SPACE}]"

_SPLIT = (
    "SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS t, "
    "generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents"
)

LINES = f"""lines AS (
  SELECT 'line:' || d.doc_id || ':' || d.i AS line_id, d.doc_id || ':' || d.i AS upstream_id,
    'source:' || d.lang AS source_work_id, 'unit:' || d.doc_id AS text_unit_id,
    'contributor:' || d.source AS contributor_id, CAST(d.i AS INTEGER) AS line_order,
    CAST(d.i // 10 + 1 AS INTEGER) AS page_no, d.t AS text
  FROM ({_SPLIT}) d)"""

HEADED = f"""lines AS (
  SELECT 'line:' || d.doc_id || ':' || d.i AS line_id, d.doc_id || ':' || d.i AS upstream_id,
    'source:' || d.lang AS source_work_id, 'unit:' || d.doc_id AS text_unit_id,
    'contributor:' || d.source AS contributor_id, CAST(d.i AS INTEGER) AS line_order,
    CAST(d.i // 10 + 1 AS INTEGER) AS page_no, d.t AS text,
    CAST(l.quality AS VARCHAR) AS heading_id, 'Heading ' || l.quality AS heading
  FROM ({_SPLIT}) d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

# lexical tokens of every line: class is decided on the exact form, then normalised
LEX = f"""lex AS (
  SELECT *, nfc_normalize(exact) AS form FROM (
    SELECT lines.*, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}]+')) AS exact FROM lines)
  WHERE regexp_full_match(exact, '[{BLOCK}]+'))"""

UNITS = """units AS (
  SELECT 'unit:' || doc_id AS text_unit_id, CAST(doc_id AS VARCHAR) AS upstream_id, 'source:' || lang AS source_work_id,
    CAST(NULL AS VARCHAR) AS parent_id, CASE WHEN doc_id % 5 = 0 THEN 'section' ELSE 'shabad' END AS unit_type, doc_id AS unit_order,
    CASE WHEN doc_id % 7 <> 0 THEN 'Unit ' || doc_id END AS title FROM documents)"""

CONTRIBUTORS = """contributors AS (
  SELECT DISTINCT 'contributor:' || source AS contributor_id, source AS name, 'contributor' AS contributor_type FROM documents)"""

ATTRIBUTIONS = """attributions AS (
  SELECT 'attribution:' || doc_id || ':' || source AS attribution_id, 'contributor:' || source AS contributor_id,
    'textUnit' AS target_type, 'unit:' || doc_id AS target_id FROM documents)"""

REFERENCE = """reference AS (
  SELECT 'record:' || item_id || ':' || i AS record_id, item_id, CAST(i AS INTEGER) AS line_index, t AS reference_text FROM (
    SELECT item_id, unnest(string_split(text, chr(10))) AS t,
      generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM benchmark))"""

_TYPE = (
    "CASE page_id % 4 WHEN 0 THEN 'literal_translation_en' WHEN 1 THEN 'interpretive_transcreation_en' "
    "WHEN 2 THEN 'commentary_en' ELSE 'poetical_dimension_en' END"
)
LAYERS = f"""layers AS (
  SELECT 'layer:p:' || (page_id // 4) || ':' || {_TYPE} AS layer_id, {_TYPE} AS content_type,
    CASE WHEN page_id % 5 <> 0 THEN 'unit:' || (page_id // 2) END AS text_unit_id, html AS content,
    'Provider archive' AS attribution_label,
    CASE WHEN page_id % 5 <> 0 THEN 'mapped_to_canonical_text_unit' ELSE 'unmapped_provider_subsection' END AS mapping_status
  FROM pages)"""


def fold_space(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'))"


_SECOND = f"regexp_replace(string_split({fold_space('text')}, ' ')[2], '[.,]', '', 'g')"
DICTIONARY = f"""dictionary AS (
  SELECT * FROM (SELECT 'term:' || conv_id || ':' || turn AS term_id, 'unit:' || conv_id AS text_unit_id, role AS language,
    {_SECOND} AS headword, lower({_SECOND}) AS transliteration, text AS meaning_en, role AS grammar_en,
    'turn ' || turn AS etymology_en FROM conversations) WHERE headword IS NOT NULL AND headword <> '')"""

MEMBERS = """members AS (
  SELECT r.record_id AS alignment_id, l.line_id, l.text_unit_id, r.item_id % 2 = 0 AS has_translation
  FROM lines l JOIN reference r ON r.reference_text = l.text)"""

TERMS = """terms AS (
  SELECT DISTINCT l.line_id, l.text_unit_id, d.term_id, d.headword, d.transliteration, d.meaning_en, d.grammar_en, d.etymology_en
  FROM dictionary d JOIN lines l ON l.text_unit_id = d.text_unit_id
  WHERE contains(regexp_replace(l.text, '\\s', '', 'g'), d.headword))"""

QUERY_TABLE = f"""queries AS (
  SELECT record_id AS query_id,
    {fold_space('reference_text')} AS query FROM reference)"""


def phrases(n: int) -> str:
    """``phrase_table`` as ``phrases``."""
    return f"""split AS (SELECT {split_words(fold_space('reference_text'))} AS w FROM reference),
phrases AS (SELECT DISTINCT array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS query_id, array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS query
  FROM (SELECT w, unnest(range(1, len(w) - {n - 2})) AS i FROM split))"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def roman_normal(x: str) -> str:
    """strip_accents of the engine also maps a few letters the reference keeps; none occur after [a-z]."""
    stripped = f"regexp_replace(lower(strip_accents({x})), '\\(([a-z])\\)', '\\1', 'g')"
    return f"trim(regexp_replace({stripped}, '[^a-z]+', ' ', 'g'))"


def phonetic_of_normal(x: str) -> str:
    for old, new in (
        ("aa", "a"), ("ee|ii", "i"), ("oo|uu", "u"), ("ai|ae", "e"), ("au", "o"), ("chh", "ch"), ("kh", "k"),
        ("gh", "g"), ("th", "t"), ("dh", "d"), ("ph", "p"), ("bh", "b"), ("jh", "j"), ("sh", "s"), ("ng", "g"),
        ("n([mb])", "\\1"), ("w", "v"), ("y", "i"), ("q", "k"), ("x", "k"),
        ("a{2,}", "a"), ("e{2,}", "e"), ("i{2,}", "i"), ("o{2,}", "o"), ("u{2,}", "u"),
    ):
        x = f"regexp_replace({x}, '{old}', '{new}', 'g')"
    return (
        f"array_to_string(list_transform(string_split({x}, ' '), lambda w: CASE WHEN length(w) > 3 "
        f"THEN regexp_replace(w, '(?:u|a|i|e|o|eh|ahi)$', '') ELSE w END), ' ')"
    )


def phonetic(x: str) -> str:
    """The bracketed-nasal look-ahead is written with a captured group."""
    bare = f"regexp_replace({x}, '\\(n\\)(h[aeiou])', ' \\1', 'gi')"
    return phonetic_of_normal(roman_normal(f"regexp_replace({bare}, '\\(n\\)', '', 'gi')"))


def primary_normal(x: str) -> str:
    return f"trim(regexp_replace(nfc_normalize({x}), '[^{BLOCK}]+', ' ', 'g'))"


def loose_of_normal(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '[{MARKS}]', '', 'g'), ' +', ' ', 'g'))"


def split_words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


SUBSECTIONS = """subsections AS (
  SELECT doc_id * 100000 + run AS "RowID", source AS "BaniCode", CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'panjabi' ELSE lang END AS "BaniLanguage",
    doc_id // 100 AS "SectionId", doc_id // 2 * 100000 + run AS "SubSectionId", """ + ", ".join(
    f"l[run * 6 + {n + 1}] AS c{n}" for n in range(6)
) + """ FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS l,
    unnest(range(0, (len(string_split(text, chr(10))) + 5) // 6)) AS run FROM documents))"""

_KIND = "CASE WHEN line_order % 10 = 9 THEN 'passage' WHEN line_order % 3 = 0 THEN 'line' ELSE 'none' END"


def _collection(code: str, prefix: str, where: str) -> str:
    return f"""SELECT '{prefix}' || substr(line_id, 5) AS alignment_id, {code} AS collection_code,
    CAST(substr(text_unit_id, 6) AS BIGINT) AS section_id, page_no AS subsection_id, line_order, line_id, text_unit_id, {_KIND} AS scope,
    CASE WHEN {_KIND} = 'none' THEN '' ELSE 'T. ' || text END AS translation FROM lines WHERE {where}"""


ALIGNMENTS = f"""alignments AS (
  {_collection("substr(contributor_id, 13)", "a", "TRUE")} UNION ALL
  {_collection("substr(source_work_id, 8)", "b", "CAST(substr(text_unit_id, 6) AS BIGINT) % 2 = 0")})"""
COLLECTIONS = """collections AS (
  SELECT *, CAST(length(collection_code) AS INTEGER) AS collection_order FROM (
    SELECT DISTINCT source AS collection_code, 'composition' AS collection_type FROM documents
    UNION ALL SELECT DISTINCT lang, 'ceremonial' FROM documents))"""


def loose_key(x: str) -> str:
    compact = f"regexp_replace(replace(nfc_normalize({x}), '੍', 'ੑ'), '[{ZERO_WIDTH}{SPACE}]', '', 'g')"
    return f"translate({compact}, '।॥|', '')"


def compact_key(x: str) -> str:
    return f"regexp_replace(replace(nfc_normalize({x}), '੍', 'ੑ'), '[{ZERO_WIDTH}{SPACE}]', '', 'g')"
