"""The whole answer of a search: families, facets, candidate forms, theme mode."""

import pytest

from conftest import make_lines
from lexiloom.operators import search as se
from lexiloom.operators import themes as th
from lexiloom.operators.containment import prefix_join
from lexiloom.operators.facets import Annotations, Facets
from lexiloom.operators.families import meaning_hits
from lexiloom.operators.glossary import glossary
from lexiloom.plans.jobs import SearchTables, corpus_search, theme_mode

# Known lines and their romanisation.
ROWS = [
    ("l1", "u1", 1, 1, "ਅਨੰਦੁ ਭਇਆ ਮੇਰੀ ਮਾਏ", "anandh bhiaa mayree maae"),
    ("l2", "u2", 1, 2, "ਸਤਿਗੁਰੁ ਮੇਰਾ ਪੂਰਾ", "sathigur mayraa pooraa"),
    ("l3", "u3", 1, 3, "ਗਗਨ ਮੈ ਥਾਲੁ", "gagan mai thaal"),
    ("l4", "u4", 1, 4, "ਅਨੰਦੁ ਅਨੰਦੁ", "anandh anandh"),
]
QUERIES = [("q1", "anandh"), ("q2", "sky"), ("q3", "ਅਨੰ"), ("q4", "  "), ("q5", "joy")]


@pytest.fixture(scope="module")
def index(spark):
    return se.build_index(make_lines(spark, ROWS))


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    terms = make([("t1", "l3", "the Sky", None), ("t2", "l1", "joy", "anandh")], "term_id string, line_id string, meaning_en string, etymology_en string")
    alignments = make([("a1", "l2", "sky of joy"), ("a2", "l3", "wide sky")], "alignment_id string, line_id string, translation string")
    second = make([("l4", "Joy, joy"), ("l2", "sky")], "line_id string, second_translation string")
    layers = make(
        [("y1", "u2", "commentary_en", "<p>joy of mercy</p>"), ("y2", "u9", "commentary_en", "<p>sky</p>"), ("y3", "u3", "commentary_pa", "sky"),
         ("y4", None, "commentary_en", "sky")],
        "layer_id string, text_unit_id string, content_type string, content string",
    )
    members = alignments.selectExpr("line_id", "translation <> '' AS has_translation")
    return SearchTables(make_lines(spark, ROWS), terms, alignments, second, layers, Annotations(members, terms.select("line_id"), layers))


def answer(spark, index, tables, **more):
    asked = spark.createDataFrame(QUERIES, "query_id string, query string")
    results, forms = corpus_search(asked, index, tables, **more)
    rows = sorted(((r.query_id, r.rank, r.family, r.result_id, r.mode) for r in results.collect()))
    return rows, sorted((r.query_id, r.position, r.form, r.frequency) for r in forms.collect())


def test_families_follow_units_and_leave_theirs_out(spark, index, tables):
    rows, forms = answer(spark, index, tables)
    by = lambda q: [(f, i) for x, _, f, i, _ in rows if x == q]
    # u1 is a unit hit, so the term of l1 that names the word adds nothing
    assert {i for f, i in by("q1")} == {"u1", "u4"} and {f for f, _ in by("q1")} == {0}
    # meanings and translations, then second translations, then layers; a unit without lines is kept
    assert by("q2") == [(1, "l2"), (1, "l3"), (2, "l2"), (3, "y2")]
    assert by("q5") == [(1, "l1"), (1, "l2"), (2, "l4"), (3, "y1")]
    assert by("q4") == []
    assert {(q, m) for q, _, _, _, m in rows} == {("q1", "latin"), ("q2", "english"), ("q5", "english"), ("q3", "primary")}
    assert [r for r in forms if r[0] == "q3"] == [("q3", 1, "ਅਨੰਦੁ", 3)]
    assert [r for r in forms if r[0] == "q1"] == [("q1", 1, "ਅਨੰਦੁ", 3)]


def test_ranks_are_gapless_and_cut(spark, index, tables):
    rows, _ = answer(spark, index, tables, limit=2)
    assert [(r[1], r[2]) for r in rows if r[0] == "q2"] == [(1, 1), (2, 1)]
    assert max(r[1] for r in rows) == 2


def test_facets_come_before_everything(spark, index, tables):
    rows, forms = answer(spark, index, tables, facets=Facets(coverage="translation"))
    assert {(q, f, i) for q, _, f, i, _ in rows} == {
        ("q2", 1, "l2"), ("q2", 1, "l3"), ("q2", 2, "l2"), ("q5", 1, "l2"), ("q5", 3, "y1")
    }
    assert forms == []


def test_theme_mode_within_facets(spark, tables):
    asked = spark.createDataFrame([("a", "mercy"), ("b", "sky")], "query_id string, query string")
    themes = th.theme_table(spark, (("compassion", ("mercy",), ("mercy",)),))
    hits = theme_mode(asked, tables, themes).collect()
    assert [(h.query_id, h.layer_id, h.label, h.mode) for h in hits] == [("a", "y1", "Compassion", "theme")]
    assert theme_mode(asked, tables, themes, Facets(work="source:X")).collect() == []
    assert theme_mode(asked, tables, themes, Facets(layer_types=("overview_en",))).collect() == []


def test_prefix_join_equals_brute_force(spark):
    words = ["a", "ab", "abc", "abcdefghijklmnop", "abcdefghijklmxyz", "b", "", None]
    prefixes = ["a", "abc", "abcdefghijklmn", "abcdefghijklmnopq", "", "c"]
    texts = spark.createDataFrame([(w,) for w in words], "hay string")
    asked = spark.createDataFrame([(p,) for p in prefixes], "needle string")
    got = sorted((r.needle, r.hay) for r in prefix_join(asked, texts, "needle", "hay").collect())
    assert got == sorted((p, w) for p in prefixes for w in words if p and w and w.startswith(p))


def test_glossary_counts_lines_once_over_spellings_in_a_small_plan(spark):
    rows = [("t1", "l1", "kal", "kal"), ("t2", "l1", "kal", "kaal"), ("t3", "l2", "kal", "kaal"), ("t4", "l3", "kal", "kal")]
    terms = spark.createDataFrame(
        [(t, n, h, s, "time", None, "turn") for t, n, h, s in rows],
        "term_id string, line_id string, headword string, transliteration string, meaning_en string, grammar_en string, etymology_en string",
    )
    entries = spark.createDataFrame([("e1", "sky", "above")], "entry_id string, headword string, content string")
    asked = spark.createDataFrame([("q1", "time"), ("q2", "kaal"), ("q3", "bov"), ("q4", "kal")], "query_id string, query string")
    found = glossary(asked, terms, entries)
    assert {(r.query_id, r.id, r.frequency, r.relevance) for r in found.collect()} == {
        ("q1", "t1", 3, 2), ("q2", "t2", 2, 0), ("q3", "e1", 0, 3), ("q4", "t1", 2, 0),
    }
    # the steps before the hits are stored, so the last plan does not repeat them
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") < 10


def test_meaning_hits_share_a_meaning_between_lines_in_a_small_plan(spark):
    terms = spark.createDataFrame(
        [("t1", "l1", "the Sky", None), ("t2", "l2", "the Sky", None), ("t3", "l1", "a sky", "sky"), ("t4", "l4", None, "of sky")],
        "term_id string, line_id string, meaning_en string, etymology_en string",
    )
    alignments = spark.createDataFrame([("a1", "l1", "Sky!"), ("a2", "l3", "T. sky"), ("a3", "l5", "")], "alignment_id string, line_id string, translation string")
    found = meaning_hits(spark.createDataFrame([("q", "sky")], "query_id string, needle string"), terms, alignments)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") < 16
    assert {(r.line_id, r.content) for r in found.collect()} == {("l1", "a sky"), ("l2", "the Sky"), ("l3", "T. sky"), ("l4", "")}
