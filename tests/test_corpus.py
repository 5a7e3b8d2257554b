import hashlib
import random

import pytest
from pyspark.sql import functions as F

from conftest import make_lines
from lexiloom.operators import alignment as al
from lexiloom.operators import reading as rd
from lexiloom.operators import release as rl
from lexiloom.operators import structure as st
from lexiloom.operators import validate as va
from lexiloom.operators.containment import substring_join
from lexiloom.session import scratch_path
from lexiloom.sources import sinks, snapshots


def test_crosswalk_proposes_and_never_approves(spark, golden_lines):
    records = spark.createDataFrame(
        [("1", "ਸੁਣਿਐ ਸਿਧ ਪੀਰ ਸੁਰਿ ਨਾਥ ॥"), ("2", "ਸੁਣਿਐ  ਧਰਤਿ ਧਵਲ ਆਕਾਸ ॥"), ("3", "ਤਕਨੀਕੀ ਬੇਮੇਲ ਨਮੂਨਾ")], "record_id string, reference_text string"
    )
    rows = {r.record_id: (r.method, r.status, r.line_id) for r in al.crosswalk(golden_lines, records).collect()}
    assert rows == {
        "1": ("proposed_exact_text", "review_required", "line:1"),
        "2": ("proposed_whitespace_normalised", "review_required", "line:2"),
        "3": ("unmatched", "unavailable", None),
    }


def test_crosswalk_lists_ambiguous_candidates_once(spark):
    lines = make_lines(spark, [(f"l{n}", "u", n, 1, "same text", None) for n in range(50)])
    records = spark.createDataFrame([(str(n), "same text") for n in range(20)], "record_id string, reference_text string")
    mapped = al.crosswalk(lines, records)
    assert {(r.method, r.candidate_count) for r in mapped.collect()} == {("ambiguous_exact_text", 50)}
    assert al.crosswalk_candidates(lines, mapped).count() == 50


def test_hierarchy_flags_cycles_and_what_leads_into_them(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("into", "a"), ("root", None), ("child", "root"), ("lost", "nowhere"), ("below", "lost")]
    found = {r.id: (r.level, r.status) for r in va.hierarchy(spark.createDataFrame(rows, "id string, parent string"), "id", "parent").collect()}
    assert {k for k, v in found.items() if v[1] == "cycle"} == {"a", "b", "c", "into"}
    assert found["root"] == (0, "ok") and found["child"] == (1, "ok")
    assert found["lost"][1] == "unknown_parent" and found["below"][1] == "unknown_parent"


def test_hierarchy_of_a_long_chain(spark):
    rows = [(n, n - 1 if n else None) for n in range(200)]
    got = va.hierarchy(spark.createDataFrame(rows, "id int, parent int"), "id", "parent")
    assert got.filter("level = id AND status = 'ok'").count() == 200


def test_validation_fails_with_its_errors(spark):
    rows = spark.createDataFrame([("1", "x"), ("1", "y"), (None, "z")], "id string, v string")
    errors = va.unique_ids(rows, "id", "line")
    assert {r.detail for r in errors.collect()} == {"duplicate 2", "missing 1"}
    with pytest.raises(va.ValidationError, match="duplicate 2"):
        va.assert_no_errors(errors)


def test_merge_collapses_equal_and_rejects_unequal(spark):
    a = spark.createDataFrame([("1", "Shared"), ("2", "A")], "id string, name string")
    b = spark.createDataFrame([("1", "Shared"), ("3", "B")], "id string, name string")
    assert rl.merge([a, b], "id").count() == 3
    with pytest.raises(va.ValidationError):
        rl.merge([a, b.withColumn("name", F.lit("other"))], "id")


def test_release_id_ignores_row_order(spark):
    rows = [(str(n), f"text {n}") for n in range(500)]
    one = rl.table_digest(spark.createDataFrame(rows, "id string, t string"), "id", "t").head()
    random.Random(1).shuffle(rows)
    two = rl.table_digest(spark.createDataFrame(rows, "id string, t string").repartition(7), "id", "t").head()
    rows[0] = (rows[0][0], "changed")
    three = rl.table_digest(spark.createDataFrame(rows, "id string, t string"), "id", "t").head()
    assert one == two and one.checksum != three.checksum and one.rows == 500


def brute_votes(lines, readings):
    units = {}
    for i, u, text in lines:
        units.setdefault(text, []).append((i, u))
    out = {}
    for par in {(r[0], r[2]) for r in readings}:
        votes = {}
        mine = [r for r in readings if (r[0], r[2]) == par]
        for r in mine:
            for _, u in units.get(r[3], []):
                votes[u] = votes.get(u, 0) + 1
        ranked = sorted(votes.values(), reverse=True)
        best = None
        if ranked and (len(ranked) == 1 or ranked[0] > ranked[1]):
            best = max(votes, key=votes.get)
        for r in mine:
            found = [i for i, u in units.get(r[3], []) if best is None or u == best]
            line = found[0] if len(found) == 1 else None
            home = best or (units[r[3]][0][1] if line else None)
            out[(r[0], r[1])] = (line, home)
    return out


@pytest.mark.parametrize("heavy", [0, 1, 3, 1000])
def test_paragraph_vote_equals_brute_force_for_any_bound(spark, heavy):
    rng = random.Random(11)
    forms = [f"form{n}" for n in range(9)]
    lines = [(f"l{n}", f"u{rng.randint(0, 11)}", rng.choice(forms + ["refrain"] * 5)) for n in range(120)]
    readings = [("r", n, n // 3, rng.choice(forms + ["refrain"] * 4 + ["absent"])) for n in range(60)]
    table = make_lines(spark, [(i, u, n, 1, t, None) for n, (i, u, t) in enumerate(lines)])
    asked = spark.createDataFrame(readings, "reading_id string, line_order int, paragraph int, text string")
    got = {(r.reading_id, r.line_order): (r.line_id, r.text_unit_id) for r in al.paragraph_crosswalk(table, asked, heavy).collect()}
    assert got == brute_votes(lines, readings)


def test_units_of_a_kind_are_tallied_once(spark):
    """A refrain in 300 units that agree, and one set of forms with it: two units of a kind, and none by the refrain alone where
    the rarer form gives more votes."""
    held = [("refrain", f"u{n:03}", 1) for n in range(300)] + [("rare", f"u{n:03}", 1) for n in range(290, 294)]
    sets = [("a", "refrain", 1), ("b", "refrain", 1), ("b", "rare", 1), ("c", "rare", 2)]
    units = spark.createDataFrame(held, "form string, text_unit_id string, n long")
    tallied = al.leading_units(spark.createDataFrame(sets, "sig string, form string, m long"), units)
    got = sorted((r.sig, r.text_unit_id, r.v) for r in tallied.collect())
    assert got == [("a", "u000", 1), ("a", "u001", 1), ("b", "u290", 2), ("b", "u291", 2), ("c", "u290", 2), ("c", "u291", 2)]
    assert al.two_of_a_kind(units).count() == 2 + 2 * 2


def test_lines_of_short_units_are_not_placed_by_ranges(spark, monkeypatch):
    lines = make_lines(spark, [(f"l{n}", "long" if n < 9 else f"u{n % 4}", n, 1, f"t{n} |", None) for n in range(30)])
    given, real = [], al.positions
    monkeypatch.setattr(al, "positions", lambda rows, *rest: given.append(rows.count()) or real(rows, *rest))
    runs = {(r.first_line_id, r.last_line_id): (r.digest, r.loose) for r in al.line_runs(lines, longest=2, block=8).collect()}
    assert given == [9]
    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()
    assert runs["l7", "l8"] == (md5("t7|t8|"), md5("t7t8")) and runs["l9", "l13"] == (md5("t9|t13|"), md5("t9t13"))
    assert len(runs) == 2 * 30 - 5


@pytest.mark.parametrize("in_row", [0, 10])
def test_substrings_are_found_in_the_row_or_by_ids(spark, in_row):
    texts = ["abcabd", "xxabdxx", "", "ab", "caba"]
    needles = ["abd", "ab", "cabd", "a", "zz"]
    asked = spark.createDataFrame(list(enumerate(needles)), "query_id int, needle string")
    table = spark.createDataFrame(list(enumerate(texts)), "id int, hay string")
    found = substring_join(asked, table, "needle", "hay", "id", stored=True, in_row=in_row)
    assert sorted((r.query_id, r.id) for r in found.collect()) == [(q, i) for q, n in enumerate(needles) for i, h in enumerate(texts) if n in h]


def test_a_tied_vote_keeps_the_unit_of_an_accepted_line(spark):
    lines = make_lines(spark, [("l1", "u1", 1, 1, "alpha", None), ("l2", "u2", 2, 1, "beta", None)])
    asked = spark.createDataFrame([("r", 1, 1, "alpha"), ("r", 2, 1, "beta")], "reading_id string, line_order int, paragraph int, text string")
    got = {r.line_order: (r.line_id, r.text_unit_id) for r in al.paragraph_crosswalk(lines, asked).collect()}
    assert got == {1: ("l1", "u1"), 2: ("l2", "u2")}


def test_crowded_locations_give_the_same_terms(spark):
    rng = random.Random(3)
    alphabet = "abcd"
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    lines = make_lines(spark, [(f"l{n}", f"u{n % 2}", n, 1, " ".join(word(4) for _ in range(5)), None) for n in range(30)])
    terms = spark.createDataFrame([(f"t{n}", f"u{n % 2}", word(rng.randint(1, 5))) for n in range(60)] + [("blank", "u0", " \u200b")], "term_id string, text_unit_id string, headword string")
    pairs = lambda bound: {(r.term_id, r.line_id) for r in al.attach_terms(lines, terms, crowded=bound).collect()}
    assert pairs(0) == pairs(1000) != set()
    assert {line for term, line in pairs(0) if term == "blank"} == {f"l{n}" for n in range(0, 30, 2)}


def test_substring_join_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [(n, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 25)))) for n in range(80)]
    needles = [(n, "".join(rng.choice("abc ") for _ in range(rng.randint(1, 6)))) for n in range(40)]
    found = substring_join(
        spark.createDataFrame(needles, "q int, needle string"), spark.createDataFrame(texts, "t int, hay string"), "needle", "hay", "t"
    )
    got = sorted((r.q, r.t) for r in found.collect())
    assert got == sorted((q, t) for q, n in needles for t, h in texts if n in h)


@pytest.mark.parametrize("block", [5, 7, 4096])
def test_runs_cross_block_edges(spark, block):
    lines = make_lines(spark, [(f"l{n:02}", "u", n, n // 4, f"t{n}", None) for n in range(23)])
    runs = {(r.first_line_id, r.last_line_id): r.digest for r in al.line_runs(lines, block=block).collect()}
    assert len(runs) == sum(23 - k for k in range(5))
    assert runs[("l03", "l07")] == hashlib.md5(b"t3t4t5t6t7").hexdigest()


def test_longer_runs_on_request(spark):
    lines = make_lines(spark, [(f"l{n}", "u", n, 1, f"t{n}", None) for n in range(8)])
    asked = spark.createDataFrame([("p", "u", "".join(f"t{n}" for n in range(1, 7)))], "record_id string, text_unit_id string, reference_text string")
    assert [r.first_line_id for r in al.within_unit(lines, asked, longest=6).collect()] == ["l1"]
    assert [r.first_line_id for r in al.within_unit(lines, asked).collect()] in ([], [None])


def test_positional_alignment_rules(spark):
    rows = [
        ("equal", ["a", "b"], ["A", "B"]),
        ("shift", ["ਮਃ ੧", "b"], ["B"]),
        ("passage", ["a", "b", "c"], ["X", "Y"]),
        ("empty", ["a"], []),
    ]
    df = spark.createDataFrame(rows, "group_id string, refs array<string>, translations array<string>")
    got = {(r.group_id, r.line_index): (r.translation, r.scope) for r in al.positional(df).collect()}
    assert got[("equal", 1)] == ("B", "line") and got[("shift", 0)] == ("", "none") and got[("shift", 1)] == ("B", "line")
    assert got[("passage", 2)] == ("X\nY", "passage") and got[("passage", 0)] == ("", "none") and got[("empty", 0)] == ("", "none")


def test_nearest_rank(spark):
    rng = random.Random(2)
    rows = [("g" if n % 3 else "h", rng.randint(0, 5000) / 7) for n in range(4000)]
    got = {r.g: r.percentile for r in rd.nearest_rank(spark.createDataFrame(rows, "g string, v double"), "g", "v", 0.95).collect()}
    for g in "gh":
        mine = sorted(v for k, v in rows if k == g)
        assert got[g] == mine[-(-len(mine) * 95 // 100) - 1]


def test_contributor_structure_counts_zero(spark, golden_lines):
    people = spark.createDataFrame([("contributor:1", "A", "guru"), ("contributor:2", "B", "bhatt")], "contributor_id string, name string, contributor_type string")
    units = spark.createDataFrame([("unit:1", "bani"), ("unit:8", "pauri")], "text_unit_id string, unit_type string")
    attributions = spark.createDataFrame([("contributor:1", "textUnit", "unit:1")], "contributor_id string, target_type string, target_id string")
    rows = {r.contributor_id: (r.kind_count, r.attributed_unit_count, r.line_count) for r in st.contributor_structure(people, attributions, units, golden_lines).collect()}
    assert rows == {"contributor:1": (0, 1, 3), "contributor:2": (0, 0, 0)}


def test_raw_page_becomes_lines_and_gaps(spark, tmp_path):
    page = (
        '{"source":{"sourceId":"G","pageNo":1},"page":[{"verseId":1,"shabadId":1,"verse":{"unicode":"ੴ ਸਤਿ ਨਾਮੁ"},"pageNo":1,"lineNo":1,'
        '"writer":{"writerId":1,"english":"Guru Nanak Sahib"},"raag":{"raagId":0}},{"verseId":3,"shabadId":2,"verse":{"unicode":""},"pageNo":1}]}'
    )
    (tmp_path / "1.json").write_text(page)
    lines, gaps = snapshots.split_gaps(snapshots.canonical_lines(snapshots.read_pages(spark, str(tmp_path))), "text")
    row = lines.head()
    assert (row.line_id, row.text_unit_id, row.text, row.contributor_id) == ("line:1", "unit:G:1", "ੴ ਸਤਿ ਨਾਮੁ", "contributor:1")
    assert [r.reason for r in gaps.collect()] == ["empty_upstream_canonical_text"]


def test_publish_keeps_the_old_version_when_the_check_fails(spark):
    root = scratch_path(spark, "publish-test")
    sinks.publish(spark.range(3), root, 1, lambda df: df.count() == 3)
    with pytest.raises(ValueError):
        sinks.publish(spark.range(5), root, 2, lambda df: False)
    assert sinks.read_published(spark, root).count() == 3


def test_backups(spark):
    rows = [('{"format":"reader-backup","version":1,"personal":{},"preferences":{}}',), ("junk",), ('{"format":"reader-backup","version":9,"personal":{},"preferences":{}}',)]
    got = snapshots.backup_verdicts(spark.createDataFrame(rows, "body string"), "body").collect()
    assert [r.accepted for r in got] == [True, False, False]


def test_a_cyclic_corpus_fails_with_the_units_of_the_cycle(spark):
    units = spark.createDataFrame(
        [("u1", "w", None, "section"), ("u2", "w", "u3", "section"), ("u3", "w", "u2", "section"), ("u4", "w", "u2", "section")],
        "text_unit_id string, source_work_id string, parent_id string, unit_type string",
    )
    works = spark.createDataFrame([("w",)], "source_work_id string")
    people = spark.createDataFrame([("c",)], "contributor_id string")
    claims = spark.createDataFrame([("a", "c", "textUnit", "u1")], "attribution_id string, contributor_id string, target_type string, target_id string")
    lines = spark.createDataFrame([("l", "w", "u1", "text")], "line_id string, source_work_id string, text_unit_id string, text string")
    found = {(r["check"], r.entity_id) for r in va.corpus_errors(works, people, units, claims, lines).collect()}
    assert found == {("unit.cycle", u) for u in ("u2", "u3", "u4")}
    with pytest.raises(va.ValidationError, match="unit.cycle"):
        va.assert_no_errors(va.corpus_errors(works, people, units, claims, lines))
