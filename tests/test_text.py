import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from lexiloom.functions import roman as rm
from lexiloom.functions import scoring as sc
from lexiloom.functions import text as tx
from lexiloom.operators import lexical as lx


def values(spark, items, expression):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(items)], "n int, v string")
    return [r[0] for r in df.orderBy("n").select(expression(F.col("v"))).collect()]


def test_nfc_shortcut_never_skips_a_string_that_needs_it():
    """Every code point, alone and between neighbours that could compose with it."""
    pattern = regex.compile(regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\U" + m.group(1).zfill(8), tx.NFC_MAYBE))
    for code in range(0x110000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        for text in (char, "a" + char, "ਕ" + char, char + "ਾ", "\u0A4D" + char):
            if not unicodedata.is_normalized("NFC", text):
                assert pattern.search(text), hex(code)


def test_nfc_is_checked_by_ranges_and_cheaply(spark):
    """The ranges find what the pattern finds, on every code point; accented text takes a fraction of the pattern's time."""
    import time

    points = spark.range(0x110000).filter("id < 55296 OR id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("v"))
    assert points.filter(tx.nfc_maybe(F.col("v")) != F.col("v").rlike(tx.NFC_MAYBE)).count() == 0
    assert points.filter(tx.nfc_maybe(F.col("v"))).count() > 1_000_000

    long = spark.range(400).select(F.concat(F.lit("é où déjà vu "), F.repeat(F.concat(F.lit("garçon naïve "), "id"), 2000)).alias("v")).repartition(4)
    long.persist().count()

    def seconds(check):
        start = time.time()
        assert long.filter(check).count() == 0
        return time.time() - start

    for check in (tx.nfc_maybe(F.col("v")), F.col("v").rlike(tx.NFC_MAYBE)):
        seconds(check)
    assert seconds(tx.nfc_maybe(F.col("v"))) < seconds(F.col("v").rlike(tx.NFC_MAYBE)) / 3


def test_nfc_and_nfd(spark):
    items = ["e\u0301", "é", "\u0A36", "ਸ਼ਾ", "plain", "Å", "가"]
    assert values(spark, items, tx.nfc) == [unicodedata.normalize("NFC", v) for v in items]
    assert values(spark, items, tx.nfd) == [unicodedata.normalize("NFD", v) for v in items]


def test_offsets_cut_the_exact_token_in_three_units(spark):
    from conftest import make_lines

    texts = ["ਸੁਣਿਐ  ਸਿਧ ॥", "a😀b 12x,\u00a0é", "   lead", "x" * 300 + " y"]
    lines = make_lines(spark, [(f"l{n}", "u", n, 1, t, None) for n, t in enumerate(texts)])
    rows = lx.token_occurrences(lines).collect()
    assert rows
    for r in rows:
        text = texts[int(r.line_id[1:])]
        assert text[r.start_cp : r.end_cp] == r.exact_form
        assert text.encode()[r.start_byte : r.end_byte].decode() == r.exact_form
        assert text.encode("utf-16-le")[2 * r.start_utf16 : 2 * r.end_utf16].decode("utf-16-le") == r.exact_form
    for n, text in enumerate(texts):
        mine = sorted((r for r in rows if r.line_id == f"l{n}"), key=lambda r: r.position)
        assert "".join(r.exact_form for r in mine) == "".join(text.split())


def test_golden_counts(spark, golden_lines):
    tokens = lx.token_occurrences(golden_lines)
    assert tokens.count() == 16
    assert tokens.filter("token_class = 'lexical_primary'").count() == 13
    row = lx.exact_frequency(golden_lines, "ਸੁਣਿਐ").head()
    assert (row.raw_frequency, row.distinct_lines, row.distinct_units, row.eligible_tokens) == (3, 3, 1, 13)
    top = lx.ranked_forms(golden_lines).head()
    assert (top.form, top.frequency, top.distinct_lines) == ("ਸੁਣਿਐ", 3, 3)
    assert lx.exact_occurrences(golden_lines, "ਸੁਣਿਐ").count() == 3


def test_written_forms_stay_separate(spark):
    from conftest import make_lines

    lines = make_lines(spark, [("l", "u", 0, 1, "ਹਰਿ ਹਰਿ ਹਰ", None)])
    rows = {r.form: (r.raw_frequency, r.combined_raw_frequency) for r in lx.related_form_frequency(lines, ["ਹਰਿ", "ਹਰ"]).collect()}
    assert rows == {"ਹਰਿ": (2, 3), "ਹਰ": (1, 3)}


@pytest.mark.parametrize(
    "raw,normal,key",
    [
        ("Anand(u) Bhaiaa", "anandu bhaiaa", "anand bea"),
        ("jo mange", "jo mange", "jo mag"),
        ("suṇiai sidh pīr", "suniai sidh pir", "suni sid pir"),
        ("chhoo(n) satigur", "chhoon satigur", "chu satigur"),
    ],
)
def test_roman_keys(spark, raw, normal, key):
    assert values(spark, [raw], rm.roman_normal) == [normal]
    got = values(spark, [raw], rm.phonetic)[0]
    assert got == key


def test_markup(spark):
    html = "<bani:x y>ਸਤਿ<br/>ਨਾਮੁ &amp; &quot;a&quot;<b>b</b>&nbsp;\r\n  plain  "
    assert values(spark, [html], tx.markup_lines)[0] == ["ਸਤਿ", 'ਨਾਮੁ & "a" b', "plain"]
    assert values(spark, [html], lambda c: tx.markup_lines_decoded_first(c, tx.PRIMARY))[0] == ["ਸਤਿ", 'ਨਾਮੁ & "a"b']




def test_ends_of_pieces_are_summed_over_a_batch():
    import pyarrow as pa

    from lexiloom.operators.lexical import running_ends

    lines = [["a", " ä", "𝒳𝒳"], [], None, [" ॥"], ["x"] * 200]
    got = running_ends.func(pa.array([["cut"], *lines], pa.list_(pa.string()))[1:]).to_pylist()
    for line, ends in zip(lines, got):
        joined = ["".join(line[: n + 1]) for n in range(len(line or []))]
        assert [(e["utf16"], e["cp"], e["byte"]) for e in ends] == [(len(j.encode("utf-16-le")) // 2, len(j), len(j.encode())) for j in joined]


def test_a_common_range_changes_no_word(spark):
    from dataclasses import replace

    LATIN = tx.LATIN

    assert LATIN.common and not replace(LATIN, common="").common
    texts = ["", "aeiou xyz", "É--Ébc Àà ZZ zZ9q", "a", "ñandú, Straße!", "日本 x本y", "\u00a0b\u2003c\u200bd"]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = replace(LATIN, common="")
    rows = table.select(*[f(F.col("t"), s) for f in (rm.primary_initials, tx.primary_normal, tx.compare_words) for s in (LATIN, plain)]).collect()
    assert all(r[0] == r[1] and r[2] == r[3] and r[4] == r[5] for r in rows)
