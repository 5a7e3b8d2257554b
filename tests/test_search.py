import random

import pytest

from conftest import make_lines
from lexiloom.operators import search as se
from lexiloom.operators import themes as th

# Known lines with a romanisation, spellings a reader would use, and the lines they must find.
LINES = [
    ("l1", "u1", 1, 1, "ਅਨੰਦੁ ਭਇਆ ਮੇਰੀ ਮਾਏ ਸਤਿਗੁਰੂ ਮੈ ਪਾਇਆ ॥", "anandh bhiaa mayree maae sathiguroo mai paaiaa"),
    ("l2", "u2", 1, 2, "ਜੋ ਮਾਗਹਿ ਠਾਕੁਰ ਅਪੁਨੇ ਤੇ ਸੋਈ ਸੋਈ ਦੇਵੈ ॥", "jo maageh Thaakur apunay thay soiee soiee dhayvai"),
    ("l3", "u3", 1, 3, "ਸਤਿਗੁਰੁ ਮੇਰਾ ਪੂਰਾ ॥", "sathigur mayraa pooraa"),
    ("l4", "u4", 1, 4, "ਗਗਨ ਮੈ ਥਾਲੁ ਰਵਿ ਚੰਦੁ ਦੀਪਕ ਬਨੇ ॥", "gagan mai thaal rav cha(n)dh dheepak banay"),
]
POSITIVE = [
    ("jo mange", "l2"),
    ("anand bheya meree", "l1"),
    ("satigur mera poora", "l3"),
    ("anand bheya curry meree mae", "l1"),
    ("ਅਨੰਦੁ ਭਇਆ ਮੇਰੀ ਮਾਏ", "l1"),
    ("ਅਨਦ ਭਇਆ ਮਰੀ ਮਾਏ", "l1"),
    ("ਅਭਮਮ", "l1"),
    ("abmmsmp", "l1"),
]
NEGATIVE = ["zzqx vvvq", "ਖ਼ਜ਼ਫ਼ ਖ਼ਜ਼ਫ਼ ਖ਼ਜ਼ਫ਼"]


@pytest.fixture(scope="module")
def found(spark):
    queries = spark.createDataFrame([(q, q) for q, _ in POSITIVE] + [(q, q) for q in NEGATIVE], "query_id string, query string")
    rows = se.search(queries, se.build_index(make_lines(spark, LINES)), limit=10, preferred_work="source:G").collect()
    return {(r.query_id, r.line_id): r for r in rows}


@pytest.mark.parametrize("query,line", POSITIVE)
def test_expected_line_is_found(found, query, line):
    assert (query, line) in found


@pytest.mark.parametrize("query", NEGATIVE)
def test_nonsense_finds_nothing(found, query):
    assert not [k for k in found if k[0] == query]


def test_exact_text_outranks(found):
    assert found[("ਅਨੰਦੁ ਭਇਆ ਮੇਰੀ ਮਾਏ", "l1")].score == 970.0
    assert found[("ਅਭਮਮ", "l1")].score == 790.0


def test_retrieval_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["har", "hari", "harinam", "nam", "sat", "satigur", "me", "mera", "t", "tu", "sukh", "a"]
    lines = make_lines(spark, [(f"l{n}", f"u{n % 7}", n, 1, "x", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 7)))) for n in range(60)])
    queries = [(f"q{n}", " ".join(rng.choice(vocabulary + ["zzz"]) for _ in range(rng.randint(1, 5)))) for n in range(30)]
    index = se.build_index(lines)
    keys = {r.line_id: r for r in index.keys.collect()}
    asked = {r.query_id: r.words for r in se.query_words(spark.createDataFrame(queries, "query_id string, query string")).collect()}

    def count(words, k):
        hit = lambda tokens, p: bool(p) and any(t.startswith(p) for t in tokens)
        return sum(hit(k.roman, w.exact) or hit(k.roman_phonetic, w.second) or hit(k.roman_consonants, w.third) for w in words)

    expected = set()
    for q, words in asked.items():
        counted = {i: count(words, k) for i, k in keys.items()}
        full = {i for i, n in counted.items() if n == len(words)}
        if not full and len(words) >= 4:
            full = {i for i, n in counted.items() if n == len(words) - 1}
        expected |= {(q, i) for i in full}
    got = [(r.query_id, r.line_id) for r in se.retrieve(spark.createDataFrame(queries, "query_id string, query string"), index).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_a_prefix_meets_the_vocabulary_once_for_all_queries(spark, monkeypatch):
    """Many queries that share short words: what is stored on the way is no product of query words and tokens."""
    lines = make_lines(spark, [(f"l{n}", "u", n, 1, "x", f"ta{chr(97 + n % 26)}{chr(97 + n // 26)}" + " rare" * (n < 10)) for n in range(300)])
    index = se.build_index(lines)
    queries = spark.createDataFrame([(f"q{n}", "t t t t t t t t rare") for n in range(50)], "query_id string, query string")
    sizes = []

    def counted(df, name):
        out = cut(df, name)
        if name.startswith("query-"):
            sizes.append(out.count())
        return out

    cut = se.cut_lineage
    monkeypatch.setattr(se, "cut_lineage", counted)
    found = se.retrieve(queries, index)
    assert found.count() == 50 * 10
    # 50 * 9 query words; 300 words begin with t, and in three fields at most
    assert max(sizes) <= 3 * 301 and len(sizes) >= 3


THEME_QUERIES = [
    ("ego", "ego"), ("diet", "diet"), ("meat", "diet"), ("vegetarian", "diet"), ("compassion", "compassion"), ("contentment", "contentment"),
    ("gender", "gender"), ("heaven", "afterlife"), ("hell", "afterlife"),
]
NO_THEME = ["jo mange", "anand bheya meree", "satigur mera poora", "ਆਨੰਦੁ ਭਇਆ", "random purple bicycle"]


def test_theme_triggers(spark):
    queries = spark.createDataFrame([(q, q) for q, _ in THEME_QUERIES] + [(q, q) for q in NO_THEME], "query_id string, query string")
    got = {r.query_id: r.theme for r in th.triggered(queries, th.theme_table(spark)).collect()}
    assert got == dict(THEME_QUERIES)


def test_theme_search_scores(spark):
    layers = spark.createDataFrame(
        [("a", "commentary_en", "u1", "Ego and pride, <b>self centred</b>"), ("b", "commentary_en", "u1", "pride only"), ("c", "overview_en", "u2", "ego"), ("d", "commentary_en", "u3", "egos")],
        "layer_id string, content_type string, text_unit_id string, content string",
    )
    pages = spark.createDataFrame([("u1", 1), ("u2", 1), ("u3", 1)], "text_unit_id string, first_page int")
    queries = spark.createDataFrame([("q", "Ego")], "query_id string, query string")
    rows = th.theme_search(queries, layers, th.theme_table(spark), pages).collect()
    # ego, pride and self-centred match: 650 + 3 * 70 + 120
    assert [(r.text_unit_id, r.layer_id, r.score) for r in rows] == [("u1", "a", 980)]


def test_mode_is_taken_before_the_cut(spark):
    hits = lambda q, units, at: [(q, f"u{n}", f"r{at}{n}", 1.0, n) for n in units]
    schema = "query_id string, text_unit_id string, result_id string, score double, position int"
    units = spark.createDataFrame(hits("a", range(4), 0) + hits("b", range(4), 0) + hits("c", range(4), 0), schema)
    family = spark.createDataFrame(hits("a", range(2, 10), 1) + hits("b", range(2, 6), 1) + hits("c", range(2, 10), 1), schema)
    asked = spark.createDataFrame([("a", "life"), ("b", "life"), ("c", "ਸਿਧ")], "query_id string, query string")
    modes = {r.query_id: r["mode"] for r in se.response_mode(se.all_families(units, [family]), asked).collect()}
    assert modes == {"a": "english", "b": "latin", "c": "primary"}
    assert {q: n for q, n in se.with_families(units, [family], 5).groupBy("query_id").count().collect()} == {"a": 5, "b": 5, "c": 5}


def test_all_words_of_a_long_query_count(spark):
    text = " ".join(f"ab{chr(97 + n)}" for n in range(13))
    lines = make_lines(spark, [("l1", "u1", 1, 1, "", text)])
    asked = spark.createDataFrame([("whole", text), ("other", text[:-3] + "zzz")], "query_id string, query string")
    words = {r.query_id: len(r.words) for r in se.query_words(asked).collect()}
    assert words == {"whole": 13, "other": 13} and lines.count() == 1


def test_stored_keys_are_strings_and_equal_the_keys_of_single_texts(spark):
    from pyspark.sql import functions as F

    from lexiloom.functions import roman as rm

    index = se.build_index(make_lines(spark, LINES))
    assert not [f for f in index.strings.schema if f.dataType.typeName() == "array"]
    alone = make_lines(spark, LINES).select("line_id", rm.phonetic("romanised").alias("key"), rm.phonetic_index(F.col("romanised")).alias("spoken"), rm.roman_initials(F.col("romanised")).alias("first"))
    wanted = {r.line_id: (r.key, r.spoken, r["first"]) for r in alone.collect()}
    got = {r.line_id: (r.roman_key, r.roman_phonetic, r.roman_first) for r in index.keys.collect()}
    assert got == wanted


def test_endings_dropped_from_words_of_four_letters(spark):
    from pyspark.sql import functions as F

    from lexiloom.functions.roman import phonetic_of_normal

    words = ["ahi", "bahi", "reh", "creh", "bat", "bata", "boi", "b", "dahia"]
    got = spark.createDataFrame([(" ".join(words),)], "t string").select(phonetic_of_normal(F.col("t"))).first()[0]
    assert got == "ahi b reh cr bat bat boi b dahi"


def test_first_letter_query_stores_no_index(spark):
    from lexiloom.plans.catalog import search as queries

    before = {t.name for t in spark.catalog.listTables()}
    # a path of its own, for which no other test has stored an index
    assert queries.first_letter_search(spark, "/root/testdata/sf0.001/.").limit(1).count() == 1
    assert {t.name for t in spark.catalog.listTables()} == before


def test_tokens_are_keyed_once_each(spark, monkeypatch):
    from lexiloom.functions.roman import reader_fold, reader_key

    rows = [("q", "thee", f"l{n}", "a b c", "the cat the") for n in range(20)] + [("p", "cat", "l", "a b", "one two three")]
    hits = spark.createDataFrame(rows, "query_id string, query string, line_id string, text string, romanised string")
    stored, real = {}, se.cut_lineage
    monkeypatch.setattr(se, "cut_lineage", lambda df, name: stored.update({name: df.count()}) or real(df, name))
    got = sorted((r.query_id, r.line_id, r.position, r.form) for r in se.aligned_forms(hits, reader_fold, reader_key).collect())
    assert got == sorted(("q", f"l{n}", at, form) for n in range(20) for at, form in ((0, "a"), (2, "c")))
    assert stored["aligned-words"] == 5


def test_a_query_given_twice_may_still_miss_its_rarest_word(spark):
    lines = make_lines(spark, [("all", "u", 1, 1, "", "abba cede fogi hajo"), ("less", "u", 2, 1, "", "abba cede fogi")])
    asked = spark.createDataFrame([("q", "abba cede fogi zuzu")] * 2 + [("r", "abba cede fogi hajo")] * 2, "query_id string, query string")
    got = sorted((r.query_id, r.line_id, r.matched_words) for r in se.retrieve(asked, se.build_index(lines)).collect())
    assert got == [("q", "all", 3)] * 2 + [("q", "less", 3)] * 2 + [("r", "all", 4)] * 2


def test_parts_of_retrieval_are_the_whole(spark):
    rng = random.Random(9)
    words = ["sat", "satigur", "nam", "har", "hari", "mera", "t", "ea"]
    lines = make_lines(spark, [(f"l{n}", "u", n, 1, "x", " ".join(rng.choices(words, k=rng.randint(1, 6)))) for n in range(40)])
    asked = spark.createDataFrame([(f"q{n}", " ".join(rng.choices([*words, "zzz"], k=rng.randint(1, 6)))) for n in range(40)], "query_id string, query string")
    index = se.build_index(lines)
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole, less = rows(se.retrieve_whole(asked, index)), rows(se.retrieve_omitted(asked, index))
    assert whole and less and rows(se.retrieve(asked, index)) == sorted(whole + less)


def test_neither_lines_nor_pairs_are_stored_by_a_search(spark, monkeypatch):
    """What a search writes belongs to the queries; the texts of hits go nowhere."""
    lines = make_lines(spark, [(f"l{n}", f"u{n}", n, 1, "", "the heron and the other heron") for n in range(200)])
    index = se.build_index(lines)
    sizes, real = {}, se.cut_lineage

    def counted(df, name, **options):
        out = real(df, name, **options)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(se, "cut_lineage", counted)
    hits = se.scored_lines(spark.createDataFrame([("q", "the"), ("r", "th")], "query_id string, query string"), index)
    assert hits.count() == 400 and not {"text", "romanised"} & set(hits.columns)
    assert max(sizes.values()) <= 10 and not {"text", "romanised"} & set(index.strings.columns)


def test_an_id_of_two_texts_has_one_score_per_line(spark):
    lines = make_lines(spark, [("l", "u", 1, 1, "", "gagan mai thaal"), ("m", "u", 2, 1, "", "gagan")])
    asked = spark.createDataFrame([("q", "gagan"), ("q", "gagan mai thaal")], "query_id string, query string")
    got = {(r.line_id, r.score) for r in se.scored_lines(asked, se.build_index(lines)).collect()}
    assert got == {("l", 1000.0), ("m", 1000.0)}
