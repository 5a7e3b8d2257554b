"""Validation, audits, releases, keyed updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.text import LATIN, lexical_words
from ...operators import release as rl
from ...operators import structure as st
from ...operators import validate as va
from ...operators.alignment import crosswalk
from ...operators.reading import nearest_rank
from ...operators.search import line_keys
from ...session import cut_lineage
from ...sources import driver_tables as src
from ..oracle import ALIGNMENTS, ATTRIBUTIONS, CONTRIBUTORS, LAYERS, LEX, LINES, REFERENCE, UNITS, with_
from ..registry import query
from .alignment import _CROSSWALK, _X
from .structure import WORKS


def model(spark, sf):
    return src.works(spark, sf), src.contributors(spark, sf), src.units(spark, sf), src.attributions(spark, sf), src.lines(spark, sf)


@query(
    "Q1_unique_ids",
    """SELECT 'event.id' AS "check", CAST(user_id AS VARCHAR) AS entity_id, 'duplicate ' || COUNT(*) AS detail FROM events GROUP BY user_id HAVING COUNT(*) > 1
  UNION ALL SELECT 'order.id', CAST(o_orderkey AS VARCHAR), 'duplicate ' || COUNT(*) FROM orders GROUP BY o_orderkey HAVING COUNT(*) > 1""",
)
def unique_ids(spark, sf):
    events = va.unique_ids(src.table(spark, sf, "events"), "user_id", "event")
    return events.unionByName(va.unique_ids(src.table(spark, sf, "orders"), "o_orderkey", "order"))


@query(
    "Q2_referential_checks",
    """SELECT 'order.customer' AS "check", CAST(o_orderkey AS VARCHAR) AS entity_id, CAST(o_custkey AS VARCHAR) AS detail FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
  UNION ALL SELECT 'line.order', l_orderkey || ':' || l_linenumber, CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'line.part', l_orderkey || ':' || l_linenumber, CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2)
  UNION ALL SELECT 'nation.region', CAST(n_nationkey AS VARCHAR), CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)
  UNION ALL SELECT 'label.document', CAST(doc_id AS VARCHAR), CAST(doc_id AS VARCHAR) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
)
def referential(spark, sf):
    t = lambda n: src.table(spark, sf, n)
    items = t("lineitem").withColumn("k", F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    checks = [
        va.unknown_reference(t("orders"), "o_orderkey", "o_custkey", t("customer").filter("c_acctbal > 0"), "c_custkey", "order.customer"),
        va.unknown_reference(items, "k", "l_orderkey", t("orders"), "o_orderkey", "line.order"),
        va.unknown_reference(items, "k", "l_partkey", t("part").filter("p_size > 2"), "p_partkey", "line.part"),
        va.unknown_reference(t("nation"), "n_nationkey", "n_regionkey", t("region"), "r_regionkey", "nation.region"),
        va.unknown_reference(t("labels").withColumn("d", F.col("doc_id")), "doc_id", "d", t("documents"), "doc_id", "label.document"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


@query("Q3_domain_check", """SELECT 'unit.type' AS "check", text_unit_id AS entity_id, unit_type AS detail FROM (SELECT 'unit:' || doc_id AS text_unit_id,
  CASE WHEN doc_id % 9 = 0 THEN lang ELSE 'section' END AS unit_type FROM documents) WHERE unit_type <> 'section'""")
def domain_check(spark, sf):
    kind = F.when(F.col("unit_order") % 9 == 0, F.substring("source_work_id", 8, 9)).otherwise("section")
    return va.outside_domain(src.units(spark, sf).withColumn("unit_type", kind), "text_unit_id", "unit_type", va.UNIT_TYPES, "unit.type")


_BLANK = "CASE WHEN length(text) % 3 = 0 THEN '' WHEN length(text) % 3 = 1 THEN NULL ELSE text END"


def _blanked(spark, sf):
    n = F.length("text") % 3
    return src.lines(spark, sf).withColumn("text", F.when(n == 0, "").when(n == 1, F.lit(None)).otherwise(F.col("text")))


@query("Q4_empty_text", with_(LINES) + f"""SELECT 'line.text' AS "check", line_id AS entity_id, 'text' AS detail FROM lines WHERE coalesce({_BLANK}, '') = ''""")
def empty_text(spark, sf):
    return va.empty_text(_blanked(spark, sf), "line_id", "text", "line.text")


@query(
    "F4_empty_text_quarantine",
    with_(LINES)
    + f"""SELECT line_id, CASE WHEN coalesce({_BLANK}, '') = '' THEN 'empty_upstream_canonical_text' END AS reason,
  CASE WHEN coalesce({_BLANK}, '') = '' THEN 'excluded_from_unicode_analysis' ELSE 'canonical' END AS disposition FROM lines""",
)
def quarantine(spark, sf):
    from ...sources.snapshots import split_gaps

    kept, gaps = split_gaps(_blanked(spark, sf), "text")
    good = kept.select("line_id", F.lit(None).cast("string").alias("reason"), F.lit("canonical").alias("disposition"))
    return good.unionByName(gaps.select("line_id", "reason", "disposition"))


_TREE = """tree AS (SELECT c_custkey AS id, CASE WHEN (c_custkey // 5) % 7 = 3 THEN CASE WHEN c_custkey % 5 = 4 THEN c_custkey - 4 ELSE c_custkey + 1 END
  WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN -1 - c_custkey ELSE c_custkey - 5 END AS parent FROM customer),
node AS (SELECT t.id, t.parent, p.id AS up FROM tree t LEFT JOIN tree p ON p.id = t.parent),
reach AS (SELECT id, up AS node, 1 AS d FROM node WHERE up IS NOT NULL UNION SELECT r.id, n.up, r.d + 1 FROM reach r JOIN node n ON n.id = r.node
  WHERE n.up IS NOT NULL AND r.d < 2000 AND r.node <> r.id),
looped AS (SELECT DISTINCT id FROM reach WHERE node = id),
cyclic AS (SELECT id FROM looped UNION SELECT r.id FROM reach r JOIN looped l ON l.id = r.node)"""


def tree(spark, sf):
    k = F.col("c_custkey")
    parent = (
        F.when(F.floor(k / 5) % 7 == 3, F.when(k % 5 == 4, k - 4).otherwise(k + 1))
        .when(k % 11 == 0, F.lit(None))
        .when(k % 13 == 0, -1 - k)
        .otherwise(k - 5)
    )
    return src.table(spark, sf, "customer").select(k.alias("id"), parent.cast("bigint").alias("parent"))


def _recursive(sql):
    return "WITH RECURSIVE " + _TREE + "\n" + sql


_STATUS = "CASE WHEN c.id IS NOT NULL THEN 'cycle' WHEN x.parent IS NOT NULL AND x.up IS NULL THEN 'unknown_parent' ELSE 'ok' END"


@query("Q5_cycle_detection", _recursive("SELECT id FROM cyclic"))
def cycles(spark, sf):
    return va.hierarchy(tree(spark, sf), "id", "parent").filter("status = 'cycle'").select("id")


@query(
    "Q12_parent_before_child",
    _recursive(
        """, far AS (SELECT n.id, coalesce(MAX(r.d), 0) AS level, coalesce(arg_max(r.node, r.d), n.id) AS last FROM node n LEFT JOIN reach r ON r.id = n.id GROUP BY n.id)
  SELECT f.id, CASE WHEN c.id IS NULL THEN CAST(f.level AS BIGINT) END AS level, CASE WHEN c.id IS NOT NULL THEN 'cycle'
  WHEN x.parent IS NOT NULL THEN 'unknown_parent' ELSE 'ok' END AS status
  FROM far f LEFT JOIN cyclic c ON c.id = f.id JOIN node x ON x.id = f.last"""
    ),
)
def levels(spark, sf):
    return va.hierarchy(tree(spark, sf), "id", "parent")


@query(
    "Q6_all_errors",
    with_(LINES, UNITS)
    + """SELECT 'unit.work' AS "check", COUNT(*) AS n FROM units WHERE source_work_id = 'source:fr' HAVING COUNT(*) > 0
  UNION ALL SELECT 'line.work', COUNT(*) FROM lines WHERE source_work_id = 'source:fr' HAVING COUNT(*) > 0""",
)
def all_errors(spark, sf):
    """A release that lacks one work: its units and lines name nothing."""
    works, people, units, attributions, lines = model(spark, sf)
    works = works.filter("source_work_id <> 'source:fr'")
    errors = va.corpus_errors(works, people, units, attributions, lines)
    return errors.groupBy("check").agg(F.count("*").alias("n"))


@query("Q7_count_reconciliation", "SELECT doc_id, n_chars AS declared, length(text) AS received FROM documents WHERE n_chars <> length(text)")
def reconcile(spark, sf):
    docs = src.table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("declared"), F.length("text").cast("bigint").alias("received"))
    return docs.filter("declared <> received")


@query("Q8_checksum_gate")
def checksum_gate(spark, sf):
    from ...sources.snapshots import file_digests

    return file_digests(spark, sf, "*.parquet")


@query(
    "Q8_manifest_verdicts",
    "SELECT * FROM (VALUES ('missing', 1::BIGINT), ('unknown', 1::BIGINT), ('changed', 1::BIGINT)) AS v(verdict, n)",
)
def manifest_verdicts(spark, sf):
    """The landed raw pages against a manifest that does not name the first file, names one more, and has an old sum of the last."""
    from ...sources.snapshots import checksum_verdicts, file_digests
    from .sources import page_snapshots

    landed = cut_lineage(file_digests(spark, page_snapshots(spark, sf), "part-*"), "digests")
    ends = landed.agg(F.min("file").alias("first"), F.max("file").alias("last"))
    first, last = ends.head()
    named = landed.filter(F.col("file") != first)
    expected = F.when(F.col("file") == last, F.lit("0" * 64)).otherwise(F.col("sha256"))
    ghost = ends.select(F.lit("part-ghost").alias("file"), F.lit("0" * 64).alias("sha256"))
    verdicts = checksum_verdicts(landed, named.select("file", expected.alias("sha256")).unionByName(ghost))
    return verdicts.filter("verdict <> 'verified'").groupBy("verdict").agg(F.count("*").alias("n"))


_RULES = (("lines", ">=", 1000), ("blank_lines", "=", 0), ("long_lines", ">=", 10), ("works", "=", 4))


@query(
    "Q9_row_count_gates",
    with_(LINES)
    + """, m AS (SELECT COUNT(*) AS lines, COUNT(*) FILTER (text = '') AS blank_lines, COUNT(*) FILTER (length(text) > 1000) AS long_lines,
  COUNT(DISTINCT source_work_id) AS works FROM lines)
  SELECT 'lines' AS name, lines AS actual, '>=' AS op, 1000::BIGINT AS bound, lines >= 1000 AS passed FROM m
  UNION ALL SELECT 'blank_lines', blank_lines, '=', 0, blank_lines = 0 FROM m
  UNION ALL SELECT 'long_lines', long_lines, '>=', 10, long_lines >= 10 FROM m
  UNION ALL SELECT 'works', works, '=', 4, works = 4 FROM m""",
)
def gates(spark, sf):
    measures = src.lines(spark, sf).agg(
        F.count("*").alias("lines"),
        F.count_if(F.col("text") == "").alias("blank_lines"),
        F.count_if(F.length("text") > 1000).alias("long_lines"),
        F.count_distinct("source_work_id").alias("works"),
    )
    return va.expectations(measures, _RULES)


@query(
    "Q10_index_completeness",
    with_(LINES)
    + """SELECT COUNT(*) FILTER (source_work_id = 'source:fr') AS missing, COUNT(*) FILTER (source_work_id = 'source:de') AS surplus,
  COUNT(*) FILTER (source_work_id = 'source:es') AS repeated FROM lines""",
)
def index_complete(spark, sf):
    """An index without one work, with foreign rows for another, and a third one indexed twice."""
    lines = src.lines(spark, sf)
    keys = line_keys(lines.withColumn("romanised", F.col("text")), LATIN).select("line_id", "source_work_id")
    foreign = keys.filter("source_work_id = 'source:de'").withColumn("line_id", F.concat("line_id", F.lit("#")))
    twice = keys.filter("source_work_id = 'source:es'")
    return va.completeness(lines, keys.filter("source_work_id <> 'source:fr'").unionByName(foreign).unionByName(twice), "line_id")


@query(
    "Q11_alignment_invariants",
    with_(LINES, ALIGNMENTS, UNITS)
    + """SELECT 'orphan_member' AS check_name, COUNT(*) FILTER (l.line_id IS NULL) AS violations FROM alignments a LEFT JOIN lines l USING (line_id)
  UNION ALL SELECT 'unit_differs', COUNT(*) FILTER (l.text_unit_id <> a.text_unit_id) FROM alignments a JOIN lines l USING (line_id)
  UNION ALL SELECT 'passage_not_last', COUNT(*) FILTER (a.scope = 'passage' AND l.line_order <> m.last) FROM alignments a JOIN lines l USING (line_id)
    JOIN (SELECT text_unit_id, page_no, MAX(line_order) AS last FROM lines GROUP BY 1, 2) m ON m.text_unit_id = l.text_unit_id AND m.page_no = l.page_no""",
)
def invariants(spark, sf):
    lines = src.lines(spark, sf)
    rows = src.alignments(spark, sf)
    own = lines.select("line_id", F.col("text_unit_id").alias("u"), "page_no", F.col("line_order").alias("o"))
    last = lines.groupBy(F.col("text_unit_id").alias("u"), "page_no").agg(F.max("line_order").alias("last"))
    joined = rows.join(own, "line_id", "left").join(last, ["u", "page_no"], "left")
    one = joined.agg(
        F.count_if(F.col("u").isNull()).alias("orphan_member"),
        F.count_if(F.col("u") != F.col("text_unit_id")).alias("unit_differs"),
        F.count_if((F.col("scope") == "passage") & (F.col("o") != F.col("last"))).alias("passage_not_last"),
    )
    return one.unpivot([], ["orphan_member", "unit_differs", "passage_not_last"], "check_name", "violations")


@query("Q15_release_identity")
def release_identity(spark, sf):
    return rl.release_id(rl.table_digest(src.lines(spark, sf), "line_id", "text", "text_unit_id"), "corpus", "2026-01-02")


@query("Q18_text_preservation")
def text_checksum(spark, sf):
    return rl.table_digest(src.lines(spark, sf), "line_id", "text")


@query("Q16_required_parts", with_(LINES) + "SELECT CAST(COUNT(*) AS BIGINT) AS n FROM lines")
def required_parts(spark, sf):
    parts = ("line_id", "source_work_id", "text_unit_id", "line_order", "page_no", "text")
    return va.require_columns(src.lines(spark, sf), parts).agg(F.count("*").alias("n"))


@query("Q17_schema_evolution", "SELECT c_custkey, 'v8' AS schema_release, c_mktsegment FROM customer")
def evolution(spark, sf):
    old = src.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    grown = va.with_column_default(old, "schema_release", F.lit("v8"))
    return va.with_column_default(grown, "c_mktsegment", F.lit("none"))


@query(
    "Q19_layer_completeness",
    with_(LAYERS)
    + """SELECT text_unit_id, COUNT(DISTINCT content_type) = 4 AS complete FROM layers WHERE text_unit_id IS NOT NULL GROUP BY 1""",
)
def layer_completeness(spark, sf):
    kinds = src.layers(spark, sf).filter("text_unit_id IS NOT NULL").groupBy("text_unit_id").agg(F.collect_set("content_type").alias("s"))
    wanted = F.array_sort(F.array(*[F.lit(k) for k in src.LAYER_TYPES]))
    return kinds.select("text_unit_id", (F.array_sort("s") == wanted).alias("complete"))


@query("A25_nearest_rank_percentile", "SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def percentile(spark, sf):
    events = src.table(spark, sf, "events")
    return nearest_rank(events, "event_type", "value", 0.95).withColumnRenamed("percentile", "p95")


@query(
    "A22_snapshot_manifest",
    "SELECT page_id, sha256(html) AS checksum, CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS record_count FROM pages",
)
def manifest(spark, sf):
    pages = src.table(spark, sf, "pages")
    return rl.snapshot_manifest(pages, "page_id", "html", F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))))


@query(
    "A21_build_report",
    with_(LINES, LEX, UNITS, REFERENCE, _X, _CROSSWALK)
    + """SELECT (SELECT COUNT(DISTINCT lang) FROM documents) AS works, (SELECT COUNT(*) FROM units) AS units, (SELECT COUNT(*) FROM lines) AS lines,
  (SELECT COUNT(*) FROM lex) AS lexical_occurrences, (SELECT COUNT(DISTINCT form) FROM lex) AS distinct_forms, (SELECT COUNT(*) FROM crosswalk) AS crosswalk_records,
  (SELECT COUNT(*) FROM crosswalk WHERE method = 'proposed_exact_text') AS exact_proposals,
  (SELECT COUNT(*) FROM crosswalk WHERE status = 'review_required') AS review_required, (SELECT COUNT(*) FROM crosswalk WHERE status = 'unavailable') AS unavailable""",
)
def build_report(spark, sf):
    from ..jobs import build_report as report

    return report(src.works(spark, sf), src.units(spark, sf), src.lines(spark, sf), src.reference_lines(spark, sf), LATIN)


# -- keyed updates ----------------------------------------------------------------------------------


def halves(spark, sf):
    rows = src.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    return rows.filter("c_custkey % 3 <> 0"), rows.filter("c_custkey % 3 <> 1")


@query("U2_keyed_merge", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def keyed_merge(spark, sf):
    return rl.merge(list(halves(spark, sf)), "c_custkey")


@query("U2_merge_conflicts", "SELECT c_custkey, CAST(2 AS BIGINT) AS variants FROM customer WHERE c_custkey % 3 = 2 AND c_nationkey > 5")
def conflicts(spark, sf):
    a, b = halves(spark, sf)
    changed = b.withColumn("c_name", F.when(F.col("c_nationkey") > 5, F.lower("c_name")).otherwise(F.col("c_name")))
    return rl.merge_conflicts(a.unionByName(changed), "c_custkey")


@query("U6_insert_if_absent", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE upper(c_name) END AS c_name, c_nationkey FROM customer")
def insert_absent(spark, sf):
    a, b = halves(spark, sf)
    return rl.insert_absent(a, b.withColumn("c_name", F.upper("c_name")), "c_custkey")


@query(
    "U7_replace_subset",
    """SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 3 <> 0 AND c_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 3 <> 1 AND c_acctbal > 9900)
  UNION ALL SELECT c_custkey, upper(c_name), c_nationkey FROM customer WHERE c_custkey % 3 <> 1 AND c_acctbal > 9900""",
)
def replace_subset(spark, sf):
    a, _ = halves(spark, sf)
    new = src.table(spark, sf, "customer").filter("c_custkey % 3 <> 1 AND c_acctbal > 9900")
    return rl.replace_subset(a, new.select("c_custkey", F.upper("c_name").alias("c_name"), "c_nationkey"), "c_nationkey")


_LATEST = """latest AS (SELECT user_id, event_type, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1)"""


@query("S10_key_value_upsert", with_(_LATEST) + "SELECT user_id, event_type, event_id, value FROM latest")
def key_value_upsert(spark, sf):
    events = src.table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return rl.upsert(events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


_HISTORY = """h AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS unit FROM events WHERE event_type = 'view'),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, unit ORDER BY ts DESC, event_id DESC) AS r FROM h) WHERE r = 1),
p AS (SELECT user_id, unit, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS position FROM l)"""


def visits(spark, sf):
    events = src.table(spark, sf, "events").filter("event_type = 'view'")
    return events.select("user_id", F.from_json("props", "k int")["k"].alias("unit"), "ts", "event_id")


@query("W5_latest_distinct_history", with_(_HISTORY) + "SELECT * FROM p WHERE position <= 100")
def history(spark, sf):
    return rl.recent(visits(spark, sf), "user_id", "unit", "ts", 100, "event_id").select("user_id", "unit", "event_id", "position")


@query("U1_union_all", with_(LINES, ALIGNMENTS) + "SELECT scope, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT scope FROM alignments WHERE scope = 'line' UNION ALL SELECT scope FROM alignments WHERE scope = 'passage') GROUP BY 1")
def union_all(spark, sf):
    rows = src.alignments(spark, sf)
    both = rows.filter("scope = 'line'").unionByName(rows.filter("scope = 'passage'"))
    return both.groupBy("scope").agg(F.count("*").alias("n"))


@query("U4_distinct_id_union", "SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal > 5000 UNION SELECT user_id FROM events")
def id_union(spark, sf):
    t = lambda n: src.table(spark, sf, n)
    ids = t("orders").select(F.col("o_custkey").alias("id"))
    return ids.union(t("customer").filter("c_acctbal > 5000").select("c_custkey")).union(t("events").select("user_id")).distinct()


@query(
    "U8_alias_expansion",
    """SELECT DISTINCT p_partkey, alias FROM (SELECT p_partkey, unnest([p_name, lower(p_brand), replace(p_name, ' ', '-'), p_name]) AS alias FROM part) WHERE alias <> ''""",
)
def alias_expansion(spark, sf):
    names = F.array_distinct(F.array("p_name", F.lower("p_brand"), F.replace("p_name", F.lit(" "), F.lit("-")), "p_name"))
    return src.table(spark, sf, "part").select("p_partkey", F.explode(names).alias("alias")).filter("alias <> ''").dropDuplicates()


@query(
    "U9_distinct_alternatives",
    "SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(text, '.'), lambda v: trim(v)), lambda v: v <> ''))), '|') AS alternatives FROM conversations",
)
def alternatives(spark, sf):
    trimmed = F.filter(F.transform(F.split("text", "\\."), lambda v: F.trim(v)), lambda v: v != "")
    rows = src.table(spark, sf, "conversations")
    return rows.select("conv_id", "turn", F.array_join(F.array_sort(F.array_distinct(trimmed)), "|").alias("alternatives"))


def filtered(spark, sf):
    works, people, units, attributions, lines = model(spark, sf)
    return rl.filter_corpus(works, units, lines, people, attributions, ["source:de", "source:fr"])


@query(
    "F6_corpus_filter",
    with_(LINES, UNITS)
    + """, w AS (SELECT * FROM documents WHERE lang IN ('de', 'fr')) SELECT 'works' AS part, COUNT(DISTINCT lang) AS n FROM w
  UNION ALL SELECT 'units', COUNT(*) FROM w UNION ALL SELECT 'lines', COUNT(*) FROM lines WHERE source_work_id IN ('source:de', 'source:fr')
  UNION ALL SELECT 'attributions', COUNT(*) FROM w UNION ALL SELECT 'contributors', COUNT(DISTINCT source) FROM w""",
)
def corpus_filter(spark, sf):
    out = None
    for name, rows in filtered(spark, sf).items():
        counted = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = counted if out is None else out.unionByName(counted)
    return out


@query(
    "K14_scoped_release",
    with_(LINES) + "SELECT source_work_id, CAST(COUNT(*) AS BIGINT) AS n FROM lines WHERE source_work_id IN ('source:de', 'source:en', 'source:fr') GROUP BY 1",
)
def scoped_release(spark, sf):
    works, people, units, attributions, lines = model(spark, sf)
    first = rl.filter_corpus(works, units, lines, people, attributions, ["source:de", "source:fr"])["lines"]
    second = rl.filter_corpus(works, units, lines, people, attributions, ["source:en", "source:fr"])["lines"]
    merged = rl.merge([first, second.select(*first.columns)], "line_id")
    return merged.groupBy("source_work_id").agg(F.count("*").alias("n"))


@query(
    "F2_first_seen_dimensions",
    "SELECT lang, arg_min(source, doc_id) AS first_source, MIN(doc_id) AS first_doc FROM documents GROUP BY lang",
)
def first_seen(spark, sf):
    docs = src.table(spark, sf, "documents").select("lang", F.col("source").alias("first_source"), F.col("doc_id").alias("first_doc"))
    return rl.first_seen(docs, "lang", ["first_source", "first_doc"], ["first_doc"])


@query(
    "W12_fallback_order",
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN CAST(turn * 10 AS DOUBLE) ELSE CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS DOUBLE) END AS effective_order
  FROM conversations""",
)
def fallback_order(spark, sf):
    rows = src.table(spark, sf, "conversations").select("conv_id", "turn")
    declared = F.when(F.col("turn") % 2 == 0, (F.col("turn") * 10).cast("string")).otherwise("n/a")
    return rl.accepted_order(rows, "conv_id", declared, ["turn"]).select("conv_id", "turn", "effective_order")


@query("W11_reading_order", with_(LINES) + "SELECT text_unit_id, line_id, line_order FROM lines")
def reading_order(spark, sf):
    return src.lines(spark, sf).select("text_unit_id", "line_id", "line_order")
