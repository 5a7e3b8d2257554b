"""Matching provider text to canonical lines: every rule accepts only what is unambiguous."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .containment import grams
from .ordering import positions
from ..functions.text import SENTENCE_MARKS, align_key, compact_key, compare_form, loose_key, unmarked, whitespace_key


def _key_counts(lines: DataFrame, key: Column) -> DataFrame:
    """Per key: how many lines, and the line itself when it is the only one."""
    return lines.select(key.alias("key"), "line_id").groupBy("key").agg(
        F.count("*").alias("n"), F.min("line_id").alias("line_id")
    )


def crosswalk(lines: DataFrame, records: DataFrame) -> DataFrame:
    """Exact text, then white-space-folded text.  A unique match is a proposal for review, several
    are ambiguous, none is unavailable; nothing is approved.

    ``candidate_key`` leads to the candidates in ``crosswalk_candidates``: they are listed once per
    key, not once per record, so a line copied everywhere does not multiply.
    """
    text = F.col("text")
    keyed = records.select(
        "record_id",
        compare_form(F.col("reference_text")).alias("exact_key"),
        whitespace_key(F.col("reference_text")).alias("folded_key"),
    )
    wanted = keyed.select(F.explode(F.array("exact_key", "folded_key")).alias("key")).distinct()
    listed = lines.select("line_id", compare_form(text).alias("e"), whitespace_key(text).alias("f"))
    exact = _key_counts(listed.withColumnRenamed("e", "text").join(
        wanted.withColumnRenamed("key", "text"), "text", "left_semi"), F.col("text"))
    folded = _key_counts(listed.withColumnRenamed("f", "text").join(
        wanted.withColumnRenamed("key", "text"), "text", "left_semi"), F.col("text"))
    joined = keyed.join(
        exact.select(F.col("key").alias("exact_key"), F.col("n").alias("en"), F.col("line_id").alias("el")), "exact_key", "left"
    ).join(
        folded.select(F.col("key").alias("folded_key"), F.col("n").alias("fn"), F.col("line_id").alias("fl")),
        "folded_key",
        "left",
    )
    en, fn = F.coalesce("en", F.lit(0)), F.coalesce("fn", F.lit(0))
    method = (
        F.when(en == 1, "proposed_exact_text")
        .when(en > 1, "ambiguous_exact_text")
        .when(fn == 1, "proposed_whitespace_normalised")
        .when(fn > 1, "ambiguous_whitespace_normalised")
        .otherwise("unmatched")
    )
    return joined.select(
        F.concat(F.lit("crosswalk:"), "record_id").alias("mapping_id"),
        "record_id",
        F.when(en == 1, F.col("el")).when((en == 0) & (fn == 1), F.col("fl")).alias("line_id"),
        method.alias("method"),
        F.when((en == 0) & (fn == 0), "unavailable").otherwise("review_required").alias("status"),
        F.when(en > 1, en).when((en == 0) & (fn > 1), fn).otherwise(F.lit(0)).cast("bigint").alias("candidate_count"),
        F.when(en > 1, F.col("exact_key")).when((en == 0) & (fn > 1), F.col("folded_key")).alias("candidate_key"),
    )


def crosswalk_candidates(lines: DataFrame, mappings: DataFrame) -> DataFrame:
    """(candidate_key, line_id) of the ambiguous mappings."""
    keys = mappings.filter("candidate_key IS NOT NULL").select("candidate_key", F.col("method").endswith("exact_text").alias("exact"))
    wanted = keys.distinct()
    both = lines.select(
        "line_id",
        F.inline(F.array(
            F.struct(compare_form(F.col("text")).alias("candidate_key"), F.lit(True).alias("exact")),
            F.struct(whitespace_key(F.col("text")).alias("candidate_key"), F.lit(False).alias("exact")),
        )),
    )
    return both.join(wanted, ["candidate_key", "exact"], "left_semi").select("candidate_key", "line_id")


def range_resolved(lines: DataFrame, references: DataFrame, before: int = 2, after: int = 80) -> DataFrame:
    """Provider line -> canonical line: the only line of its form, or the only one whose page lies in
    [expected - before, expected + after].

    ``references``: record_id, group_id, reference_text, expected_page.  Lines are first collapsed to
    (form, page) with a count, so copies on one page are one row; a form's page table is summed
    over the wanted window.
    """
    refs = references.select("record_id", "group_id", "expected_page", align_key(F.col("reference_text")).alias("form"))
    forms = refs.select("form").distinct()
    paged = (
        lines.select(align_key(F.col("text")).alias("form"), "page_no", "line_id", "text_unit_id")
        .join(forms, "form", "left_semi")
        .groupBy("form", "page_no")
        .agg(F.count("*").alias("n"), F.min(F.struct("line_id", "text_unit_id")).alias("only"))
    )
    totals = paged.groupBy("form").agg(F.sum("n").alias("total"), F.min("only").alias("single"))
    placed = refs.select("form", "expected_page").filter("expected_page IS NOT NULL AND expected_page <> 0").distinct()
    near = (
        placed.join(paged, "form")
        .filter(F.col("page_no").between(F.col("expected_page") - before, F.col("expected_page") + after))
        .groupBy("form", "expected_page")
        .agg(F.sum("n").alias("near"), F.min("only").alias("near_single"))
    )
    joined = refs.join(totals, "form", "left").join(near, ["form", "expected_page"], "left")
    unique, ranged = F.col("total") == 1, (F.col("total") > 1) & (F.col("near") == 1)
    chosen = F.when(unique, F.col("single")).when(ranged, F.col("near_single"))
    return joined.select(
        "record_id",
        "group_id",
        chosen["line_id"].alias("line_id"),
        chosen["text_unit_id"].alias("text_unit_id"),
        F.when(unique, "exact_unique")
        .when(ranged, "exact_by_expected_page")
        .when(F.col("total").isNotNull(), "ambiguous")
        .otherwise("unmatched")
        .alias("status"),
        F.when(unique | ranged, F.lit(0)).otherwise(F.coalesce("total", F.lit(0))).cast("bigint").alias("candidate_count"),
    )


def groups_to_units(resolved: DataFrame) -> DataFrame:
    """A provider group belongs to a unit only when all its matched lines agree on one."""
    pairs = resolved.groupBy("group_id", "text_unit_id").agg(F.count("*").alias("n"))
    agreed = pairs.groupBy("group_id").agg(
        F.count("text_unit_id").alias("units"), F.min("text_unit_id").alias("unit"), F.sum("n").alias("reference_lines")
    )
    return agreed.select(
        "group_id", "reference_lines", F.when(F.col("units") == 1, F.col("unit")).alias("text_unit_id")
    )


def map_layers(layers: DataFrame, group_units: DataFrame) -> DataFrame:
    """Every layer of a resolved group takes its unit and the mapped status."""
    return layers.drop("text_unit_id").join(group_units.select("group_id", "text_unit_id"), "group_id", "left").withColumn(
        "mapping_status",
        F.when(F.col("text_unit_id").isNotNull(), "mapped_to_canonical_text_unit").otherwise(F.col("mapping_status")),
    )


RUN_MAX = 5
BLOCK = 4096


def line_runs(
    lines: DataFrame, key: Callable[[Column], Column] = compact_key, longest: int = RUN_MAX, block: int = BLOCK
) -> DataFrame:
    """All runs of 1..longest consecutive lines of a unit, with the digests of the joined key, ``digest`` of the key itself and
    ``loose`` without sentence marks: a joined text is made and hashed inside the row, and never moved.

    A unit of up to ``block`` lines is one window, and its lines move once.  A longer one may hold a third of all rows: its
    lines are placed by ranges, and every line is sent to its block of ``block`` ordinals and, when it is among the first of
    a block, also to the block before as look-ahead.  Runs start only at a block's own lines.
    """
    order = ["page_no", "line_order", "line_id"]
    counted = lines.groupBy(F.col("text_unit_id").alias("_long")).agg(F.count("*").alias("_n"))
    long_units = cut_lineage(counted.filter(F.col("_n") > block).select("_long"), "long-units")
    is_long = F.col("text_unit_id").eqNullSafe(F.col("_long"))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.select("text_unit_id", *order, key(F.col("text")).alias("k0"))

    in_unit = W.partitionBy("text_unit_id").orderBy(*order)
    short = placed(lines.join(long_units, is_long, "left_anti")).withColumn("ordinal", (F.row_number().over(in_unit) - 1).cast("bigint"))
    ordinal = positions(placed(lines.join(long_units, is_long, "left_semi")), "text_unit_id", order)
    own = ordinal.select("*", F.floor(F.col("ordinal") / block).alias("blk"), F.lit(True).alias("own"))
    ahead = own.filter((F.col("ordinal") % block < longest - 1) & (F.col("blk") > 0)).withColumns(
        {"blk": F.col("blk") - 1, "own": F.lit(False)}
    )
    in_block = W.partitionBy("text_unit_id", "blk").orderBy("ordinal")
    blocks = _followed(own.unionByName(ahead), in_block, longest).filter("own").drop("own")
    return _runs(_followed(short.withColumn("own", F.lit(True)), in_unit, longest).drop("own"), longest).unionByName(_runs(blocks, longest))


def _followed(rows: DataFrame, w: W, longest: int) -> DataFrame:
    """Every line with the ids (i) and joined keys (j) up to each of the ``longest`` lines from it on."""
    ids = [F.col("line_id") if n == 0 else F.lead("line_id", n).over(w) for n in range(longest)]
    keys = [F.col("k0") if n == 0 else F.lead("k0", n).over(w) for n in range(longest)]
    kept = ["text_unit_id", "ordinal", "own", "line_id"]
    follow = rows.select(*kept, *[i.alias(f"i{n}") for n, i in enumerate(ids)], *[k.alias(f"s{n}") for n, k in enumerate(keys)])
    joined = [F.concat(*[F.col(f"s{m}") for m in range(n + 1)]).alias(f"j{n}") for n in range(longest)]
    return follow.select(*kept, *[f"i{n}" for n in range(longest)], *joined)


def _runs(follow: DataFrame, longest: int) -> DataFrame:
    """One row per run; a text without sentence marks is hashed once."""
    options = []
    for n in range(longest):
        joined = F.col(f"j{n}")
        marked = reduce(or_, [F.contains(joined, F.lit(mark)) for mark in SENTENCE_MARKS])
        digest = F.md5(joined)
        options.append(
            F.struct(
                F.lit(n + 1).alias("length"), digest.alias("digest"), F.when(marked, F.md5(unmarked(joined))).otherwise(digest).alias("loose"),
                F.col(f"i{n}").alias("last_line_id"),
            )
        )
    runs = follow.select("text_unit_id", F.col("line_id").alias("first_line_id"), "ordinal", F.inline(F.array(*options)))
    return runs.filter(F.col("last_line_id").isNotNull())


def within_unit(lines: DataFrame, references: DataFrame, longest: int = RUN_MAX) -> DataFrame:
    """Provider line -> one line (exact, then loose) or the single run of 2..longest lines of the unit.

    ``references``: record_id, text_unit_id, reference_text.  Returns the accepted first and last line.
    """
    refs = references.select(
        "record_id",
        "text_unit_id",
        F.md5(compact_key(F.col("reference_text"))).alias("exact"),
        F.md5(loose_key(F.col("reference_text"))).alias("loose"),
    )
    units = refs.select("text_unit_id").distinct()
    runs = line_runs(lines.join(units, "text_unit_id", "left_semi"), longest=longest)
    # one row per (unit, key, kind): how many runs, and the run when it is the only one; only keys that are asked for are grouped
    kinds = runs.select(
        "text_unit_id",
        F.inline(F.array(
            F.struct(F.col("digest").alias("key"), F.when(F.col("length") == 1, 1).otherwise(3).alias("kind")),
            F.struct(F.col("loose").alias("key"), F.when(F.col("length") == 1, 2).otherwise(4).alias("kind")),
        )),
        F.struct("first_line_id", "last_line_id", "length").alias("run"),
    ).filter("kind <> 3")
    wanted = refs.select("text_unit_id", F.explode(F.array("exact", "loose")).alias("key")).distinct()
    kinds = kinds.join(wanted, ["text_unit_id", "key"], "left_semi")
    counted = kinds.groupBy("text_unit_id", "key", "kind").agg(F.count("*").alias("n"), F.min("run").alias("run"))
    asked = refs.select(
        "record_id",
        "text_unit_id",
        F.inline(F.array(*[
            F.struct(F.col("exact" if kind in (1, 3) else "loose").alias("key"), F.lit(kind).alias("kind")) for kind in (1, 2, 3, 4)
        ])),
    )
    # a run matching exactly also matches loosely, so kind 4 alone counts the matching runs
    found = asked.filter("kind <> 3").join(counted, ["text_unit_id", "key", "kind"]).filter("n = 1")
    best = found.groupBy("record_id", "text_unit_id").agg(F.min_by("run", "kind").alias("run"), F.min("kind").alias("kind"))
    return refs.select("record_id", "text_unit_id").join(best, ["record_id", "text_unit_id"], "left").select(
        "record_id",
        "text_unit_id",
        "run.first_line_id",
        "run.last_line_id",
        F.coalesce("run.length", F.lit(0)).alias("member_count"),
        F.when(F.col("kind") == 4, "verified_exact_range_within_unit")
        .when(F.col("kind").isNotNull(), "verified_exact_within_unit")
        .otherwise("unmatched")
        .alias("status"),
    )


# Opening words of heading lines, and the citation line.
HEADING_WORDS = (
    "ੴ", "ਰਾਗੁ?", "ਮਃ", "ਮਹਲਾ", "ਸਲੋਕ", "ਸਲੋਕੁ", "ਪਉੜੀ", "ਆਸਾ", "ਤਿਲੰਗ", "ਬਿਲਾਵਲੁ", "ਸੋਰਠਿ", "ਮਾਰੂ", "ਸੂਹੀ",
    "ਰਾਮਕਲੀ", "ਵਡਹੰਸੁ", "ਸਿਰੀਰਾਗੁ",
)
CITATION = "^[-–—][\\s]*ਗੁਰੂ ਗ੍ਰੰਥ ਸਾਹਿਬ"


def is_heading(line: Column, opening: tuple[str, ...] = HEADING_WORDS) -> Column:
    return line.rlike("^(" + "|".join(opening) + ")")


def is_citation(line: Column, pattern: str = CITATION) -> Column:
    return line.rlike(pattern)


def positional(groups: DataFrame, heading: Callable[[Column], Column] = is_heading) -> DataFrame:
    """i-th translation to i-th reference line of a group; rows: group_id, line_index, reference,
    translation, scope ('line', 'passage' at the last line when counts do not fit, 'none').

    ``groups``: group_id, refs array<string>, translations array<string>.
    """
    gap = F.size("refs") - F.size("translations")
    headed = F.forall(F.slice("refs", F.lit(1), F.greatest(gap, F.lit(0))), lambda line: heading(line))
    shift = F.when(F.size("translations") == 0, F.lit(None)).when(gap == 0, 0).when(gap.between(1, 2) & headed, gap)
    prepared = groups.withColumns({"shift": shift.cast("int"), "n": F.size("refs")})
    rows = prepared.select("*", F.posexplode("refs").alias("line_index", "reference"))
    at = F.col("line_index") - F.col("shift")
    mapped = F.when(at >= 0, F.get("translations", at))
    fallback = F.col("shift").isNull() & (F.size("translations") > 0) & (F.col("line_index") == F.col("n") - 1)
    whole = F.when(fallback, F.array_join("translations", "\n"))
    text = F.coalesce(mapped, whole, F.lit(""))
    return rows.select(
        "group_id",
        "line_index",
        "reference",
        text.alias("translation"),
        F.when(fallback, "passage").when(text != "", "line").otherwise("none").alias("scope"),
    )


CROWDED = 200


def attach_terms(
    lines: DataFrame, dictionary: DataFrame, key: Callable[[Column], Column] = compact_key, crowded: int = CROWDED
) -> DataFrame:
    """Dictionary terms on the lines of their location that contain the headword.

    A headword whose key is empty stands on every line of its location.  The others are searched for:
    a location with few terms is a plain equi-join with ``contains`` as residual.  In a crowded one
    that would pair everything with everything, so there a headword first looks up its opening
    characters among the character pieces of the lines; both ways give the same rows.
    """
    keyed = dictionary.withColumn("_word", key(F.col("headword")))
    blank = keyed.filter("_word = ''").join(lines.select("line_id", "text_unit_id"), "text_unit_id")
    terms = keyed.filter("_word <> ''")
    sizes = terms.groupBy("text_unit_id").agg(F.count("*").alias("_terms"))
    text = lines.join(sizes, "text_unit_id").select("line_id", "text_unit_id", "_terms", key(F.col("text")).alias("_text"))
    few = text.filter(F.col("_terms") <= crowded).join(terms, "text_unit_id").filter(F.contains("_text", "_word"))
    busy = text.filter(F.col("_terms") > crowded)
    cut = F.flatten(F.array(*[grams(F.col("_text"), n) for n in (1, 2, 3)]))
    listed = busy.select("line_id", "text_unit_id", F.explode(F.array_distinct(cut)).alias("_gram"))
    opened = terms.withColumn("_gram", F.substring("_word", 1, 3))
    many = (
        opened.join(listed, ["text_unit_id", "_gram"])
        .join(busy.select("line_id", "_text"), "line_id")
        .filter(F.contains("_text", "_word"))
    )
    columns = ["line_id", *dictionary.columns]
    return few.select(*columns).unionByName(many.select(*columns)).unionByName(blank.select(*columns)).dropDuplicates(["term_id", "line_id"])


HEAVY = 50


def _signature(count: str) -> Column:
    """Digest of a set of (form, count)."""
    return F.struct(F.bit_xor(F.xxhash64("form", count)), F.bit_xor(F.xxhash64(count, "form")), F.count("*")).alias("sig")


def two_of_a_kind(held: DataFrame) -> DataFrame:
    """The rows of two units, those of the smallest ids, among all that agree in their forms and counts."""
    kind = held.groupBy("text_unit_id").agg(_signature("n"))
    alike = W.partitionBy("sig").orderBy("text_unit_id")
    two = kind.withColumn("r", F.row_number().over(alike)).filter("r <= 2").select("text_unit_id")
    return held.join(two, "text_unit_id", "left_semi")


def leading_units(sets: DataFrame, held: DataFrame) -> DataFrame:
    """(sig, text_unit_id, v): the unit with most votes of every set of forms, or two that share the most.

    ``sets``: sig, form, m; ``held``: form, text_unit_id, n.  Pairing every set with every unit of its forms grows as the
    square of the corpus.  Units that agree in all their forms have the same votes, so two of each kind stand for all.
    The units of a set's rarest form give a number of votes that is reached; forms that could not reach it together, the
    most frequent ones first, need not name units: one that holds no other form has fewer votes.
    """
    kept = cut_lineage(two_of_a_kind(held), "kinds-of-units")
    sizes = kept.groupBy("form").agg(F.count("*").alias("size"), F.max("n").alias("most"))
    sets = cut_lineage(
        sets.join(sizes, "form").select("sig", "form", "m", "size", (F.col("m") * F.col("most")).alias("bound")), "heavy-sets"
    )

    def tally(pairs: DataFrame) -> DataFrame:
        votes = pairs.join(kept, "text_unit_id").join(sets.select("sig", "form", "m"), ["sig", "form"])
        return votes.groupBy("sig", "text_unit_id").agg(F.sum(F.col("m") * F.col("n")).alias("v"))

    rarest = sets.groupBy("sig").agg(F.min_by("form", F.struct("size", "form")).alias("form"))
    first = tally(rarest.join(kept.select("form", "text_unit_id"), "form").select("sig", "text_unit_id"))
    sure = first.groupBy("sig").agg(F.max("v").alias("sure"))
    so_far = W.partitionBy("sig").orderBy(F.col("size").desc(), "form").rowsBetween(W.unboundedPreceding, W.currentRow)
    needed = sets.withColumn("reach", F.sum("bound").over(so_far)).join(sure, "sig").filter(F.col("reach") >= F.col("sure"))
    pairs = needed.join(kept.select("form", "text_unit_id"), "form").select("sig", "text_unit_id").distinct()
    top = W.partitionBy("sig").orderBy(F.col("v").desc(), "text_unit_id")
    two_best = tally(pairs).withColumn("r", F.row_number().over(top)).filter("r <= 2")
    return two_best.withColumn("best", F.max("v").over(W.partitionBy("sig"))).filter("v = best").select("sig", "text_unit_id", "v")


def paragraph_crosswalk(lines: DataFrame, readings: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Reading lines to canonical lines by the vote of their paragraph.

    The unit with strictly most form matches wins; a line is accepted when it is the only one of its
    form there.  Without a winner a line that is the only one of its form anywhere is accepted, with
    its own unit.  ``readings``: reading_id, line_order, paragraph, text.

    A form that occurs in many units would pair every paragraph with all of them.  Light forms
    (at most ``heavy`` units) name the candidate units.  Heavy forms only add votes to these, and for
    units reached by heavy forms alone the best per distinct set of heavy forms is enough, or two that
    share the most: any other such unit has no more votes than they have.
    """
    par = ["reading_id", "paragraph"]
    rows = cut_lineage(
        readings.select(
            "reading_id",
            "line_order",
            F.coalesce("paragraph", "line_order").alias("paragraph"),
            F.md5(loose_key(F.col("text"))).alias("form"),
        ),
        "reading-forms",
    )
    wanted = rows.select("form").distinct()
    placed = lines.select("line_id", "text_unit_id", F.md5(loose_key(F.col("text"))).alias("form"))
    form_units = cut_lineage(
        placed.join(wanted, "form", "left_semi")
        .groupBy("form", "text_unit_id")
        .agg(F.count("*").alias("n"), F.min("line_id").alias("line_id")),
        "form-units",
    )
    forms = form_units.groupBy("form").agg(
        F.count("*").alias("units"),
        F.sum("n").alias("total"),
        F.min("line_id").alias("single"),
        F.min_by("text_unit_id", "line_id").alias("single_unit"),
    )
    asked = rows.groupBy(*par, "form").agg(F.count("*").alias("m")).join(forms.select("form", "units"), "form")
    light, dense = asked.filter(F.col("units") <= heavy), cut_lineage(asked.filter(F.col("units") > heavy), "heavy-forms")
    votes = light.join(form_units, "form").groupBy(*par, "text_unit_id").agg(F.sum(F.col("m") * F.col("n")).alias("v"))
    extra = (
        dense.join(votes.select(*par, "text_unit_id"), par)
        .join(form_units.select("form", "text_unit_id", "n"), ["form", "text_unit_id"])
        .select(*par, "text_unit_id", (F.col("m") * F.col("n")).alias("v"))
    )
    reached = votes.unionByName(extra).groupBy(*par, "text_unit_id").agg(F.sum("v").alias("v"))
    signed = dense.groupBy(*par).agg(_signature("m"))
    sample = signed.groupBy("sig").agg(F.min(F.struct(*par)).alias("p")).select("sig", "p.*")
    crowded = forms.filter(F.col("units") > heavy).select("form")
    leading = leading_units(
        sample.join(dense, par).select("sig", "form", "m"),
        form_units.join(crowded, "form", "left_semi").select("form", "text_unit_id", "n"),
    )
    only_heavy = signed.join(leading, "sig").join(reached.select(*par, "text_unit_id"), [*par, "text_unit_id"], "left_anti")
    everyone = reached.unionByName(only_heavy.select(*par, "text_unit_id", "v"))
    ranked = everyone.groupBy(*par, "v").agg(F.count("*").alias("tied"), F.min("text_unit_id").alias("unit"))
    best = ranked.groupBy(*par).agg(F.max_by(F.struct("tied", "unit"), "v").alias("b")).select(
        *par, F.when(F.col("b.tied") == 1, F.col("b.unit")).alias("best_unit")
    )
    voted = rows.join(best, par, "left").join(forms.select("form", "total", "single", "single_unit"), "form", "left")
    local = form_units.select("form", F.col("text_unit_id").alias("best_unit"), "n", F.col("line_id").alias("local"))
    found = voted.join(local, ["form", "best_unit"], "left")
    line = F.when(F.col("best_unit").isNotNull(), F.when(F.col("n") == 1, F.col("local"))).otherwise(
        F.when(F.col("total") == 1, F.col("single"))
    )
    return found.select(
        "reading_id",
        "line_order",
        line.alias("line_id"),
        F.coalesce("best_unit", F.when(line.isNotNull(), F.col("single_unit"))).alias("text_unit_id"),
        F.when(line.isNotNull(), "verified_exact_within_paragraph_unit")
        .when(F.col("best_unit").isNotNull(), "unit_only")
        .otherwise("unmapped")
        .alias("status"),
    )


def last_members(members: DataFrame) -> DataFrame:
    """Marks the last member of every alignment as its anchor; a partial aggregate finds it."""
    last = members.groupBy("alignment_id").agg(F.max("member_order").alias("_last"))
    return members.join(last, "alignment_id").withColumn("is_anchor", F.col("member_order") == F.col("_last")).drop("_last")


def backfill(rows: DataFrame, updates: DataFrame, key: str, column: str, only_missing: bool = True) -> DataFrame:
    """Fills ``column`` by key; where stated, only values that are null or empty."""
    new = updates.select(key, F.nullif(F.trim(column), F.lit("")).alias("_new"))
    old = F.nullif(F.col(column), F.lit("")) if only_missing else F.lit(None).cast("string")
    joined = rows.join(new, key, "left")
    return joined.withColumn(column, F.coalesce(old, "_new", F.col(column))).drop("_new")


def form_semi_join(rows: DataFrame, selected: DataFrame, key: Callable[[Column], Column] = loose_key) -> DataFrame:
    """Only rows whose comparable text occurs in the selected readings."""
    forms = selected.select(key(F.col("text")).alias("_form")).filter("_form <> ''").distinct()
    return rows.withColumn("_form", key(F.col("text"))).join(forms, "_form", "left_semi").drop("_form")
