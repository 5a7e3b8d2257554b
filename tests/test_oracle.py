"""Every query that has SQL gives the same rows as that SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, canonical

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


# a sample over all families; tools/check.py runs every query
SAMPLE = (
    "A1_exact_frequency", "A3_ranked_forms", "A5_grouped_frequency", "W1_token_offsets", "A14_unit_summaries", "J7_any_annotation", "J12_exact_crosswalk",
    "J14_contiguous_range_match", "J17_paragraph_vote_crosswalk", "Q5_cycle_detection", "Q12_parent_before_child", "U2_keyed_merge", "W5_latest_distinct_history",
    "J24_one_omission", "J25_first_letter_search", "K8_theme_search", "S2_raw_page_scan", "N1_incremental_ingest", "N2_running_history", "X16_markup_lines",
)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toArrow().to_pandas()
    want = con.sql(entry.oracle_sql()[name]).to_arrow_table().to_pandas()
    assert canonical(got) == canonical(want)


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
