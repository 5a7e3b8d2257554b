import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from lexiloom.session import local_session

    session = local_session(cores="4", shuffle_partitions=4, app="lexiloom-tests")
    yield session
    session.stop()


LINE_SCHEMA = (
    "line_id string, upstream_id string, source_work_id string, text_unit_id string, contributor_id string, "
    "line_order int, page_no int, text string, romanised string, heading_id string, heading string"
)


@pytest.fixture(scope="session")
def golden_lines(spark):
    """The three-line fixture: 16 tokens, 13 of them lexical."""
    # Fixed values
    texts = ["ਸੁਣਿਐ ਸਿਧ ਪੀਰ ਸੁਰਿ ਨਾਥ ॥", "ਸੁਣਿਐ ਧਰਤਿ ਧਵਲ ਆਕਾਸ ॥", "ਸੁਣਿਐ ਦੀਪ ਲੋਅ ਪਾਤਾਲ ॥"]
    rows = [
        (f"line:{n}", str(n), "source:G", "unit:8", "contributor:1", n, 2, text, None, None, None)
        for n, text in enumerate(texts, 1)
    ]
    return spark.createDataFrame(rows, LINE_SCHEMA)


def make_lines(spark, rows):
    """rows: (line_id, unit, order, page, text, romanised)"""
    full = [(i, i, "source:G", u, "contributor:1", o, p, t, r, None, None) for i, u, o, p, t, r in rows]
    return spark.createDataFrame(full, LINE_SCHEMA)
