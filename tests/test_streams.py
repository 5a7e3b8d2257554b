"""Positions in hot groups, and pages that are landed more than once."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators.ordering import positions
from lexiloom.sources.snapshots import checksum_verdicts, file_digests, require_checksums
from lexiloom.streaming.ingest import ingest


def test_positions_equal_brute_force(spark):
    rng = random.Random(3)
    groups = ["hot"] * 400 + ["a", "b", None, "c"] * 10
    rows = [(n, g, rng.choice([None, 1, 2, 3]), rng.random()) for n, g in enumerate(groups)]
    table = spark.createDataFrame(rows, "id int, g string, page int, place double")
    got = positions(table, "g", ["page", "place", "id"]).collect()
    want = {}
    for group in set(groups):
        own = sorted((r for r in rows if r[1] == group), key=lambda r: (r[2] is not None, r[2] or 0, r[3], r[0]))
        want.update({r[0]: n for n, r in enumerate(own)})
    assert {r.id: r.ordinal for r in got} == want and len(got) == len(rows)
    assert positions(table.filter("false"), "g", ["id"]).collect() == []


def test_repeated_rows_have_positions_of_their_own(spark):
    table = spark.createDataFrame([("g", 1)] * 50, "g string, v int")
    assert sorted(r.ordinal for r in positions(table, "g", ["v"]).collect()) == list(range(50))


def page(number, *texts, source="G"):
    verses = [{"verseId": number * 100 + n, "shabadId": number, "pageNo": str(number), "lineNo": str(n), "verse": {"unicode": t}} for n, t in enumerate(texts)]
    return json.dumps({"source": {"sourceId": source, "pageNo": number}, "count": len(texts), "page": verses})


def test_pages_are_taken_once(spark, tmp_path):
    landed, target, state = tmp_path / "landed", tmp_path / "target", tmp_path / "state"
    landed.mkdir()
    run = lambda: ingest(spark, str(landed), str(target), str(state))
    read = lambda part: sorted((r.line_id, r.text) for r in spark.read.parquet(f"{target}/{part}").collect())

    # two copies in one batch: that of the smaller file is taken, its lines and its gaps
    (landed / "b.json").write_text(page(1, "second", "copy") + "\n" + page(2, "two"))
    (landed / "a.json").write_text(page(1, "first", ""))
    run()
    assert read("lines") == [("line:100", "first"), ("line:200", "two")] and read("gaps") == [("line:101", "")]

    # a late copy in a later batch is none, a new page is one; nothing landed, nothing done
    (landed / "0.json").write_text(page(1, "late") + "\n" + page(3, "three") + "\n" + page(3, "three") + "\n" + page(1, "other", source="A"))
    run()
    run()
    # the page of another source has the same verse number
    assert read("lines") == [("line:100", "first"), ("line:100", "other"), ("line:200", "two"), ("line:300", "three")]

    # a batch whose commit was lost runs again over the same files and overwrites its folders
    last = max((state / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    held = last.read_bytes()
    last.unlink()
    (state / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert last.read_bytes()[:2] == held[:2]
    assert read("lines") == [("line:100", "first"), ("line:100", "other"), ("line:200", "two"), ("line:300", "three")]


def test_page_without_a_number_is_known_by_its_file(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    for name in ("x", "y"):
        body = json.loads(page(7, name))
        body["source"] = None
        (landed / f"{name}.json").write_text(json.dumps(body))
    ingest(spark, str(landed), str(tmp_path / "t"), str(tmp_path / "s"))
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "t" / "lines")).collect()) == ["x", "y"]


def test_checksum_verdicts_and_gate(spark, tmp_path):
    for name, body in (("a.txt", b"one"), ("b.txt", b"two"), ("c.txt", b"three"), ("d.txt", b"four"), ("empty.txt", b"")):
        (tmp_path / name).write_bytes(body)
    digests = file_digests(spark, str(tmp_path), "*.txt")
    sha = lambda body: hashlib.sha256(body).hexdigest()
    rows = [("a.txt", sha(b"one")), ("b.txt", sha(b"two")), ("empty.txt", sha(b"")), ("c.txt", sha(b"old")), ("d.txt", None), ("gone.txt", sha(b""))]
    manifest = spark.createDataFrame(rows, "file string, sha256 string")
    verdicts = checksum_verdicts(digests, manifest.filter("file <> 'b.txt'"))
    assert {r.file: r.verdict for r in verdicts.collect()} == {
        "a.txt": "verified", "b.txt": "unknown", "c.txt": "changed", "d.txt": "changed", "empty.txt": "missing", "gone.txt": "missing"
    }
    with pytest.raises(ValueError, match="changed: 2 files, first c.txt; missing: 2 files, first empty.txt; unknown: 1 files"):
        require_checksums(verdicts)
    require_checksums(checksum_verdicts(digests, digests))


def test_digest_of_a_large_file_is_taken_in_pieces(spark, tmp_path):
    """Read in several splits; line feeds at either end, none, a byte-order mark, bytes that are no text."""
    noise = bytes(range(256)) * 3000
    bodies = [b"\n" + noise, noise + b"\n", noise + b"\n\n", b"\xef\xbb\xbf" + noise, b"\xef\xbb\xbf" + noise + b"\n", b"x" * 5000, b"\r\n" * 5000, b"small"]
    for n, body in enumerate(bodies):
        (tmp_path / f"{n}.bin").write_bytes(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = {r.file: (r.length, r.sha256) for r in file_digests(spark, str(tmp_path), "*.bin", whole=1000).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"{n}.bin": (len(body), hashlib.sha256(body).hexdigest()) for n, body in enumerate(bodies)}


def test_landed_files_are_bounded(spark, tmp_path, monkeypatch):
    """Their number grows with the documents, and a page's text is not moved four times."""
    import glob

    from lexiloom.plans.catalog import sources

    monkeypatch.setattr(sources, "LANDED_PAGES", 5)
    text = "a line of text\n" * 50
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    path = sources.page_snapshots(spark, str(tmp_path))
    files = glob.glob(f"{path.removeprefix('file:')}/part-*")
    assert len(files) >= 40
    assert sum(len(open(f, "rb").read()) for f in files) < 200 * len(text)
