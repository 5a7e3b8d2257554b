import hashlib
import json
import time

import pytest

from lexiloom.llm import warc
from lexiloom.llm.blocks import leaves
from lexiloom.llm.extraction import composed, extract, fit, main_texts

PAGE = (
    "<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>One</a></li>"
    "<li><a href='b?x=1&amp;y=2'>Two</a></li></ul></nav><!-- <p>gone</p> --><div class='ad'>Buy now.</div><article><h1>Head&nbsp;line</h1><p><b>First  part<br>goes on &lt;here&gt;."
    "<br><p>Second &#8212; one.</p><div class='share'><a href='#'>Share</a></div><p>Third is last."
    "</article><section class='comments'><p>I think so too.</p></section><footer>&copy; all</footer>"
)
MAIN = "Head line\nFirst part goes on <here>.\nSecond — one.\nThird is last."


def make_pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "'y' as block")


@pytest.fixture(scope="module")
def model(spark):
    return fit(make_pages(spark, [(i, "http://e/", PAGE.replace("First", f"Word{i} and more. It is said")) for i in range(30)]))


def test_leaves_tolerate_broken_markup():
    found = [(leaf.path[-1][0], leaf.text) for leaf in leaves(PAGE)]
    assert found[0] == ("title", "T & t") and ("li", "Two") in found and ("p", "First part goes on <here>.") in found
    assert [leaf.text for leaf in leaves("plain < text <b>bold</b>")] == ["plain < text bold"]
    assert leaves("") == [] == leaves("<p><script>x")


def test_reading_time_is_linear_in_broken_pages():
    n = 1 << 20
    for unit in ("<a ", '<a "', "<a '\"", "<p class=\"x' ", "<script", "<!--", "<title ", "<html lang", "<a href=", "<", "<a<", "<a b='>\" "):
        page = unit * (n // len(unit))
        start = time.process_time()
        leaves(page)
        warc._facts(page, "http://e/")
        assert time.process_time() - start < 10, unit


def test_quoted_and_unpaired_signs():
    assert [leaf.text for leaf in leaves("<p title='a > b'>one</p><p class=\"x<y\">two</p>")] == ["one", "two"]
    assert [leaf.text for leaf in leaves("<p>it <b class=it's>is</b> so</p>")] == ["it is so"]


def test_groups_of_pages_are_bounded_by_their_longest(model, monkeypatch):
    sizes, forward = [], model.forward
    monkeypatch.setattr(type(model), "forward", lambda self, *padded: sizes.append(padded[0].shape[:2]) or forward(*padded))
    pages = [leaves("<p>word</p>" * 12)] * 100 + [leaves("<p>word</p>" * 3000)]
    main_texts(model, pages)
    assert max(a * b for a, b in sizes) <= 4096


def test_links_of_elements_outside_comments_and_scripts():
    page = "<html lang='de'><!-- <a href='/no'> --><script src=s.js>'<a href=/no2>'</script><form action='/f'><map><area href=/ar></map><video poster=p.png src='v.mp4'><source src=w.mp4></video>"
    title, language, links = warc._facts(page, "http://e/")
    assert (title, language) == (None, "de")
    assert [(x["tag"], x["url"]) for x in links] == [("script", "http://e/s.js"), ("form", "http://e/f"), ("area", "http://e/ar"), ("video", "http://e/p.png"), ("video", "http://e/v.mp4"), ("source", "http://e/w.mp4")]


def test_main_text(spark, model):
    rows = [(1, "http://e/1", PAGE), (1, "http://e/1", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<nav>x</nav>")]
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in extract(make_pages(spark, rows), model).toArrow().to_pylist())
    assert got[:2] == [("1", MAIN, len(MAIN))] * 2 and got[2:4] == [("2", "", 0), ("3", "", 0)] and got[4][0] == "None"
    assert extract(make_pages(spark, []), model).count() == 0


def test_held_out_layouts(model):
    import numpy as np

    rng, wrong, total = np.random.default_rng(5), 0, 0
    for _ in range(60):
        page, labels = composed(["Some words stand here.", "Others follow them.", "And more"], rng)
        wanted = "\n".join(leaf.text for leaf, y in zip(page, labels, strict=True) if y)
        wrong, total = wrong + (main_texts(model, [page])[0] != wanted), total + 1
    assert wrong / total < 0.2


def test_warc_records(spark):
    source = warc.responses(make_pages(spark, [(1, "http://e.org/d/p", PAGE), (1, "http://e.org/d/p", PAGE), (2, None, None)]))
    rows = warc.derive(source).toArrow().to_pylist()
    assert len(rows) == 6
    sources = {r["source_id"]: r for r in source.toArrow().to_pylist()}
    for r in rows:
        origin, raw = sources[r["source_id"]], r["block"].encode()
        assert r["refers_to"] == origin["record_id"] and r["warc_date"] == origin["warc_date"] and r["source_payload_digest"] == origin["payload_digest"]
        assert r["content_length"] == len(raw) and r["block_digest"] == "sha256:" + hashlib.sha256(raw).hexdigest()
        assert any(o["record_id"] == r["concurrent_to"] and o["warc_type"] != r["warc_type"] for o in rows)
    facts = json.loads(next(r["block"] for r in rows if r["source_id"] == "1" and r["warc_type"] == "metadata"))
    assert facts["title"] == "T & t" and {"tag": "a", "url": "http://e.org/d/b?x=1&y=2"} in facts["links"] and ["Content-Type", "text/html; charset=UTF-8"] in facts["headers"]
    assert sources["1"]["payload_digest"] == "sha256:" + hashlib.sha256(PAGE.encode()).hexdigest()
    data = b"".join(map(warc.serialized, rows))
    assert [(f["WARC-Record-ID"], b.decode()) for f, b in warc.parsed(data)] == [(r["record_id"], r["block"]) for r in rows]
    for (fields, _), r in zip(warc.parsed(data), rows, strict=True):
        assert (fields["WARC-Source-Block-Digest"], fields["WARC-Source-Payload-Digest"]) == (r["source_block_digest"], r["source_payload_digest"])
        assert json.loads(fields["WARC-Source-Headers"]) == r["source_headers"]


def test_http_heads():
    block = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nTransfer-Encoding: chunked\r\n\r\n".encode() + b"3\r\na\xe9b\r\n1\r\nc\r\n0\r\n\r\n"
    status, fields, body = warc.split_http(block)
    assert status == "HTTP/1.1 200 OK" and warc.decoded(fields, body) == ("aébc", "latin-1")
    assert warc.split_http(b"no head") == ("", [], b"no head")
    assert warc.decoded([("Content-Type", "text/html; charset=nonsense")], b"x")[1] == "utf-8"
