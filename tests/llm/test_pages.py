"""WARC round trip and main text of pages."""

import gzip
import hashlib
from collections import Counter

import pyarrow as pa
import pytest

from wardenframe.llm import html_text, warc
from wardenframe.llm.common import fresh_path

SCHEMA = "page_id long, url string, html string, text string, record_type string, size int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "other", "other", 1) for r in rows], SCHEMA)


ROWS = [
    (1, "http://a/1", "<p>" + "x" * 2000 + "</p>"), (2, "http://a/2", "<p>" + "x" * 2000 + "</p>"), (3, "http://b/\r\n3", "<p>" + "x" * 2000 + "</p>"),
    (4, None, None), (5, "http://c", ""), (6, "u", "é" * 600), (7, "u", "é" * 600), (8, "u", "short"), (9, "u", "short"), (10, "u", "z" * 3_000_000), (3, "again", "<p>" + "x" * 2000 + "</p>"),
]


def test_round_trip(spark):
    path = fresh_path(spark, "test-warc")
    warc.write_archives(warc.archive_records(pages(spark, ROWS)), path)
    found = warc.read_archives(spark, path).collect()
    assert Counter((r.record_id, r.record_type, r.refers_to) for r in found) == Counter({
        ("<urn:page:1>", "revisit", "<urn:page:3>"): 1, ("<urn:page:2>", "revisit", "<urn:page:3>"): 1, ("<urn:page:3>", "response", None): 2,
        ("<urn:page:4>", "response", None): 1, ("<urn:page:5>", "response", None): 1, ("<urn:page:6>", "revisit", "<urn:page:7>"): 1, ("<urn:page:7>", "response", None): 1,
        ("<urn:page:8>", "response", None): 1, ("<urn:page:9>", "response", None): 1, ("<urn:page:10>", "response", None): 1,
    })
    bodies = {r[0]: (r[2] or "").encode() for r in ROWS}
    for r in found:
        body = bodies[int(r.record_id[10:-1])]
        assert r.payload_digest == "sha1:" + hashlib.sha1(body).hexdigest() and int(r.payload_bytes) == len(body)
        assert bytes(r.payload) == (body if r.record_type == "response" else b"")


def test_pushed_filters_skip_payloads(spark):
    path = fresh_path(spark, "test-warc")
    warc.write_archives(warc.archive_records(pages(spark, ROWS)), path)
    frame = warc.read_archives(spark, path)
    assert frame.filter("record_type = 'revisit' AND refers_to = '<urn:page:3>'").count() == 2
    assert frame.filter("record_type IN ('response', 'other') AND target_uri IS NOT NULL").count() == 7
    assert {r.payload for r in warc.read_archives(spark, path, payloads=False).collect()} == {None}
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("target_uri",), "a")]))
    assert len(left) == 1 and reader.wanted({"warc-type": "revisit"}) and not reader.wanted({"warc-type": "response"})


def test_skipped_records_are_not_decompressed(monkeypatch):
    plain = [warc.record_bytes({"WARC-Type": kind}, bytes(range(256)) * 400) for kind in ("response", "revisit", "response")]
    archive = b"".join(map(warc.gzip_member, plain))
    assert gzip.decompress(archive) == b"".join(plain)
    longest = []
    grown = warc._Packed.fill
    monkeypatch.setattr(warc._Packed, "fill", lambda self, count: (grown(self, count), longest.append(len(self.buffer)))[0])
    found = list(warc.read_records(pa.BufferReader(archive), lambda h: h["warc-type"] == "revisit", payloads=False))
    assert [h["warc-type"] for h, _ in found] == ["revisit"]


@pytest.mark.parametrize("pack", [lambda r: r, gzip.compress])
def test_foreign_archives(pack):
    """Plain archives, and members without their length."""
    records = [warc.record_bytes({"WARC-Type": "response", "WARC-Record-ID": str(k)}, b"p" * size) for k, size in enumerate((0, 10, 100_000))]
    found = list(warc.read_records(pa.BufferReader(b"".join(map(pack, records))), lambda h: h["warc-record-id"] != "1"))
    assert [(h["warc-record-id"], len(p)) for h, p in found] == [("0", 0), ("2", 100_000)]


def _compressed(data):
    import gzip

    return gzip.compress(data)


def _records(count=5, size=40_000):
    return [warc.record_bytes({"WARC-Type": "response" if k % 2 else "metadata", "WARC-Record-ID": str(k)}, bytes([k]) * (size * (k % 3) + k)) for k in range(count)]


@pytest.mark.parametrize("shape", ["plain", "whole", "pairs", "split", "padded"])
def test_members_need_not_be_records(shape):
    records = _records()
    joined = b"".join(records)
    archive = {
        "plain": lambda: joined, "whole": lambda: _compressed(joined), "pairs": lambda: b"".join(_compressed(b"".join(records[k:k + 2])) for k in range(0, 5, 2)),
        "split": lambda: b"".join(_compressed(joined[k:k + 30_000]) for k in range(0, len(joined), 30_000)), "padded": lambda: warc.gzip_member(b"".join(records[:2])) + b"".join(map(warc.gzip_member, records[2:])),
    }[shape]()
    for payloads in (True, False):
        for wanted in (lambda h: True, lambda h: h["warc-type"] == "response", lambda h: False):
            found = list(warc.read_records(pa.BufferReader(archive), wanted, payloads))
            want = [(str(k), bytes([k]) * (40_000 * (k % 3) + k) if payloads else None) for k in range(5) if wanted({"warc-type": "response" if k % 2 else "metadata"})]
            assert [(h["warc-record-id"], p) for h, p in found] == want


@pytest.mark.parametrize("pack", [lambda x: x, _compressed, warc.gzip_member])
@pytest.mark.parametrize("payloads", [True, False])
def test_truncated_archives_raise(pack, payloads):
    records = [pack(r) for r in _records(3)]
    whole = b"".join(records)
    for cut in (len(whole) - 30_000 if pack(b"") == b"" else len(whole) - 20, len(records[0]) + 10, len(whole) - len(records[2]) + 40):
        with pytest.raises(ValueError, match="archive ends inside"):
            list(warc.read_records(pa.BufferReader(whole[:cut]), lambda h: True, payloads))


def test_odd_headers():
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a/\r\n  b c\r\n\td\r\nno colon\r\ncontent-length:  3 \r\n\r\nabc\r\n\r\n"
    (headers, payload), = warc.read_records(pa.BufferReader(record), lambda h: True)
    assert headers["warc-target-uri"] == "http://a/ b c d" and payload == b"abc"
    with pytest.raises(ValueError, match="does not tell its length"):
        list(warc.read_records(pa.BufferReader(b"WARC/1.0\r\nWARC-Type: response\r\n\r\nabc\r\n\r\n"), lambda h: True))
    assert list(warc.read_records(pa.BufferReader(b""), lambda h: True)) == [] == list(warc.read_records(pa.BufferReader(b"\r\n\r\n"), lambda h: True))
    assert warc.http_body(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody") == b"body" and warc.http_body(b"no message\r\n\r\nx") == b"no message\r\n\r\nx"


def test_records_have_a_date_and_revisits_a_profile(spark):
    records = warc.archive_records(pages(spark, ROWS), date="2024-01-31T12:00:00Z").collect()
    assert {r.record_date for r in records} == {"2024-01-31T12:00:00Z"}
    assert all((r.profile == warc.SAME_PAYLOAD) == (r.record_type == "revisit") for r in records)


def test_archives_of_nothing(spark):
    path = fresh_path(spark, "test-warc")
    warc.write_archives(warc.archive_records(pages(spark, [])), path)
    assert warc.read_archives(spark, path).collect() == []


def text_of(source):
    blocks = html_text.page_blocks(source)
    taken = html_text.article_tree().predict(html_text.block_features(blocks))
    return "\n\n".join(b.text for b, yes in zip(blocks, taken) if yes)


PROSE = "the tide came in before anyone had counted the boats that were still out on the water that night"


@pytest.mark.parametrize("source,expected", [
    (f"<nav><a href=x>Home</a></nav><article><h1>T&eacute;l &amp; co</h1><p>{PROSE}<p>In.</p></article><footer>&copy; us</footer>", f"Tél & co\n\n{PROSE}\n\nIn."),
    (f"<article><p>a<b>b</b>\n c<br>d</p><script>var t='</p>';</script><style>p{{}}</style><!-- <p>no</p> --><div class=ad>Buy</div><p>{PROSE}", f"ab c d\n\n{PROSE}"),
    (f"<header><p>{PROSE}</p></header><main><p>Yes.</p></main><aside>{PROSE}</aside>", "Yes."),
    (f"<article><p>{PROSE}</p><section class='comments'><p>{PROSE}</p></section><form><p>{PROSE}</p></form></article>", PROSE),
    (f"<div class='page has-sidebar'><article><p>x &lt;b&gt; y</p></article><div class=sidebar><p>{PROSE}</p></div></div>", "x <b> y"),
    ("<html><head><title>no</title><body><article><table><tr><td>one<td>two</table></article>", "one\n\ntwo"),
    ("", ""),
])
def test_main_text(source, expected):
    assert text_of(source) == expected


@pytest.mark.parametrize("source,expected", [
    (f"<html><head><title>no</title><article><p>{PROSE}</p></article>", [PROSE]),
    (f"<head><meta charset=utf-8><script>var a = '<body>';</script><link rel=x><p>{PROSE}", [PROSE]),
    (f"<body><div><p>one <button>Share</div><article><p>{PROSE}</p></article></body>", ["one", PROSE]),
    (f"<body><button>Share<article><p>{PROSE}</p></article></body>", [PROSE]),
    (f"<p>one <svg><path d=1><p>{PROSE}</p>", ["one", PROSE]),
    (f"<div><select><option>no</div><object data=x><p>{PROSE}</p><iframe src=x></iframe><p>two</p>", [PROSE, "two"]),
    (f"<p>one <span><noscript>no</span> two</p><p>{PROSE}</p>", ["one two", PROSE]),
    (f"<p>one <noscript><p>no</p></noscript> two <object><object>no</object>no</object></p><p>{PROSE}", ["one two", PROSE]),
    (f"<p>{PROSE}</p><script>var t = '<p>no</p>';", [PROSE]),
    ("<article><p>so <math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></semantics></math> holds</p></article>", ["so x=1 holds"]),
])
def test_optional_and_missing_end_tags(source, expected):
    assert [b.text for b in html_text.page_blocks(source)] == expected


def test_extraction_rows(spark):
    rows = [(1, "u", f"<article><p>{PROSE}</p></article>"), (2, None, None), (3, "v", ""), (1, "u", f"<article><p>{PROSE}</p></article>"), (4, "w", "<article><p>" + "long " * 200_000 + "</p></article>"), (None, "x", "<article>no key</article>")]
    found = html_text.extract_text(pages(spark, rows), keep=("url",)).collect()
    assert Counter((r.page_id, r.url, len(r.text)) for r in found) == Counter([(1, "u", len(PROSE))] * 2 + [(2, None, 0), (3, "v", 0), (4, "w", 999_999), (None, "x", 6)])
    assert html_text.extract_text(pages(spark, [])).collect() == []


def test_deep_pages_take_no_longer():
    import time

    began = time.time()
    blocks = html_text.page_blocks("<article>" + "<div>x" * 100_000 + "</p>" * 1000 + "</article>tail")
    assert len(blocks) == 100_001 and blocks[0].in_article and blocks[99_999].in_article and not blocks[-1].in_article
    assert time.time() - began < 5


def test_tree_learns_its_table():
    for page in html_text.labelled_pages():
        blocks = html_text.page_blocks(page)
        assert (html_text.article_tree().predict(html_text.block_features(blocks)) == [b.marked for b in blocks]).all()


