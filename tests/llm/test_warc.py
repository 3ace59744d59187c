"""WARC archives: exact round trip, revisits, and payloads in several chunks."""

import base64
import hashlib

import pytest

from tracewright.llm import warc

BIG = "é0123456789" * 40_000


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture
def pages(spark):
    rows = [(4, "http://a/4", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (9, None, None), (1, "http://a/1\r\nX: y", ""), (7, "http://ü/", BIG),
            (8, "u", BIG), (None, "n", "only null"), (None, "n", "<p>x</p>"), (5, "u", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"), (6, "u", "<p>x</p> ")]
    return spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id bigint, url string, html string, archive string, chunk int").repartition(3)


@pytest.mark.parametrize("size", [1 << 20, 1000])
def test_round_trip(pages, monkeypatch, size):
    monkeypatch.setattr(warc, "CHUNK", size)
    monkeypatch.setattr(warc, "_READ", 777)
    rows = warc.read_archives(warc.write_archives(pages)).collect()
    got, chunks = {}, {}
    for r in sorted(rows, key=lambda r: (r.archive, r.record, r.chunk)):
        key = r.archive, r.record
        chunks[key] = chunks.get(key, b"") + bytes(r.data)
        assert r.bytes == len(chunks[key]) and len(r.data) <= size
        if r.last:
            assert key not in got
            got[key] = r
    out = sorted((str(r.page), r.type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got.values())
    n = lambda t: len((t or "").encode())
    x, big, odd = "<p>x</p>", BIG, "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"
    assert out == sorted([
        ("2", "response", None, n(x), sha(x)), ("2", "response", None, n(x), sha(x)), ("4", "revisit", "2", n(x), sha(x)), ("null", "revisit", "2", n(x), sha(x)),
        ("1", "response", None, 0, sha("")), ("9", "revisit", "1", 0, sha("")), ("7", "response", None, n(big), sha(big)), ("8", "revisit", "7", n(big), sha(big)),
        ("null", "response", None, 9, sha("only null")), ("5", "response", None, n(odd), sha(odd)), ("6", "response", None, n(x) + 1, sha(x + " "))])
    for key, r in got.items():
        if r.type == "response":
            assert len(chunks[key]) == r.payload_bytes and base64.b32encode(hashlib.sha1(chunks[key]).digest()).decode() == r.payload_digest
            assert (max(x.chunk for x in rows if (x.archive, x.record) == key) + 1) == max(1, -(-r.payload_bytes // size))


def test_least_length(pages):
    rows = warc.read_archives(warc.write_archives(pages, least=9), ["page", "type", "payload_bytes"]).collect()
    kinds = {(r.page, r.type) for r in rows if r.payload_bytes < 9}
    assert kinds == {(p, "response") for p in ("4", "2", "null", "9", "1")} and ("8", "revisit") in {(r.page, r.type) for r in rows}


def test_empty_table(pages):
    archives = warc.write_archives(pages.limit(0))
    assert archives.count() == 0 and warc.read_archives(archives).count() == 0
