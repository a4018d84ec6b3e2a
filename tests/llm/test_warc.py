import gzip

import pytest

from tidegraph.llm import warc
from tidegraph.llm.queries import QUERIES, SQL
from tidegraph.plans.storage import new_path

PAGES = [(3, "http://a/", "same"), (1, "http://b/", "same"), (2, None, "WARC/1.1\r\nWARC-Type: x\r\n\r\nContent-Length: 3\r\n\r\n\r\n\r\n"),
         (4, "http://c/\r\nWARC-Type: evil", ""), (5, "http://d/", None), (6, "http://é/", "é日␛\r\n" * 50_000), (1, "http://b/", "same"), (None, "http://n/", "alone")]


def captures(spark, pages, **options):
    path = new_path(spark, "warc-test")
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS digest")
    warc.write_captures(df, path, **options)
    return path, warc.read_captures(spark, path)


def test_round_trip(spark):
    path, found = captures(spark, PAGES, captures_per_file=2)
    rows = found.select("request.type", "metadata.block", "response.type", warc.payload_of(found.response.block),
                        "response.payload_digest", "response.refers_to", "response.uri").toDF("q", "m", "t", "p", "d", "r", "u").collect()
    assert len(rows) == len(PAGES) and all(r.q == "request" for r in rows)
    got = sorted((bytes(r.m).decode(), r.t, None if r.t == "revisit" else bytes(r.p).decode(), r.d, r.r) for r in rows)
    want = []
    for page, _, html in PAGES:
        payload = html or ""
        first = {"same": 1, "": 4}.get(payload, page)
        revisit = page is not None and first != page
        want.append((f"pageId: {'' if page is None else page}\r\npayloadLength: {len(payload.encode())}\r\n", "revisit" if revisit else "response",
                     None if revisit else payload, "sha1:" + warc.sha1_base32(payload.encode()), f"<urn:page:{first}>" if revisit else None))
    assert got == sorted(want, key=str) or sorted(got, key=str) == sorted(want, key=str)
    assert "http://c/ WARC-Type: evil" in {r.u for r in rows}


def test_small_payloads_are_not_revisits(spark):
    _, found = captures(spark, [(1, "u", "same"), (2, "u", "same")], least_bytes=5)
    assert [r.t for r in found.select("response.type").toDF("t").collect()] == ["response"] * 2


def test_no_pages(spark):
    _, found = captures(spark, [])
    assert found.count() == 0


@pytest.mark.parametrize("pack", [bytes, gzip.compress, lambda d: b"".join(gzip.compress(p) for p in (d[:50], d[50:]))])
def test_reader(pack):
    record = lambda kind, block: f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    blocks = [b"a" * 3_000_000, b"", b"\r\n\r\nWARC/1.0\r\n", bytes(range(256))]
    data = b"".join(record(str(i), b) for i, b in enumerate(blocks))
    assert [(h["warc-type"], b) for h, b in warc.records(pack(data))] == [(str(i), b) for i, b in enumerate(blocks)]
    with pytest.raises(ValueError):
        list(warc.records(pack(data[:-300])))


def test_incomplete_captures(spark):
    _, found = captures(spark, PAGES[:2])
    path = new_path(spark, "warc-test")
    rows = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    warc.write_captures(rows, path)
    only = warc.assemble(warc.read_records(spark, path).filter("type = 'response'")).collect()
    assert len(only) == 1 and only[0].request is None and only[0].metadata is None and only[0].response is not None
    assert found.count() == 2


def test_query(spark, sf):
    from oracle_check import connect, difference
    assert difference(QUERIES["op8_warc"](spark, sf).toPandas(), connect(sf).sql(SQL["op8_warc"]).df()) is None
