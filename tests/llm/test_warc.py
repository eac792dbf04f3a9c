import base64
import gzip
import hashlib
import random
import tempfile

import pytest

from lagscope.llm import warc as W
from tests.llm.helpers import table

PAGES = "page_id bigint, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2] or "", []).append(r)
    out = []
    for text, rs in groups.items():
        rs.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
        for i, r in enumerate(rs):
            out.append((r[0], len(text.encode()), digest(text), "revisit" if i else "response", rs[0][0] if i else None))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in W.op12(df).collect()), key=repr)


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def odd(spark):
    rows = [(1, "http://a/x y?é#f", "<p>\r\n\r\n</p>"), (2, "http://a/", FAKE), (3, None, None), (4, "", ""),
            (0, "http://b", FAKE * 3 + "\n\n"), (5, "http://b", "<p>\r\n\r\n</p>"), (5, "http://b", "<p>\r\n\r\n</p>"),
            (None, None, None), (None, "http://c", "only"), (6, "javascript:void(0)\nX: y", "\n"), (7, "http://d", "\r"),
            (8, "http://d", "é😀" * 50_000), (-9, "http://d", "é😀" * 50_000), (9, "http://e", "\r\n\r\n"),
            (10, "http://e", "ends with a break\n"), (11, "http://e", "\x00\x01\x85 ")]
    return spark.createDataFrame(rows, PAGES)


def test_table_against_brute_force(spark):
    pages = table(spark, "pages")
    assert got(pages) == brute([tuple(r) for r in pages.collect()])


def test_edges(spark):
    pages = odd(spark)
    want = brute([tuple(r) for r in pages.collect()])
    assert got(pages) == want
    assert got(pages.withColumn("digest", pages.url).withColumn("record_id", pages.url)) == want
    assert got(pages.limit(0)) == []


def test_hot_payload(spark):
    rng = random.Random(2)
    rows = [(i, f"http://h{i % 7}/{i}", "same" if i % 3 else rng.choice("abc") + str(i % 50)) for i in range(1500)]
    assert got(spark.createDataFrame(rows, PAGES).repartition(8)) == brute(rows)


def test_round_trip_and_nested_rows(spark):
    """Payloads, targets and requests come back; files can be cut by hand."""
    pages, path = odd(spark), tempfile.mkdtemp(prefix="lagscope-t-") + "/w"
    W.write(pages, path)
    rows = W.captures(W.read(spark, path)).collect()
    assert len(rows) == pages.count() and all(r.n_requests == r.n_metadata == 1 for r in rows)
    by_id = {r.page_id: r for r in rows if r.page_id is not None and r.record_type == "response"}
    html = {r.page_id: r.html or "" for r in pages.collect()}
    assert by_id and all(bytes(r.response.payload).decode() == html[p] for p, r in by_id.items())
    assert by_id[1].uri == "http://a/x%20y?%C3%A9#f" and by_id[3].uri is None
    assert by_id[6].uri == "javascript:void(0)%0AX:%20y"
    lines = [x for p in spark.read.format("binaryFile").load(path + "/*.gz").collect()
             for x in gzip.decompress(p.content).split(b"\r\n")]
    assert b"Host: a" in lines and b"GET /x%20y?%C3%A9 HTTP/1.1" in lines


def test_transactions_across_files(spark):
    """Records of a capture need not be neighbours, nor in order, nor whole."""
    def record(kind, rid, block, **more):
        head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in more.items())
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{rid}>\r\n{head}content-length:  {len(block)}\r\n\r\n{block}\r\n\r\n"
    http = "HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    files = [record("warcinfo", "i", "") + record("metadata", "m1", "page-id: 1\r\n", WARC_Concurrent_To="<r1>")
             + record("revisit", "v", http, WARC_Refers_To="<r1>", Content_Type="application/http")
             + record("revisit", "lost", http, WARC_Refers_To="<gone>", WARC_Payload_Digest="sha1:ABC"),
             record("request", "q2", "GET", WARC_Concurrent_To="<r1>") + record("request", "q1", "GET", WARC_Concurrent_To="<r1>"),
             record("response", "r1", http + "body", Content_Type="application/http; msgtype=response")
             + record("metadata", "stray", "x: y", WARC_Concurrent_To="<none>")]
    path = tempfile.mkdtemp(prefix="lagscope-t-")
    for i, f in enumerate(files):
        with gzip.open(f"{path}/{i}.warc.gz", "wb") as out:
            out.write(f.encode())
    rows = {r.record_id: r for r in W.captures(W.read(spark, path)).collect()}
    assert set(rows) == {"<r1>", "<v>", "<lost>"}
    r, v, lost = rows["<r1>"], rows["<v>"], rows["<lost>"]
    assert (r.page_id, r.payload_bytes, r.payload_digest, r.n_requests, r.request.record_id) == (1, 4, digest("body"), 2, "<q1>")
    assert (v.refers_to, v.payload_bytes, v.payload_digest, v.request) == (1, 4, digest("body"), None)
    assert (lost.refers_to, lost.payload_bytes, lost.payload_digest) == (None, None, "ABC")


@pytest.mark.parametrize("bad", ["WARC/1.1\r\nContent-Length: 9\r\n\r\nab", "WARC/1.1\r\nX: y\r\n\r\n", "nonsense\r\n"])
def test_broken_archives_are_errors(spark, bad):
    path = tempfile.mkdtemp(prefix="lagscope-t-")
    with gzip.open(f"{path}/a.warc.gz", "wb") as out:
        out.write(bad.encode())
    with pytest.raises(Exception, match="ends inside a record|without Content-Length|no record begins"):
        W.read(spark, path).collect()
