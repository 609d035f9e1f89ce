import hashlib

import netweir.llm.warc_index as wi
from netweir.session import work_dir

LONG = "<p>" + "ä" * 80 + "</p>"
PAGES = [
    (1, "http://A.example.net/x?q=1#top", LONG), (2, "https://b.example.net:8080/y", LONG), (3, "http://a.example.net/x?q=1", LONG), (4, None, None), (5, "", ""), (6, "not a url\n", "short"),
    (7, "http://a.example.net/z", "short"), (8, "http://[bad", LONG + "1"), (8, "http://[bad", LONG + "1"), (None, "http://c.net/", LONG), (9, "http://c.net/ a", "x" * 300_000),
]


def expected(rows):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [p for p, _, g in rows if (g or "").encode() == data and p is not None]
        first = min(same) if len(data) >= 100 and i is not None and min(same) < i else None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if first is None else "revisit", first))
    return sorted(out, key=str)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(wi, "LINES", 2)
    df = spark.createDataFrame([(*r, "x", 1) for r in PAGES], "page_id long, url string, html string, key string, first int")
    got = wi.write_and_read(df).collect()
    # Rows that repeat share a key and are found once for each of them.
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(PAGES)


def test_look_up_reads_payloads(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = work_dir(spark, "warc")
    directory = wi.write_index(wi.write_archives(df, folder), folder)
    keys = spark.createDataFrame([(wi.surt("http://a.example.net/x?q=1"),), ("net,none)/",)], "key string")
    found = wi.look_up(keys, directory, folder)
    got = {r.page_id: (r.record_type, r.payload) for r in wi.read_records(found, folder).collect()}
    assert got == {1: ("response", bytearray(LONG.encode())), 3: ("revisit", None)}


def test_keys():
    assert wi.surt("HTTP://www.Example.net:80/a/b?c=d#e") == "net,example,www)/a/b?c=d"
    assert wi.surt(None) == ")/"


def test_empty(spark):
    assert wi.write_and_read(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
