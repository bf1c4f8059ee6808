"""ARC to WARC and dated URL lists on small fixtures."""

import hashlib

import pytest

from hyperloom.llm import url_lists, warc

LONG = "<p>" + "x" * 1200
PAGES = [(1, "http://a.org/1 b", LONG), (5, "http://b.org/", LONG), (3, None, LONG), (2, "http://c.org/", "short"), (4, "http://d.org/", "short"), (6, "http://e.org/", None), (None, "http://f.org/", "ü" * 700), (7, "http://g.org/", "")]


@pytest.mark.parametrize("segment", [1, 4000, 4 << 20])
def test_conversion(spark, segment):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    warcs = warc.convert_archives(warc.arc_archives(warc.revisits(pages), segment))
    rows = {r["page_id"]: r for r in warc.read_archives(warcs).collect()}
    assert len(rows) == len(PAGES)
    for ident, _, html in PAGES:
        raw = (html or "").encode()
        assert (rows[ident]["payload_bytes"], rows[ident]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {i: r["refers_to"] for i, r in rows.items() if r["record_type"] == "revisit"} == {1: 5, 3: 5}
    assert rows[2]["warc_date"] == "2000-01-01T00:02:00Z" and rows[1]["url"] == "http://a.org/1%20b" and rows[3]["url"] == "-"
    headers = [h for r in warcs.collect() for h, _ in warc.read_warc(bytes(r["data"]))]
    five = next(h["WARC-Record-ID"] for h in headers if h["X-Page-Id"] == "5")
    assert {h["WARC-Refers-To"] for h in headers if h["WARC-Type"] == "revisit"} == {five}


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.convert_archives(warc.arc_archives(warc.revisits(pages)))).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    data = warc.arc_header(version, "f", "20000101000000") + warc.arc_record(version, "f", "u", "20000102030405", b"one\n\ntwo") + warc.arc_record(version, "f", "v", "20000102030406", b"")
    assert [(f["URL"], f["Archive-date"], b) for f, b in warc.read_arc(data)] == [("u", "20000102030405", b"one\n\ntwo"), ("v", "20000102030406", b"")]
    with pytest.raises(ValueError):
        list(warc.read_arc(data[:-4].replace(b"one\n\ntwo\n", b"one")))


def test_active_entries(spark):
    events = [("a.org", 10, "add"), ("a.org", 20, "remove"), ("a.org", 30, "add"), ("x.a.org", 15, "add"), ("x.a.org", 15, "remove"), ("b.org", 5, "remove"), ("b.org", 6, "add"), ("b.org", 7, "add"), (None, 1, "add")]
    lists = url_lists.intervals(spark.createDataFrame(events, "entry string, at long, action string"))
    captures = [(k, u, t) for k, (u, t) in enumerate([("http://x.a.org/p", 9), ("http://x.a.org/p", 10), ("http://x.a.org/p", 20), ("http://A.org:80", 35), ("http://u@b.org", 6), ("http://b.org", 5), (None, 9), ("no url", 9), ("http://c.org", None)])]
    rows = url_lists.active_entries(spark.createDataFrame(captures, "page_id long, url string, fetched long"), lists).collect()
    assert {r["page_id"]: (r["n_active"], r["first_entry"]) for r in rows} == {
        0: (0, None), 1: (1, "a.org"), 2: (0, None), 3: (1, "a.org"), 4: (1, "b.org"), 5: (0, None), 6: (0, None), 7: (0, None), 8: (0, None)
    }
    assert url_lists.active_entries(spark.createDataFrame(captures, "page_id long, url string, fetched long"), lists.limit(0)).count() == 9


def test_repeated_page_ids(spark):
    rows = [(5, "a", LONG), (5, "b", LONG), (5, "b", LONG), (3, "a", LONG), (None, "a", LONG), (8, "c", LONG + "y" * 2_000_000), (9, "c", LONG + "y" * 2_000_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest long").repartition(4)
    warcs = warc.convert_archives(warc.arc_archives(warc.revisits(pages)))
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.read_archives(warcs).collect())
    assert got == [("3", "revisit", 5), ("5", "response", None), ("5", "response", None), ("5", "response", None), ("8", "revisit", 9), ("9", "response", None), ("None", "revisit", 5)]
    headers = [h for r in warcs.collect() for h, _ in warc.read_warc(bytes(r["data"]))]
    first = {h["WARC-Record-ID"] for h in headers if h["X-Page-Id"] == "5" and h["WARC-Target-URI"] == "a"}
    assert {h["WARC-Refers-To"] for h in headers if h.get("X-Refers-To-Page") == "5"} == first


def test_captures_that_repeat_long_hosts_addresses_and_clashing_columns(spark):
    deep = ".".join(["d"] * 300) + ".a.org"
    captures = [(1, "http://[::1]:8080/p", 5), (2, "http://[::1]/", 5), (3, f"http://{deep}/", 5), (4, "http://a.org/", 5), (4, "http://a.org/", 5), (None, "http://a.org/", 5)]
    frame = spark.createDataFrame([(*c, 0, 0, "z") for c in captures], "page_id long, url string, fetched long, capture long, entry long, host string").repartition(3)
    events = spark.createDataFrame([("a.org", 1, "add"), ("[::1]", 1, "add")], "entry string, at long, action string")
    lists = url_lists.intervals(events).selectExpr("*", "1 AS capture", "'q' AS host")
    got = sorted((str(r["page_id"]), r["host"][:6], r["n_active"], r["first_entry"]) for r in url_lists.active_entries(frame, lists).collect())
    assert got == [("1", "[::1]", 1, "[::1]"), ("2", "[::1]", 1, "[::1]"), ("3", "d.d.d.", 1, "a.org"), ("4", "a.org", 1, "a.org"), ("4", "a.org", 1, "a.org"), ("None", "a.org", 1, "a.org")]
    assert url_lists.active_entries(frame.limit(0), lists).count() == 0
