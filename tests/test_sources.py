import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from signalweave.operators.intake import run_report
from signalweave.params import SOURCE_TYPES
from signalweave.sources import feeds


@pytest.fixture()
def landed(tmp_path):
    def put(source, name, content):
        d = tmp_path / "in" / f"source={source}"
        d.mkdir(parents=True, exist_ok=True)
        (d / name).write_text(content if isinstance(content, str) else json.dumps(content))
        return str(tmp_path / "in")

    return put


def test_rss(spark, landed):
    path = landed("A", "a.xml", """<rss><channel><title>c</title>
<item><title> One </title><link> https://a/1 </link><description>d</description><pubDate>Mon, 02 Jun 2026 10:00:00 +0200</pubDate></item>
<item><title></title><description>no link</description><pubDate>never</pubDate></item></channel></rss>""")
    sources = spark.createDataFrame([("A", "https://a")], "name string, url string")
    got = {r.title: r for r in feeds.rss(spark, path, sources).collect()}
    assert got["One"].url == "https://a/1" and got["One"].published_at == dt.datetime(2026, 6, 2, 8) and got["One"].source_name == "A"
    assert got["(untitled)"].url == "https://a" and got["(untitled)"].published_at is None


FEEDS = {
    "v2": ("""<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:atom="http://www.w3.org/2005/Atom"><channel><title>c</title><link>https://c</link>
<atom:link href="https://c/feed" rel="self"/><item><title><![CDATA[A & <b>B</b>]]></title><link>https://a/1</link><content:encoded><![CDATA[<p>long</p>]]></content:encoded><dc:date>2026-06-02T10:00:00+02:00</dc:date></item></channel></rss>""", "utf-8"),
    "v1": ("""<?xml version="1.0" encoding="ISO-8859-1"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel rdf:about="x"><title>c</title></channel>
<item rdf:about="https://b/1"><title>Übung</title><link>https://b/1</link><description>d</description><dc:date>2026-06-02T10:00:00Z</dc:date></item></rdf:RDF>""", "iso-8859-1"),
    "v09": ("""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://my.netscape.com/rdf/simple/0.9/"><channel><title>c</title></channel><item><title>Old</title><link>https://o/1</link></item></rdf:RDF>""", "utf-8"),
    "atom": ("""<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><link href="https://f"/><entry><title type="html">One &amp; two</title><link rel="edit" href="https://e/edit"/><link rel="alternate" href="https://e/1"/><updated>2026-06-03T10:00:00Z</updated><summary>s</summary></entry>
<entry><title>Two</title><link href="https://e/2"/><published>2026-06-01T10:00:00Z</published><updated>2026-06-03T10:00:00Z</updated><content>c</content></entry></feed>""", "utf-16"),
}


def test_feeds_of_all_kinds_under_one_type(spark, tmp_path):
    for name, (text, charset) in FEEDS.items():
        d = tmp_path / f"source={name}"
        d.mkdir()
        (d / "f.xml").write_bytes(text.encode(charset))
    day = lambda d, h=10: dt.datetime(2026, 6, d, h)
    got = sorted((r.source_name, r.title, r.url, r.published_at, r.summary, r.bad) for r in feeds.READERS["rss"](spark, str(tmp_path)).collect())
    assert got == [
        ("atom", "One & two", "https://e/1", day(3), "s", False),
        ("atom", "Two", "https://e/2", day(1), "c", False),
        ("v09", "Old", "https://o/1", None, None, False),
        ("v1", "Übung", "https://b/1", day(2), "d", False),
        ("v2", "A & <b>B</b>", "https://a/1", day(2, 8), "<p>long</p>", False),
    ]


def test_broken_payloads_become_errors_with_a_message(spark, landed):
    landed("Good", "g.xml", "<rss><channel><item><title>t</title></item></channel></rss>")
    landed("Empty", "e.xml", "<rss><channel></channel></rss>")
    landed("Cut", "c.xml", "<rss><channel><item><title>t</ti")
    path = landed("Page", "p.xml", "<html><body>moved</body></html>")
    got = {r.source_name: (r.title, r.bad, r.error) for r in feeds.rss(spark, path).collect()}
    assert got["Good"] == ("t", False, None) and "Empty" not in got
    assert got["Cut"][1] and got["Cut"][2].startswith("ParseError: ") and got["Page"] == (None, True, "ValueError: the payload is no feed")


def test_arxiv(spark, landed):
    path = landed("X", "x.xml", """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Two
   lines</title><link href="https://x/pdf" rel="related"/><link href="https://x/1"/><published>2026-06-02T10:00:00Z</published><summary> s </summary></entry></feed>""")
    r = feeds.arxiv(spark, path).first()
    assert (r.title, r.url, r.published_at, r.summary) == ("Two lines", "https://x/1", dt.datetime(2026, 6, 2, 10), "s")


def test_json_payloads(spark, landed, tmp_path):
    path = landed("R", "r.json", [{"name": "", "tag_name": "v1", "html_url": "h", "published_at": "2026-06-02T10:00:00Z", "body": "b"}, {"name": None, "tag_name": None}])
    assert [r.title for r in feeds.releases(spark, path).collect()] == ["v1", "(unnamed release)"]


def test_repo_search(spark, landed):
    path = landed("S", "s.json", {"items": [{"full_name": "o/r", "html_url": "h", "created_at": None, "description": None, "stargazers_count": 7}, {"html_url": "h2"}]})
    assert [r.title for r in feeds.repo_search(spark, path, "New").collect()] == ["New: o/r", "New: (unknown repo)"]


def test_rises_of_stars(spark, landed):
    rows = [("o/up", 100), ("o/same", 50), ("o/down", 5), ("o/new", 9)]
    path = landed("Stars", "s.json", {"items": [{"full_name": n, "html_url": f"h/{n}", "description": None, "stargazers_count": k} for n, k in rows] + [{"html_url": "x"}]})
    t = dt.datetime(2026, 6, 18)
    old = spark.createDataFrame([("o/up", 70, t), ("o/up", 80, t + dt.timedelta(1)), ("o/same", 50, t), ("o/down", 9, t)], "repo_full_name string, stars long, captured_at timestamp")
    sources = spark.createDataFrame([("Stars", True, "u")], "name string, enabled boolean, url string")
    got = feeds.all_items(spark, {"github_star_velocity": path}, sources, old, F.lit("2026-06-20").cast("timestamp")).collect()
    assert [(r.title, r.url, r.summary, r.source_type) for r in got] == [("o/up gained 20 stars (now 100)", "h/o/up", "", "github_star_velocity")]
    assert feeds.all_items(spark, {"github_star_velocity": path}, sources).count() == 0
    assert set(feeds.READERS) == set(SOURCE_TYPES)


def test_advisories_and_issues(spark, landed):
    path = landed("V", "v.json", [{"ghsa_id": "G-1", "summary": "x" * 400, "description": "d", "severity": "high", "html_url": "h"}, {"cve_id": "C-1", "summary": "s", "url": "u"}])
    a, b = feeds.advisories(spark, path).collect()
    assert len(a.title) == 300 and a.summary == "[severity: high] d" and a.title.startswith("Advisory G-1: xx") and (b.title, b.summary, b.url) == ("Advisory C-1: s", "s", "u")


def test_issue_kinds(spark, landed):
    path = landed("I", "i.json", [{"title": "t", "html_url": "h", "body": "y" * 2000, "pull_request": {"url": "p"}}, {"title": "u", "html_url": "h"}])
    a, b = feeds.issues(spark, path).collect()
    assert a.title == "[PR] t" and len(a.summary) == 1000 and b.title == "[issue] u"


def test_a_bad_file_stops_no_other(spark, landed):
    landed("Good", "g.json", [{"name": "n"}])
    path = landed("Bad", "b.json", "{ not json")
    sources = spark.createDataFrame([("Good", True), ("Bad", True), ("Silent", True), ("Off", False)], "name string, enabled boolean")
    items = feeds.releases(spark, path).cache()
    got = {r.source_name: (r.item_count, r.error_count, r.ok, r.error) for r in run_report(items, sources).collect()}
    assert got == {"Good": (1, 0, True, None), "Bad": (0, 1, False, "JSONDecodeError: Expecting property name enclosed in double quotes: line 1 column 3 (char 2)"), "Silent": (0, 0, True, None)}


def test_payloads_of_a_table_are_read_as_files_are(spark, landed, tmp_path):
    texts = {"a.json": '[{"name": "é"}, {"tag_name": "v2"}]', "b.json": "[]", "c.json": "oops"}
    for name, text in texts.items():
        path = landed("S", name, text)
    wide = '[{"name": "w"}]'.encode("utf-16")
    rows = [("S", n, t.encode()) for n, t in texts.items()]
    table = feeds.landed(spark.createDataFrame(rows, "source string, path string, content binary"), f"{tmp_path}/table")
    asked = ("source_name", "title", "bad", "error")
    assert sorted(map(str, feeds.releases(spark, table).select(*asked).collect())) == sorted(map(str, feeds.releases(spark, path).select(*asked).collect()))
    more = feeds.landed(spark.createDataFrame([("007", "w", wide)], "source string, path string, content binary"), f"{tmp_path}/table")
    assert {(r.source_name, r.title) for r in feeds.releases(spark, more).where("NOT bad").collect()} == {("S", "é"), ("S", "v2"), ("007", "w")}


def test_many_small_payloads_are_few_files(spark, tmp_path):
    rows = spark.range(3000).selectExpr("concat('s', id % 20) AS source", "cast(id AS string) AS path", "cast('[]' AS binary) AS content")
    assert feeds.payloads(spark, feeds.landed(rows, f"{tmp_path}/table")).count() == 3000
    assert len(list((tmp_path / "table").glob("part-*"))) <= rows.rdd.getNumPartitions()
