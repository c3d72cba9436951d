"""Feeds: kinds of XML, namespaces, payloads that aren't well-formed, warnings."""

import pytest

from storyline.sources import feeds

CONTENT = """<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:media="m"><channel><title>T</title>
<item><title>A &amp; B</title><guid>https://e.org/guid</guid><content:encoded><![CDATA[<p>The whole text</p>]]></content:encoded><dc:date>Mon, 01 Jan 2024 10:00:00 GMT</dc:date><media:content url="x"/></item>
<item><title>C</title><guid isPermaLink="false">tag:1</guid><description>D</description></item>
<item><title>E</title><link>https://e.org/e</link><description>short</description><content:encoded>long</content:encoded><source url="u">Daily Paper</source></item></channel></rss>"""
RDF = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel rdf:about="c"><title>T</title></channel>
<item rdf:about="1"><title>One</title><link>https://e.org/1</link><description>d</description><dc:date>Tue, 02 Jan 2024 08:00:00 GMT</dc:date></item><item rdf:about="2"><title>Two</title><link>https://e.org/2</link></item></rdf:RDF>"""
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><title>T</title><entry><title type="html">X</title><link rel="self" href="https://e.org/self"/><link rel="alternate" href="https://e.org/x"/><content type="html">&lt;b&gt;body&lt;/b&gt;</content><updated>Tue, 02 Jan 2024 08:00:00 GMT</updated></entry></feed>'
CUT = '<rss xmlns:content="c"><channel><item><title>Whole</title><link>https://e.org/w</link><content:encoded>t</content:encoded></item><item><title>A & B</title><link>https://e.org/amp</link></item><item><title>Cu'


@pytest.fixture()
def bronze(spark):
    rows = [("content", CONTENT, 200, None), ("rdf", RDF, 200, None), ("atom", ATOM, 200, None), ("cut", CUT, 200, None), ("start", "<rss><chan", 200, None), ("html", "<p>no<br>", 200, None), ("nothing", "", 200, None), ("null", None, 503, None), ("error", None, None, "timed out"), ("bare", "<rss><channel/></rss>", 200, None)]
    return spark.createDataFrame(rows, "feed_id string, payload string, status int, error string")


def dim(spark, bronze):
    return feeds.catalogue(spark, [(r["feed_id"], r["feed_id"], "big", "https://e.org/rss", "media", 80, "eu", "en", True, "media") for r in bronze.collect()])


def test_items_of_all_kinds(spark, bronze):
    found = {}
    for r in feeds.parsed(bronze).orderBy("pos").collect():
        found.setdefault(r["feed_id"], []).append((r["title"], r["link"], r["summary"], str(r["published_at"]) if r["published_at"] else None, r["item_source"]))
    assert found == {
        "content": [("A & B", "https://e.org/guid", "<p>The whole text</p>", "2024-01-01 10:00:00", None), ("E", "https://e.org/e", "short", None, "Daily Paper")],
        "rdf": [("One", "https://e.org/1", "d", "2024-01-02 08:00:00", None), ("Two", "https://e.org/2", None, None, None)],
        "atom": [("X", "https://e.org/x", "<b>body</b>", "2024-01-02 08:00:00", None)],
        "cut": [("Whole", "https://e.org/w", "t", None, None)],
    }


def test_health_and_warnings(spark, bronze):
    table = dim(spark, bronze)
    health = {r["feed_id"]: (r["ok"], r["n_entries"], r["diagnosis"]) for r in feeds.health(bronze, table).collect()}
    assert health == {
        "content": (True, 2, "ok"), "rdf": (True, 2, "ok"), "atom": (True, 1, "ok"), "cut": (True, 1, "ok"), "bare": (True, 0, "empty"),
        "start": (False, 0, "malformed"), "html": (False, 0, "malformed"), "nothing": (False, 0, "malformed"), "null": (False, 0, "HTTP 503"), "error": (False, 0, "timed out"),
    }
    unknown = spark.createDataFrame([("content", "content", "Unknown", "A title"), ("rdf", "rdf", "Wire", "B")], "feed_id string, source string, publisher string, title string")
    said = sorted(r["warning"] for r in feeds.warnings(bronze, table, unknown).collect())
    assert said == ["content: 출처(publisher) 식별 실패 - A title", "error: timed out", "html: 피드 파싱 실패", "nothing: 피드 파싱 실패", "null: HTTP 503", "start: 피드 파싱 실패"]


def test_the_cap_counts_items_without_links(spark, bronze):
    """The first items of a feed are looked at, those that are left out afterwards included."""
    table = dim(spark, bronze)
    assert sorted(r["title"] for r in feeds.entries(bronze, table, per_feed=2).where("feed_id = 'content'").collect()) == ["A & B"]
    assert feeds.entries(bronze, table, per_feed=3).where("feed_id = 'content'").count() == 2


def test_no_payloads(spark, bronze):
    assert feeds.parsed(bronze.limit(0)).count() == 0
