"""Entities by stages, texts that readers see, rules, and the store's further states."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from storyline.functions import facets
from storyline.functions.entities import Lexicon, with_entity_matches
from storyline.operators import select
from storyline.plans import display, presentation, view
from storyline.sources import feeds, rules
from storyline.sources.store import Store

ARTICLE = "title string, excerpt string, content string, tags array<string>, entities array<string>, source string, publisher string, source_type string, is_official boolean"


def matches(spark, **values):
    row = {"title": "", "excerpt": "", "content": "", "tags": [], "entities": [], "source": "", "publisher": "", "source_type": "media", "is_official": False} | values
    df = spark.createDataFrame([tuple(row[c.split()[0]] for c in ARTICLE.split(", "))], ARTICLE)
    return [tuple(m) for m in with_entity_matches(df, Lexicon.standard()).first()["entity_matches"]]


def test_entities_by_stages(spark):
    assert matches(spark, title="Audi and Bosch agree", excerpt="Toyota waits") == [("bosch", "title", 100), ("audi", "title", 100), ("toyota", "rss_summary", 90)]
    # longer aliases first, and the parts of a longer name count too
    assert matches(spark, title="Hyundai Mobis grows") == [("hyundai_mobis", "title", 100), ("hyundai", "title", 100)]
    # the parent group of a brand that is there isn't added
    assert matches(spark, title="Audi plans", entities=["Volkswagen", "BMW", "nobody"]) == [("audi", "title", 100), ("bmw", "explicit_article_entity", 95)]
    # content counts only if nothing was found, and only its beginning
    assert matches(spark, title="A plan", content="x" * 1493 + " tesla " + "kia") == [("tesla", "content", 80)]
    assert matches(spark, title="Kia plan", content="tesla") == [("kia", "title", 100)]
    # publishers of news count by the title alone, official sources by their name
    assert matches(spark, title="A plan", excerpt="as Automotive News says", source="Automotive News") == []
    assert matches(spark, title="Automotive News at 100") == [("automotive_news", "title", 100)]
    assert matches(spark, title="A plan", source="Toyota Newsroom", source_type="official") == [("toyota", "publisher_attribution", 95)]
    assert matches(spark, title=None, excerpt=None, content=None, source=None, publisher=None) == []


def test_regions(spark):
    def keys(text):
        row = spark.range(1).select(facets.region_keys(F.lit(text)).alias("k"), facets.counted_regions(F.lit(text)).alias("c")).first()
        return row["k"], row["c"]

    assert keys("plant in seoul") == (["all", "korea", "asia"], ["global", "korea"])
    assert keys("wolfsburg") == (["all", "europe", "germany"], ["global", "germany"])
    assert keys("the eu") == (["all", "europe"], ["europe"])
    assert keys("museum of seats") == (["all", "global"], ["global"])


def test_titles_and_summaries(spark):
    lexicon = Lexicon.standard()

    def title(text, category="oem", tags=(), excerpt="", source="Blog"):
        tags_ = F.array(*map(F.lit, tags)).cast("array<string>")
        return spark.range(1).select(display.title_ko(F.lit(text), F.lit(excerpt), F.lit(""), tags_, F.lit(category), F.lit(source), lexicon)).first()[0]

    assert title("현대차, 신차 공개 - Blog") == "현대차, 신차 공개"
    assert title("Kia recalls vans | Wire") == "Kia: 품질·규제 리스크 확대"
    assert title("Nothing said", "market") == "Blog: 산업 영향 이슈"
    assert title("Nothing said", "tier1", ["EV", "ZF", "event_start:2026-01-01", "Bosch", "BMW"]) == "ZF, Bosch: 전동화·배터리 공급망 변화"
    assert title("Linux days", "conference") == "자동차 컨퍼런스: SDV·차량 소프트웨어 아젠다"
    shown = lambda a, b: spark.range(1).select(display.shown_summary_ko(F.lit(a), F.lit(b)), display.factual_summary_ko(F.lit(a))).first()
    assert tuple(shown("요약 원문 제목: x\ny", "뜻")) == ("요약 [의미: 뜻]", "요약")
    assert tuple(shown("", "")) == ("핵심 동향을 확인할 수 있는 자동차 산업 참고 링크입니다.", "핵심 동향을 확인할 수 있는 자동차 산업 기사입니다.")


@pytest.mark.parametrize("title", ["CITROËN recalls vehicles", "citroËn recalls vehicles", "Citroën recalls vehicles"])
def test_names_with_accents_are_found_in_any_case(spark, title):
    made = display.title_ko(F.lit(title), F.lit(""), F.lit(""), F.array(F.lit("SDV")), F.lit("oem"), F.lit("Reuters"), Lexicon.standard())
    assert spark.range(1).select(made).first()[0].startswith("Citroën: ")


def test_view_names_what_upper_case_titles_name(spark):
    columns = "id long, title string, excerpt string, tags array<string>, source string, publisher string, source_type string, category string, primary_category string, url string, published_at timestamp, relevance_score int, impact_score int, source_score int, novelty_score int, recency_score int, text string"
    row = (1, "CITROËN recalls vehicles", "", ["SDV"], "Reuters", "Reuters", "media", "oem", "oem", "https://e.example/1", None, 500, 500, 500, 500, 500, "CITROËN recalls vehicles")
    shown = view.views(spark.createDataFrame([row], columns), Lexicon.standard()).first()
    assert shown["title_en"] == "CITROËN recalls vehicles" and shown["title_ko"].startswith("Citroën: ")


def test_leftovers_go_to_regulation_and_market(spark):
    rows = [(1, "u1", "oem", "oem", "media"), (2, "u1", "other", "other", "media"), (3, "u3", "institution", "institution", "regulator"), (4, "u4", "reference", "reference", "media"), (5, "u5", "other", "big", "media")]
    df = spark.createDataFrame(rows, "id long, url string, category string, primary_category string, source_type string")
    found = {r["id"]: r["section"] for r in select.with_leftovers(df, presentation.SECTIONS).collect()}
    assert found == {1: "oem", 3: "regulation", 4: "market", 5: "top_stories"}


def test_robots_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://a.x/p?q=1", "http://a.x/q", "http://b.x/", "http://c.x/", "http://d.x/deep", "ftp://a.x/", None])], "id long, url string")
    policies = spark.createDataFrame([("http://a.x", 200), ("http://b.x", 403), ("http://c.x", 500), ("http://d.x", 200)], "origin string, status int")
    table = spark.createDataFrame([("http://a.x", 1, "*", True, "/p?q"), ("http://a.x", 2, "*", False, "/p"), ("http://d.x", 1, "Bot", False, "*"), ("http://d.x", 0, "*", False, "")], "origin string, ordinal int, agent string, allow boolean, path string")
    may = lambda agent: [r["may_fetch"] for r in rules.with_robots(pages, policies, table, agent).orderBy("id").collect()]
    assert may("reader/1") == [True, True, False, True, True, False, False]
    assert may("SomeBot/2")[4] is False


@pytest.mark.parametrize(("html", "found"), [("<head><meta name='description' content='A &amp; b'></head>", "A &amp; b"), ('<META content="x" property="og:description"/><body>', "x"), ("<body><meta name=description content=x></body>", ""), (None, "")])
def test_meta_description(spark, html, found):
    assert spark.range(1).select(rules.meta_description(F.lit(html).cast("string"))).first()[0] == found


def test_store_keeps_states(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.settings("mail") == {} and not store.completed("daily", "2024-01-01")
    store.put_settings("mail", {"to": "a@b", "smtp_password": "x"}, "2024-01-01", secrets_elsewhere=True)
    store.put_settings("other", {"smtp_password": "y"}, "2024-01-01")
    assert store.settings("mail") == {"to": "a@b"} and store.settings("other") == {"smtp_password": "y"}
    store.mark_sent("2024-01-01", "2024-01-01 08:00:00")
    store.mark_sent("2024-01-02", "2024-01-02 08:00:00")
    store.mark_sent("2024-01-01", "2024-01-01 09:00:00")
    assert sorted(map(tuple, store.keyed("sent").select("issue_date", "sent_at").collect())) == [("2024-01-01", "2024-01-01 09:00:00"), ("2024-01-02", "2024-01-02 08:00:00")]
    token = store.acquire("daily", "2024-01-04", "2024-01-04 06:00:00")
    assert token and store.finish("daily", "2024-01-04", "2024-01-04 06:05:00", token, error="boom")
    assert not store.completed("daily", "2024-01-04")
    token = store.acquire("daily", "2024-01-04", "2024-01-04 07:00:00")
    assert token and store.finish("daily", "2024-01-04", "2024-01-04 07:05:00", token, metrics={"feeds_ok": 3})
    assert store.completed("daily", "2024-01-04") and store.latest_run("daily").first()["status"] == "completed"
    assert store.runs("daily").first()["metrics"] == '{"feeds_ok": 3}'


def test_feed_subsets_and_problems(spark):
    rows = [("", "A One", "oem", "https://a.example/rss", "media", 70, "us", "en", True, "media", "rss"), ("unece", "U", "regulation", "https://u.example", "regulator", 100, "global", "en", True, "primary", "search"), ("x", "X", "oem", "https://x.example", "odd", 70, "us", "en", False, "club", "post"), ("y", "Y", "oem", "https://y.example", "official", 70, "us", "en", True, "primary")]
    table = feeds.catalogue(spark, rows)
    assert sorted(r["id"] for r in feeds.daily(table).collect()) == ["a_one", "unece"]
    assert sorted(r["id"] for r in feeds.extra(table).collect()) == ["x", "y"]
    assert sorted((r["id"], r["problem"]) for r in feeds.problems(table).collect()) == [("x", "unknown group"), ("x", "unknown method"), ("x", "unknown source type")]
    bronze = spark.createDataFrame([("y", "<html>", 301, None), ("x", "<html>", 200, None)], "feed_id string, payload string, status int, error string")
    table = table.withColumn("discovery_method", F.when(F.col("id") == "y", "manual_web").otherwise("rss"))
    assert {r["feed_id"]: (r["ok"], r["n_entries"], r["diagnosis"]) for r in feeds.health(bronze, table).collect() if r["feed_id"] in "xy"} == {"y": (True, 0, "ok"), "x": (False, 0, "malformed")}


def test_html_mail_is_escaped(spark):
    view = spark.createDataFrame([(1, "<b>A & B</b>", "Wire", "oem", "high", 70, "news", "https://e.example/?a=1&b=2", 0), (2, "C", "Wire", "big", "watch", 20, "news", "", 1)], "id long, title string, publisher string, category string, level string, score int, signal string, url string, position int")
    totals = spark.createDataFrame([(2, 0, 1, 0)], "total int, critical int, high int, conference int")
    html = presentation.mail_html(view, totals, "2024-01-01", warnings=["a < b"]).first()["html"]
    assert "&lt;b&gt;A &amp; B&lt;/b&gt;" in html and "?a=1&amp;b=2" in html and "a &lt; b" in html and "Total 2" in html
    assert html.index("<h2>big</h2>") < html.index("<h2>oem</h2>") and html.count("<a href") == 1


def test_summaries_of_a_connector(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, title string, excerpt string")
    found = presentation.summarised(rows, lambda df: df.assign(summary=df["title"] + "!").query("id == 1"), "summary string").orderBy("id").collect()
    assert [r["summary"] for r in found] == ["a!", None]

    def broken(df: pd.DataFrame) -> pd.DataFrame:
        raise RuntimeError

    assert [r["summary"] for r in presentation.summarised(rows, broken, "summary string").collect()] == [None, None]


def test_titles_and_summaries_take_white_space_as_sql_does(spark):
    """A vertical tab is no white space, all spaces are trimmed, and a source's name ends where the text ends."""
    import duckdb
    from pyspark.sql import functions as F

    from storyline.plans import display, news

    texts = ["a\x0bb", " a b ", " a\tb \n", "a  b - Reuters", "a - Reuters\u0085", "　a | src ", "a\x0b- Reuters", "\x0ba", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, title string")
    found = [tuple(r) for r in rows.orderBy("i").select(display.clean_title(F.col("title")), display.trimmed(F.col("title"))).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, title VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [[i, t] for i, t in enumerate(texts)])
    assert found == con.execute(f"SELECT {news._CLEAN}, trim(title) FROM t ORDER BY i").fetchall()
