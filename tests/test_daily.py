"""The daily run, what it logs and counts, the memory of a stream, and the view of an article."""

import datetime as dt
import io
import json

import pytest
from pyspark.sql import functions as F

from storyline.functions.entities import Lexicon
from storyline.functions.text import title_key
from storyline.operators import dedupe
from storyline.plans import daily, view
from storyline.sources import feeds, runlog
from storyline.sources.issues import Issues
from storyline.sources.store import Store
from storyline.streaming import ingest
from storyline.streaming.memory import Memory

ENTRY = "ord long, canonical_url string, title string, bucket string, published_at timestamp"


def day(n, hour=6):
    return dt.datetime(2024, 1, n, hour)


def test_titles_near_an_index_are_those_of_brute_force(spark):
    words = "alfa bravo charly delta echos foxtrot golfs hotels india juliett".split()
    old = [" ".join(words[i : i + n]) + f" {k}" for i in range(4) for n in (3, 4, 5, 6) for k in (1, 2)]
    new = [" ".join([*words[i : i + n], "zulus"][::-1]) + f" {k}" for i in range(5) for n in (3, 4, 5, 6) for k in (1, 3)] + ["", "alfa"]
    o, n = spark.createDataFrame(list(enumerate(old)), "id long, title string"), spark.createDataFrame(list(enumerate(new)), "id long, title string")
    found = sorted(r["id"] for r in dedupe.near_index(n, dedupe.title_index(o)).collect())
    l, r = dedupe.with_title_features(n).alias("l"), dedupe.with_title_features(o).alias("r")
    alike = dedupe.titles_alike((F.col("l.title_tokens"), F.col("r.title_tokens")), (F.col("l.title_numbers"), F.col("r.title_numbers")))
    assert found == sorted(x["id"] for x in l.crossJoin(r).where(alike).select("l.id").distinct().collect()) and 5 < len(found) < len(new)


BATCHES = [
    [(0, "u0", "Ford recalls trucks over airbag inflator defect", "oem", day(1)), (1, "u1", "Ford recalls trucks over airbag inflator defects", "oem", day(1)), (2, "u2", "Kia shows compact car in Seoul", "oem", day(1)), (3, "c1", "Annual battery conference opens doors today", "conference", day(1)), (4, "u4", "no time for this long title", "oem", None)],
    [(5, "u2", "Quite another headline about nothing much", "oem", day(3)), (6, "u6", "Trucks recalled: Ford recalls trucks over airbag inflator defect", "oem", day(3)), (7, "u7", "BMW opens plant near Debrecen city", "oem", day(3)), (8, "c2", "Annual battery conference opens doors today now", "conference", day(3))],
    [(9, "u9", "Ford recalls trucks over airbag inflator defect", "oem", day(9)), (10, "u10", "BMW opens new plant near Debrecen city", "oem", day(9)), (11, "", "empty link", "oem", day(9)), (12, "u12", None, "oem", day(9))],
    [],
]


def chained(spark):
    """Each batch less what the kept rows of the seven days before its latest row bar."""
    kept, out = [], []
    for rows in BATCHES:
        times = [r[4] for r in rows if r[4]]
        old = [r for r in kept if times and r[4] and r[4] > max(times) - dt.timedelta(days=7) and r[3] != "conference"]
        history = spark.createDataFrame(old, ENTRY).withColumn("title_key", title_key(F.col("title"))) if old else None
        ids = {r["ord"] for r in dedupe.deduped(spark.createDataFrame(rows, ENTRY), history).collect()}
        kept += [r for r in rows if r[0] in ids]
        out.append(sorted(ids))
    return out


def test_a_stream_remembers_what_it_kept(spark, tmp_path):
    """As the batch operator over the same days; a batch that comes again gives the same rows; old ones are forgotten."""
    expected = chained(spark)
    assert expected == [[0, 2, 3, 4], [7, 8], [9], []]
    memory = Memory(spark, f"file://{tmp_path}/memory")
    batches = [spark.createDataFrame(rows, ENTRY) for rows in BATCHES]
    found = [sorted(r["ord"] for r in memory.handle(b, i).collect()) for i, b in enumerate(batches)]
    assert found == expected
    assert sorted(r["ord"] for r in Memory(spark, f"file://{tmp_path}/memory").handle(batches[1], 1).collect()) == expected[1]
    assert sorted(r["ord"] for r in memory.kept().collect()) == sorted(sum(expected, []))
    assert len(memory.log.last()[1]["parts"]) == 2  # that of the first day has gone


def test_a_stream_through_its_memory(spark, tmp_path, monkeypatch):
    """Files of a folder, a run for each; parts are put together without a change of the result."""
    monkeypatch.setattr("storyline.streaming.memory.MOST_PARTS", 1)
    memory, expected = Memory(spark, f"file://{tmp_path}/memory"), chained(spark)
    for i, rows in enumerate(BATCHES[:3]):
        spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.run_available(ingest.table_stream(spark, str(tmp_path / "in"), ENTRY), str(tmp_path / "cp"), lambda df, n: memory.handle(df, n) and None)
        assert sorted(r["ord"] for r in memory.kept().collect()) == sorted(sum(expected[: i + 1], []))
        assert len(memory.log.last()[1]["parts"]) == 1


def test_counts_come_with_the_job(spark):
    rows, watch = runlog.observed(spark.range(100), even=F.count_if(F.col("id") % 2 == 0))
    assert rows.where("id < 10").count() == 10 and watch.get == {"n": 100, "even": 50}
    none, watch = runlog.observed(spark.range(0))
    assert none.count() == 0 and watch.get["n"] == 0


def test_log_of_a_run(spark, tmp_path):
    out = io.StringIO()
    log = runlog.RunLog(out)
    with log.step("collector", "fetch", "feed"):
        pass
    with pytest.raises(ValueError), log.step("collector", "fetch", "다른"):
        raise ValueError("boom")
    log.log("warning", "store", "slow", duration=1.23456)
    out.write("not json\n")
    lines = [json.loads(x) for x in out.getvalue().splitlines()[:3]]
    assert [(x["level"], x["event"], x["source"], x["error"]) for x in lines] == [("INFO", "fetch_completed", "feed", None), ("ERROR", "fetch_failed", "다른", "boom"), ("WARNING", "slow", None, None)]
    assert lines[2]["duration"] == 1.2346 and list(lines[0]) == ["timestamp", "level", "component", "source", "event", "duration", "error"]
    (tmp_path / "run.log").write_text(out.getvalue())
    found = runlog.records(spark, str(tmp_path / "run.log")).collect()
    assert len(found) == 3 and {r["event"] for r in found} == {"fetch_completed", "fetch_failed", "slow"}
    closed = io.StringIO()
    closed.close()
    assert runlog.RunLog(closed).log("info", "a", "b")["event"] == "b"


def payload(*items):
    return "<rss><channel>" + "".join(f"<item><title>{t}</title><link>https://{h}.example/{t.replace(' ', '-')}</link><description>{d}</description><pubDate>Mon, 01 Jan 2024 0{i}:00:00 GMT</pubDate></item>" for i, (h, t, d) in enumerate(items)) + "</channel></rss>"


def test_daily_run(spark, tmp_path):
    """Feeds to an issue: counts, warnings, log, events, order, memory of the day before, and no second run."""
    feed = lambda *row: (*row, "eu", "en", True, "media", "rss")
    dim = feeds.catalogue(spark, [feed("wire", "Wire", "oem", "https://w.example", "media", 80), feed("trade", "Trade", "oem", "https://t.example", "media", 70), feed("gone", "Gone", "oem", "https://g.example", "media", 70)])
    first = payload(("w", "Ford recalls trucks over airbag inflator defect", "a"), ("w", "Kia shows compact car in Seoul", "b"), ("w", "Kia shows compact car in Seoul", "again"))
    second = payload(("t", "Ford trucks recalled for faulty airbag inflators", "c"))
    bronze = spark.createDataFrame([("wire", first, 200, None), ("trade", second, 200, None), ("gone", None, 404, None)], "feed_id string, payload string, status int, error string")
    out, folder = io.StringIO(), f"file://{tmp_path}/s"
    metrics = daily.run(spark, folder, "2024-01-01", bronze, dim, Lexicon.standard(), "2024-01-01 08:00:00", log=runlog.RunLog(out))
    assert {k: v for k, v in metrics.items() if k != "collection_duration"} == {"feeds_total": 3, "feeds_ok": 2, "feeds_failed": 1, "articles_collected": 4, "articles_after_dedupe": 3, "articles_selected": 2}
    assert [json.loads(x)["event"] for x in out.getvalue().splitlines()] == ["collection_started", "collection_completed"]
    state, articles, events, bridge = Issues(spark, folder + "/issues").issue("2024-01-01")
    rows = articles.collect()
    assert state["metrics"] == metrics and [r["position"] for r in rows] == [0, 1, 2] and len({r["event_id"] for r in rows}) == 2
    assert rows[2]["event_id"] in {rows[0]["event_id"], rows[1]["event_id"]} and rows[2]["event_source_count"] == 2
    assert events.count() == 2 and sorted(r["relationship"] for r in bridge.collect()) == ["coverage", "primary", "primary"]
    assert [r["warning"] for r in Issues(spark, folder + "/issues").table("warnings_table", "2024-01-01").collect()] == ["Gone: HTTP 404"]
    assert daily.run(spark, folder, "2024-01-01", bronze, dim, Lexicon.standard(), "2024-01-01 09:00:00", log=runlog.RunLog(io.StringIO())) == {}
    third = spark.createDataFrame([("wire", payload(("x", "Kia shows compact car in Seoul", "b"), ("x", "BMW opens plant near Debrecen city", "n")), 200, None)], bronze.schema)
    after = daily.run(spark, folder, "2024-01-02", third, dim, Lexicon.standard(), "2024-01-02 08:00:00", log=runlog.RunLog(io.StringIO()))
    assert (after["articles_collected"], after["articles_after_dedupe"]) == (2, 1)
    with pytest.raises(Exception):
        daily.run(spark, folder, "2024-01-03", bronze.drop("payload"), dim, Lexicon.standard(), "2024-01-03 08:00:00", log=runlog.RunLog(out))
    assert json.loads(out.getvalue().splitlines()[-1])["event"] == "collection_failed"
    assert Store(spark, folder + "/store").runs("daily").where("status = 'failed'").count() == 1 and Issues(spark, folder + "/issues").latest_date() == "2024-01-02"


def test_page_and_filters(spark):
    rows = spark.createDataFrame(
        [(0, "Ford recalls trucks - Wire", "oem", "https://e.org/0", 700, ["Ford", "event_start:2024-01-01"], None), (1, "독일 공장", "zz", "https://news.google.com/1", 500, [], "요약 [의미: 큼] 원문 제목: X"), (2, None, "zz", "https://e.org/2", 400, None, "")],
        "id long, title string, category string, url string, priority_score int, tags array<string>, summary_ko string",
    ).withColumns({"primary_category": F.col("category"), "excerpt": F.lit(None).cast("string"), "source": F.lit(""), "publisher": F.lit(None).cast("string"), "source_type": F.when(F.col("id") == 2, "regulator").otherwise("media"), "position": F.col("id"), "published_at": F.lit("2024-01-01 08:00:00").cast("timestamp")})
    rows = rows.withColumns({f"{k}_score": F.lit(500) for k in ("relevance", "impact", "source", "recency", "novelty")}).withColumn("level", F.lit("medium"))
    shown = dedupe.checkpointed(view.page(rows, Lexicon.standard()))
    found = {r["id"]: r for r in shown.collect()}
    assert {i: r["section"] for i, r in found.items()} == {0: "oem", 1: "market", 2: "regulation"}
    assert found[0]["title_en"] == "Ford recalls trucks" and found[0]["shown_tags"] == ["Ford"] and found[0]["category_ko"] == "OEM" and found[0]["time"] == "2024-01-01 08:00"
    assert found[1]["title_ko"] == "독일 공장" and found[1]["factual_summary_ko"] == "요약" and found[1]["link"] is None and found[1]["category_en"] == "ZZ"
    assert found[2]["title_en"] == "" and found[2]["publisher_shown"] == "출처 미상" and found[2]["factual_summary_en"] == view.NO_SUMMARY_EN and found[2]["shown_tags"] == []
    counts = {(r["facet"], r["label"]): r["n"] for r in view.index(shown).collect()}
    assert counts["all", "all"] == 3 and counts["section", "market"] == 1 and counts["kind", "regulator"] == 1
    assert sorted(r["id"] for r in view.filtered(shown, "all", None, "regulator").collect()) == [2]
    assert view.filtered(shown, region="us").count() == sum("us" in r["region_keys"] for r in found.values())
