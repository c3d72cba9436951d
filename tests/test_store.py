"""Leases, versions and whole issues: crashes and races."""

import threading

import pytest
from pyspark.sql import functions as F

from storyline.sources.issues import Issues
from storyline.sources.log import CommitLog
from storyline.sources.store import Store, conformed, normalised, with_positions

DAY = "2024-01-01"


def test_one_of_many_commits(spark, tmp_path):
    won = []
    logs = [CommitLog(spark, f"file://{tmp_path}/log") for _ in range(6)]
    threads = [threading.Thread(target=lambda i=i, log=log: won.append(i) if log.commit(1, {"who": i}) else None) for i, log in enumerate(logs)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and logs[0].last() == (1, {"who": won[0]})
    assert logs[0].commit(2, {"who": "ü"}) and not logs[1].commit(2, {}) and logs[2].last() == (2, {"who": "ü"})
    assert [p.name for p in (tmp_path / "log").iterdir() if p.name.startswith("_")] == []


def test_a_lease_ends_and_tokens_fence(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    first = store.acquire("daily", DAY, f"{DAY} 06:00:00")  # this one dies here
    assert first and not store.acquire("daily", DAY, f"{DAY} 06:29:59") and not store.acquire("daily", DAY, f"{DAY}T06:10:00+00:00")
    second = store.acquire("daily", DAY, f"{DAY} 06:30:00")
    assert second > first
    assert not store.finish("daily", DAY, f"{DAY} 06:31:00", first)  # comes back too late
    assert not store.completed("daily", DAY)
    assert store.finish("daily", DAY, f"{DAY} 06:40:00", second, metrics={"feeds_ok": 40}) and store.completed("daily", DAY)
    assert not store.acquire("daily", DAY, f"{DAY} 09:00:00") and not store.finish("daily", DAY, f"{DAY} 09:00:00", second)
    assert store.acquire("daily", "2024-01-02", "2024-01-02 06:00:00") and store.latest_run("daily").first()["run_date"] == "2024-01-02"


def test_one_of_two_workers_gets_the_run(spark, tmp_path):
    got = []
    stores = [Store(spark, f"file://{tmp_path}/s") for _ in range(4)]
    threads = [threading.Thread(target=lambda s=s: got.append(s.acquire("daily", DAY, f"{DAY} 06:00:00"))) for s in stores]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(map(bool, got)) == [False, False, False, True]


def test_two_writers_lose_and_double_no_row(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    row = lambda k, v: spark.createDataFrame([(k, v)], "key string, value string")
    store.put("t", ["key"], row("a", "0"))
    threads = [threading.Thread(target=lambda i=i: Store(spark, f"file://{tmp_path}/s").put("t", ["key"], row("bcd"[i], str(i)))) for i in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(map(tuple, store.keyed("t").collect())) == [("a", "0"), ("b", "0"), ("c", "1"), ("d", "2")]


def tables(spark, n, event="e1"):
    articles = spark.createDataFrame([(f"a{i}", f"T{i}", i, event) for i in reversed(range(n))], "article_id string, title string, position long, event_id string")
    events = spark.createDataFrame([(event, "E", 5.0, n, 2), ("e0", "Z", 9.0, 1, 1)], "event_id string, title string, importance double, source_count int, independent_sources int")
    bridge = spark.createDataFrame([(event, f"a{i}", 1.0 - i / 10) for i in range(n)] * 2, "event_id string, article_id string, similarity double")
    return {"articles": articles, "events": events, "event_articles": bridge}


def test_issues_appear_whole(spark, tmp_path):
    issues = Issues(spark, f"file://{tmp_path}/i")
    assert issues.state(DAY) == {} and issues.latest_date() is None and issues.table("articles", DAY) is None
    issues.save(DAY, "t1", warnings=["w"], metrics={"n": 3}, **tables(spark, 3))
    issues.mark_sent(DAY, "t2")
    state, articles, events, bridge = issues.issue(DAY)
    assert [r["article_id"] for r in articles.collect()] == ["a0", "a1", "a2"] and [r["event_id"] for r in events.collect()] == ["e0", "e1"]
    assert articles.first()["event_title"] == "E" and articles.first()["event_source_count"] == 3
    assert [r["article_id"] for r in bridge.collect()] == ["a0", "a1", "a2"]  # repeated keys count once
    assert (state["warnings"], state["metrics"], state["sent_at"]) == (["w"], {"n": 3}, "t2")

    def dies(_number, _content):
        raise RuntimeError("killed")

    # a write that ends before its commit leaves the old issue whole
    broken = Issues(spark, f"file://{tmp_path}/i")
    log = broken._log(DAY)
    log.commit = dies
    broken._log = lambda _date: log
    with pytest.raises(RuntimeError):
        broken.save(DAY, "t3", **tables(spark, 5, "e5"))
    assert issues.issue(DAY)[1].count() == 3 and issues.issue(DAY)[2].count() == 2
    issues.save(DAY, "t4", **tables(spark, 2, "e7"))
    state, articles, events, bridge = issues.issue(DAY)
    assert (articles.count(), bridge.count(), events.where("event_id = 'e1'").count()) == (2, 2, 0)
    assert (state["created_at"], state["updated_at"], state["sent_at"]) == ("t1", "t4", "t2")
    issues.save("2024-01-02", "t5", articles=tables(spark, 4)["articles"])
    assert [tuple(r)[::2] for r in issues.listed().collect()] == [("2024-01-02", 4), (DAY, 2)] and issues.latest_date() == "2024-01-02"
    assert issues.rows("articles", issues.dates()).count() == 6
    assert issues.vacuum(0) == 6 and issues.issue(DAY)[1].count() == 2
    assert issues.delete(DAY) and not issues.delete(DAY) and issues.dates() == ["2024-01-02"] and issues.table("events", DAY) is None
    with pytest.raises(ValueError):
        issues.save(DAY, "t6", others=tables(spark, 1)["events"])


def test_articles_have_all_columns(spark):
    row = normalised(spark.createDataFrame([("u", "official")], "url string, source_type string")).first()
    assert len(row) == 44 and row["tags"] == [] and row["is_official"] and row["priority_score"] == 0.0 and row["article_id"].startswith("art_")
    assert conformed(spark.createDataFrame([(["x"], None)], "topics array<string>, title string")).first()["topics"] == ["x"]


def test_positions_of_one_large_day(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4900, F.lit(DAY)).when(F.col("id") < 4990, F.lit("2024-01-02")).cast("date").alias("issue_date"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("score"), "id")
    found = with_positions(rows, [F.desc("score"), F.asc("id")]).collect()
    for date in {r["issue_date"] for r in found}:
        own = sorted((r for r in found if r["issue_date"] == date), key=lambda r: (-r["score"], r["id"]))
        assert [r["position"] for r in own] == list(range(len(own)))
    assert len(found) == 5000
