"""Operators on small tables."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from storyline.operators import dedupe, graph, scoring, select, similarity
from storyline.plans import catalogue, news
from storyline.sources import feeds, pages
from storyline.sources.store import Store, normalised


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_first_of_each(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, None), (5, "b")], "id long, k string")
    assert ids(dedupe.first_of_each(rows, ["k"], ["id"])) == [1, 5]


def test_near_titles_and_greedy_choice(spark):
    rows = [
        (0, "Carmaker raises prices of electric models in Europe", "u0", "big"),
        (1, "Carmaker raises price of electric models in Europe - Wire", "u1", "big"),
        (2, "Carmaker raises prices of electric models in Europe", "u2", "big"),
        (3, "Maker shows model 3 with new range battery pack", "u3", "big"),
        (4, "Maker shows model 4 with new range battery pack", "u4", "big"),
        (5, "Something else entirely here", "u0", "big"),
    ]
    entries = spark.createDataFrame(rows, "ord long, title string, canonical_url string, bucket string")
    assert ids(dedupe.deduped(entries), "ord") == [0, 3, 4]
    history = spark.createDataFrame([("h", "Maker shows model 4 with new range battery pack", dedupe_key("Maker shows model 4 with new range battery pack"))], "canonical_url string, title string, title_key string")
    assert ids(dedupe.deduped(entries, history), "ord") == [0, 3]


def dedupe_key(title):
    return "".join(c for c in title.lower() if c.isalnum())


def brute_greedy(n, edges):
    kept = []
    for i in range(n):
        if not any((k, i) in edges for k in kept):
            kept.append(i)
    return kept


def test_greedy_is_that_of_one_pass(spark):
    import random

    rng = random.Random(3)
    edges = {(a, b) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.06}
    nodes = spark.createDataFrame([(i,) for i in range(40)], "id long")
    assert ids(dedupe.greedy_kept(nodes, spark.createDataFrame(sorted(edges), "left long, right long"))) == brute_greedy(40, edges)


def alike(a, b):
    """titles_alike of plain words."""
    x, y = set(a.split()), set(b.split())
    c, least, most = len(x & y), min(len(x), len(y)), max(len(x), len(y))
    return c >= 4 and (c * 5 >= most * 4 or c * 20 >= least * 17) or c >= 3 and least >= 4 and c * 4 >= len(x | y) * 3


def one_pass(rows, history=()):
    kept = []
    for o, title, url, bucket in rows:
        known = [*[(t, u, b) for _, t, u, b in kept], *[(t, u, "big") for u, t in history]]
        if not any(u == url or t.replace(" ", "") == title.replace(" ", "") or ("conference" not in (b, bucket) and alike(t, title)) for t, u, b in known):
            kept.append((o, title, url, bucket))
    return [r[0] for r in kept]


def test_copies_of_dropped_titles_go(spark):
    import random

    schema = "ord long, title string, canonical_url string, bucket string"
    a, b = "alfa bravo charly delta echos foxtrot golfs hotels", "alfa bravo charly delta echos foxtrot golfs hotels indias"
    rows = [(1, a, "u1", "big"), *((o, b, f"u{o}", "big") for o in (3, 7, 9, 11))]
    assert ids(dedupe.deduped(spark.createDataFrame(rows, schema)), "ord") == one_pass(rows) == [1]
    short = [(1, "alfa 1", "u1", "big"), (2, "the alfa 1", "u2", "big"), (3, "the of", "u3", "big"), (4, "of the", "u4", "big"), (5, "alfa 1", "u5", "big")]
    assert ids(dedupe.deduped(spark.createDataFrame(short, schema)), "ord") == [1, 2, 3, 4]
    rng = random.Random(7)
    words = "alfa bravo charly delta echos foxtrot golfs hotels indias julius kilos limas".split()
    pool = [" ".join(rng.sample(words, rng.choice([2, 3, 4, 5, 9, 10, 11]))) for _ in range(60)]
    rows = [(i, rng.choice(pool), f"u{rng.randrange(150)}", rng.choice(["big", "big", "oem", "conference"])) for i in range(200)]
    assert ids(dedupe.deduped(spark.createDataFrame(rows, schema)), "ord") == one_pass(rows)
    # near titles within the history: each is kept before all others
    history = [(f"h{i}", t) for i, t in enumerate(pool[:12])]
    old = spark.createDataFrame([(u, t, t.replace(" ", "")) for u, t in history], "canonical_url string, title string, title_key string")
    assert ids(dedupe.deduped(spark.createDataFrame(rows, schema), old), "ord") == one_pass(rows, history)


def test_near_title_members_are_all_documents(spark, tmp_path):
    a, b, c = "alfa bravo charly delta echos foxtrot golfs hotels", "alfa bravo charly delta echos foxtrot golfs hotels indias", "kilos limas mikes novas"
    titles = [a, c, b, a, b, "short one", "short one", c, "quite another title here"]
    docs = spark.createDataFrame([(i, f"{t}\ntext", "en", "src1") for i, t in enumerate(titles)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r["component"] for r in catalogue.queries()["near_title_members"](spark, str(tmp_path)).collect()}
    assert found == {0: 0, 1: 1, 2: 0, 3: 0, 4: 0, 5: 5, 6: 6, 7: 1, 8: 8}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 9), (9, 10), (10, 11)], "left long, right long")
    assert {r["node"]: r["component"] for r in graph.connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 10: 7, 11: 7}


def test_components_never_end_unsettled(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "left long, right long")
    assert {r["component"] for r in graph.connected_components(edges).collect()} == {0}
    with pytest.raises(RuntimeError):
        graph.connected_components(edges, rounds=1)


def test_recency_and_levels(spark):
    ref = dt.datetime(2024, 1, 10)
    rows = [(0, ref), (1, ref - dt.timedelta(hours=2)), (2, ref - dt.timedelta(hours=36)), (3, ref - dt.timedelta(hours=144)), (4, None), (5, ref + dt.timedelta(hours=5))]
    df = spark.createDataFrame(rows, "id long, t timestamp").orderBy("id")
    assert [r["s"] for r in df.select(scoring.recency_score(F.col("t"), F.lit(ref)).alias("s")).collect()] == [1000, 962, 500, 62, 500, 1000]
    points = spark.createDataFrame([(800,), (799,), (600,), (599,), (450,), (449,)], "p int")
    assert [r["l"] for r in points.select(scoring.level(F.col("p")).alias("l")).collect()] == ["critical", "high", "high", "medium", "medium", "watch"]


def test_pair_similarity_of_worked_cases(spark):
    found = {(r["left"], r["right"]): r["similarity"] for r in catalogue.pair_similarity(spark, "").collect()}
    assert found[0, 1] == 0.866 and found[0, 2] == 0.458 and found[6, 7] == 0.57
    assert found[3, 4] >= 0.65 and found[3, 5] == 0.0


def test_events(spark):
    rows = {r["primary_id"]: r["article_ids"] for r in catalogue.event_clusters(spark, "").collect()}
    assert sorted(rows.values()) == [[0, 1], [2], [3, 4], [5], [6], [7]]
    assert 3 in rows  # the regulator is primary


def test_candidates_lose_no_pair_that_scores(spark):
    """Every pair of 0.60 or more by brute force is a candidate, undated rows included; articles of one URL are linked with its first."""
    rows, lexicon = news.news(spark, SF), news.LEXICON
    rows = rows.where("doc_id < 90").withColumns(
        {
            "id": F.col("doc_id"), "canonical_url": F.col("url"), "topics": F.array().cast("array<string>"),
            "title": F.regexp_replace(F.substring_index("title", " ", 9), "(?i)explained", "recalls"),
            "published_at": F.when(F.col("doc_id") % 13 == 0, F.lit(None)).otherwise(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 7200)),
        }
    )
    featured = dedupe.checkpointed(similarity.with_features(rows, lexicon).drop("excerpt", "content"))
    l, r = featured.alias("l"), featured.alias("r")
    every = l.join(r, F.col("l.id") < F.col("r.id")).select(F.col("l.id").alias("left"), F.col("r.id").alias("right"), similarity.likeness("l", "r").alias("similarity"))
    url = {r["id"]: r["url"] for r in featured.select("id", "url").collect()}
    first = {}
    for i in sorted(url):
        first.setdefault(url[i], i)
    expected = {tuple(x) for x in every.where("similarity >= 0.6").collect() if {first[url[x["left"]]], first[url[x["right"]]]} == {x["left"], x["right"]}}
    expected |= {(first[u], i, 1.0) for i, u in url.items() if i != first[u]}
    found = {tuple(x) for x in similarity.scored_pairs(featured).where("similarity >= 0.6").collect()}
    assert len(expected) > 10 and found == expected


def test_profiles_are_compared_once(spark, monkeypatch):
    """Few profiles are compared before the pairs of articles are made, many with each pair; the scores are the same."""
    rows = dedupe.checkpointed(similarity.with_features(*catalogue.event_articles(spark, SF)))
    scores = lambda df: sorted(map(tuple, df.collect()))
    few = similarity.scored_pairs(rows)
    assert "arrays_overlap" not in few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(similarity, "PROFILE_PAIRS", 0)
    many = similarity.scored_pairs(rows)
    assert "arrays_overlap" in many._jdf.queryExecution().optimizedPlan().toString()
    found = scores(few)
    assert found == scores(many) and len({x[2] for x in found}) > 20 and len({x[:2] for x in found}) == len(found)


def test_articles_of_one_url_are_a_star(spark):
    """n articles of one URL have n - 1 links, and each is in the event of their best."""
    from storyline.operators import events

    rows, lexicon = news.news(spark, SF), news.LEXICON
    rows = rows.where("doc_id < 120").withColumns({"id": F.col("doc_id"), "position": F.col("doc_id"), "priority_score": F.pmod(F.col("doc_id") * 7, F.lit(101)), "topics": F.array().cast("array<string>")})
    rows = rows.withColumn("canonical_url", F.when(F.col("id") < 100, "https://e.org/one").otherwise(F.concat(F.lit("https://e.org/"), F.col("id").cast("string")))).withColumn("url", F.col("canonical_url"))
    featured = dedupe.checkpointed(similarity.with_features(rows.withColumn("title", F.lit("Ford recalls trucks over airbag inflator defect")), lexicon))
    pairs = dedupe.checkpointed(similarity.scored_pairs(featured))
    assert pairs.where("left < 100 and right < 100").count() == 99 and pairs.count() <= 99 + 21 * 20 / 2
    members = {r["id"]: r["primary_id"] for r in events.clusters(featured, pairs).collect()}
    assert sorted(members) == list(range(120)) and len({members[i] for i in range(100)}) == 1


def test_events_of_all_documents(spark):
    """Every pair of documents that is alike is found, and every document is in one event."""
    from storyline.operators import similarity

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    all_ids = ids(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    rows = dedupe.checkpointed(similarity.with_features(*catalogue.event_articles(spark, sf)))
    every = rows.alias("l").join(rows.alias("r"), F.col("l.id") < F.col("r.id")).select(F.col("l.id").alias("left"), F.col("r.id").alias("right"), similarity.likeness("l", "r").alias("similarity"))
    alike = lambda df: sorted(map(tuple, df.where("similarity >= 0.6").select("left", "right", "similarity").collect()))
    found = alike(catalogue.queries()["pair_similarity"](spark, sf))
    assert found and found == alike(every)
    events = catalogue.queries()["event_clusters"](spark, sf).collect()
    assert sorted(i for r in events for i in r["article_ids"]) == all_ids
    sizes = {r["primary_id"]: r["source_count"] for r in events}
    assert {r["primary_id"]: r["n"] for r in catalogue.queries()["event_coherence"](spark, sf).collect()} == sizes
    assert {r["primary_id"]: r["source_count"] for r in catalogue.queries()["event_coverage"](spark, sf).collect()} == {k: n for k, n in sizes.items() if n > 1}


def test_whole_texts_are_matched(spark, tmp_path):
    """What stands after the excerpt counts."""
    text = "Title\n" + "xyz " * 200 + "the and leaux was"
    spark.createDataFrame([(0, text, "en", "src1"), (1, "Title\nxyz", "de", "src1")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: {r["doc_id"]: r for r in catalogue.queries()[name](spark, str(tmp_path)).collect()}
    assert run("entity_match_whole")[0]["entities"] == "the" and run("topic_implications_whole")[0]["topics"] == "Joining,Speech"
    assert run("taxonomy_categories_whole")[0]["primary_category"] == "sdv"
    scores = run("article_scores_whole")[0]
    assert (scores["relevance_score"], scores["impact_score"]) == (890, 430)
    assert {r["entity_id"]: r["n"] for r in catalogue.queries()["entity_groups_whole"](spark, str(tmp_path)).collect()} == {"the": 1}
    points = scores["priority_score"] // 10
    assert f"Score: {points} /" in catalogue.briefing_mail(spark, str(tmp_path)).first()["text"]
    assert catalogue.article_scores(spark, str(tmp_path)).where("doc_id = 0").first()["priority_score"] // 10 == points


def test_flagship_is_the_whole_briefing(spark, tmp_path):
    """No copies, one article of an event, repeats of the history lose points."""
    a, b = "alfa bravo charly delta echos foxtrot golfs hotels", "kilos limas mikes novas oscars papas"
    titles = [(1, a, "src1"), *((i, a, "src4") for i in range(2, 9)), (9, b + " 7", "src4"), (10, b + " 8", "src4"), (11, b + " 6", "src0"), (12, "quite another title here", "src4"), (13, "romeo sierra tango union 5", "src0"), (14, "romeo sierra tango union 5", "src4")]
    spark.createDataFrame([(i, f"{t}\nthe text", "en", s) for i, t, s in titles], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = catalogue.flagship(spark, str(tmp_path)).collect()
    found = [r["doc_id"] for r in rows]
    assert len(found) == len(set(found)) and not set(found) & {2, 3, 4, 5, 6, 7, 8, 11, 13, 14} and {1, 12} <= set(found)
    history = spark.createDataFrame([("h", b + " 6", (b + "6").replace(" ", ""))], "canonical_url string, title string, title_key string")
    entries = catalogue.entries(spark, str(tmp_path)).where("ord in (9, 12)")
    score = lambda h: {r["id"]: r["novelty_score"] for r in catalogue.briefing.articles(entries, catalogue.LEXICON, F.lit(catalogue.REF_TIME).cast("timestamp"), catalogue.TAXONOMY, h).collect()}
    before, after = score(None), score(history)
    assert after[9] == before[9] - 300 and after[12] == before[12]


def test_flagship_of_a_table_has_no_near_titles(spark):
    rows = catalogue.flagship(spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
    best = dedupe.checkpointed(rows)
    assert best.count() and best.groupBy("category").count().where("count > 5").count() == 0
    assert dedupe.near_pairs(best, "doc_id").count() == 0


def test_section_top_prefers_direct_links(spark):
    rows = spark.createDataFrame([(1, "a", 5, True), (2, "a", 9, False), (3, "b", 1, False)], "ord long, category string, score int, direct boolean").withColumn("published_at", F.lit(None).cast("timestamp"))
    assert ids(select.section_top(rows, 5, direct=F.col("direct")), "ord") == [1, 3]


RSS = """<rss version="2.0"><channel><title>Wire</title>
<item><title>One</title><link>https://e.org/1?utm_source=x</link><description>&lt;p&gt;Text&lt;/p&gt;</description><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item>
<item><title></title><link>https://e.org/2</link></item><item><title>No link</title></item></channel></rss>"""
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><title>T</title><entry><title>Eins</title><link href="https://e.de/1"/><updated>2024-01-01T10:00:00Z</updated><summary>S</summary></entry></feed>'


def test_feeds(spark):
    dim = feeds.catalogue(spark, [("", n, "big", f"https://{n}.org/rss", "media", 80, "eu", "en", True, "media") for n in ("Wire", "Atom", "Broken", "Empty")])
    bronze = spark.createDataFrame([("wire", RSS, 200, None), ("atom", ATOM, 200, None), ("broken", "<rss><chan", 200, None), ("empty", "<rss><channel></channel></rss>", 200, None)], "feed_id string, payload string, status int, error string")
    rows = {r["feed_id"]: r for r in feeds.entries(bronze, dim).collect()}
    assert set(rows) == {"wire", "atom"}
    assert rows["wire"]["canonical_url"] == "https://e.org/1" and rows["wire"]["published_at"] == dt.datetime(2024, 1, 1, 10) and rows["wire"]["excerpt"] == "Text"
    assert rows["atom"]["published_at"] is None
    assert {r["feed_id"]: r["ok"] for r in feeds.health(bronze, dim).collect()} == {"wire": True, "atom": True, "broken": False, "empty": True}


def test_page_text():
    html = "<html><body><nav>Menu</nav><article><p>A paragraph that is long enough to be kept.</p><p>Short</p><p>Subscribe to read the rest of this article</p></article></body></html>"
    assert pages.extract(html) == "A paragraph that is long enough to be kept."
    assert pages.extract(None) == ""


def test_store_replaces_days_and_leases_runs(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    day = lambda d, n: normalised(spark.createDataFrame([(f"https://e.org/{i}", "t") for i in range(n)], "url string, title string")).withColumn("issue_date", F.lit(d).cast("date"))
    store.save("articles", day("2024-01-01", 3))
    store.save("articles", day("2024-01-02", 2))
    store.save("articles", day("2024-01-01", 1))
    assert store.issue("articles", "2024-01-01").count() == 1 and store.read("articles").count() == 3
    assert str(store.latest_date()) == "2024-01-02"
    assert store.acquire("daily", "2024-01-01", "2024-01-01 06:00:00")
    assert not store.acquire("daily", "2024-01-01", "2024-01-01 06:10:00")
    token = store.acquire("daily", "2024-01-01", "2024-01-01 06:45:00")
    assert token and store.finish("daily", "2024-01-01", "2024-01-01 06:50:00", token)
    assert not store.acquire("daily", "2024-01-01", "2024-01-01 09:00:00")


def test_stream_keeps_the_first(spark, tmp_path):
    from storyline.streaming import ingest

    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("a", dt.datetime(2024, 1, 2)), ("b", dt.datetime(2024, 1, 2))], "k string, t timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = ingest.first_within(ingest.table_stream(spark, str(tmp_path / "in"), rows.schema), "t", ["k"])
    ingest.run_available(stream, str(tmp_path / "cp"), lambda df, _: df.write.mode("append").parquet(out))
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_conferences_and_mail(spark):
    from storyline.plans import presentation as P

    rows = [("Past", "2024-01-01", "2024-01-02", "A", "u1", ["EV"], 0), ("Now", "2024-01-08", "2024-01-12", "B", "u2", ["SDV", "종료"], 1), ("Next", "2024-02-28", "2024-03-01", "C", "u3", ["ADAS"], 20)]
    table = spark.createDataFrame(rows, "name string, start_date string, end_date string, location string, url string, tags array<string>, ordinal int")
    table = table.withColumns({"start_date": F.to_date("start_date"), "end_date": F.to_date("end_date")})
    found = P.conferences(table, F.lit("2024-01-10").cast("date")).collect()
    assert [r["title"] for r in found] == ["Now | 2024년 1월 8-12일 · B", "Next | 2024년 2월 28일-3월 1일 · C"]
    assert [r["score"] for r in found] == [53, 50]
    assert found[0]["tags"][:2] == ["SDV", "진행중"]
    views = spark.createDataFrame([("oem", "high", "T1", 61, "fresh", "P", "u", 1), ("big", "watch", "T0", 11, "s", "P", "u", 1)], "category string, level string, title string, score int, signal string, publisher string, url string, position int")
    text = P.mail_text(views, "2024-01-10").first()["text"]
    assert text.startswith("Brief 2024-01-10: 2 articles\n\nbig\n- [watch] T0") and "oem\n- [high] T1\n  Score: 61 / fresh" in text


def test_fallbacks_only_without_direct_links(spark):
    from storyline.plans import presentation as P

    articles = spark.createDataFrame([("a", "tier1", True), ("b", "oem", False)], "title string, category string, is_indirect boolean")
    static = spark.createDataFrame([("s", "tier1", False)], "title string, category string, is_indirect boolean")
    assert ids(P.with_fallbacks(articles, static, "tier1"), "title") == ["a", "b", "s"]
    assert ids(P.with_fallbacks(articles, static, "oem"), "title") == ["a", "b"]


def test_presentation_order_is_by_issue(spark):
    rows = spark.createDataFrame([("d1", "a", 2), ("d1", "b", 1), ("d1", "c", 3), ("d2", "x", 1)], "issue_date string, key string, rank int")
    chosen = spark.createDataFrame([("c",)], "key string")
    found = {r["key"]: r["position"] for r in select.presentation_order(rows, chosen, "key", "rank").collect()}
    assert found == {"c": 0, "b": 1, "a": 2, "x": 0}


def test_section_assignment_by_url(spark):
    rows = spark.createDataFrame([("u1", "en", 1), ("u1", "de", 2), ("u2", "de", 3), ("u3", "zz", 4)], "url string, category string, id int").withColumn("primary_category", F.col("category"))
    found = {r["id"]: r["section"] for r in select.assigned(rows, [("north", ["en"]), ("centre", ["de"])]).collect()}
    assert found == {1: "north", 3: "centre", 4: None}


def test_pairs_of_blocks_of_any_size(spark):
    """Blocks of a few articles meet all that one block of all meets, each pair once; also without dates and across windows."""
    rows = catalogue._featured(spark, SF).withColumn("published_at", F.when(F.col("id") % 20 == 3, None).otherwise(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 9000)))
    rows = dedupe.checkpointed(rows.withColumn("url", F.when(F.col("id") % 50 == 7, "same").otherwise(F.col("url"))).where("id < 120"))
    found = [sorted(tuple(x) for x in similarity.blocks(rows, size=n).select("left", "right", "common", "n1", "n2", "same_url").collect()) for n in (7, 2000)]
    assert found[0] == found[1] and len({x[:2] for x in found[0]}) == len(found[0]) > 100
    l, r = rows.alias("l"), rows.alias("r")
    every = l.join(r, F.col("l.id") < F.col("r.id")).select(F.col("l.id").alias("left"), F.col("r.id").alias("right"), similarity.likeness("l", "r").alias("s")).where("s >= 0.6")
    scored = {(x[0], x[1]): x[2] for x in similarity.scored_pairs(rows.drop("canonical_url").withColumn("canonical_url", F.col("url").substr(1, 0)).withColumn("url", F.concat("url", F.col("id").cast("string")))).collect()}
    wanted = {(x[0], x[1]): x[2] for x in every.collect() if x[2] < 1.0}
    assert wanted and all(scored[k] == v for k, v in wanted.items())


def test_repeats_of_titles_by_their_rare_words(spark):
    """Titles that share four words and 3/4 of the larger one, by brute force; common words alone bring nothing together."""
    titles = [(i, sorted({f"w{(i * k) % 23}" for k in range(1, 4 + i % 6)} | {"a", "b", "c"})) for i in range(60)]
    new, old = [t for t in titles if t[0] % 3], [t for t in titles if t[0] % 3 == 0]
    table = lambda rows: spark.createDataFrame(rows, "id long, title_tokens array<string>")
    alike = lambda a, b: len(set(a) & set(b)) >= 4 and len(set(a) & set(b)) * 4 >= max(len(a), len(b)) * 3
    wanted = sorted(i for i, t in new if any(alike(t, o) for _, o in old))
    assert 0 < len(wanted) < len(new) and ids(dedupe.repeated(table(new), table(old))) == wanted
    # a word that all titles have leads from none to another
    words = lambda n: [(i, ["common", *(f"{n}{i}{k}" for k in range(5))]) for i in range(50)]
    assert dedupe.title_meetings(table(words("x")), table(words("y"))).count() == 0
