"""The daily run: feeds to a saved issue, under a lease, with its metrics, warnings and log."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.functions.entities import Lexicon
from storyline.functions.text import clean_text, hashed_id, title_key
from storyline.operators import events, select, similarity
from storyline.operators.graph import checkpointed
from storyline.operators.taxonomy import Taxonomy
from storyline.plans import briefing
from storyline.sources import feeds, runlog
from storyline.sources.issues import Issues
from storyline.sources.store import Store, with_positions

JOB, MEMORY_DAYS = "daily", 7


def past(issues: Issues, date: str, days: int = MEMORY_DAYS) -> DataFrame | None:
    """canonical_url, title and title_key of the articles of the ``days`` before, less conferences; None if there are none."""
    first = (dt.date.fromisoformat(date) - dt.timedelta(days=days)).isoformat()
    rows = issues.rows("articles", [d for d in issues.dates() if first <= d < date])
    return None if rows is None else rows.where("category <> 'conference'").select("canonical_url", "title", title_key(F.col("title")).alias("title_key"))


def collected(bronze: DataFrame, dim: DataFrame, date: str) -> DataFrame:
    """Entries of the feeds as a run takes them: clean titles, ``ord`` by feed and place."""
    rows = feeds.entries(bronze, dim).withColumn("title", clean_text(F.col("title"))).withColumn("issue_date", F.lit(date))
    return with_positions(rows, [F.asc("feed_id"), F.asc("pos")], name="ord").drop("issue_date")


def run(spark: SparkSession, folder: str, date: str, bronze: DataFrame, dim: DataFrame, lexicon: Lexicon, now: str, taxonomy: Taxonomy | None = None, log: runlog.RunLog | None = None, per_section: int = briefing.PER_SECTION) -> dict:
    """Makes and saves the issue of a day; its metrics, or nothing if the day is done or another has it.

    Entries are de-duplicated against themselves and the last seven days' issues, classified,
    scored and linked; all articles are saved, those of the presentation first, with events, bridge and
    warnings in one commit.  Counts come with the jobs that make the rows.  A failure ends the run as
    failed, and leaves the day's old issue.
    """
    log, store, issues = log or runlog.RunLog(), Store(spark, f"{folder}/store"), Issues(spark, f"{folder}/issues")
    token = store.acquire(JOB, date, now)
    if not token:
        return {}
    begun = time.perf_counter()
    log.log("info", "collector", "collection_started", "collector")
    try:
        with log.step("collector", "collection", "collector"):
            entries, n_entries = runlog.observed(collected(bronze, dim, date))
            entries = checkpointed(entries)
            rows = briefing.articles(entries, lexicon, F.lit(now).cast("timestamp"), taxonomy, past(issues, date))
            rows, n_kept = runlog.observed(rows.withColumns({"article_id": hashed_id("art_", F.col("canonical_url")), "is_reference": F.col("source_type").isin("regulator", "institution", "research")}))
            rows = checkpointed(rows)
            featured = checkpointed(similarity.with_features(rows, lexicon))
            members = checkpointed(events.clusters(featured, similarity.scored_pairs(featured)))
            found = checkpointed(events.events(featured, members))
            best, n_best = runlog.observed(briefing.presentation(rows, members, per_section))
            best = checkpointed(best)
            named = members.join(found.select("primary_id", "event_id"), "primary_id")
            placed = select.by_priority(rows.join(named.select("id", "event_id"), "id").withColumn("issue_date", F.lit(date)), by=["issue_date"], name="_rank")
            placed = select.presentation_order(placed.drop("position"), best.select("id"), "id", "_rank").drop("_rank", "issue_date")
            ids = rows.select("id", "article_id")
            bridge = events.relationships(rows, members).join(ids, "id").join(found.select("primary_id", "event_id"), "primary_id")
            # no issue has an event without its primary article's id
            shown = found.join(ids.withColumnsRenamed({"id": "primary_id", "article_id": "primary_article_id"}), "primary_id")
            health = feeds.health(bronze, dim).agg(F.count("*").alias("total"), F.count_if("ok").alias("ok")).first()
            metrics = {
                "feeds_total": health["total"], "feeds_ok": health["ok"], "feeds_failed": health["total"] - health["ok"],
                "articles_collected": n_entries.get["n"], "articles_after_dedupe": n_kept.get["n"], "articles_selected": n_best.get["n"],
                "collection_duration": round(time.perf_counter() - begun, 4),
            }
            said = feeds.warnings(bronze, dim, entries)
            issues.save(date, now, metrics=metrics, articles=placed, events=shown, event_articles=bridge.select("event_id", "article_id", "relationship", "similarity"), warnings_table=said)
    except Exception as e:
        store.finish(JOB, date, now, token, error=str(e) or type(e).__name__)
        raise
    store.finish(JOB, date, now, token, metrics=metrics)
    return metrics
