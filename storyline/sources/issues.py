"""Whole issues: articles, events and their bridge of a day appear together.

The tables of a day are written aside, then one commit of the day's manifest names
their folders; readers follow the manifest.  A write that is killed half-way leaves
the old issue whole, and old rows go with the old manifest: no file is changed in place.
Folders that no manifest names any more are removed by :meth:`Issues.vacuum`.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.sources.log import CommitLog

#: Tables of an issue, their keys (the last row by key counts), and columns in which a day's rows come back in order.
TABLES = {"articles": ["article_id"], "events": ["event_id"], "event_articles": ["event_id", "article_id"], "warnings_table": ["feed_id", "warning"]}
ORDER = {"articles": [F.asc, "position"], "events": [F.desc, "importance", "created_at"], "event_articles": [F.desc, "similarity"], "warnings_table": [F.asc, "feed_id", "warning"]}
#: What an event gives its articles, by the articles' names of it.
OF_EVENT = {
    "event_source_count": "source_count",
    "event_independent_source_count": "independent_sources",
    "event_has_official_source": "has_official",
    "event_has_regulatory_source": "has_regulator",
    "event_has_major_media_source": "has_major_media",
    "event_official_source_url": "official_url",
    "event_official_source_name": "official_name",
    "event_reference_source_name": "reference_name",
    "event_related_sources": "related_sources",
}


class Issues:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _log(self, date: str) -> CommitLog:
        return CommitLog(self.spark, f"{self.folder}/{date}/log")

    def save(self, date: str, now: str, warnings: Iterable[str] = (), metrics: dict | None = None, title: str | None = None, **tables: DataFrame) -> int:
        """Replaces the issue of a day by ``articles``, ``events``, ``event_articles`` and ``warnings_table``; the number of its commit.

        Rows that repeat a key count once.  Of two writers both commits count, one after the
        other; the later one's issue is what readers see.  When the issue first appeared stays.
        """
        unknown = set(tables) - set(TABLES)
        if unknown:
            raise ValueError(f"no tables of an issue: {sorted(unknown)}")
        found = {}
        for name, rows in tables.items():
            path = f"{self.folder}/{date}/{name}-{uuid.uuid4().hex}"
            key = [c for c in TABLES[name] if c in rows.columns]
            (rows.dropDuplicates(key) if key and name != "articles" else rows).write.parquet(path)
            found[name] = path
        log = self._log(date)
        while True:
            number, before = log.last()
            created = before.get("created_at", now) if before and not before.get("deleted") else now
            state = {"issue_date": date, "title": title or f"Brief {date}", "warnings": list(warnings), "metrics": metrics or {}, "created_at": created, "updated_at": now, "sent_at": before.get("sent_at") if not before.get("deleted") else None, "tables": found}
            if log.commit(number + 1, state):
                return number + 1

    def mark_sent(self, date: str, now: str) -> bool:
        """Notes when an issue was sent; whether there is one."""
        while True:
            log = self._log(date)
            number, state = log.last()
            if not state or state.get("deleted"):
                return False
            if log.commit(number + 1, state | {"sent_at": now}):
                return True

    def delete(self, date: str) -> bool:
        """Takes an issue with its articles, events and bridge away, in one commit; whether there was one."""
        while True:
            log = self._log(date)
            number, state = log.last()
            if not state or state.get("deleted"):
                return False
            if log.commit(number + 1, {"issue_date": date, "deleted": True, "tables": {}}):
                return True

    def state(self, date: str) -> dict:
        """The manifest of a day; empty if there is no issue."""
        state = self._log(date).last()[1]
        return {} if state.get("deleted") else state

    def dates(self) -> list[str]:
        """Days with an issue, the latest first."""
        root = self.path(self.folder)
        names = [x.getPath().getName() for x in self.fs.listStatus(root) if x.isDirectory()] if self.fs.exists(root) else []
        return sorted((d for d in names if self.state(d)), reverse=True)

    def latest_date(self) -> str | None:
        return next(iter(self.dates()), None)

    def rows(self, name: str, dates: Iterable[str]) -> DataFrame | None:
        """A table of several days with ``issue_date``; None if no manifest names it.  Columns that a day lacks are null there."""
        out = None
        for date in dates:
            path = self.state(date).get("tables", {}).get(name)
            if path:
                day = self.spark.read.parquet(path).withColumn("issue_date", F.lit(date).cast("date"))
                out = day if out is None else out.unionByName(day, allowMissingColumns=True)
        return out

    def table(self, name: str, date: str, state: dict | None = None) -> DataFrame | None:
        """A day's table in its order: articles by position, events by importance and the latest, bridge by similarity."""
        path = (self.state(date) if state is None else state).get("tables", {}).get(name)
        if not path:
            return None
        rows = self.spark.read.parquet(path).withColumn("issue_date", F.lit(date).cast("date"))
        way, *columns = ORDER[name]
        return rows.orderBy(*(way(c) for c in columns if c in rows.columns))

    def issue(self, date: str) -> tuple[dict, DataFrame | None, DataFrame | None, DataFrame | None]:
        """(manifest, articles, events, bridge) of one commit; articles carry what their event says."""
        state = self.state(date)
        articles, events, bridge = (self.table(name, date, state) for name in ("articles", "events", "event_articles"))
        if articles is not None and events is not None and "event_id" in articles.columns:
            given = {a: e for a, e in OF_EVENT.items() if e in events.columns}
            titles = events.select("event_id", F.col("title").alias("_title"), *(F.col(e).alias(f"_{a}") for a, e in given.items()))
            joined = articles.join(titles, "event_id", "left")
            said = {a: F.coalesce(F.col(f"_{a}"), F.col(a)) if a in articles.columns else F.col(f"_{a}") for a in given}
            said["event_title"] = F.coalesce(F.nullif("event_title", F.lit("")), "_title") if "event_title" in articles.columns else F.col("_title")
            articles = joined.withColumns(said).drop("_title", *(f"_{a}" for a in given)).orderBy("position")
        return state, articles, events, bridge

    def listed(self) -> DataFrame:
        """Issues with their numbers of articles, the latest first: numbers come from the files' footers."""
        rows = [(d, t.get("title"), t.get("tables", {}).get("articles")) for d in self.dates() for t in [self.state(d)]]
        counted = [(d, title, self.spark.read.parquet(path).count() if path else 0) for d, title, path in rows]
        return self.spark.createDataFrame(counted, "issue_date string, title string, n_articles long").orderBy(F.desc("issue_date"))

    def vacuum(self, older_than_seconds: float = 7 * 86_400) -> int:
        """Removes folders that no last manifest names and that are older; how many."""
        gone, limit = 0, (time.time() - older_than_seconds) * 1000
        root = self.path(self.folder)
        for day in self.fs.listStatus(root) if self.fs.exists(root) else []:
            named = {p.rpartition("/")[2] for p in self._log(day.getPath().getName()).last()[1].get("tables", {}).values()}
            for x in self.fs.listStatus(day.getPath()):
                name = x.getPath().getName()
                if x.isDirectory() and name != "log" and name not in named and x.getModificationTime() <= limit:
                    self.fs.delete(x.getPath(), True)
                    gone += 1
        return gone
