"""The store: Parquet tables by issue date, keyed tables, and the runs of jobs.

Writes of a day replace that day (dynamic partition overwrite), so a repeated run
leaves one copy; :mod:`storyline.sources.issues` has the tables that must appear together.
Keyed tables (settings, sent marks) are written whole under a new folder, which the next
commit of their log names: of two writers who read the same version one commits, the
other reads again, so no row is lost or doubled.  Runs are a log of states for each job
and day; the number of the commit that took a run is its token.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.operators.graph import checkpointed
from storyline.sources.log import CommitLog

#: Columns of an article: type, and what stands for null.
ARTICLE_DEFAULTS = {
    "article_id": ("string", None),
    "url": ("string", ""),
    "canonical_url": ("string", None),
    "original_url": ("string", None),
    "title": ("string", ""),
    "publisher": ("string", None),
    "source": ("string", ""),
    "source_id": ("string", None),
    "discovered_via": ("string", None),
    "source_type": ("string", "media"),
    "source_authority": ("int", 70),
    "category": ("string", "big"),
    "primary_category": ("string", None),
    "secondary_categories": ("array<string>", []),
    "topics": ("array<string>", []),
    "entities": ("array<string>", []),
    "tags": ("array<string>", []),
    "excerpt": ("string", ""),
    "content": ("string", ""),
    "content_source_type": ("string", "fallback"),
    "summary_ko": ("string", ""),
    "summary_en": ("string", ""),
    "why_it_matters_ko": ("string", ""),
    "key_points": ("array<string>", []),
    "summary_model": ("string", None),
    "summary_version": ("string", None),
    "summary_created_at": ("timestamp", None),
    "published_at": ("timestamp", None),
    "collected_at": ("timestamp", None),
    "score": ("double", 0.0),
    "source_score": ("double", 0.0),
    "relevance_score": ("double", 0.0),
    "impact_score": ("double", 0.0),
    "novelty_score": ("double", 0.0),
    "recency_score": ("double", 0.0),
    "priority_score": ("double", 0.0),
    "event_id": ("string", None),
    "event_title": ("string", None),
    "related_article_ids": ("array<string>", []),
    "is_official": ("boolean", False),
    "is_reference": ("boolean", False),
    "is_primary_source": ("boolean", False),
    "position": ("long", 0),
    "issue_date": ("date", None),
}
LEASE_MINUTES = 30


def conformed(rows: DataFrame, defaults: dict[str, tuple[str, object]] = ARTICLE_DEFAULTS) -> DataFrame:
    """The columns of ``defaults`` in their types, missing or null ones filled; older tables are read this way."""
    columns = {}
    for name, (kind, default) in defaults.items():
        value = F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        fill = F.array() if isinstance(default, list) else F.lit(default)
        columns[name] = value if default is None else F.coalesce(value, fill.cast(kind))
    return rows.select(*(c.alias(n) for n, c in columns.items()))


def normalised(articles: DataFrame) -> DataFrame:
    """Derived fields of an article: ids, publisher, category, flags."""
    rows = conformed(articles)
    kind = F.col("source_type")
    return rows.withColumns(
        {
            "canonical_url": F.coalesce(F.nullif("canonical_url", F.lit("")), "url"),
            "publisher": F.coalesce(F.nullif("publisher", F.lit("")), "source"),
            "primary_category": F.coalesce("primary_category", "category"),
            "category": F.when((F.col("category") == "big") & (F.coalesce("primary_category", F.lit("big")) != "big"), F.col("primary_category")).otherwise(F.col("category")),
            "is_official": F.col("is_official") | (kind == "official"),
            "is_primary_source": F.col("is_primary_source") | kind.isin("official", "regulator", "press_release"),
            "article_id": F.coalesce("article_id", F.concat(F.lit("art_"), F.substring(F.sha2(F.coalesce(F.nullif("canonical_url", F.lit("")), F.col("url")), 256), 1, 16))),
        }
    )


class Store:
    """Tables by date, keyed tables, runs and settings."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def exists(self, table: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._path(table))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def save(self, table: str, rows: DataFrame) -> None:
        """Replaces the issue dates that ``rows`` hold, and no others.  A large day is several tasks, small ones share one."""
        rows.hint("rebalance", "issue_date").write.partitionBy("issue_date").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self._path(table))

    def read(self, table: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(self._path(table))

    def issue(self, table: str, date: str) -> DataFrame:
        """Rows of one date; only its partition is read."""
        return self.read(table).where(F.col("issue_date") == F.lit(date).cast("date"))

    def latest_date(self):
        return self.read("articles").agg(F.max("issue_date")).first()[0]

    def _log(self, table: str) -> CommitLog:
        return CommitLog(self.spark, f"{self._path(table)}/log")

    def put(self, table: str, key: list[str], rows: DataFrame) -> int:
        """Upserts keyed rows (the table stays small enough to be rewritten); the number of the new version."""
        log = self._log(table)
        while True:
            number, state = log.last()
            after = merged(self.spark.read.parquet(state["data"]), rows, key) if state else rows
            data = f"{self._path(table)}/{uuid.uuid4().hex}"
            after.write.parquet(data)
            if log.commit(number + 1, {"data": data}):
                return number + 1

    def has(self, table: str) -> bool:
        """Whether a keyed table has a version."""
        return bool(self._log(table).numbers())

    def keyed(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self._log(table).last()[1]["data"])

    def _run(self, job: str, date: str) -> CommitLog:
        return self._log(f"runs/{job}/{date}")

    def acquire(self, job: str, date: str, now: str, lease_minutes: int = LEASE_MINUTES) -> int:
        """Takes the run of a day, unless it is done or another's lease holds: the token, else 0.

        Taking it is one commit on top of the state that was looked at, so of those who saw
        the same state one gets it, and one who dies afterwards leaves a lease that ends.
        """
        log = self._run(job, date)
        number, state = log.last()
        if state.get("status") == "completed":
            return 0
        if state.get("status") == "running" and _time(now) - _time(state["started_at"]) < dt.timedelta(minutes=lease_minutes):
            return 0
        taken = {"job": job, "run_date": date, "status": "running", "started_at": now, "finished_at": None, "metrics": "{}", "error": None, "token": number + 1}
        return number + 1 if log.commit(number + 1, taken) else 0

    def finish(self, job: str, date: str, now: str, token: int, error: str | None = None, metrics: dict | None = None) -> bool:
        """Ends a run as completed, or as failed with an error; whether ``token`` still held it.

        One whose lease ended and whose run another took can't end that one's.
        """
        log = self._run(job, date)
        number, state = log.last()
        if state.get("status") != "running" or state.get("token") != token:
            return False
        status = "failed" if error else "completed"
        return log.commit(number + 1, state | {"status": status, "finished_at": now, "error": error, "metrics": json.dumps(metrics or {}, ensure_ascii=False)})

    def runs(self, job: str) -> DataFrame:
        """The state of a job's runs, a row for each day."""
        root = CommitLog(self.spark, self._path(f"runs/{job}"))
        days = [x.getPath().getName() for x in root.fs.listStatus(root.root)] if root.fs.exists(root.root) else []
        found = [(s["job"], s["run_date"], s["status"], s["started_at"], s["finished_at"], s["metrics"], s["error"]) for d in sorted(days) for s in [self._run(job, d).last()[1]] if s]
        return self.spark.createDataFrame(found, "job string, run_date string, status string, started_at string, finished_at string, metrics string, error string")

    def completed(self, job: str, date: str) -> bool:
        """Whether a day's run is done, or its issue is there."""
        if self._run(job, date).last()[1].get("status") == "completed":
            return True
        return self.exists("articles") and not self.issue("articles", date).isEmpty()

    def latest_run(self, job: str) -> DataFrame:
        """The run of a job that began last."""
        return self.runs(job).orderBy(F.desc("started_at")).limit(1)

    def mark_sent(self, date: str, now: str) -> None:
        """Notes when a day's issue was sent; other issues stay as they are."""
        self.put("sent", ["issue_date"], self.spark.createDataFrame([(date, now)], "issue_date string, sent_at string"))

    def put_settings(self, key: str, values: dict, now: str, secrets_elsewhere: bool = False) -> None:
        """Stores settings as JSON; a password that the environment brings isn't stored."""
        kept = {k: v for k, v in values.items() if not (secrets_elsewhere and k == "smtp_password")}
        self.put("settings", ["key"], self.spark.createDataFrame([(key, json.dumps(kept, ensure_ascii=False), now)], "key string, value string, updated_at string"))

    def settings(self, key: str) -> dict:
        """The stored settings; empty if there are none."""
        row = self.keyed("settings").where(F.col("key") == key).first() if self.has("settings") else None
        return json.loads(row["value"] or "{}") if row else {}


def _time(value: str) -> dt.datetime:
    """A time as ISO has it; without a zone it is UTC."""
    at = dt.datetime.fromisoformat(value)
    return at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)


def merged(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] | None = None) -> DataFrame:
    """Upsert: new rows win by key; columns in ``keep`` stay as they first were."""
    both = old.join(new, key, "full_outer")
    columns = []
    for name in new.columns:
        if name in key:
            columns.append(F.col(name))
            continue
        mine = old[name] if name in old.columns else F.lit(None)
        columns.append((F.coalesce(mine, new[name]) if name in (keep or []) else F.when(F.coalesce(*(new[c].cast("string") for c in new.columns if c not in key)).isNotNull(), new[name]).otherwise(mine)).alias(name))
    return both.select(*columns)


def recent(rows: DataFrame, date: Column, as_of: Column, days: int, bounded: bool = True) -> DataFrame:
    """Rows of the ``days`` before ``as_of``; later ones too if not bounded."""
    rows = rows.where(date >= F.date_sub(as_of, days))
    return rows.where(date < as_of) if bounded else rows


def history(issues: DataFrame, articles: DataFrame) -> DataFrame:
    """Issues with their numbers of articles, 0 included, newest first."""
    counts = articles.groupBy("issue_date").agg(F.count("*").alias("n_articles"))
    return issues.join(counts, "issue_date", "left").withColumn("n_articles", F.coalesce("n_articles", F.lit(0))).orderBy(F.desc("issue_date"))


def metrics(rows: DataFrame) -> DataFrame:
    """Totals of an issue: all, critical, high (no conferences), conferences."""
    conference = F.col("category") == "conference"
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if((F.col("level") == "critical") & ~conference).alias("critical"),
        F.count_if((F.col("level") == "high") & ~conference).alias("high"),
        F.count_if(conference).alias("conference"),
    )


def run_stats(feeds: DataFrame, entries: DataFrame, kept: DataFrame, chosen: DataFrame, seconds: float) -> DataFrame:
    """One row: feeds in all, read and failed (``ok``), articles collected, kept and chosen, and how long it took."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    feeds_row = feeds.agg(F.count("*").alias("feeds_total"), F.count_if("ok").alias("feeds_ok"), F.count_if(~F.coalesce(F.col("ok"), F.lit(False))).alias("feeds_failed"))
    counts = n(entries, "articles_collected").join(n(kept, "articles_after_dedupe")).join(n(chosen, "articles_selected"))
    return feeds_row.join(counts).withColumn("collection_duration", F.bround(F.lit(float(seconds)), 4))


def latest_in_group(runs: DataFrame, by: list[str], time: str) -> DataFrame:
    """The last row of each group by time: a partial aggregate, no window."""
    return runs.groupBy(*by).agg(F.max_by(F.struct(*(c for c in runs.columns if c not in by)), time).alias("_last")).select(*by, "_last.*")


def with_positions(rows: DataFrame, order: list[Column], by: str = "issue_date", name: str = "position") -> DataFrame:
    """Adds ``position`` from 0 within the issue date.

    Rows are dealt into ranges of (date, order), each sorted on its own; a row's position is its
    place in its range plus the date's rows in the ranges before, from prefix sums of one
    count for each range and date.  So a day of any size spreads over all tasks.  Rows that
    tie in ``order`` share a range, in any order among them.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, F.col(by), *order).sortWithinPartitions(F.col(by), *order)
    # ranges and places in them must not be dealt anew where a task is repeated
    placed = checkpointed(dealt.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}))
    counts = placed.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_in")).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_by").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("_by", "_in", "_first", F.coalesce(before, F.lit(0)).alias("_base"))
    joined = placed.join(bases, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_in")))
    return joined.withColumn(name, (F.col("_place") - F.col("_first") + F.col("_base")).cast(T.LongType())).drop("_range", "_place", "_by", "_in", "_first", "_base")
