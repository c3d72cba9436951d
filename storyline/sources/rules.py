"""Rules about what may be fetched and when a run is due, as predicates over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entries whose pages aren't fetched.
NEVER_FETCHED_KINDS, NEVER_FETCHED_BUCKETS = ["reference", "static"], ["reference", "conference"]


def page_fetch_allowed(entry_bucket: Column, entry_kind: Column, feed_bucket: Column, feed_kind: Column, enabled: bool = True) -> Column:
    """Whether an entry's page may be fetched: not for conferences, references and static entries, nor for such feeds."""
    if not enabled:
        return F.lit(False)
    no = (F.coalesce(entry_bucket, F.lit("")) == "conference") | F.coalesce(entry_kind, F.lit("")).isin(*NEVER_FETCHED_KINDS)
    return ~(no | F.coalesce(feed_bucket, F.lit("")).isin(*NEVER_FETCHED_BUCKETS) | F.coalesce(feed_kind, F.lit("")).isin(*NEVER_FETCHED_KINDS))


def with_robots(pages: DataFrame, policies: DataFrame, rules: DataFrame, agent: str, url: str = "url", name: str = "may_fetch") -> DataFrame:
    """Adds whether robots rules let an agent fetch a URL.

    ``policies`` has (origin, status) of the robots files asked for; ``rules`` has
    (origin, ordinal, agent, allow, path).  A host that answers 401 or 403 forbids
    all, one without a file allows all; else the first rule decides whose path the
    URL's begins with (``*``: any), of those for the agent if there are some, else of
    those for ``*``; an empty path allows.  URLs that aren't http(s) aren't fetched.
    Both tables have a row or a few for each origin and are joined by it; rules of
    an origin are gathered before, so a hot host is one row on their side.
    """
    low = agent.lower()
    own = F.contains(F.lit(low), F.lower("agent")) & (F.col("agent") != "*")
    rows = rules.withColumn("_own", own).where(own | (F.col("agent") == "*"))
    each = F.struct("ordinal", "_own", F.when(F.col("path") == "", True).otherwise(F.col("allow")).alias("allow"), "path")
    gathered = rows.groupBy("origin").agg(F.array_sort(F.collect_list(each)).alias("_rules"), F.max("_own").alias("_any_own"))
    status = policies.groupBy("origin").agg(F.max("status").alias("_status"))
    found = pages.withColumn("origin", F.coalesce(F.regexp_extract(url, "^(https?://[^/?#]*)", 1), F.lit(""))).withColumn("_path", F.coalesce(F.nullif(F.regexp_extract(url, "^https?://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/")))
    found = found.join(status, "origin", "left").join(gathered, "origin", "left")
    fits = F.filter("_rules", lambda r: (r["_own"] == F.col("_any_own")) & ((r["path"] == "*") | F.col("_path").startswith(r["path"])))
    decided = F.coalesce(F.get(fits, F.lit(0))["allow"], F.lit(True))
    may = F.when(F.col("origin") == "", False).when(F.col("_status").isin(401, 403), False).when(F.col("_status") == 200, decided).otherwise(True)
    return found.withColumn(name, may).drop("origin", "_path", "_status", "_rules", "_any_own")


def minutes_of(clock: Column) -> Column:
    """Minutes since midnight of HH:MM; null for what isn't such a time."""
    parts = F.split(F.trim(clock), ":")
    hour, minute = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    sound = (F.size(parts) == 2) & hour.between(0, 23) & minute.between(0, 59)
    return F.when(sound, hour * 60 + minute)


def due(now: Column, clock: Column, completed: Column, force: Column) -> Column:
    """Whether a day's run is due, and why: (run, reason).  A run that was missed is caught up."""
    early = F.hour(now) * 60 + F.minute(now) < minutes_of(clock)
    reason = F.when(force, "forced").when(minutes_of(clock).isNull(), "invalid_time").when(early, "before_scheduled_time").when(completed, "already_completed").otherwise("scheduled_or_catchup")
    return F.struct(reason.isin("forced", "scheduled_or_catchup").alias("run"), reason.alias("reason"))


def meta_description(html: Column) -> Column:
    """The content of a page's description (or og:description) in its head; empty without one."""
    head = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)^(.*?)(?:</head>|<body|\z)", 1)
    tag = r"(?is)<meta\b[^>]*?\b(?:name|property)\s*=\s*[\"'](?:og:)?description[\"'][^>]*>"
    return F.regexp_extract(F.regexp_extract(head, tag, 0), r"(?is)\bcontent\s*=\s*([\"'])(.*?)\1", 2)
