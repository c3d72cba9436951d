"""What a reader sees: conferences, coverage of events, views of articles, the text of the daily mail."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.operators.select import section_ordinal

# Sections of the page and the categories that each holds.
SECTIONS = [
    ("top_stories", ["big"]),
    ("oem", ["oem"]),
    ("tier1_supply", ["tier1", "supply_chain"]),
    ("software_sdv", ["sdv", "software", "cybersecurity"]),
    ("adas_autonomous", ["adas_autonomous"]),
    ("ev_battery", ["ev_battery"]),
    ("regulation", ["regulation"]),
    ("market", ["market", "manufacturing"]),
    ("conference", ["conference"]),
]
# Points of a conference by tag.
CONFERENCE_POINTS = {"예정": 10, "SDV": 6, "ADAS": 4, "EV": 3}
SIGNALS = [
    (["investment", "invest", "funding", "billion"], "investment and spending"),
    (["partnership", "collaboration", "joint", "alliance"], "alliances"),
    (["recall", "probe", "investigation", "regulator"], "quality and regulatory risk"),
    (["software", "sdv", "ota", "zonal"], "vehicle software"),
    (["battery", "ev", "electric"], "electrification"),
]


def date_range(start: Column, end: Column) -> Column:
    """A range of dates without what repeats: same day, same month, same year, or both in full."""
    y, m, d = (lambda c: F.year(c).cast("string")), (lambda c: F.month(c).cast("string")), (lambda c: F.day(c).cast("string"))
    first = F.concat(y(start), F.lit("년 "), m(start), F.lit("월 "), d(start))
    return (
        F.when(start == end, F.concat(first, F.lit("일")))
        .when((F.year(start) == F.year(end)) & (F.month(start) == F.month(end)), F.concat(first, F.lit("-"), d(end), F.lit("일")))
        .when(F.year(start) == F.year(end), F.concat(first, F.lit("일-"), m(end), F.lit("월 "), d(end), F.lit("일")))
        .otherwise(F.concat(first, F.lit("일-"), y(end), F.lit("년 "), m(end), F.lit("월 "), d(end), F.lit("일")))
    )


def conferences(table: DataFrame, as_of: Column) -> DataFrame:
    """Conferences (name, start_date, end_date, location, url, tags, ordinal) that haven't ended, as articles in order of start."""
    rows = table.where(F.col("end_date") >= as_of)
    plain = F.array_except("tags", F.array(F.lit("종료"), F.lit("예정")))
    status = F.when(F.col("start_date") >= as_of, "예정").otherwise("진행중")
    rows = rows.withColumn("tags", F.concat(plain, F.array(status)))
    score = F.lit(48) - F.least("ordinal", F.lit(12)) + sum((F.when(F.array_contains("tags", t), p).otherwise(0) for t, p in CONFERENCE_POINTS.items()), F.lit(0))
    dated = F.concat("tags", F.array(F.concat(F.lit("event_start:"), F.col("start_date").cast("string")), F.concat(F.lit("event_end:"), F.col("end_date").cast("string"))))
    title = F.concat("name", F.lit(" | "), date_range(F.col("start_date"), F.col("end_date")), F.lit(" · "), "location")
    return rows.select(title.alias("title"), "url", F.lit("conference").alias("category"), F.col("start_date").cast("timestamp").alias("published_at"), dated.alias("tags"), score.alias("score")).orderBy("published_at")


def tag_date(tags: Column, prefix: str) -> Column:
    """The date that a tag like ``event_start:2026-01-06`` carries."""
    return F.to_date(F.substring(F.get(F.filter(tags, lambda t: t.startswith(prefix)), F.lit(0)), len(prefix) + 1, 10))


def visible_tags(tags: Column) -> Column:
    return F.filter(tags, lambda t: ~t.startswith("event_start:") & ~t.startswith("event_end:"))


def with_fallbacks(articles: DataFrame, static: DataFrame, category: str) -> DataFrame:
    """Static rows are added where no article of the category has a direct link."""
    some = articles.agg(F.coalesce(F.bool_or((F.col("category") == category) & ~F.col("is_indirect")), F.lit(False)).alias("_some"))
    added = static.join(F.broadcast(some)).where("not _some").drop("_some")
    return articles.unionByName(added, allowMissingColumns=True)


def coverage(events: DataFrame) -> DataFrame:
    """Coverage of events with more than one source or an official one."""
    shown = events.where((F.col("source_count") > 1) | F.col("has_official"))
    n, own = F.col("source_count").cast("string"), F.col("independent_sources").cast("string")
    label = F.concat_ws(
        " · ",
        F.concat(n, F.lit(" sources")),
        F.when(F.col("independent_sources") < F.col("source_count"), F.concat(own, F.lit(" independent publishers"))),
        F.when(F.col("has_official"), F.lit("Official source available")),
        F.when(F.col("has_regulator"), F.lit("Regulatory source available")),
    )
    return shown.select("event_id", "primary_id", "source_count", "independent_sources", "related_sources", label.alias("label"))


def signal(text: Column) -> Column:
    """What kind of business news a text is, by the first list with a word in it."""
    low = F.lower(text)
    out = F.lit("product and strategy")
    for words, name in reversed(SIGNALS):
        out = F.when(low.rlike("|".join(words)), name).otherwise(out)
    return out


def article_view(articles: DataFrame) -> DataFrame:
    """Columns that are shown."""
    return articles.select(
        "id", "title", F.coalesce(F.nullif("publisher", F.lit("")), F.lit("Unknown")).alias("publisher"), "category", "level", (F.col("priority_score") / 10).cast("int").alias("score"),
        F.coalesce(F.date_format("published_at", "yyyy-MM-dd HH:mm"), F.lit("")).alias("time"), visible_tags(F.col("tags")).alias("tags"), signal(F.concat_ws(" ", "title", "excerpt")).alias("signal"), "url",
    )


def escaped(text: Column) -> Column:
    """Text as HTML shows it."""
    out = F.coalesce(text, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def mail_html(views: DataFrame, totals: DataFrame, issue_date: str, order: list[str] | None = None, warnings: list[str] | None = None) -> DataFrame:
    """One row: the daily mail as HTML.  ``totals`` is one row (total, critical, high, conference); sections and articles as in :func:`mail_text`.

    An article without a link has no button; everything that comes from articles is escaped.
    """
    link = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit('<a href="'), escaped(F.col("url")), F.lit('">Read</a>'))).otherwise("")
    card = F.concat(
        F.lit('<div class="card"><b>['), escaped(F.col("level")), F.lit("]</b> <h3>"), escaped(F.col("title")), F.lit("</h3><p>Score "), F.col("score").cast("string"),
        F.lit(" · "), escaped(F.col("signal")), F.lit("</p><p>"), escaped(F.col("publisher")), F.lit("</p>"), link, F.lit("</div>"),
    )
    by_section = views.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", card.alias("card")))), lambda x: x["card"]), "").alias("cards"))
    part = F.concat(F.lit("<h2>"), escaped(F.col("category")), F.lit("</h2>"), F.col("cards"))
    body = by_section.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(section_ordinal(F.col("category"), order).alias("o"), part.alias("t")))), lambda x: x["t"]), "").alias("body"))
    cells = F.concat(*(F.concat(F.lit(f"<td>{label} "), F.col(c).cast("string"), F.lit("</td>")) for c, label in (("total", "Total"), ("critical", "Critical"), ("high", "High"), ("conference", "Conferences"))))
    notes = F.concat(*(F.concat(F.lit('<p class="note">'), escaped(F.lit(w)), F.lit("</p>")) for w in warnings)) if warnings else F.lit("")
    head = f'<!doctype html><html><head><meta charset="utf-8"><title>Brief {issue_date}</title></head><body><h1>{issue_date}</h1><table><tr>'
    return body.join(totals).select(F.concat(F.lit(head), cells, F.lit("</tr></table>"), "body", notes, F.lit("</body></html>")).alias("html"))


def summarised(articles: DataFrame, summarise: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "id", columns: list[str] | None = None) -> DataFrame:
    """``articles`` with the columns that ``summarise`` makes of a batch of them: the place of a language model.

    ``summarise`` gets ``key`` and ``columns`` and returns ``key`` with the columns of
    ``schema`` (a DDL string); rows that it leaves out or that fail are without a
    summary, so that the template's can take their place.
    """
    wanted = [key, *(columns or ["title", "excerpt"])]
    kind = articles.schema[key].dataType.simpleString()
    names = [key, *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                made = summarise(batch)
                yield pd.DataFrame({n: made[n].to_numpy(dtype=object) for n in names})
            except Exception:  # a connector's failure costs its batch the summaries, not the issue
                pass

    return articles.join(articles.select(*wanted).mapInPandas(run, f"{key} {kind}, {schema}"), key, "left")


def mail_text(views: DataFrame, issue_date: str, order: list[str] | None = None) -> DataFrame:
    """One row: the text of the daily mail, sections in order, articles by position (at most a few per section)."""
    entry = F.concat_ws("\n", F.concat(F.lit("- ["), "level", F.lit("] "), "title"), F.concat(F.lit("  Score: "), F.col("score").cast("string"), F.lit(" / "), "signal"), F.concat(F.lit("  Source: "), "publisher"), F.concat(F.lit("  "), "url"))
    by_section = views.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", entry.alias("text")))), lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("n"))
    part = F.concat("category", F.lit("\n"), "text")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(section_ordinal(F.col("category"), order).alias("o"), part.alias("t")))), lambda x: x["t"]), "\n\n")
    head = F.concat(F.lit(f"Brief {issue_date}: "), F.coalesce(F.sum("n"), F.lit(0)).cast("string"), F.lit(" articles\n\n"))
    return by_section.agg(F.concat(head, body).alias("text"))
