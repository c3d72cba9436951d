"""Ranking and selection: order, top k of sections, assignment to sections, presentation order, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyline.functions import fixed_values as V


def ranked(rows: DataFrame, score: str, time: str, arrival: str, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Adds the rank by falling score, then the newest (undated last), then arrival."""
    order = [F.desc(score), F.desc(F.coalesce(F.unix_micros(time), F.lit(0))), F.asc(arrival)]
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order)))


def section_top(rows: DataFrame, k: int, section: str = "category", score: str = "score", time: str = "published_at", arrival: str = "ord", direct: Column | None = None) -> DataFrame:
    """The k best of each section; where a section has direct links, only those count.

    The window's limit is pushed below the shuffle, so each task sends k rows a section.
    """
    if direct is not None:
        best = rows.groupBy(section).agg(F.max(direct.cast("int")).alias("_direct"))
        rows = rows.join(best, section).where((F.col("_direct") == 0) | direct).drop("_direct")
    return ranked(rows, score, time, arrival, [section]).where(F.col("rank") <= k)


def section_ordinal(section: Column, order: list[str] | None = None) -> Column:
    order = order or V.CATEGORIES
    return F.coalesce(F.create_map(*(F.lit(x) for i, s in enumerate(order) for x in (s, i)))[section], F.lit(len(order)))


def assigned(rows: DataFrame, sections: list[tuple[str, list[str]]], url: str = "url", category: str = "category", primary: str = "primary_category") -> DataFrame:
    """Adds ``section``: the first section that holds either category of a row, provided no row of its URL matched an earlier one."""
    first = F.lit(None).cast("int")
    for i, (_, categories) in reversed(list(enumerate(sections))):
        first = F.when(F.col(category).isin(*categories) | F.col(primary).isin(*categories), i).otherwise(first)
    found = rows.withColumn("_i", first)
    least = found.where("_i is not null").groupBy(url).agg(F.min("_i").alias("_least"))
    names = F.array(*(F.lit(name) for name, _ in sections))
    return found.join(least, url, "left").where("_i is null or _i = _least").withColumn("section", F.get(names, F.col("_i"))).drop("_i", "_least")


def with_leftovers(rows: DataFrame, sections: list[tuple[str, list[str]]], url: str = "url", category: str = "category", primary: str = "primary_category") -> DataFrame:
    """:func:`assigned`, and what no section holds goes to regulation (regulators and institutions) or to market.

    A leftover whose URL stands in a section is left out.
    """
    found = assigned(rows, sections, url, category, primary)
    taken = found.where("section is not null").select(url).distinct()
    rest = found.where("section is null").join(taken, url, "left_anti")
    target = F.when(F.col("source_type").isin("regulator", "institution"), "regulation").otherwise("market")
    return found.where("section is not null").unionByName(rest.withColumn("section", target))


def by_priority(rows: DataFrame, score: str = "priority_score", time: str = "published_at", arrival: str = "position", by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Adds the rank by level, whole points (half to even), score and time, each falling, then arrival.  ``score`` is in tenths."""
    level_rank = F.when(F.col(score) >= 800, 4).when(F.col(score) >= 600, 3).when(F.col(score) >= 450, 2).otherwise(1)
    order = [F.desc(level_rank), F.desc(F.bround(F.col(score) / 10, 0)), F.desc(score), F.desc(F.coalesce(F.unix_micros(time), F.lit(0))), F.asc(arrival)]
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order)))


def conferences_in_order(rows: DataFrame, title: str = "title", start: str = "start_date") -> list[Column]:
    """Order of conferences: by start, undated last, then by title."""
    return [F.asc_nulls_last(start), F.asc(title)]


def presentation_order(rows: DataFrame, chosen: DataFrame, key: str, rank: str, issue: str = "issue_date") -> DataFrame:
    """Adds ``position`` within each issue: chosen rows first, then the rest, each by rank."""
    from storyline.sources.store import with_positions

    picked = rows.join(chosen.select(key).distinct().withColumn("_chosen", F.lit(0)), key, "left")
    return with_positions(picked.withColumn("_chosen", F.coalesce("_chosen", F.lit(1))), [F.asc("_chosen"), F.asc(rank), F.asc(key)], issue).drop("_chosen")


def facet_counts(rows: DataFrame, keys: Column, labels: list[str]) -> DataFrame:
    """label and n for rows with several keys, 0 for labels that none has; ``all`` counts every row."""
    spark = rows.sparkSession
    dim = spark.createDataFrame([(x, i) for i, x in enumerate(["all", *labels])], "label string, ordinal int")
    counted = rows.select(F.explode(F.array_distinct(F.concat(F.array(F.lit("all")), keys))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return F.broadcast(dim).join(counted, "label", "right").unionByName(dim.join(counted, "label", "left_anti").withColumn("n", F.lit(0).cast("long"))).where("ordinal is not null")


def substring_keys(text: Column, terms: dict[str, list[str]]) -> Column:
    """Keys any of whose terms is found anywhere in the text (also within words)."""
    low = F.lower(text)
    return F.filter(
        F.array(*(F.when(F.greatest(*(F.contains(low, F.lit(t)) for t in ts), F.lit(False)), F.lit(k)) for k, ts in terms.items())), lambda x: x.isNotNull()
    )


def filtered(rows: DataFrame, region: str | None = None, topic: str | None = None, source_type: str | None = None) -> DataFrame:
    """Rows that meet all of the facets given (regions and topics are arrays)."""
    if region:
        rows = rows.where(F.array_contains("regions", region))
    if topic:
        rows = rows.where(F.array_contains("topics", topic))
    return rows.where(F.col("source_type") == source_type) if source_type else rows


def upcoming(rows: DataFrame, as_of: Column, end: str = "end_date") -> DataFrame:
    """Events that haven't ended; undated ones stay."""
    return rows.where(F.col(end).isNull() | (F.col(end) >= as_of))


def direct_only(rows: DataFrame, indirect: Column) -> DataFrame:
    """Rows with direct links, or all of them if none is direct."""
    some = rows.agg(F.coalesce(F.bool_or(~indirect), F.lit(False)).alias("_some"))
    return rows.join(F.broadcast(some)).where(~F.col("_some") | ~indirect).drop("_some")
