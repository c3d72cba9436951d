"""Keys by which readers filter articles: regions, topics, kinds of source."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.functions import fixed_values as V
from storyline.functions.text import let


def region_text(title: Column, url: Column, excerpt: Column, summary: Column, tags: Column) -> Column:
    parts = (F.coalesce(x, F.lit("")) for x in (title, url, excerpt, summary, F.array_join(tags, " ")))
    return F.lower(F.concat_ws(" ", *parts))


def in_region(low: Column, terms: list[str]) -> Column:
    """Whether a lower-case text names a region."""
    whole = [t for t in terms if not t.endswith(" ")]
    found = low.rlike(f"(?<![a-z0-9])({'|'.join(map(re.escape, whole))})(?![a-z0-9])") if whole else F.lit(False)
    for t in terms:
        if t.endswith(" "):
            found = found | F.contains(F.concat(low, F.lit(" ")), F.lit(t))
    return found


def _chosen(flags: list[tuple[str, Column]]) -> Column:
    return F.filter(F.array(*(F.when(f, F.lit(k)) for k, f in flags)), lambda x: x.isNotNull())


def counted_regions(low: Column, terms: dict[str, list[str]] | None = None) -> Column:
    """Regions by which an article counts: us, europe, asia by their own terms (global if none is named), germany and korea besides."""
    terms = terms or V.REGION_TERMS

    def keys(text: Column) -> Column:
        main = [(k, in_region(text, terms[k])) for k in ("us", "europe", "asia")]
        none = ~(main[0][1] | main[1][1] | main[2][1])
        return _chosen([*main, ("global", none), *((k, in_region(text, terms[k])) for k in ("germany", "korea"))])

    return let(low, keys)


def region_keys(low: Column, terms: dict[str, list[str]] | None = None) -> Column:
    """Regions by which an article is found: a country counts for its continent, and ``all`` is always there."""
    terms = terms or V.REGION_TERMS

    def keys(text: Column) -> Column:
        us, europe, germany, korea, asia = (in_region(text, terms[k]) for k in ("us", "europe", "germany", "korea", "asia"))
        none = ~(us | europe | germany | korea | asia)
        east = korea | asia
        return _chosen([("all", F.lit(True)), ("us", us), ("europe", europe | germany), ("germany", germany), ("korea", korea), ("asia", east), ("global", none)])

    return let(low, keys)


def topic_keys(low: Column, terms: dict[str, list[str]] | None = None) -> Column:
    """Topics of which a term stands anywhere in a lower-case text, also within words."""
    terms = terms or V.TOPIC_TERMS
    return let(low, lambda text: _chosen([(k, text.rlike("|".join(map(re.escape, ts)))) for k, ts in terms.items()]))


def source_facet(kind: Column, is_official: Column) -> Column:
    kind = F.lower(F.coalesce(kind, F.lit("")))
    return (
        F.when(F.coalesce(is_official, F.lit(False)) | kind.isin("official", "event"), "official")
        .when(kind.isin("regulator", "research"), kind)
        .when(kind.isin("institution", "open_source"), "institution")
        .otherwise("media")
    )


def counts(rows: DataFrame, keys: Column, labels: list[str]) -> DataFrame:
    """label and n for each of the labels, 0 included, and for ``all``: one small aggregate."""
    flags = [F.count_if(F.array_contains(keys, k)).alias(f"n{i}") for i, k in enumerate(labels)]
    one = rows.agg(F.count("*").alias("all"), *flags)
    pairs = [F.struct(F.lit("all").alias("label"), F.col("all").alias("n")), *(F.struct(F.lit(k).alias("label"), F.col(f"n{i}").alias("n")) for i, k in enumerate(labels))]
    return one.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def bundle(rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """facet, label and n of several facets at once, and of all rows: one scan and one aggregation.

    A facet is a string or an array of strings; a row counts once for each of its labels.
    """
    schema = rows.select(*(c.alias(k) for k, c in keys.items())).schema

    def labelled(name: str, column: Column) -> Column:
        labels = F.array_distinct(column) if schema[name].dataType.typeName() == "array" else F.array(column)
        return F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.struct(F.lit(name).alias("facet"), x.alias("label")))

    parts = [labelled(name, column) for name, column in keys.items()]
    parts.append(F.array(F.struct(F.lit("all").alias("facet"), F.lit("all").alias("label"))))
    return rows.select(F.explode(F.concat(*parts)).alias("x")).where("x.label is not null").groupBy("x.facet", "x.label").agg(F.count("*").alias("n"))
