"""Articles as readers see them: headline, summaries, reasons, facets, coverage, section, in the order of the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.functions import facets
from storyline.functions.attribution import column_or
from storyline.functions.entities import Lexicon
from storyline.operators import scoring, select
from storyline.plans import display
from storyline.plans.presentation import SECTIONS, coverage, visible_tags

# Names of the categories in Korean and English; others are shown in upper case.
CATEGORY_NAMES = {
    "big": ("주요 뉴스", "Top Stories"),
    "oem": ("OEM", "OEM"),
    "tier1": ("부품사", "Tier 1"),
    "supply_chain": ("공급망", "Supply Chain"),
    "sdv": ("SDV", "SDV"),
    "software": ("소프트웨어", "Software"),
    "cybersecurity": ("사이버보안", "Cybersecurity"),
    "adas_autonomous": ("자율주행", "ADAS / Autonomous"),
    "ev_battery": ("전기차 / 배터리", "EV / Battery"),
    "regulation": ("정책 / 규제", "Regulation"),
    "market": ("시장", "Market"),
    "manufacturing": ("제조", "Manufacturing"),
    "conference": ("컨퍼런스", "Conference"),
    "institution": ("기관", "Institution"),
    "reference": ("참고", "Reference"),
}
NO_PUBLISHER, NO_SUMMARY_EN = "출처 미상", "Reference briefing covering key automotive industry developments."


def category_name(category: Column, lang: str = "ko") -> Column:
    i = 0 if lang == "ko" else 1
    names = F.create_map(*(F.lit(x) for k, v in CATEGORY_NAMES.items() for x in (k, v[i])))
    return F.coalesce(names[category], F.upper(category))


def views(rows: DataFrame, lexicon: Lexicon, found: DataFrame | None = None) -> DataFrame:
    """``rows`` (scored articles) with the columns that are shown; those of events in ``found`` by ``primary_id`` = ``id``.

    A summary or a reason that an article brings (summary_ko, summary_en, why_it_matters_ko) is
    shown; where it is null or empty the template's stands.
    """
    own = lambda name: F.nullif(F.trim(column_or(rows, name)), F.lit(""))
    none = F.array().cast("array<string>")
    tags, title, excerpt = F.coalesce("tags", none), F.coalesce("title", F.lit("")), F.coalesce("excerpt", F.lit(""))
    source = F.coalesce(own("source"), own("publisher"), F.lit(""))
    shown_tags = visible_tags(tags)
    summary = F.coalesce(own("summary_ko"), display.summary_ko(title, excerpt, F.col("category"), shown_tags, source))
    low = facets.region_text(title, F.col("url"), excerpt, F.coalesce(own("summary_ko"), F.lit("")), tags)
    topical = F.lower(F.concat_ws(" ", title, excerpt, F.array_join(tags, " ")))
    primary = F.coalesce(own("primary_category"), own("category"), F.lit("general"))
    out = scoring.reasons(rows).withColumns(
        {
            "title_en": display.clean_title(title),
            "title_ko": display.title_ko(title, excerpt, F.coalesce(own("summary_ko"), F.lit("")), tags, F.col("category"), source, lexicon),
            "factual_summary_ko": display.factual_summary_ko(summary),
            "factual_summary_en": F.coalesce(F.trim(F.regexp_replace(own("summary_en"), r"\s*\[Why it matters:.*?\]", "")), F.nullif(display.trimmed(excerpt), F.lit("")), F.lit(NO_SUMMARY_EN)),
            "key_points": display.key_points(title, excerpt, F.coalesce(column_or(rows, "entities", None, "array<string>"), none), F.coalesce(column_or(rows, "topics", None, "array<string>"), none), tags, source),
            "signal_ko": display.business_signal(title, excerpt),
            "signal_en": display.business_signal(title, excerpt, "en"),
            "why_ko": F.coalesce(own("why_it_matters_ko"), F.col("reason_ko")),
            "why_en": F.col("reason_en"),
            "category_ko": category_name(primary),
            "category_en": category_name(primary, "en"),
            "region_keys": facets.region_keys(low),
            "counted_regions": facets.counted_regions(low),
            "topic_keys": facets.topic_keys(topical),
            "kind": facets.source_facet(F.col("source_type"), column_or(rows, "is_official", False, "boolean")),
            "publisher_shown": F.coalesce(own("publisher"), own("source"), F.lit(NO_PUBLISHER)),
            "link": display.shown_url(column_or(rows, "canonical_url"), column_or(rows, "original_url"), F.col("url")),
            "time": display.shown_time(F.col("published_at")),
            "shown_tags": shown_tags,
        }
    )
    if found is None:
        return out.withColumn("coverage", F.lit(None).cast("string"))
    return out.join(coverage(found).select(F.col("primary_id").alias("id"), F.col("label").alias("coverage")), "id", "left")


def page(rows: DataFrame, lexicon: Lexicon, found: DataFrame | None = None, members: DataFrame | None = None, per_section: int | None = None) -> DataFrame:
    """The page: primary articles (with ``members``) in their sections, leftovers included, each by priority, with all that is shown.

    ``section`` and ``rank`` give the order; ``per_section`` limits a section.
    """
    if members is not None:
        rows = rows.join(members.where("id = primary_id").select("id"), "id", "left_semi")
    placed = select.by_priority(select.with_leftovers(rows, SECTIONS), by=["section"])
    if per_section is not None:
        placed = placed.where(F.col("rank") <= per_section)
    return views(placed, lexicon, found)


def index(shown: DataFrame) -> DataFrame:
    """facet, label and n of the page: regions, topics, kinds of source and sections in one scan."""
    return facets.bundle(shown, {"region": F.col("counted_regions"), "topic": F.col("topic_keys"), "kind": F.col("kind"), "section": F.col("section")})


def filtered(shown: DataFrame, region: str | None = None, topic: str | None = None, kind: str | None = None) -> DataFrame:
    """Articles of the page that meet all facets given; ``all`` meets every one."""
    for name, column in ((region, "region_keys"), (topic, "topic_keys")):
        if name not in (None, "", "all"):
            shown = shown.where(F.array_contains(column, name))
    return shown if kind in (None, "", "all") else shown.where(F.col("kind") == kind)
