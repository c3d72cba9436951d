"""Classification into ordered categories by additive points."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.functions import fixed_values as V
from storyline.functions.text import has_any


@dataclass(frozen=True)
class Rule:
    """Points for a category: ``each`` for every one of the topics found, ``points`` if any of the rule's evidence is there."""

    category: str
    points: int
    topics: tuple[str, ...] = ()
    each: int = 0
    words: tuple[str, ...] = ()
    substrings: tuple[str, ...] = ()
    entity_kinds: tuple[str, ...] = ()
    source_types: tuple[str, ...] = ()
    buckets: tuple[str, ...] = ()


# Topics that count as software-defined vehicle.
SDV_TOPICS = (
    "SDV",
    "E/E Architecture",
    "Zonal Architecture",
    "HPC",
    "Vehicle Computer",
    "AUTOSAR",
    "Adaptive AUTOSAR",
    "Classic AUTOSAR",
    "SOA",
    "Middleware",
    "OTA",
    "Vehicle OS",
    "Android Automotive",
    "QNX",
    "Embedded Linux",
    "Yocto",
)

# Points of the categories.
RULES = [
    Rule("conference", 35, entity_kinds=("conference",), buckets=("conference",), source_types=("event",)),
    Rule("conference", 20, words=("conference", "expo", "summit", "symposium", "show", "congress")),
    Rule("cybersecurity", 36, topics=("Automotive Cybersecurity",)),
    Rule("cybersecurity", 15, substrings=("cybersecurity", "vulnerability", "hack", "iso 21434", "unece r155")),
    Rule("sdv", 32, topics=SDV_TOPICS, each=4),
    Rule("sdv", 10, substrings=("zonal", "e/e architecture", "software-defined", "sdv", "autosar")),
    Rule("adas_autonomous", 30, topics=("Autonomous Driving", "ADAS")),
    Rule("adas_autonomous", 12, substrings=("robotaxi", "self-driving", "autonomous vehicle", "adas", "fsd")),
    Rule("ev_battery", 28, topics=("Battery", "EV", "Charging")),
    Rule("ev_battery", 10, substrings=("battery", "solid-state", "lfp", "ncm", "charging", "gigafactory", "electric vehicle")),
    Rule("regulation", 26, topics=("Tariff", "Euro 7", "CO2", "Trade", "Regulation")),
    Rule("regulation", 12, source_types=("regulator",), substrings=("recall", "probe", "investigation", "tariff", "regulator", "safety standard")),
    Rule("supply_chain", 25, topics=("Supply Chain", "Semiconductor")),
    Rule("supply_chain", 10, substrings=("semiconductor", "chip shortage", "chips", "wafer", "foundry", "supply chain")),
    Rule("manufacturing", 22, topics=("Manufacturing",), substrings=("assembly plant", "production line", "factory output", "manufacturing")),
    Rule("market", 20, substrings=("sales", "deliveries", "quarterly profit", "revenue", "market share", "earnings", "guidance")),
    Rule("software", 20, topics=("DevOps", "Cloud", "CI/CD", "Functional Safety", "AI")),
    Rule("oem", 21, entity_kinds=("oem",)),
    Rule("tier1", 21, entity_kinds=("tier1", "battery", "tech")),
    Rule("institution", 18, entity_kinds=("institution", "regulator"), source_types=("research", "institution")),
]
BUCKET_POINTS, SECONDARY, MOST_SECONDARY = 4, 15, 4


@dataclass(frozen=True)
class Taxonomy:
    categories: list[str] = field(default_factory=lambda: V.CATEGORIES)
    rules: list[Rule] = field(default_factory=lambda: RULES)
    default: str = "big"


def points(rule: Rule, text: Column, topics: Column, kinds: Column, source_type: Column, bucket: Column) -> Column:
    # ``text`` is in lower case
    low = text
    found = F.lit(False)
    if rule.topics:
        found = found | F.arrays_overlap(topics, F.array(*map(F.lit, rule.topics)))
    if rule.words:
        found = found | has_any(low, list(rule.words), low)
    for s in rule.substrings:
        found = found | F.contains(low, F.lit(s))
    if rule.entity_kinds:
        found = found | F.arrays_overlap(kinds, F.array(*map(F.lit, rule.entity_kinds)))
    if rule.source_types:
        found = found | source_type.isin(*rule.source_types)
    if rule.buckets:
        found = found | bucket.isin(*rule.buckets)
    n = F.size(F.array_intersect(topics, F.array(*map(F.lit, rule.topics)))) * rule.each if rule.each else F.lit(0)
    return F.when(F.coalesce(found, F.lit(False)), n + rule.points).otherwise(0)


def classified(articles: DataFrame, taxonomy: Taxonomy | None = None, text: str = "text", topics: str = "topics", kinds: str = "entity_kinds", source_type: str = "source_type", bucket: str = "bucket") -> DataFrame:
    """Adds primary_category and secondary_categories.

    The most points win, the earlier category among equals; without points it is
    the default.  Secondary are others of 15 points or more by rank, then makers and
    suppliers that the text names, four at most.
    """
    taxonomy = taxonomy or Taxonomy()
    empty = F.array().cast("array<string>")
    t, e = F.coalesce(topics and F.col(topics), empty), F.coalesce(F.col(kinds), empty)
    scores = []
    for i, category in enumerate(taxonomy.categories):
        own = sum((points(r, F.col("_low"), t, e, F.col(source_type), F.col(bucket)) for r in taxonomy.rules if r.category == category), F.lit(0))
        if category != taxonomy.default:
            own = own + F.when(F.col(bucket) == category, BUCKET_POINTS).otherwise(0)
        scores.append(F.struct((-own).cast("int").alias("minus"), F.lit(i).alias("i"), F.lit(category).alias("category")))
    ranked = F.filter(F.array_sort(F.array(*scores)), lambda s: s["minus"] < 0)
    with_rank = articles.withColumn("_low", F.lower(text)).withColumn("_ranked", ranked).drop("_low")
    primary = F.coalesce(F.get("_ranked", F.lit(0))["category"], F.lit(taxonomy.default))
    others = F.transform(F.filter(F.slice("_ranked", 2, len(taxonomy.categories)), lambda s: s["minus"] <= -SECONDARY), lambda s: s["category"])
    named = F.filter(
        F.array(F.when(F.array_contains(e, "oem"), F.lit("oem")), F.when(F.arrays_overlap(e, F.array(*map(F.lit, ("tier1", "battery", "tech")))), F.lit("tier1"))), lambda x: x.isNotNull()
    )
    with_rank = with_rank.withColumn("primary_category", primary)
    return with_rank.withColumn("secondary_categories", F.slice(F.array_except(F.array_distinct(F.concat(others, named)), F.array("primary_category")), 1, MOST_SECONDARY)).drop("_ranked")
