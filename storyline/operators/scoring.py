"""Scores of an article, each in whole tenths of a point so that results are exact, and its priority."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.functions import fixed_values as V
from storyline.functions.text import has_word, matches

# Weights of the components in hundredths, and the boundaries of the levels in tenths.
WEIGHTS = {"relevance": 30, "impact": 25, "source": 20, "recency": 15, "novelty": 10}
LEVELS = [("critical", 800), ("high", 600), ("medium", 450)]
HALF_LIFE_HOURS = 36.0
# Base points by category.
RELEVANT = {65: ["sdv", "software", "cybersecurity"], 60: ["adas_autonomous", "ev_battery"], 35: ["oem", "tier1", "regulation", "supply_chain", "manufacturing"]}
WEIGHTY = {42: ["big", "regulation", "market"], 35: ["oem", "tier1", "manufacturing", "supply_chain", "ev_battery"]}


def clamped(tenths: Column, low: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(1000), tenths)).cast("int")


def source_score(kind: Column, name: Column, authority: Column) -> Column:
    """Standing of a source by its kind and name, averaged with an authority other than the default 70."""
    kind, name = F.lower(F.coalesce(kind, F.lit("media"))), F.lower(F.coalesce(name, F.lit("")))
    has = lambda *words: F.lit(False) if not words else name.rlike("|".join(words))
    base = (
        F.when(name.isin("공식 뉴스룸", "unknown"), 500)
        .when(kind.isin("regulator", "institution") | has("nhtsa", "epa", "unece", "iso", "sae"), 950)
        .when(has("reuters", "bloomberg", "associated press", "ap news"), 930)
        .when(has("automotive news", "wardsauto", "green car congress", "electrek", "heise autos", "insideevs"), 880)
        .when(kind.isin("official", "press_release") | has("newsroom"), 850)
        .when(kind == "research", 880)
        .when((kind == "open_source") | has("eclipse", "linux foundation", "soafee"), 850)
        .when((kind == "aggregator") | has("google"), 550)
        .otherwise(750)
    )
    return clamped(F.when(authority.isNotNull() & (authority != 70), base / 2 + authority * 5).otherwise(base))


def relevance_score(category: Column, text: Column, tags: Column, core: list[str] | None = None, step: int = 120, most: int = 450) -> Column:
    """Base points of the category and points for each distinct core topic, tagged or in the text."""
    core = V.CORE_TOPICS if core is None else core
    lowered = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.lower(x))
    n = sum(((F.array_contains(lowered, t) | has_word(text, t)).cast("int") for t in core), F.lit(0))
    base = F.lit(250)
    for points, names in RELEVANT.items():
        base = F.when(category.isin(*names), points * 10).otherwise(base)
    return clamped(base + F.least(n * step, F.lit(most)))


def impact_score(category: Column, text: Column, signals: list[str] | None = None) -> Column:
    """Base points of the category and 18 for each kind of signal in the text, 55 at most."""
    signals = V.IMPACT_SIGNALS if signals is None else signals
    n = sum((matches(F.lower(text), s).cast("int") for s in signals), F.lit(0))
    base = F.lit(250)
    for points, names in WEIGHTY.items():
        base = F.when(category.isin(*names), points * 10).otherwise(base)
    return clamped(base + F.least(n * 180, F.lit(550)))


def novelty_score(title: Column, text: Column, repeats: Column, evergreen: str = V.EVERGREEN, promotion: str = V.PROMOTION, signals: list[str] | None = None) -> Column:
    """90, less for evergreen and promotional texts and for repeats of earlier articles."""
    signals = V.IMPACT_SIGNALS if signals is None else signals
    low = F.lower(text)
    loud = reduce(or_, (matches(low, s) for s in signals), F.lit(False))
    lasting = F.when(matches(F.lower(title), evergreen), 350).when(matches(low, evergreen), 200).otherwise(0)
    advertised = F.when(matches(low, promotion) & ~loud, 200).otherwise(0)
    return clamped(F.lit(900) - lasting - advertised - F.when(repeats, 300).otherwise(0))


def recency_score(published_at: Column, ref_time: Column, half_life: float = HALF_LIFE_HOURS) -> Column:
    """100 points halved every ``half_life`` hours, 5 at least; 50 without a date; what lies ahead counts as now."""
    hours = F.greatest(F.lit(0.0), (F.unix_micros(ref_time) - F.unix_micros(published_at)) / 3.6e9)
    return F.when(published_at.isNull(), 500).otherwise(clamped(F.bround(F.pow(F.lit(0.5), hours / max(1.0, half_life)) * 1000, 0), 50))


def priority_score(relevance: Column, impact: Column, source: Column, recency: Column, novelty: Column) -> Column:
    """Weighted sum, with a boost for weighty or relevant articles and a penalty for faint ones, rounded half to even."""
    parts = {"relevance": relevance, "impact": impact, "source": source, "recency": recency, "novelty": novelty}
    total = sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0))  # thousandths
    boost = F.greatest(F.when((impact >= 650) & (source >= 850), 20000).otherwise(0), F.when((relevance >= 800) & (impact >= 450), 15000).otherwise(0))
    total = total + boost - F.when((relevance < 400) & (impact < 400), 10000).otherwise(0)
    whole = F.floor(total / 100)
    rest = total - whole * 100
    up = (rest > 50) | ((rest == 50) & (whole % 2 == 1))
    return clamped(whole + up.cast("int"))


def level(priority: Column) -> Column:
    out = F.lit("watch")
    for name, least in reversed(LEVELS):
        out = F.when(priority >= least, name).otherwise(out)
    return out


def with_scores(articles: DataFrame, ref_time: Column, **options) -> DataFrame:
    """Adds the six scores (tenths) and the level.

    Reads category, title, text, tags, source_type, publisher, source_authority,
    published_at and repeats (whether an earlier article says the same).
    """
    core, signals = options.get("core"), options.get("signals")
    scored = articles.withColumns(
        {
            "source_score": source_score(F.col("source_type"), F.col("publisher"), F.col("source_authority")),
            "relevance_score": relevance_score(F.col("category"), F.col("text"), F.col("tags"), core),
            "impact_score": impact_score(F.col("category"), F.col("text"), signals),
            "novelty_score": novelty_score(F.col("title"), F.col("text"), F.col("repeats"), options.get("evergreen", V.EVERGREEN), options.get("promotion", V.PROMOTION), signals),
            "recency_score": recency_score(F.col("published_at"), ref_time, options.get("half_life", HALF_LIFE_HOURS)),
        }
    )
    scored = scored.withColumn("priority_score", priority_score(*(F.col(f"{k}_score") for k in ("relevance", "impact", "source", "recency", "novelty"))))
    return scored.withColumn("level", level(F.col("priority_score")))


# What an article's scores (tenths) say about it, in order: name of a score, least, most, Korean, English.
REASONS = [
    ("relevance", 700, 1000, "차량 소프트웨어·SDV 관련성 높음", "High software & SDV relevance"),
    ("relevance", 500, 699, "전동화·차량 전장 관련 이슈", "Automotive systems relevance"),
    ("impact", 650, 1000, "투자·제휴·규제 등 대형 이슈화 신호", "High industry impact (investment/partnership/regulation)"),
    ("impact", 450, 649, "사업·제휴 등 주요 이슈화 신호", "Moderate business signal (partnership/product)"),
    ("source", 880, 1000, "주요 통신사·공신력 출처", "High authority publication"),
    ("source", 800, 879, "공식 발표·전문 매체", "Official/specialized source"),
    ("recency", 700, 1000, "최근 24시간 이내 보도", "Recent publication"),
    ("novelty", 850, 1000, "독창적 신규 보도", "Fresh reporting"),
    ("novelty", 0, 500, "중복 또는 일반 해설 항목", "Previously covered / evergreen content"),
]
AUTHORITY_REASON = ("주요 출처의 대형 산업 이슈화 신호", "High-impact development from authoritative source")
SOFTWARE_REASON = ("SDV·SW 분야 핵심 협력·배치 이슈", "Strategic SDV & software initiative")
FAINT_REASON = ("관찰 항목 (낮은 관련도·영향도)", "Watch item (low relevance & impact)")
OTHER_REASON = ("일반 산업 참고 항목", "General industry reference")


def reasons(articles: DataFrame) -> DataFrame:
    """Adds reasons_ko and reasons_en, why an article ranks where it does, and reason_ko and reason_en, the first three in a line."""
    score = lambda name: F.col(f"{name}_score")
    said = [((score("impact") >= 650) & (score("source") >= 850), AUTHORITY_REASON), ((score("relevance") >= 800) & (score("impact") >= 450), SOFTWARE_REASON)]
    said += [(score(name).between(least, most), texts) for name, least, most, *texts in REASONS]
    said.append(((score("relevance") < 400) & (score("impact") < 400), FAINT_REASON))
    columns = {}
    for i, lang in enumerate(("ko", "en")):
        found = F.filter(F.array(*(F.when(c, F.lit(t[i])) for c, t in said)), lambda x: x.isNotNull())
        columns[f"reasons_{lang}"] = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(OTHER_REASON[i])))
    rows = articles.withColumns(columns)
    return rows.withColumns({f"reason_{lang}": F.array_join(F.slice(f"reasons_{lang}", 1, 3), " · ") for lang in ("ko", "en")})
