"""Feeds: catalogue, XML parsing of RSS 2.0, RDF and Atom, dates, publishers, health, warnings.

Fetching is outside the engine: payloads land in a bronze table (feed_id, payload,
status, error) or folder of files, and everything from there on is a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.functions.attribution import with_host_publisher
from storyline.functions.sources import authority
from storyline.functions.text import clean_text, slug, strip_html
from storyline.functions.urls import canonical, is_intermediary, unwrapped

FEED = "id string, name string, bucket string, url string, source_type string, authority_score int, region string, language string, enabled boolean, catalog_group string, discovery_method string"
_ITEM = "title: string, link: string, guid: struct<_VALUE: string, _isPermaLink: string>, description: string, `content:encoded`: string, pubDate: string, `dc:date`: string, source: string"
_ENTRY = "title: string, link: array<struct<_href: string, _rel: string>>, updated: string, published: string, summary: string, content: string"
#: One schema for all kinds: RSS has its items in the channel, RDF beside it, Atom has entries; a payload that isn't XML stands in ``_corrupt``.
FEED_XML = f"channel struct<title: string, item: array<struct<{_ITEM}>>>, item array<struct<{_ITEM}>>, entry array<struct<{_ENTRY}>>, _corrupt string"
FEED_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
PER_FEED = 12

# Names that aren't a publisher's.
NO_PUBLISHER = ["google news", "google"]


def catalogue(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A feed dimension; ids default to the slug of the name, columns at the end may be left out."""
    width = len(FEED.split(","))
    feeds = spark.createDataFrame([(*row, *[None] * (width - len(row))) for row in rows], FEED)
    return feeds.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), slug(F.col("name"))))


# Groups that are read daily as a whole, and other feeds that are; further names of feeds.
DAILY_GROUPS, DAILY_IDS = ["media", "institution", "aggregator"], ["unece", "eclipse_sdv"]
ALIASES = {
    "unece": ["unece_wp29", "unece_wp_29", "wp29"],
    "european_commission": ["european_commission_auto", "ec_auto"],
    "electrive_en": ["electrive"],
    "bmw": ["bmw_group"],
    "volkswagen": ["volkswagen_group", "vw"],
    "toyota": ["toyota_motor"],
    "hyundai": ["hyundai_motor"],
    "kia": ["kia_worldwide"],
    "zf": ["zf_group"],
    "magna": ["magna_international"],
    "eclipse_score": ["eclipse_s_core", "score"],
}
# What a catalogue may say.
SOURCE_TYPES = ["media", "official", "institution", "regulator", "research", "open_source", "aggregator", "press_release", "event", "news_agency", "industry_media", "specialist_media", "tech_media"]
GROUPS, METHODS = ["primary", "media", "institution", "aggregator"], ["rss", "atom", "search", "manual_web"]


def daily(feeds: DataFrame, groups: list[str] | None = None, ids: list[str] | None = None) -> DataFrame:
    """Feeds of the routine collection."""
    return feeds.where(F.col("catalog_group").isin(*(groups or DAILY_GROUPS)) | F.col("id").isin(*(ids or DAILY_IDS)))


def extra(feeds: DataFrame, groups: list[str] | None = None, ids: list[str] | None = None) -> DataFrame:
    """Feeds that the routine collection leaves out."""
    return feeds.join(daily(feeds, groups, ids).select("id"), "id", "left_anti")


def lookup(names: DataFrame, feeds: DataFrame, name: str = "name", aliases: dict[str, list[str]] | None = None, ordinal: str = "id") -> DataFrame:
    """``names`` with the id of the feed that each means (``feed_id``, null if none): by id, name or another name, whatever the notation.

    Where feeds share a key the first by ``ordinal`` counts.  The catalogue becomes a
    table of keys, so names of any number are an equi-join away.
    """
    table = ALIASES if aliases is None else aliases
    also = F.coalesce(F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in table.items() for x in kv))[F.col("id")], F.array().cast("array<string>")) if table else F.array().cast("array<string>")
    keys = feeds.select("id", F.col(ordinal).alias("o"), F.explode(F.array_distinct(F.concat(F.array("id", slug(F.col("id")), slug(F.col("name"))), also))).alias("_key"))
    first = keys.where("_key <> ''").groupBy("_key").agg(F.min(F.struct("o", "id")).alias("f"))
    plain = first.select(F.col("_key").alias("_slug"), F.col("f").alias("_by_slug"))
    exact = first.select(F.col("_key").alias("_raw"), F.col("f").alias("_by_raw"))
    rows = names.withColumn("_slug", slug(F.col(name))).join(plain, "_slug", "left").join(exact, F.col(name) == F.col("_raw"), "left")
    found = F.least("_by_slug", "_by_raw")["id"]
    return rows.withColumn("feed_id", found).drop("_slug", "_raw", "_by_slug", "_by_raw")


def enabled(feeds: DataFrame, group: str | None = None) -> DataFrame:
    feeds = feeds.where("enabled")
    return feeds.where(F.col("catalog_group") == group) if group else feeds


def problems(feeds: DataFrame) -> DataFrame:
    """Violations of the catalogue's rules: (id, problem)."""
    checks = {
        "no name": F.coalesce("name", F.lit("")) == "",
        "no url": ~F.coalesce("url", F.lit("")).rlike("^https?://"),
        "no id": F.coalesce("id", F.lit("")) == "",
        "authority out of range": ~F.coalesce("authority_score", F.lit(-1)).between(0, 100),
        "unknown source type": ~F.coalesce("source_type", F.lit("")).isin(*SOURCE_TYPES),
        "unknown group": F.col("catalog_group").isNotNull() & ~F.col("catalog_group").isin(*GROUPS),
        "unknown method": F.col("discovery_method").isNotNull() & ~F.col("discovery_method").isin(*METHODS),
    }
    rows = feeds.select("id", F.explode(F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items())), lambda x: x.isNotNull())).alias("problem"))
    for key in ("id", "url"):
        rows = rows.unionByName(feeds.groupBy(key).agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1").select(F.col("first").alias("id"), F.lit(f"duplicate {key}").alias("problem")))
    return rows


def rfc822(value: Column) -> Column:
    """A date of RSS as a UTC timestamp; other notations (also ISO) are null."""
    value = F.regexp_replace(F.trim(value), r"^[A-Za-z]{3},\s*", "")
    named = F.regexp_replace(value, r"\s(GMT|UTC|UT|Z)$", " +0000")
    bare = F.when(named.rlike(r":\d{2}$"), F.concat(named, F.lit(" +0000"))).otherwise(named)
    return F.try_to_timestamp(F.regexp_replace(bare, r"^(\d) ", "0$1 "), F.lit("dd MMM yyyy HH:mm:ss xx"))


def _items(x: Column) -> Column:
    """Items of a parsed payload in order: title, link, summary, date, item_source."""
    first = lambda *cs: F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in cs))
    # a guid is a link unless it says that it isn't
    guid = lambda e: F.when(F.lower(F.coalesce(e["guid"]["_isPermaLink"], F.lit("true"))) != "false", e["guid"]["_VALUE"])
    # the first link to the page itself, else the first
    href = lambda e: F.coalesce(F.get(F.filter(e["link"], lambda h: F.coalesce(h["_rel"], F.lit("alternate")) == "alternate"), F.lit(0)), F.get(e["link"], F.lit(0)))["_href"]
    made = lambda title, link, summary, date, source: F.struct(title.alias("title"), link.alias("link"), summary.alias("summary"), date.alias("date"), source.alias("item_source"))
    rss = lambda e: made(e["title"], first(e["link"], guid(e)), first(e["description"], e["content:encoded"]), F.coalesce(e["pubDate"], e["dc:date"]), e["source"])
    atom = lambda e: made(e["title"], href(e), first(e["summary"], e["content"]), F.coalesce(e["published"], e["updated"]), F.lit(None).cast("string"))
    parts = [F.transform(x["channel"]["item"], rss), F.transform(x["item"], rss), F.transform(x["entry"], atom)]
    return F.concat(*(F.coalesce(p, F.array().cast("array<struct<title:string,link:string,summary:string,date:string,item_source:string>>")) for p in parts))


def read(bronze: DataFrame) -> DataFrame:
    """``bronze`` (feed_id, payload, more) with ``well_formed`` and ``items``, parsed once.

    RSS, RDF and Atom are read by one schema, with the namespaced fields of their items.
    Of a payload that isn't well-formed (cut short, a bare ``&``) the items that are whole and well-formed
    count nonetheless: each is parsed on its own, with the namespaces that the feed declares.  No payload, no items.
    """
    rows = bronze.withColumn("_x", F.from_xml("payload", FEED_XML, FEED_OPTIONS))
    rows = rows.withColumn("well_formed", F.col("payload").isNotNull() & F.col("_x").isNotNull() & F.col("_x._corrupt").isNull())
    declared = F.array_join(F.array_distinct(F.regexp_extract_all("payload", F.lit(r"""xmlns:\w+=(?:"[^"]*"|'[^']*')"""), F.lit(0))), " ")
    pieces = F.when(~F.col("well_formed"), F.regexp_extract_all("payload", F.lit(r"(?s)<(item|entry)[\s>].*?</\1>"), F.lit(0)))
    whole = lambda piece: F.from_xml(F.concat(F.lit("<x "), declared, F.lit(">"), piece, F.lit("</x>")), FEED_XML, FEED_OPTIONS)
    saved = F.flatten(F.transform(pieces, lambda piece: _items(whole(piece))))
    return rows.withColumn("items", F.coalesce(F.when(F.col("well_formed"), _items(F.col("_x"))).otherwise(saved), F.array())).drop("_x")


def parsed(bronze: DataFrame, per_feed: int | None = None) -> DataFrame:
    """Entries of payloads (feed_id, payload): title, link, summary, published_at, item_source, pos.

    Items without a title or link are left out; ``per_feed`` limits what is looked at of each
    feed, these items included.
    """
    items = F.col("items") if per_feed is None else F.slice("items", 1, per_feed)
    rows = read(bronze).select("feed_id", F.posexplode(items).alias("pos", "e"))
    return rows.select("feed_id", "pos", "e.title", "e.link", "e.summary", rfc822(F.col("e.date")).alias("published_at"), "e.item_source").where("coalesce(title, '') <> '' and coalesce(link, '') <> ''")


def with_publisher(rows: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Adds publisher, discovered_via and source_authority to items (title, link, item_source) with their feed's columns.

    The publisher is the item's own, else for aggregators the end of the title, the one
    whose host the link has, or "Unknown"; else the feed.  One that isn't the feed has the
    authority of its name, the feed its own.
    """
    url = unwrapped(F.col("link"))
    aggregator = (F.col("source_type") == "aggregator") | F.contains("feed_url", F.lit("google.com")) | F.contains("name", F.lit("Google News"))
    said = lambda c: F.when(~F.lower(c).isin("", *NO_PUBLISHER), c)
    own, suffix = said(F.trim("item_source")), said(F.trim(F.regexp_extract("title", r"\s+[-|–—]\s+([^-|–—]+)$", 1)))
    netloc = F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1))
    rows = with_host_publisher(rows, F.when(aggregator & ~F.contains(netloc, F.lit("google.")), netloc), hosts, "_by_host")
    rows = rows.withColumns({"publisher": F.coalesce(own, F.when(aggregator, F.coalesce(suffix, "_by_host", F.lit("Unknown"))).otherwise(F.col("name"))), "discovered_via": F.when(aggregator, "Google News").otherwise(F.col("name"))})
    other = (F.col("publisher") != F.col("name")) & (F.col("publisher") != "Unknown")
    return rows.withColumn("source_authority", F.when(other, authority(F.col("publisher"))).otherwise(F.coalesce("authority_score", authority(F.col("publisher"))))).drop("_by_host")


def entries(bronze: DataFrame, feeds: DataFrame, per_feed: int = PER_FEED, hosts: DataFrame | None = None) -> DataFrame:
    """Feed entries with publisher, canonical URL and excerpt, of the first ``per_feed`` items of each feed."""
    rows = parsed(bronze, per_feed)
    dim = feeds.select(F.col("id").alias("feed_id"), "name", "bucket", "source_type", "authority_score", F.col("url").alias("feed_url"))
    rows = with_publisher(rows.join(dim, "feed_id"), hosts)
    return rows.select(
        "feed_id", "pos", "title", F.col("link").alias("url"), canonical(F.col("link")).alias("canonical_url"), F.col("name").alias("source"), "publisher", "discovered_via", "bucket", "source_type",
        "source_authority", "published_at", strip_html(F.col("summary")).alias("excerpt"), is_intermediary(unwrapped(F.col("link"))).alias("is_indirect"),
    )


def health(bronze: DataFrame, feeds: DataFrame) -> DataFrame:
    """One row for each feed: ok, status, number of entries, diagnosis.  Malformed payloads without entries fail; well-formed empty ones are ok."""
    usable = lambda e: (F.coalesce(e["title"], F.lit("")) != "") & (F.coalesce(e["link"], F.lit("")) != "")
    fetched = read(bronze).select("feed_id", "status", "error", "well_formed", F.size("items").alias("n_items"), F.size(F.filter("items", usable)).cast("long").alias("n_entries"))
    manual = F.coalesce(F.col("discovery_method") == "manual_web", F.lit(False))
    rows = feeds.select(F.col("id").alias("feed_id"), "name", manual.alias("_manual")).join(fetched, "feed_id", "left").withColumn("n_entries", F.coalesce("n_entries", F.lit(0)))
    # pages that people read need only answer
    answered = F.col("error").isNull() & F.coalesce(F.col("status") < 400, F.lit(False))
    rows = rows.withColumn("n_entries", F.when(F.col("_manual"), 0).otherwise(F.col("n_entries")))
    ok = F.when(F.col("_manual"), answered).otherwise(F.col("error").isNull() & F.coalesce(F.col("status") == 200, F.lit(False)) & (F.coalesce("well_formed", F.lit(False)) | (F.coalesce("n_items", F.lit(0)) > 0)))
    said = (
        F.when(F.col("status").isNull() & F.col("error").isNull(), "not fetched")
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("_manual") & answered, "ok")
        .when(F.col("status") != 200, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .when(~ok, "malformed")
        .when(F.col("n_entries") == 0, "empty")
        .otherwise("ok")
    )
    return rows.select("feed_id", "name", ok.alias("ok"), "status", "n_entries", said.alias("diagnosis"))


# What the warnings of a collection say.
PARSE_FAILED, NO_PUBLISHER_FOUND = "피드 파싱 실패", "출처(publisher) 식별 실패"


def warnings(bronze: DataFrame, feeds: DataFrame, found: DataFrame) -> DataFrame:
    """feed_id and warning: of feeds that failed, and of items in ``found`` (:func:`entries`) whose publisher isn't known."""
    failed = health(bronze, feeds).where(~F.col("ok") & (F.col("diagnosis") != "not fetched"))
    why = F.when(F.col("diagnosis") == "malformed", F.lit(PARSE_FAILED)).otherwise(F.col("diagnosis"))
    lost = found.where("publisher = 'Unknown'")
    return failed.select("feed_id", F.concat("name", F.lit(": "), why).alias("warning")).unionByName(lost.select("feed_id", F.concat("source", F.lit(f": {NO_PUBLISHER_FOUND} - "), clean_text(F.col("title"), 60)).alias("warning")))
