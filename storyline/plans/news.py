"""Named queries with the domain's own lists and rules, and their SQL.

The tables hold invented words.  So that names, signals and rules occur, each document
becomes an article with names and phrases put before its first line and its whole
text, chosen by its id; everything else is the operators' work over all documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.functions import attribution as A
from storyline.functions import entities as E
from storyline.functions import facets
from storyline.functions import features as X
from storyline.functions import fixed_values as V
from storyline.operators import events, scoring, select, taxonomy
from storyline.plans import display, presentation, view
from storyline.sources import feeds, rules, store

Query = Callable[[SparkSession, str], DataFrame]
LEXICON = E.Lexicon.standard()
NAMES = [*LEXICON.aliases()]
PHRASES = [
    "unveils zonal architecture platform for its next EV",
    "recalls vehicles over airbag defect after NHTSA probe",
    "to invest $2 billion in battery gigafactory",
    "and partners announce joint venture for autonomous driving",
    "reports quarterly profit and revenue guidance",
    "explained: what is an OTA update",
    "faces tariff investigation in Germany and the U.S.",
    "shows robotaxi with AI cockpit at CES 2026",
    "proud to announce charging network in Seoul, Korea",
    "has 16 GB RAM, leather seats and a white lotus badge",
    "ransomware attack stops assembly plant in Japan",
    "names new CEO, cuts jobs - Example Wire",
    "소프트웨어 중심 자동차 전략 발표",
    "Classic AUTOSAR supplier wins contract in China",
]
PUBLISHERS = ["Reuters", "Automotive News", "NHTSA", "Toyota Newsroom", "PR Newswire", "Blog", "McKinsey", "BMW Group", "Google News", "Eclipse SDV"]
KINDS = ["media", "official", "regulator", "research", "press_release", "institution", "event", "open_source", "aggregator"]
TAGS = ["SDV", "BMW", "Bosch", "예정", "event_start:2026-01-06", "EV", "Software", "Regulation"]
HOSTS = ["news.example.org", "www.google.com", "example.eu", "news.google.com"]


def picked(values: list[str], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(i, F.lit(len(values))).cast("int"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article for each document."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = picked(NAMES, i * 7)
    whole = i % 3
    return docs.select(
        "doc_id",
        F.concat_ws(" ", F.when(whole == 0, F.upper(name)).otherwise(name), picked(PHRASES, i), F.substring(F.split(text, "\n")[0], 1, 240)).alias("title"),
        F.concat(picked(NAMES, i * 5 + 3), F.lit(" said "), text).alias("excerpt"),
        F.lit("").alias("content"),
        F.array(picked(TAGS, i), picked(TAGS, F.floor(i / 5))).alias("tags"),
        F.when(i % 4 == 0, F.array(picked(NAMES, i * 11))).otherwise(F.array().cast("array<string>")).alias("entities"),
        picked(PUBLISHERS, i).alias("source"),
        picked(PUBLISHERS, F.floor(i / 3)).alias("publisher"),
        picked(KINDS, i).alias("source_type"),
        (i % 10 == 0).alias("is_official"),
        F.concat(F.lit("https://"), picked(HOSTS, i), F.lit("/a/"), F.floor(i / 2).cast("string")).alias("url"),
        picked(V.CATEGORIES, i).alias("category"),
        picked(V.CATEGORIES, F.floor(i / 7)).alias("primary_category"),
        F.timestamp_seconds(F.lit(1704067200) + i * 60).alias("published_at"),
        F.when(i % 6 == 0, 90).otherwise(70).alias("source_authority"),
        (i % 9 == 0).alias("repeats"),
    )


# --- SQL of the same -----------------------------------------------------------------------------


def s(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strings(values: list[str]) -> str:
    return "[" + ", ".join(map(s, values)) + "]" if values else "[]::VARCHAR[]"


def pick(values: list[str], i: str) -> str:
    return f"({strings(values)})[({i}) % {len(values)} + 1]"


N = f"""WITH d0 AS (SELECT doc_id AS i, coalesce(text, '') AS text FROM documents), n AS (SELECT i AS doc_id,
  CASE WHEN i % 3 = 0 THEN upper({pick(NAMES, "i * 7")}) ELSE {pick(NAMES, "i * 7")} END || ' ' || {pick(PHRASES, "i")} || ' ' || substring(string_split(text, chr(10))[1], 1, 240) AS title,
  {pick(NAMES, "i * 5 + 3")} || ' said ' || text AS excerpt, [{pick(TAGS, "i")}, {pick(TAGS, "i // 5")}] AS tags,
  CASE WHEN i % 4 = 0 THEN [{pick(NAMES, "i * 11")}] ELSE []::VARCHAR[] END AS entities, {pick(PUBLISHERS, "i")} AS source, {pick(PUBLISHERS, "i // 3")} AS publisher,
  {pick(KINDS, "i")} AS source_type, i % 10 = 0 AS is_official, 'https://' || {pick(HOSTS, "i")} || '/a/' || (i // 2) AS url,
  {pick(V.CATEGORIES, "i")} AS category, {pick(V.CATEGORIES, "i // 7")} AS primary_category, TIMESTAMP '2024-01-01' + i * INTERVAL 1 MINUTE AS published_at,
  CASE WHEN i % 6 = 0 THEN 90 ELSE 70 END AS source_authority, i % 9 = 0 AS repeats FROM d0)"""


def is_plain(word: str) -> bool:
    return not re.search(r"[^a-zA-Z0-9\s\-._/]", word)


def word_sql(low: str, words: list[str]) -> str:
    plain = [w for w in words if is_plain(w)]
    found = [f"regexp_matches({low}, {s('(^|[^a-z0-9])(' + '|'.join(re.escape(w.lower()) for w in plain) + ')([^a-z0-9]|$)')})"] if plain else []
    return "(" + " OR ".join([*found, *(f"contains({low}, {s(w.lower())})" for w in words if not is_plain(w))]) + ")"


def alias_sql(text: str, alias: str) -> str:
    found = word_sql(f"lower({text})", [alias])
    if alias not in E.BRAND_PATTERNS:
        return found
    low = f"lower({text} || ' ' || {text})"
    upper = f"regexp_matches({text}, {s(chr(92) + 'b' + re.escape(alias.upper()) + chr(92) + 'b')})" if alias in V.UPPERCASE_ALIASES else "true"
    return f"({found} AND CASE WHEN regexp_matches({low}, {s(E.brand_pattern(alias, "for"))}) THEN true WHEN regexp_matches({low}, {s(E.brand_pattern(alias, "against"))}) THEN false ELSE {upper} END)"


def ids_sql(text: str, aliases: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {alias_sql(text, a)} THEN {s(i)} END" for a, i in aliases) + "], lambda x: x IS NOT NULL)"


def entity_sql(text: str, e: E.Entity) -> str:
    return "(" + " OR ".join(alias_sql(text, w) for w in e.words()) + ")"


def flat(pattern: str) -> str:
    """A pattern without look-around, which only asks for borders."""
    return pattern.replace("(?<![A-Za-z0-9])", "(^|[^A-Za-z0-9])").replace("(?![A-Za-z0-9])", "([^A-Za-z0-9]|$)")


LETTER = r"[\p{L}\p{N}_]"


def bordered(pattern: str) -> str:
    r"""A pattern between two \b with borders for which every letter counts, as in Spark."""
    return rf"(^|[^{LETTER[1:]})" + pattern.removeprefix(r"\b").removesuffix(r"\b") + rf"([^{LETTER[1:]}|$)"


def region_sql(low: str, terms: list[str]) -> str:
    whole = "|".join(re.escape(t) for t in terms if not t.endswith(" "))
    found = [f"regexp_matches({low}, {s('(^|[^a-z0-9])(' + whole + ')([^a-z0-9]|$)')})"]
    return "(" + " OR ".join([*found, *(f"contains({low} || ' ', {s(t)})" for t in terms if t.endswith(" "))]) + ")"


def case_sql(low: str, cases: list[tuple[list[str], str]], other: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains({low}, {s(w)})" for w in words) + f" THEN {s(said)}" for words, said in cases)
    return f"CASE {whens} ELSE {other} END"


def by_sql(key: str, table: dict[str, str], other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {s(k)} THEN {s(v)}" for k, v in table.items()) + f" ELSE {other} END"


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- facets ---------------------------------------------------------------------------------------------

R = {k: region_sql("low", v) for k, v in V.REGION_TERMS.items()}
REGIONS_SQL = f"{N}, r0 AS (SELECT doc_id, lower(title || ' ' || url || ' ' || excerpt || ' ' || '' || ' ' || array_to_string(tags, ' ')) AS low FROM n), r AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in R.items())} FROM r0)"


def _regions(spark, sf_dir) -> DataFrame:
    low = facets.region_text(F.col("title"), F.col("url"), F.col("excerpt"), F.lit(""), F.col("tags"))
    return news(spark, sf_dir).select("doc_id", low.alias("low"))


@query(f"""{REGIONS_SQL} SELECT doc_id, array_to_string(list_filter(['all', CASE WHEN us THEN 'us' END, CASE WHEN europe OR germany THEN 'europe' END, CASE WHEN germany THEN 'germany' END, CASE WHEN korea THEN 'korea' END,
  CASE WHEN korea OR asia THEN 'asia' END, CASE WHEN NOT (us OR europe OR germany OR korea OR asia) THEN 'global' END], lambda x: x IS NOT NULL), ',') AS regions FROM r""")
def news_regions(spark, sf_dir):
    return _regions(spark, sf_dir).select("doc_id", F.array_join(facets.region_keys(F.col("low")), ",").alias("regions"))


@query(f"""{REGIONS_SQL}, c AS (SELECT count(*) AS a, count(*) FILTER (WHERE us) AS us, count(*) FILTER (WHERE europe) AS europe, count(*) FILTER (WHERE asia) AS asia, count(*) FILTER (WHERE NOT (us OR europe OR asia)) AS g,
  count(*) FILTER (WHERE germany) AS germany, count(*) FILTER (WHERE korea) AS korea FROM r)
SELECT unnest(['all', 'europe', 'germany', 'korea', 'us', 'global', 'asia']) AS label, unnest([a, europe, germany, korea, us, g, asia]) AS n FROM c""")
def region_facets(spark, sf_dir):
    return facets.counts(_regions(spark, sf_dir).withColumn("keys", facets.counted_regions(F.col("low"))), F.col("keys"), V.REGIONS)


TOPIC_LOW = "lower(title || ' ' || excerpt || ' ' || array_to_string(tags, ' '))"


@query(f"{N}, t AS (SELECT {TOPIC_LOW} AS low FROM n) SELECT 'all' AS label, count(*) AS n FROM t " + " ".join(f"UNION ALL SELECT {s(k)}, count(*) FROM t WHERE {' OR '.join(f'contains(low, {s(x)})' for x in v)}" for k, v in V.TOPIC_TERMS.items()))
def topic_facets(spark, sf_dir):
    low = F.lower(F.concat_ws(" ", "title", "excerpt", F.array_join("tags", " ")))
    rows = news(spark, sf_dir).select(facets.topic_keys(low).alias("keys"))
    return facets.counts(rows, F.col("keys"), list(V.TOPIC_TERMS))


FACET_SQL = "CASE WHEN is_official OR source_type IN ('official', 'event') THEN 'official' WHEN source_type IN ('regulator', 'research') THEN source_type WHEN source_type IN ('institution', 'open_source') THEN 'institution' ELSE 'media' END"


@query(f"{N}, f AS (SELECT {FACET_SQL} AS k FROM n) SELECT label, CASE label WHEN 'all' THEN (SELECT count(*) FROM f) ELSE (SELECT count(*) FROM f WHERE k = label) END AS n FROM (SELECT unnest(['all', 'media', 'official', 'institution', 'regulator', 'research']) AS label)")
def source_facets(spark, sf_dir):
    rows = news(spark, sf_dir).select(F.array(facets.source_facet(F.col("source_type"), F.col("is_official"))).alias("keys"))
    return facets.counts(rows, F.col("keys"), V.SOURCE_FACETS)


# --- index bundle ------------------------------------------------------------------------------------

BUNDLE_SQL = f"""{N}, r AS (SELECT *, lower(title || ' ' || excerpt || ' ' || array_to_string(tags, ' ')) AS low, {FACET_SQL} AS kind FROM n)
SELECT 'kind' AS facet, kind AS label, count(*) AS n FROM r GROUP BY kind
UNION ALL SELECT 'section', category, count(*) FROM r GROUP BY category
""" + " ".join(f"UNION ALL SELECT 'topic', {s(k)}, count(*) FROM r WHERE {' OR '.join(f'contains(low, {s(x)})' for x in v)} HAVING count(*) > 0" for k, v in V.TOPIC_TERMS.items())


@query(BUNDLE_SQL + " UNION ALL SELECT 'all', 'all', count(*) FROM r HAVING count(*) > 0")
def news_index_bundle(spark, sf_dir):
    """Counts by kind of source, section and topic, and of all, in one scan."""
    low = F.lower(F.concat_ws(" ", "title", "excerpt", F.array_join("tags", " ")))
    rows = news(spark, sf_dir).select(facets.source_facet(F.col("source_type"), F.col("is_official")).alias("kind"), F.col("category").alias("section"), facets.topic_keys(low).alias("topics"))
    return facets.bundle(rows, {"kind": F.col("kind"), "section": F.col("section"), "topic": F.col("topics")})


# --- attribution of sources --------------------------------------------------------------------------

SAID = ["", "via Reuters", "(AFP) reports", "according to Automotive News", "courtesy of  Bloomberg", "written by AP,", "Evia Reuters", "(yonhap)", "VIA yonhap", "reported by dow jones", "from associated press", "byreuters"]
NAMED = [*PUBLISHERS, "reuters", "yna", "WSJ Pro", "Thomson Reuters", "", "EPA", "Financial Times", "electrive", "The FTC Blog", " AP News "]
VIA = ["", "Reuters", "Google News", "AP", "Wire"]
HOST_HEADS = ["", "www.", "m.", "not", "news.example."]
HOST_TAILS = [*A.PUBLISHER_HOSTS, "example.org", "reuters.com.evil.example", "co.kr"]


def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All articles with publishers of many names and credits in their texts."""
    i, rows = F.col("doc_id"), news(spark, sf_dir)
    return rows.withColumns(
        {
            "id": i, "position": i, "priority_score": (i % 101).cast("int"), "publisher": picked(NAMED, F.floor(i / 2)), "discovered_via": picked(VIA, F.floor(i / 3)),
            "content": F.concat("excerpt", F.lit(" via Bloomberg")), "excerpt": F.concat(picked(SAID, i), F.lit(" "), F.col("excerpt")),
        }
    )


CANON = "(VALUES " + ", ".join(f"({s(k)}, {s(v)})" for k, v in A.PUBLISHERS.items()) + ")"
WIRE = "coalesce(" + ", ".join(f"nullif(lower(trim(regexp_extract(said, {s('(?i)' + p)}, 1))), '')" for p in A.CREDITS) + ")"
ORIGIN_SQL = f"""{N}, w AS (
  SELECT *, title || ' ' || {pick(SAID, "doc_id")} || ' ' || excerpt || ' ' || substring(excerpt || ' via Bloomberg', 1, 500) AS said,
         trim(coalesce(nullif({pick(NAMED, "doc_id // 2")}, ''), nullif(source, ''), 'Unknown')) AS own, {pick(VIA, "doc_id // 3")} AS discovered, doc_id % 101 AS priority FROM n
), x AS (SELECT *, {WIRE} AS wire, CASE WHEN contains(lower(discovered), 'reuters') OR contains(lower(discovered), 'bloomberg') OR contains(lower(discovered), 'ap') THEN discovered END AS via FROM w),
o AS (
  SELECT x.*, coalesce(c.canonical, upper(wire[1]) || wire[2:], via, own) AS origin FROM x LEFT JOIN {CANON} c(key, canonical) ON c.key = coalesce(wire, lower(via), lower(own))
)"""


@query(ORIGIN_SQL + " SELECT doc_id, origin FROM o")
def news_origins(spark, sf_dir):
    return A.with_origin(attributed(spark, sf_dir)).select("doc_id", "origin")


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {s(w)})" for w in words) + ")"


@query(f"""{ORIGIN_SQL}, m AS (SELECT *, min(doc_id) OVER (PARTITION BY doc_id // 5) AS p, source_type IN ('official', 'press_release') OR is_official AS off FROM o),
f AS (SELECT *, min(CASE WHEN off THEN doc_id END) OVER (PARTITION BY p) AS first_off FROM m),
g AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY CASE WHEN doc_id = p THEN 0 WHEN doc_id = first_off THEN 1 ELSE 2 END, doc_id) AS place FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY p, lower(own) ORDER BY place) AS again FROM g)
SELECT p AS primary_id, CAST(count(*) AS INT) AS source_count, CAST(least(count(*), count(DISTINCT lower(origin))) AS INT) AS independent_sources, bool_or(off) AS has_official,
  bool_or(source_type = 'regulator' OR {_any("lower(own)", A.REGULATORS)}) AS has_regulator, bool_or({_any("lower(own)", A.MAJOR_MEDIA)}) AS has_major_media,
  max(CASE WHEN doc_id = first_off THEN url END) AS official_url, max(CASE WHEN doc_id = first_off THEN own END) AS official_name, max(CASE WHEN doc_id = p THEN own END) AS reference_name,
  CAST(max(priority) AS INT) AS importance, string_agg(own, '|' ORDER BY place) FILTER (WHERE again = 1) AS related_sources
FROM h GROUP BY p""")
def news_agreement(spark, sf_dir):
    """Agreement of sources: every five documents are an event, whose first is primary."""
    rows = attributed(spark, sf_dir)
    first = rows.groupBy(F.floor(F.col("doc_id") / 5).alias("g")).agg(F.min("doc_id").alias("primary_id"))
    members = rows.select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 5).alias("g")).join(first, "g").select("id", "primary_id", F.lit(1.0).alias("similarity"))
    found = events.events(rows, members).withColumn("related_sources", F.array_join("related_sources", "|"))
    return found.select("primary_id", "source_count", "independent_sources", "has_official", "has_regulator", "has_major_media", "official_url", "official_name", "reference_name", "importance", "related_sources")


@query(f"""WITH h AS (SELECT page_id, {pick(HOST_HEADS, "page_id")} || {pick(HOST_TAILS, "page_id // 5")} AS host FROM pages)
SELECT page_id, CASE {" ".join(f"WHEN ends_with(host, {s(k)}) THEN {s(v)}" for k, v in A.PUBLISHER_HOSTS.items())} END AS publisher FROM h""")
def host_publishers(spark, sf_dir):
    i = F.col("page_id")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat(picked(HOST_HEADS, i), picked(HOST_TAILS, F.floor(i / 5))).alias("host"))
    return A.with_host_publisher(pages, F.col("host"), name="publisher").select("page_id", "publisher")


# --- entities, topics, categories --------------------------------------------------------------------------

_EVERY, _OTHERS = E.aliases_by_length(LEXICON), E.aliases_by_length(LEXICON, tuple(V.MEDIA_ENTITIES))
_MAKERS = E.aliases_by_length(LEXICON, tuple(V.MEDIA_ENTITIES), ("oem", "tier1", "battery", "tech", "regulator"))
_KNOWN = f"MAP({strings(list(LEXICON.aliases()))}, {strings(list(LEXICON.aliases().values()))})"
_GROUPED = [e for e in LEXICON.entities if e.group]
_GROUP = f"MAP({strings([e.id for e in _GROUPED])}, {strings([e.group.lower() for e in _GROUPED])})"


def _new(found: str, held: str) -> str:
    return f"list_distinct(list_filter({found}, lambda x: NOT list_contains({held}, x)))"


@query(f"""{N}, m1 AS (SELECT *, list_distinct({ids_sql("title", _EVERY)}) AS a, map_extract({_KNOWN}, lower(trim(coalesce(entities[1], ''))))[1] AS own FROM n),
m2 AS (SELECT *, CASE WHEN own IS NULL OR list_contains({strings(V.MEDIA_ENTITIES)}, own) OR list_contains(a, own)
    OR len(list_filter(a, lambda x: contains(coalesce(map_extract({_GROUP}, x)[1], ''), own) OR contains(coalesce(map_extract({_GROUP}, x)[1], ''), replace(own, '_', ' ')))) > 0 THEN []::VARCHAR[] ELSE [own] END AS b FROM m1),
m3 AS (SELECT *, {_new(ids_sql("array_to_string(tags, ' ')", _OTHERS), "(a || b)")} AS c FROM m2), m4 AS (SELECT *, {_new(ids_sql("excerpt", _OTHERS), "(a || b || c)")} AS d FROM m3),
m5 AS (SELECT *, CASE WHEN is_official OR source_type = 'official' THEN {_new(ids_sql("(source || ' ' || publisher)", _MAKERS), "(a || b || c || d)")} ELSE []::VARCHAR[] END AS e FROM m4)
SELECT doc_id, array_to_string(list_sort(list_transform(a, lambda x: x || ':title:100') || list_transform(b || c, lambda x: x || ':explicit_article_entity:95') || list_transform(d, lambda x: x || ':rss_summary:90')
  || list_transform(e, lambda x: x || ':publisher_attribution:95')), ',') AS matches FROM m5""")
def entity_stages(spark, sf_dir):
    rows = E.with_entity_matches(news(spark, sf_dir), LEXICON)
    each = F.transform("entity_matches", lambda m: F.concat_ws(":", m["entity"], m["source"], m["confidence"].cast("string")))
    return rows.select("doc_id", F.array_join(F.array_sort(each), ",").alias("matches"))


_AI_SQL = f"(regexp_matches(body, {s(flat(V.AI_UPPER))}) OR regexp_matches(body, {s('(?i)' + '|'.join(map(flat, V.AI_PHRASES)))}))"
_T_FLAGS = ", ".join(f"{word_sql('low', list(t.words))} AS t{i}" for i, t in enumerate(LEXICON.topics))
_T_LIST = f"CASE WHEN ai THEN ['AI'] ELSE [] END || " + " || ".join(f"CASE WHEN t{i} THEN {strings([t.name, *t.implied])} ELSE [] END" for i, t in enumerate(LEXICON.topics))
TOPICS_SQL = f"{N}, b0 AS (SELECT *, title || ' ' || excerpt AS body, lower(title || ' ' || excerpt) AS low FROM n), b1 AS (SELECT *, {_AI_SQL} AS ai, {_T_FLAGS} FROM b0), b AS (SELECT * EXCLUDE ({', '.join(f't{i}' for i in range(len(LEXICON.topics)))}), list_distinct({_T_LIST}) AS topics FROM b1)"


def _topics(spark, sf_dir) -> DataFrame:
    rows = news(spark, sf_dir).withColumn("text", F.concat_ws(" ", "title", "excerpt"))
    return rows.withColumn("topics", E.topics(F.col("text"), LEXICON))


@query(f"{TOPICS_SQL} SELECT doc_id, array_to_string(list_sort(topics), ',') AS topics FROM b")
def news_topics(spark, sf_dir):
    return _topics(spark, sf_dir).select("doc_id", F.array_join(F.array_sort("topics"), ",").alias("topics"))


_KINDS_OF = {k: [e for e in LEXICON.entities if e.kind == k] for k in dict.fromkeys(e.kind for e in LEXICON.entities)}
_KIND_FLAGS = "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(entity_sql('body', e) for e in es)} THEN {s(k)} END" for k, es in _KINDS_OF.items()) + "], lambda x: x IS NOT NULL)"


def _rule_sql(r: taxonomy.Rule) -> str:
    has = []
    if r.topics:
        has.append(f"list_has_any(topics, {strings(list(r.topics))})")
    if r.words:
        has.append(word_sql("low", list(r.words)))
    has += [f"contains(low, {s(x)})" for x in r.substrings]
    if r.entity_kinds:
        has.append(f"list_has_any(kinds, {strings(list(r.entity_kinds))})")
    if r.source_types:
        has.append(f"source_type IN ({', '.join(map(s, r.source_types))})")
    if r.buckets:
        has.append(f"category IN ({', '.join(map(s, r.buckets))})")
    each = f" + {r.each} * len(list_intersect(topics, {strings(list(r.topics))}))" if r.each else ""
    return f"CASE WHEN {' OR '.join(has)} THEN {r.points}{each} ELSE 0 END"


def _points_sql(category: str) -> str:
    own = [_rule_sql(r) for r in taxonomy.RULES if r.category == category]
    return " + ".join([*own, f"CASE WHEN category = {s(category)} THEN {taxonomy.BUCKET_POINTS} ELSE 0 END"] if category != "big" else [*own, "0"])


_RANKED = "list_sort(list_filter([" + ", ".join(f"{{'m': -({_points_sql(c)}), 'i': {i}, 'c': {s(c)}}}" for i, c in enumerate(V.CATEGORIES)) + "], lambda x: x.m < 0))"


@query(f"""{TOPICS_SQL}, k AS (SELECT *, {_KIND_FLAGS} AS kinds FROM b), p AS (SELECT doc_id, kinds, {_RANKED} AS p FROM k),
o AS (SELECT doc_id, coalesce(p[1].c, 'big') AS primary_category, list_transform(list_filter(p[2:], lambda x: x.m <= -15), lambda x: x.c) AS others,
  CASE WHEN list_contains(kinds, 'oem') THEN ['oem'] ELSE [] END || CASE WHEN list_has_any(kinds, ['tier1', 'battery', 'tech']) THEN ['tier1'] ELSE [] END AS named FROM p)
SELECT doc_id, primary_category, array_to_string((list_filter(others || list_filter(named, lambda x: NOT list_contains(others, x)), lambda x: x <> primary_category))[1:4], ',') AS secondary FROM o""")
def news_categories(spark, sf_dir):
    rows = _topics(spark, sf_dir).drop("primary_category")
    done = taxonomy.classified(rows.withColumns({"entity_kinds": E.entity_kinds(F.col("text"), LEXICON), "bucket": F.col("category")}))
    return done.select("doc_id", "primary_category", F.array_join("secondary_categories", ",").alias("secondary"))


# --- scores and order ------------------------------------------------------------------------------------------

REF_TIME = "2024-01-02 00:00:00"
_NAME = "lower(publisher)"
_STANDING = (
    f"CASE WHEN {_NAME} IN ('공식 뉴스룸', 'unknown') THEN 500 WHEN source_type IN ('regulator', 'institution') OR regexp_matches({_NAME}, 'nhtsa|epa|unece|iso|sae') THEN 950"
    f" WHEN regexp_matches({_NAME}, 'reuters|bloomberg|associated press|ap news') THEN 930 WHEN regexp_matches({_NAME}, 'automotive news|wardsauto|green car congress|electrek|heise autos|insideevs') THEN 880"
    f" WHEN source_type IN ('official', 'press_release') OR contains({_NAME}, 'newsroom') THEN 850 WHEN source_type = 'research' THEN 880 WHEN source_type = 'open_source' OR regexp_matches({_NAME}, 'eclipse|linux foundation|soafee') THEN 850"
    f" WHEN source_type = 'aggregator' OR contains({_NAME}, 'google') THEN 550 ELSE 750 END"
)
_CORE = " + ".join(f"CAST(list_contains(tag_low, {s(t)}) OR {word_sql('low', [t])} AS INT)" for t in V.CORE_TOPICS)
_SIG = " + ".join(f"CAST(regexp_matches(low, {s(bordered(p))}) AS INT)" for p in V.IMPACT_SIGNALS)
NEWS_SCORES = f"""{N}, x0 AS (SELECT *, lower(title || ' ' || excerpt) AS low, list_transform(tags, lambda t: lower(t)) AS tag_low, {_STANDING} AS standing FROM n),
x1 AS (SELECT *, {_CORE} AS core, {_SIG} AS sig FROM x0),
x2 AS (SELECT *, CAST(least(1000, greatest(100, CASE WHEN source_authority <> 70 THEN standing / 2.0 + source_authority * 5 ELSE standing END)) AS INT) AS source_score,
  CAST(least(1000, greatest(100, CASE WHEN category IN ('sdv', 'software', 'cybersecurity') THEN 650 WHEN category IN ('adas_autonomous', 'ev_battery') THEN 600 WHEN category IN ('oem', 'tier1', 'regulation', 'supply_chain', 'manufacturing') THEN 350 ELSE 250 END + least(core * 120, 450))) AS INT) AS relevance_score,
  CAST(least(1000, greatest(100, CASE WHEN category IN ('oem', 'tier1', 'manufacturing', 'supply_chain', 'ev_battery') THEN 350 WHEN category IN ('big', 'regulation', 'market') THEN 420 ELSE 250 END + least(sig * 180, 550))) AS INT) AS impact_score,
  CAST(least(1000, greatest(100, 900 - CASE WHEN regexp_matches(lower(title), {s(bordered(V.EVERGREEN))}) THEN 350 WHEN regexp_matches(low, {s(bordered(V.EVERGREEN))}) THEN 200 ELSE 0 END
    - CASE WHEN regexp_matches(low, {s(bordered(V.PROMOTION))}) AND sig = 0 THEN 200 ELSE 0 END - CASE WHEN repeats THEN 300 ELSE 0 END)) AS INT) AS novelty_score,
  CAST(greatest(50, least(1000, round(pow(0.5, greatest(0, (epoch_us(TIMESTAMP '{REF_TIME}') - epoch_us(published_at)) / 3.6e9) / 36.0) * 1000))) AS INT) AS recency_score FROM x1),
x3 AS (SELECT *, relevance_score * 30 + impact_score * 25 + source_score * 20 + recency_score * 15 + novelty_score * 10
  + greatest(CASE WHEN impact_score >= 650 AND source_score >= 850 THEN 20000 ELSE 0 END, CASE WHEN relevance_score >= 800 AND impact_score >= 450 THEN 15000 ELSE 0 END)
  - CASE WHEN relevance_score < 400 AND impact_score < 400 THEN 10000 ELSE 0 END AS total FROM x2),
x4 AS (SELECT *, CAST(least(1000, greatest(100, total // 100 + CASE WHEN total % 100 > 50 OR (total % 100 = 50 AND (total // 100) % 2 = 1) THEN 1 ELSE 0 END)) AS INT) AS priority_score FROM x3),
x AS (SELECT *, CASE WHEN priority_score >= 800 THEN 'critical' WHEN priority_score >= 600 THEN 'high' WHEN priority_score >= 450 THEN 'medium' ELSE 'watch' END AS level FROM x4)"""


def _scored(spark, sf_dir) -> DataFrame:
    rows = news(spark, sf_dir).withColumn("text", F.concat_ws(" ", "title", "excerpt"))
    return scoring.with_scores(rows, F.lit(REF_TIME).cast("timestamp"))


@query(f"{NEWS_SCORES} SELECT doc_id, source_score, relevance_score, impact_score, novelty_score, recency_score, priority_score, level FROM x")
def news_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "source_score", "relevance_score", "impact_score", "novelty_score", "recency_score", "priority_score", "level")


_LEVEL = "CASE level WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
_SECTION = "CASE " + " ".join(f"WHEN category IN ({', '.join(map(s, cs))}) OR primary_category IN ({', '.join(map(s, cs))}) THEN {i}" for i, (_, cs) in enumerate(presentation.SECTIONS)) + " END"
SECTIONED = f"""{NEWS_SCORES}, y0 AS (SELECT *, {_SECTION} AS i FROM x), y1 AS (SELECT *, min(i) OVER (PARTITION BY url) AS least FROM y0),
y AS (SELECT *, CASE WHEN least IS NULL THEN CASE WHEN source_type IN ('regulator', 'institution') THEN 'regulation' ELSE 'market' END ELSE ({strings([k for k, _ in presentation.SECTIONS])})[i + 1] END AS section FROM y1 WHERE i = least OR least IS NULL)"""


@query(f"""{SECTIONED} SELECT doc_id, section, rank FROM (SELECT doc_id, section, CAST(row_number() OVER (PARTITION BY section ORDER BY {_LEVEL} DESC,
  CAST(priority_score // 10 + CASE WHEN priority_score % 10 > 5 OR (priority_score % 10 = 5 AND (priority_score // 10) % 2 = 1) THEN 1 ELSE 0 END AS INT) DESC, priority_score DESC, published_at DESC, doc_id) AS INT) AS rank FROM y) WHERE rank <= 5""")
def news_sections(spark, sf_dir):
    """The first five of each section, leftovers included."""
    rows = select.with_leftovers(_scored(spark, sf_dir), presentation.SECTIONS)
    return select.by_priority(rows, arrival="doc_id", by=["section"]).where("rank <= 5").select("doc_id", "section", "rank")


@query(f"{SECTIONED} SELECT section, count(*) AS n FROM y GROUP BY section")
def news_section_sizes(spark, sf_dir):
    return select.with_leftovers(_scored(spark, sf_dir), presentation.SECTIONS).groupBy("section").agg(F.count("*").alias("n"))


_SAID = [("impact_score >= 650 AND source_score >= 850", scoring.AUTHORITY_REASON), ("relevance_score >= 800 AND impact_score >= 450", scoring.SOFTWARE_REASON)]
_SAID += [(f"{name}_score BETWEEN {least} AND {most}", texts) for name, least, most, *texts in scoring.REASONS]
_SAID.append(("relevance_score < 400 AND impact_score < 400", scoring.FAINT_REASON))
_WHY = ["list_filter([" + ", ".join(f"CASE WHEN {c} THEN {s(t[i])} END" for c, t in _SAID) + "], lambda x: x IS NOT NULL)" for i in (0, 1)]


@query(f"""{NEWS_SCORES}, w AS (SELECT doc_id, {_WHY[0]} AS ko, {_WHY[1]} AS en FROM x) SELECT doc_id, CASE WHEN len(ko) = 0 THEN {s(scoring.OTHER_REASON[0])} ELSE array_to_string(ko[1:3], ' · ') END AS reason_ko,
  CASE WHEN len(en) = 0 THEN {s(scoring.OTHER_REASON[1])} ELSE array_to_string(en[1:3], ' · ') END AS reason_en, greatest(len(en), 1) AS n FROM w""")
def news_reasons(spark, sf_dir):
    return scoring.reasons(_scored(spark, sf_dir)).select("doc_id", "reason_ko", "reason_en", F.size("reasons_en").cast("long").alias("n"))


@query(f"""{NEWS_SCORES}, m AS (SELECT doc_id, category, min(doc_id) OVER (PARTITION BY url) AS primary_id FROM n)
SELECT doc_id, array_to_string(list_filter(list_sort(list(doc_id) OVER (PARTITION BY primary_id)), lambda i: i <> doc_id), ',') AS related FROM m""".replace(NEWS_SCORES, N))
def news_related(spark, sf_dir):
    """Articles with one URL as one event, named by the smallest id."""
    rows = news(spark, sf_dir).select("doc_id", "url")
    members = rows.join(rows.groupBy("url").agg(F.min("doc_id").alias("primary_id")), "url").select(F.col("doc_id").alias("id"), "primary_id")
    return events.related(members).select(F.col("id").alias("doc_id"), F.array_join(F.transform("related_ids", lambda i: i.cast("string")), ",").alias("related"))


@query(f"""{N}, g AS (SELECT url, count(*) AS n, min(least(1.0, (doc_id % 17) / 10.0)) AS least FROM n GROUP BY url) SELECT CAST(sum(n) AS BIGINT) AS articles, count(*) AS events, count(*) FILTER (WHERE n > 1) AS multi_article_events,
  count(*) FILTER (WHERE n = 1) AS singletons, count(*) FILTER (WHERE NOT (n > 1 AND least < 0.65)) AS healthy, count(*) FILTER (WHERE n > 1 AND least < 0.65) AS suspicious, round_even(coalesce(avg(CASE WHEN n > 1 THEN least END), 0.0), 3) AS mean_coherence FROM g""")
def event_diagnosis(spark, sf_dir):
    i = F.col("doc_id") % 17
    found = news(spark, sf_dir).groupBy("url").agg(F.count("*").alias("n"), F.min(F.least(F.lit(1.0), i / 10)).alias("mean"))
    doubts = F.filter(F.array(F.when((F.col("n") > 1) & (F.col("mean") < V.SAME_MEMBER), F.lit("weak member"))), lambda x: x.isNotNull())
    return events.diagnosis(found.withColumn("doubts", doubts))


# --- texts that readers see ----------------------------------------------------------------------------------------

_LOW = "lower(title || ' ' || excerpt)"
_SIGNAL_KO = case_sql(_LOW, [(w, ko) for w, ko, _ in V.BUSINESS_SIGNALS], s(V.OTHER_BUSINESS_SIGNAL[0]))
_SIGNAL_EN = case_sql(_LOW, [(w, en) for w, _, en in V.BUSINESS_SIGNALS], s(V.OTHER_BUSINESS_SIGNAL[1]))
_NO_FIELD = f"list_filter(tags, lambda t: NOT list_contains({strings(V.FIELD_TAGS)}, t))"
_FIELD = f"list_filter(tags, lambda t: list_contains({strings(V.FIELD_TAGS)}, t))"
_SUMMARY = f"""CASE WHEN len({_NO_FIELD}) > 0 THEN array_to_string({_NO_FIELD}[1:3], ', ') ELSE source END || ' 관련 ' || {by_sql('category', V.CATEGORY_LABELS, s(V.OTHER_CATEGORY_LABEL))}
  || ' 뉴스입니다. 핵심 신호는 ' || {_SIGNAL_KO} || '이며, ' || {by_sql('category', V.IMPACT_SENTENCES, s(V.OTHER_IMPACT))} || '.'"""


@query(f"""{N} SELECT doc_id, {_SUMMARY} AS summary_ko, {_SIGNAL_EN} AS signal_en, array_to_string(list_filter([
  CASE WHEN len(entities) > 0 THEN '주요 기업 및 기관: ' || array_to_string(entities[1:4], ', ') WHEN len({_NO_FIELD}) > 0 THEN '주요 기업 및 기관: ' || array_to_string({_NO_FIELD}[1:4], ', ') ELSE '출처: ' || source END,
  CASE WHEN len({_FIELD}) > 0 THEN '핵심 기술·주제: ' || array_to_string({_FIELD}[1:4], ', ') END, '산업 신호: ' || {_SIGNAL_KO}], lambda x: x IS NOT NULL), '|') AS key_points FROM n""")
def news_summaries(spark, sf_dir):
    title, excerpt, tags, source = (F.col(c) for c in ("title", "excerpt", "tags", "source"))
    points = display.key_points(title, excerpt, F.col("entities"), F.array().cast("array<string>"), tags, source)
    return news(spark, sf_dir).select(
        "doc_id", display.summary_ko(title, excerpt, F.col("category"), tags, source).alias("summary_ko"), display.business_signal(title, excerpt, "en").alias("signal_en"), F.array_join(points, "|").alias("key_points")
    )


_CLEAN = f"regexp_replace(trim(regexp_replace(title, '\\s+', ' ', 'g')), {s(V.SOURCE_SUFFIX)}, '')"
_VISIBLE = f"list_filter(tags, lambda t: NOT starts_with(t, 'event_start:') AND NOT starts_with(t, 'event_end:') AND NOT list_contains({strings(V.GENERIC_TAGS)}, t))"
_DISPLAY_NAMES = [e.name for kinds in (("oem",), ("tier1", "battery", "tech"), ("institution", "regulator"), ("conference",)) for e in LEXICON.of_kinds(*kinds)]
_SUBJECT = (
    f"CASE WHEN len({_VISIBLE}) > 0 THEN array_to_string({_VISIBLE}[1:2], ', ') "
    + " ".join(f"WHEN regexp_matches(t, {s('(?i)(^|[^A-Za-z0-9])' + re.escape(n) + '([^A-Za-z0-9]|$)')}) THEN {s(n)}" for n in _DISPLAY_NAMES)
    + f" ELSE {by_sql('category', V.SUBJECTS_BY_CATEGORY, 'source')} END"
)
# a dot is no letter, so the border after "a.i." asks for a letter to follow
_AI_HEADLINE = bordered(V.AI_HEADLINE[0]).replace(r"a\.i\.|", "") + rf"|(^|[^{LETTER[1:]})a\.i\.{LETTER}"
_PLAIN_HEADLINE = f"CASE WHEN regexp_matches(h, {s(_AI_HEADLINE)}) THEN {s(V.AI_HEADLINE[1])} ELSE {by_sql('category', V.HEADLINES_BY_CATEGORY, s(V.OTHER_HEADLINE))} END"
_HEADLINE = f"CASE WHEN category = 'conference' THEN {case_sql('h', V.CONFERENCE_HEADLINES, s(V.OTHER_CONFERENCE_HEADLINE))} ELSE {case_sql('h', V.HEADLINES, _PLAIN_HEADLINE)} END"


@query(f"""{N}, c0 AS (SELECT *, {_CLEAN} AS t FROM n), c AS (SELECT *, lower(t || ' ' || excerpt || '  ' || array_to_string(tags, ' ')) AS h FROM c0)
SELECT doc_id, t AS title_en, CASE WHEN regexp_matches(t, '[가-힣]') AND (category = 'conference' OR length(t) <= 90) THEN t ELSE {_SUBJECT} || ': ' || {_HEADLINE} END AS title_ko,
  CASE WHEN contains(url, 'google.com') THEN NULL ELSE url END AS link, strftime(published_at, '%Y-%m-%d %H:%M') AS time FROM c""")
def news_titles(spark, sf_dir):
    made = display.title_ko(F.col("title"), F.col("excerpt"), F.lit(""), F.col("tags"), F.col("category"), F.col("source"), LEXICON)
    none = F.lit(None).cast("string")
    return news(spark, sf_dir).select("doc_id", display.clean_title(F.col("title")).alias("title_en"), made.alias("title_ko"), display.shown_url(none, none, F.col("url")).alias("link"), display.shown_time(F.col("published_at")).alias("time"))


# --- features of events -------------------------------------------------------------------------------------------------


def _theme_sql(terms: list[str]) -> str:
    return "|".join(rf"(^|[^{LETTER[1:]})" + re.escape(t) + (rf"([^{LETTER[1:]}|$)" if t in V.ACRONYMS else "") for t in terms)


@query(f"{N}, l AS (SELECT doc_id, lower(title || ' ' || excerpt) AS low FROM n) SELECT doc_id, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(low, {s(_theme_sql(v))}) THEN {s(k)} END" for k, v in V.THEMES.items()) + "], lambda x: x IS NOT NULL)), ',') AS themes, array_to_string(CASE WHEN regexp_matches(low, " + s("|".join(map(bordered, V.RECALL_PATTERNS))) + ") THEN list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(low, {s('|'.join(map(re.escape, v)))}) THEN {s(k)} END" for k, v in V.DEFECTS.items()) + "], lambda x: x IS NOT NULL)) ELSE []::VARCHAR[] END, ',') AS defects FROM l")
def news_themes(spark, sf_dir):
    text = F.concat_ws(" ", "title", "excerpt")
    return news(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(X.themes(text)), ",").alias("themes"), F.array_join(F.array_sort(X.defects(text)), ",").alias("defects"))


# --- rules ----------------------------------------------------------------------------------------------------------------

ROBOTS = [
    ("http://example.org", 1, "*", False, "/es/"),
    ("https://m.example.com", 1, "*", False, "/"),
]


@query(f"{N} SELECT doc_id, NOT (category = 'conference' OR source_type IN ('reference', 'static') OR primary_category IN ('reference', 'conference')) AS allowed FROM n")
def page_fetch_rule(spark, sf_dir):
    allowed = rules.page_fetch_allowed(F.col("category"), F.col("source_type"), F.col("primary_category"), F.lit("media"))
    return news(spark, sf_dir).select("doc_id", allowed.alias("allowed"))


_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"
_PATH = "coalesce(nullif(regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1), ''), '/')"


@query(f"""WITH p AS (SELECT page_id, {_ORIGIN} AS origin, {_PATH} AS path FROM pages), h AS (SELECT DISTINCT origin FROM p WHERE origin <> ''),
g AS (SELECT origin, CASE WHEN length(origin) % 5 = 0 THEN 403 WHEN length(origin) % 5 = 1 THEN 404 ELSE 200 END AS status FROM h)
SELECT page_id, CASE WHEN p.origin = '' THEN false WHEN status = 403 THEN false WHEN status = 404 THEN true WHEN starts_with(origin, 'https:') THEN NOT starts_with(path, '/es/') ELSE CASE WHEN starts_with(path, '/en/1') THEN true ELSE NOT starts_with(path, '/en/') END END AS may_fetch
FROM p LEFT JOIN g USING (origin)""")
def robots_rule(spark, sf_dir):
    """Every host has a policy: some forbid all, some have none, some name this agent, the others all agents."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    hosts = pages.select(F.regexp_extract("url", "^(https?://[^/?#]*)", 1).alias("origin")).where("origin <> ''").distinct()
    code = F.char_length("origin") % 5
    policies = hosts.withColumn("status", F.when(code == 0, 403).when(code == 1, 404).otherwise(200))
    secure = F.col("origin").startswith("https:")
    rule = lambda n, agent, allow, path: F.struct(F.lit(n).alias("ordinal"), F.lit(agent).alias("agent"), F.lit(allow).alias("allow"), F.lit(path).alias("path"))
    own = F.when(secure, F.array(rule(1, "*", False, "/"), rule(2, "reader", False, "/es/"))).otherwise(F.array(rule(1, "*", True, "/en/1"), rule(2, "*", False, "/en/"), rule(3, "other", False, "/")))
    table = hosts.select("origin", F.explode(own).alias("r")).select("origin", "r.*")
    return rules.with_robots(pages, policies, table, "Reader/1.0").select("page_id", "may_fetch")


_CLOCKS = ["07:30", "25:00", "12:05", " 6:15 ", "x", "23:59"]


@query(f"""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS TIMESTAMP) + o_orderkey * INTERVAL 37 MINUTE AS now, {pick(_CLOCKS, "o_orderkey")} AS clock FROM orders),
m AS (SELECT *, CASE clock WHEN '07:30' THEN 450 WHEN '12:05' THEN 725 WHEN ' 6:15 ' THEN 375 WHEN '23:59' THEN 1439 END AS due_at FROM o)
SELECT k AS o_orderkey, reason, reason IN ('forced', 'scheduled_or_catchup') AS run FROM (SELECT k, CASE WHEN k % 11 = 0 THEN 'forced' WHEN due_at IS NULL THEN 'invalid_time' WHEN hour(now) * 60 + minute(now) < due_at THEN 'before_scheduled_time' WHEN k % 3 = 0 THEN 'already_completed' ELSE 'scheduled_or_catchup' END AS reason FROM m)""")
def schedule_due(spark, sf_dir):
    key = F.col("o_orderkey")
    now = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + key * 37 * 60)
    found = rules.due(now, picked(_CLOCKS, key), key % 3 == 0, key % 11 == 0)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", found["reason"].alias("reason"), found["run"].alias("run"))


@query("SELECT o_custkey AS job, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run, max(o_orderdate) AS started_at FROM orders GROUP BY o_custkey")
def latest_runs(spark, sf_dir):
    runs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("started_at"))
    return store.latest_in_group(runs.withColumn("at", F.struct("started_at", "run")), ["job"], "at").select("job", "run", "started_at")


@query("""SELECT (SELECT count(*) FROM supplier) AS feeds_total, (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS feeds_ok, (SELECT count(*) FROM supplier WHERE NOT coalesce(s_acctbal > 0, false)) AS feeds_failed,
(SELECT count(*) FROM documents) AS articles_collected, (SELECT count(*) FROM documents WHERE lang <> 'es') AS articles_after_dedupe, (SELECT count(*) FROM documents WHERE lang = 'en') AS articles_selected, 1.2346::DOUBLE AS collection_duration""")
def run_statistics(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    feeds = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_acctbal") > 0).alias("ok"))
    return store.run_stats(feeds, docs, docs.where("lang <> 'es'"), docs.where("lang = 'en'"), 1.23456)


@query("""WITH f AS (SELECT 'feed_' || s_suppkey AS id, s_name AS name, s_suppkey AS o FROM supplier),
k AS (SELECT o, id, unnest([id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_'), CASE WHEN id = 'feed_3' THEN 'third' END]) AS key FROM f), m AS (SELECT key, arg_min(id, o) AS id FROM k WHERE key IS NOT NULL GROUP BY key),
q AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Feed ' || (doc_id % 30) WHEN 1 THEN 'SUPPLIER / 00000000' || (doc_id % 9 + 1) WHEN 2 THEN 'third' ELSE 'nobody' END AS wanted FROM documents)
SELECT doc_id, wanted, m.id AS feed_id FROM q LEFT JOIN m ON m.key = trim(regexp_replace(lower(wanted), '[^a-z0-9]+', '_', 'g'), '_')""")
def feed_lookup(spark, sf_dir):
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    catalogue = suppliers.select(F.concat(F.lit("feed_"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("o"))
    i = F.col("doc_id")
    wanted = F.when(i % 4 == 0, F.concat(F.lit("Feed "), (i % 30).cast("string"))).when(i % 4 == 1, F.concat(F.lit("SUPPLIER / 00000000"), (i % 9 + 1).cast("string"))).when(i % 4 == 2, "third").otherwise("nobody")
    names = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", wanted.alias("wanted"))
    return feeds.lookup(names, catalogue, "wanted", {"feed_3": ["third"]}, "o").select("doc_id", "wanted", "feed_id")


_DAILY = "g IN ('media', 'institution', 'aggregator') OR id IN ('unece', 'eclipse_sdv')"


@query(f"""WITH f AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'unece' ELSE 'f' || s_suppkey END AS id, (['primary', 'media', 'institution', 'aggregator', 'primary'])[s_suppkey % 5 + 1] AS g, s_suppkey % 3 <> 0 AS enabled FROM supplier)
SELECT CASE WHEN {_DAILY} THEN 'daily' ELSE 'extra' END AS subset, g AS catalog_group, count(*) AS n, count(*) FILTER (WHERE enabled) AS enabled FROM f GROUP BY ALL""")
def feed_subsets(spark, sf_dir):
    key = F.col("s_suppkey")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.when(key % 7 == 0, "unece").otherwise(F.concat(F.lit("f"), key.cast("string"))).alias("id"), picked(["primary", "media", "institution", "aggregator", "primary"], key).alias("catalog_group"), (key % 3 != 0).alias("enabled")
    )
    both = feeds.daily(rows).withColumn("subset", F.lit("daily")).unionByName(feeds.extra(rows).withColumn("subset", F.lit("extra")))
    return both.groupBy("subset", "catalog_group").agg(F.count("*").alias("n"), F.count_if("enabled").alias("enabled"))


# --- the view of an article ------------------------------------------------------------------------------------------------

_NOT_TECHNICAL = "list_filter(tags, lambda t: NOT starts_with(t, 'event_start:') AND NOT starts_with(t, 'event_end:'))"
_NAMED = {lang: by_sql("primary_category", {k: v[i] for k, v in view.CATEGORY_NAMES.items()}, "upper(primary_category)") for i, lang in enumerate(("ko", "en"))}


@query(f"""{NEWS_SCORES}, c0 AS (SELECT *, {_CLEAN} AS t, {_NOT_TECHNICAL} AS vt, {_WHY[0]} AS ko, {_WHY[1]} AS en FROM x), c AS (SELECT *, lower(t || ' ' || excerpt || '  ' || array_to_string(tags, ' ')) AS h FROM c0)
SELECT doc_id, t AS title_en, CASE WHEN regexp_matches(t, '[가-힣]') AND (category = 'conference' OR length(t) <= 90) THEN t ELSE {_SUBJECT} || ': ' || {_HEADLINE} END AS title_ko,
  {_SUMMARY.replace('(tags,', '(vt,')} AS factual_summary_ko, trim(excerpt) AS factual_summary_en, {_SIGNAL_KO} AS signal_ko, {_SIGNAL_EN} AS signal_en,
  CASE WHEN len(ko) = 0 THEN {s(scoring.OTHER_REASON[0])} ELSE array_to_string(ko[1:3], ' · ') END AS why_ko, CASE WHEN len(en) = 0 THEN {s(scoring.OTHER_REASON[1])} ELSE array_to_string(en[1:3], ' · ') END AS why_en,
  {_NAMED['ko']} AS category_ko, {_NAMED['en']} AS category_en, {FACET_SQL} AS kind, publisher AS publisher_shown, CASE WHEN contains(url, 'google.com') THEN NULL ELSE url END AS link,
  strftime(published_at, '%Y-%m-%d %H:%M') AS time, array_to_string(vt, ',') AS shown_tags FROM c""")
def news_view(spark, sf_dir):
    """All that readers see of an article."""
    shown = view.views(_scored(spark, sf_dir), LEXICON)
    plain = "doc_id title_en title_ko factual_summary_ko factual_summary_en signal_ko signal_en why_ko why_en category_ko category_en kind publisher_shown link time".split()
    return shown.select(*plain, F.array_join("shown_tags", ",").alias("shown_tags"))
