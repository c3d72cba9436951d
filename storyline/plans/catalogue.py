"""Named queries over the standard tables, and their SQL equivalents.

The tables hold invented words, so taggers run with a small lexicon of frequent
ones; the operators are those of the news domain.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyline.functions import entities as E
from storyline.functions import features as X
from storyline.functions import sources as S
from storyline.functions import text as T
from storyline.functions import urls as U
from storyline.operators import dedupe, events, graph, scoring, select, similarity, taxonomy
from storyline.plans import briefing, news, presentation
from storyline.sources import feeds
from storyline.sources import pages as P
from storyline.sources import store
from storyline.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
REF_TIME = "2024-01-02 00:00:00"

LEXICON = E.Lexicon(
    [
        E.Entity("The", "the", "oem", "Articles", ("les", "der")),
        E.Entity("Of", "of", "tier1", "", ("des",)),
        E.Entity("Und", "und", "institution", "", ("que",)),
        E.Entity("With", "with", "conference", "Articles", ("avec",)),
    ],
    [E.Topic("Joining", ("and", "et"), ("Speech",)), E.Topic("Speech", ("that", "dass")), E.Topic("Place", ("in", "dans"), ("Joining", "Ground"))],
    ambiguous=False,
)
TAXONOMY = taxonomy.Taxonomy(
    ["big", "oem", "tier1", "sdv", "market", "institution"],
    [
        taxonomy.Rule("sdv", 32, topics=("Joining", "Place"), each=4),
        taxonomy.Rule("market", 36, substrings=("tion",)),
        taxonomy.Rule("market", 20, words=("on",)),
        taxonomy.Rule("oem", 21, entity_kinds=("oem",)),
        taxonomy.Rule("tier1", 41, entity_kinds=("tier1",)),
        taxonomy.Rule("institution", 18, entity_kinds=("institution",), source_types=("src1",)),
    ],
)
CORE, SIGNALS = ["the", "of", "and", "les", "und"], ["(^|[^a-z])(anat|haanth|leaux)([^a-z]|$)", "(^|[^a-z])(to|ou)([^a-z]|$)", "(^|[^a-z])the [a-z]+ing([^a-z]|$)"]
EVERGREEN, PROMOTION = "(^|[^a-z])(of the|le de)([^a-z]|$)", "(^|[^a-z])(in to|was)([^a-z]|$)"
SECTIONS = [("north", ["en"]), ("centre", ["de", "fr"])]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """Documents as articles: the first line is the title, the whole text the excerpt, ids are minutes."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id"),
        F.substring(F.split("text", "\n")[0], 1, 240).alias("title"),
        F.col("text").alias("excerpt"),
        "lang",
        "source",
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("published_at"),
    )


A = "WITH a AS (SELECT doc_id, substring(string_split(text, chr(10))[1], 1, 240) AS title, text AS excerpt, lang, source, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS published_at FROM documents)"
MARKS = r"regexp_replace(regexp_replace(title, '^\s*\[[^\]]*\]|【[^】]*】|\([^)]*\)', ' ', 'g'), '\s*[-|–—]\s*[^-|–—]+$', '')"
KEY = f"regexp_replace(lower({MARKS}), '[^a-z0-9가-힣]+', '', 'g')"
STOP = ", ".join(f"'{w}'" for w in [*T.V.STOP_WORDS, *T.TITLE_EXTRA_STOP_WORDS])
TOKENS = f"list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower({MARKS}), '[^a-z0-9가-힣]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({STOP}))))"
NUMBERS = r"list_sort(list_distinct(regexp_extract_all(lower(title), '\b[0-9]+[a-z]?\b')))"


def word_sql(text: str, *words: str) -> str:
    return f"regexp_matches(lower({text}), '(^|[^a-z0-9])({'|'.join(words)})([^a-z0-9]|$)')"


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- URLs ------------------------------------------------------------------------------

URL_SQL = r"""
WITH u AS (
  SELECT page_id, url, lower(regexp_extract(url, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?', 1)) AS scheme,
    regexp_replace(lower(regexp_extract(url, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?', 2)), ':(80|443)$', '') AS netloc,
    regexp_replace(regexp_replace(regexp_extract(url, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?', 3), '/+$', ''), '/{2,}', '/', 'g') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?', 4), '&'),
      lambda p: split_part(p, '=', 2) <> '' AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_') AND lower(split_part(p, '=', 1)) NOT IN ('ref', 'ref_src', 'ref_url', 'fbclid', 'gclid'))) AS kept
  FROM pages)
"""


@query(URL_SQL + "SELECT page_id, scheme || '://' || netloc || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url FROM u")
def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.canonical(F.col("url")).alias("canonical_url"))


@query(URL_SQL + "SELECT netloc AS host, count(*) AS n FROM u GROUP BY netloc")
def url_host_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(URL_SQL + "SELECT page_id, netloc AS host FROM u WHERE NOT ends_with(netloc, 'google.com') AND starts_with(netloc, 'm.')")
def url_mobile_direct(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").withColumn("host", U.host(F.col("url")))
    return select.direct_only(rows, U.is_intermediary(F.col("url"))).where(F.col("host").startswith("m.")).select("page_id", "host")


@query(URL_SQL + ", c AS (SELECT page_id, netloc || path AS k FROM u) SELECT min(page_id) AS page_id, k AS url_key, count(*) AS copies FROM c GROUP BY k")
def url_exact_dedupe(spark, sf_dir):
    key = F.regexp_extract(U.canonical(F.col("url")), r"^[a-z]+://([^?]*)", 1)
    return table(spark, sf_dir, "pages").groupBy(F.regexp_replace(key, "/$", "").alias("url_key")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


@query("SELECT DISTINCT source, 'https://news.google.com/rss/search?q=' || source || '&hl=en-US&gl=US&ceid=US:en' AS feed_url FROM documents")
def search_feed_urls(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", U.search_feed(F.col("source")).alias("feed_url")).distinct()


# --- text ------------------------------------------------------------------------------


@query(f"{A} SELECT doc_id, {KEY} AS title_key, len({TOKENS}) AS n_tokens, array_to_string({TOKENS}, ' ') AS tokens, array_to_string({NUMBERS}, ' ') AS numbers FROM a")
def title_features(spark, sf_dir):
    rows = dedupe.with_title_features(articles(spark, sf_dir))
    return rows.select("doc_id", "title_key", F.size("title_tokens").cast("long").alias("n_tokens"), F.array_join("title_tokens", " ").alias("tokens"), F.array_join("title_numbers", " ").alias("numbers"))


@query(r"""WITH c AS (SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(text, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE rtrim(substring(t, 1, 239)) || '…' END AS excerpt FROM c""")
def clean_excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("excerpt"))


@query("SELECT doc_id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9가-힣]+', ' ', 'g')), ' '), lambda w: length(w) > 2 AND w NOT IN ('the','and','for','with','from','that','this','are','was','has')))) AS tokens FROM documents")
def simple_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.simple_tokens(F.col("text")).alias("tokens"))


@query("SELECT page_id, 'art_' || substring(sha256(trim(url)), 1, 16) AS article_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM pages")
def article_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.hashed_id("art_", F.col("url")).alias("article_id"), T.slug(F.col("url")).alias("slug"))


@query("SELECT doc_id, length(text) > 1000 AS cut, CASE WHEN length(text) <= 1000 THEN text ELSE regexp_replace(substring(text, 1, 1000), ' [^ ]*$', '') || '…' END AS body FROM documents")
def text_cut_at_word(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (F.char_length("text") > 1000).alias("cut"), T.cut_at_word(F.col("text"), 1000).alias("body"))


@query(f"{A}, s AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ({STOP})))) AS w FROM a) SELECT doc_id, len(w) AS n_words FROM s")
def title_word_counts(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9]+"), F.lit(0))
    stop = F.array(*map(F.lit, T.V.STOP_WORDS + T.TITLE_EXTRA_STOP_WORDS))
    kept = F.filter(F.array_except(words, stop), lambda w: (F.char_length(w) > 1) & ~w.rlike("^[0-9]+$"))
    return articles(spark, sf_dir).select("doc_id", F.size(kept).cast("long").alias("n_words"))


# --- de-duplication ----------------------------------------------------------------------


@query(f"{A}, k AS (SELECT doc_id, lang, {KEY} AS title_key FROM a) SELECT doc_id, lang, title_key FROM (SELECT *, row_number() OVER (PARTITION BY title_key ORDER BY doc_id) AS n FROM k WHERE title_key <> '') WHERE n = 1")
def exact_dedupe(spark, sf_dir):
    rows = articles(spark, sf_dir).select("doc_id", "lang", T.title_key(F.col("title")).alias("title_key"))
    return dedupe.first_of_each(rows, ["title_key"], ["doc_id"])


@query(f"{A}, k AS (SELECT doc_id, source, {KEY} AS title_key FROM a) SELECT doc_id, title_key FROM k WHERE source <> 'src0' AND title_key NOT IN (SELECT title_key FROM k WHERE source = 'src0' AND title_key <> '')")
def history_antijoin(spark, sf_dir):
    rows = articles(spark, sf_dir).select("doc_id", "source", T.title_key(F.col("title")).alias("title_key"))
    return dedupe.unseen(rows.where("source <> 'src0'"), rows.where("source = 'src0'"), ["title_key"]).select("doc_id", "title_key")


NEAR = f"""{A}, w AS (SELECT doc_id, {TOKENS} AS t, {NUMBERS} AS n FROM a), f AS (SELECT t, n, min(doc_id) AS rep FROM w WHERE len(t) >= 3 GROUP BY t, n),
x AS (SELECT rep, unnest(t) AS token FROM f),
p AS (SELECT l.rep AS a, r.rep AS b, count(*) AS c FROM x l JOIN x r ON l.token = r.token AND l.rep < r.rep GROUP BY ALL),
pairs AS (SELECT p.a AS "left", p.b AS "right" FROM p JOIN f u ON u.rep = p.a JOIN f v ON v.rep = p.b
  WHERE u.n = v.n AND ((c >= 4 AND (c * 5 >= greatest(len(u.t), len(v.t)) * 4 OR c * 20 >= least(len(u.t), len(v.t)) * 17)) OR (c >= 3 AND least(len(u.t), len(v.t)) >= 4 AND c * 4 >= (len(u.t) + len(v.t) - c) * 3)))"""


@query(NEAR + ' SELECT "left", "right" FROM pairs')
def near_title_pairs(spark, sf_dir):
    return dedupe.near_pairs(articles(spark, sf_dir), "doc_id")


@query(NEAR.replace("WITH a", "WITH RECURSIVE a") + ', e AS (SELECT "left" AS x, "right" AS y FROM pairs UNION ALL SELECT "right", "left" FROM pairs), r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT x AS node, least(x, min(y)) AS component FROM r GROUP BY x')
def near_title_components(spark, sf_dir):
    return graph.connected_components(dedupe.near_pairs(articles(spark, sf_dir), "doc_id"))


MEMBERS = ", g AS (SELECT x AS node, least(x, min(y)) AS component FROM r GROUP BY x) SELECT w.doc_id, CASE WHEN len(w.t) >= 4 THEN coalesce(g.component, f.rep) ELSE w.doc_id END AS component FROM w LEFT JOIN f ON f.t = w.t AND f.n = w.n LEFT JOIN g ON g.node = f.rep"


@query(SQL["near_title_components"].partition(" SELECT x AS node")[0] + MEMBERS)
def near_title_members(spark, sf_dir):
    """The component of every document, copies included; one without a near-equal title is its own."""
    return dedupe.near_groups(articles(spark, sf_dir), "doc_id").select(F.col("id").alias("doc_id"), "component")


@query()
def greedy_dedupe(spark, sf_dir):
    rows = articles(spark, sf_dir).select(F.col("doc_id").alias("ord"), "title", F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("canonical_url"), F.col("lang").alias("bucket"))
    return dedupe.deduped(rows).select("ord", "title_key")


@query("""WITH p AS (SELECT lang AS p, source AS g, count(*) AS n FROM documents GROUP BY ALL), k AS (
SELECT (SELECT sum(n * (n - 1) // 2) FROM p) AS b, (SELECT sum(n * (n - 1) // 2) FROM (SELECT sum(n) AS n FROM p GROUP BY p)) AS q, (SELECT sum(n * (n - 1) // 2) FROM (SELECT sum(n) AS n FROM p GROUP BY g)) AS g)
SELECT CAST(b AS BIGINT) AS both, CAST(q AS BIGINT) AS predicted, CAST(g AS BIGINT) AS gold, CAST(q - b AS BIGINT) AS false_merges, CAST(g - b AS BIGINT) AS false_splits, CAST(floor(b * 1000000 / q) AS BIGINT) AS precision, CAST(floor(b * 1000000 / g) AS BIGINT) AS recall, CAST(floor(b * 2000000 / (q + g)) AS BIGINT) AS f1 FROM k""")
def cluster_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return graph.pair_quality(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("cluster")), docs.select(F.col("doc_id").alias("id"), F.col("source").alias("cluster")))


# --- entities, topics, categories --------------------------------------------------------------

ENT = {"the": ("the", "les", "der"), "of": ("of", "des"), "und": ("und", "que"), "with": ("with", "avec")}
ENT_SQL = "list_filter([" + ", ".join(f"CASE WHEN {word_sql('excerpt', *w)} THEN '{k}' END" for k, w in ENT.items()) + "], lambda x: x IS NOT NULL)"
TOPIC_SQL = (
    "(CASE WHEN {j} THEN ['Joining'] ELSE [] END || CASE WHEN {s} THEN ['Speech'] ELSE [] END || CASE WHEN {p} THEN ['Place'] ELSE [] END"
    " || CASE WHEN {j} AND NOT {s} THEN ['Speech'] ELSE [] END || CASE WHEN {p} AND NOT {j} THEN ['Joining'] ELSE [] END || CASE WHEN {p} THEN ['Ground'] ELSE [] END)"
).format(j=word_sql("excerpt", "and", "et"), s=word_sql("excerpt", "that", "dass"), p=word_sql("excerpt", "in", "dans"))


@query(f"{A} SELECT doc_id, array_to_string({ENT_SQL}, ',') AS entities FROM a")
def entity_match(spark, sf_dir, whole=False):
    return articles(spark, sf_dir, whole).select("doc_id", F.array_join(E.entity_ids(F.col("excerpt"), LEXICON), ",").alias("entities"))


@query(f"{A} SELECT doc_id, array_to_string({TOPIC_SQL}, ',') AS topics FROM a")
def topic_implications(spark, sf_dir, whole=False):
    return articles(spark, sf_dir, whole).select("doc_id", F.array_join(E.topics(F.col("excerpt"), LEXICON), ",").alias("topics"))


@query(f"{A}, e AS (SELECT unnest({ENT_SQL}) AS id FROM a) SELECT id AS entity_id, CASE WHEN id IN ('the', 'with') THEN 'Articles' END AS parent_group, count(*) AS n FROM e GROUP BY ALL")
def entity_groups(spark, sf_dir, whole=False):
    found = articles(spark, sf_dir, whole).select(F.explode(E.entity_ids(F.col("excerpt"), LEXICON)).alias("entity_id")).groupBy("entity_id").agg(F.count("*").alias("n"))
    dim = E.alias_table(spark, LEXICON).select("entity_id", "parent_group").distinct()
    return found.join(F.broadcast(dim), "entity_id").select("entity_id", "parent_group", "n")


def _classified(spark, sf_dir, whole: bool = False) -> DataFrame:
    rows = articles(spark, sf_dir, whole).withColumn("topics", E.topics(F.col("excerpt"), LEXICON))
    kinds = E.entity_kinds(F.col("excerpt"), LEXICON)
    return taxonomy.classified(rows.withColumns({"entity_kinds": kinds, "source_type": F.col("source"), "bucket": F.lit("oem")}), TAXONOMY, "excerpt")


CAT_SQL = f"""{A}, t AS (SELECT doc_id, {TOPIC_SQL} AS topics, {ENT_SQL} AS ents, lower(excerpt) AS low, source FROM a),
s AS (SELECT doc_id, ents, [
  {{'m': -(CASE WHEN list_contains(ents, 'the') THEN 21 ELSE 0 END + 4), 'i': 1, 'c': 'oem'}},
  {{'m': -(CASE WHEN list_contains(ents, 'of') THEN 41 ELSE 0 END), 'i': 2, 'c': 'tier1'}},
  {{'m': -(CASE WHEN len(list_intersect(topics, ['Joining', 'Place'])) > 0 THEN 32 + 4 * len(list_intersect(topics, ['Joining', 'Place'])) ELSE 0 END), 'i': 3, 'c': 'sdv'}},
  {{'m': -(CASE WHEN contains(low, 'tion') THEN 36 ELSE 0 END + CASE WHEN {word_sql('low', 'on')} THEN 20 ELSE 0 END), 'i': 4, 'c': 'market'}},
  {{'m': -(CASE WHEN list_contains(ents, 'und') OR source = 'src1' THEN 18 ELSE 0 END), 'i': 5, 'c': 'institution'}}] AS p FROM t),
r AS (SELECT doc_id, ents, list_sort(list_filter(p, lambda x: x.m < 0)) AS p FROM s),
o AS (SELECT doc_id, p[1].c AS primary_category, list_transform(list_filter(p[2:], lambda x: x.m <= -15), lambda x: x.c) AS others,
  CASE WHEN list_contains(ents, 'the') THEN ['oem'] ELSE [] END || CASE WHEN list_contains(ents, 'of') THEN ['tier1'] ELSE [] END AS named FROM r)
SELECT doc_id, primary_category, array_to_string((list_filter(others || list_filter(named, lambda x: NOT list_contains(others, x)), lambda x: x <> primary_category))[1:4], ',') AS secondary FROM o"""


@query(CAT_SQL)
def taxonomy_categories(spark, sf_dir, whole=False):
    return _classified(spark, sf_dir, whole).select("doc_id", "primary_category", F.array_join("secondary_categories", ",").alias("secondary"))


@query(r"""SELECT doc_id, CASE WHEN r AND i THEN 'RECALL_AND_INVESTIGATION' WHEN r THEN 'RECALL' WHEN i THEN 'INVESTIGATION' ELSE 'NO_RECALL' END AS context FROM (
SELECT doc_id, regexp_matches(lower(text), '\b(recalls?|recalling|recalled)\b') AS r, regexp_matches(lower(text), '\b(investigat(e|es|ed|ing|ion|ions)|probes?|probing|probed|inquir(y|ies)|preliminary evaluation|engineering analysis)\b') AS i FROM documents)""")
def recall_contexts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.recall_context(F.col("text")).alias("context"))


# --- scores ---------------------------------------------------------------------------------------


def _scored(spark, sf_dir, whole: bool = False, spread: bool = False) -> DataFrame:
    rows = articles(spark, sf_dir, whole)
    rows = (graph.spread(rows) if spread else rows).withColumns(
        {
            "category": F.when(F.col("lang") == "en", "sdv").when(F.col("lang") == "de", "oem").otherwise("big"),
            "text": F.col("excerpt"),
            "tags": F.array("lang"),
            "source_type": F.when(F.col("source") == "src1", "regulator").when(F.col("source") == "src2", "aggregator").otherwise("media"),
            "publisher": F.col("source"),
            "source_authority": F.when(F.col("source") == "src3", 95).otherwise(70),
            "repeats": F.lit(False),
        }
    )
    return scoring.with_scores(rows, F.lit(REF_TIME).cast("timestamp"), core=CORE, signals=SIGNALS, evergreen=EVERGREEN, promotion=PROMOTION)


SCORE_SQL = f"""{A}, c AS (SELECT *, CASE lang WHEN 'en' THEN 'sdv' WHEN 'de' THEN 'oem' ELSE 'big' END AS category, lower(excerpt) AS low FROM a),
n AS (SELECT *, {' + '.join(f"CAST({word_sql('excerpt', w)} AS INT)" for w in CORE)} AS core,
  {' + '.join(f"CAST(regexp_matches(low, '{s}') AS INT)" for s in SIGNALS)} AS sig FROM c),
p AS (SELECT *, CAST(CASE source WHEN 'src1' THEN 950 WHEN 'src2' THEN 550 WHEN 'src3' THEN 850 ELSE 750 END AS INT) AS source_score,
  CAST(least(1000, greatest(100, CASE category WHEN 'sdv' THEN 650 WHEN 'oem' THEN 350 ELSE 250 END + least(core * 120, 450))) AS INT) AS relevance_score,
  CAST(least(1000, greatest(100, CASE category WHEN 'oem' THEN 350 WHEN 'big' THEN 420 ELSE 250 END + least(sig * 180, 550))) AS INT) AS impact_score,
  CAST(greatest(100, 900 - CASE WHEN regexp_matches(lower(title), '{EVERGREEN}') THEN 350 WHEN regexp_matches(low, '{EVERGREEN}') THEN 200 ELSE 0 END - CASE WHEN regexp_matches(low, '{PROMOTION}') AND sig = 0 THEN 200 ELSE 0 END) AS INT) AS novelty_score,
  CAST(greatest(50, least(1000, round(pow(0.5, greatest(0, (epoch_us(TIMESTAMP '{REF_TIME}') - epoch_us(published_at)) / 3.6e9) / 36.0) * 1000))) AS INT) AS recency_score FROM n),
v AS (SELECT *, relevance_score * 30 + impact_score * 25 + source_score * 20 + recency_score * 15 + novelty_score * 10
  + greatest(CASE WHEN impact_score >= 650 AND source_score >= 850 THEN 20000 ELSE 0 END, CASE WHEN relevance_score >= 800 AND impact_score >= 450 THEN 15000 ELSE 0 END)
  - CASE WHEN relevance_score < 400 AND impact_score < 400 THEN 10000 ELSE 0 END AS total FROM p),
f AS (SELECT *, CAST(least(1000, greatest(100, total // 100 + CASE WHEN total % 100 > 50 OR (total % 100 = 50 AND (total // 100) % 2 = 1) THEN 1 ELSE 0 END)) AS INT) AS priority_score FROM v),
g AS (SELECT *, CASE WHEN priority_score >= 800 THEN 'critical' WHEN priority_score >= 600 THEN 'high' WHEN priority_score >= 450 THEN 'medium' ELSE 'watch' END AS level FROM f)"""


@query(SCORE_SQL + " SELECT doc_id, source_score, relevance_score, impact_score, novelty_score, recency_score, priority_score, level FROM g")
def article_scores(spark, sf_dir, whole=False):
    return _scored(spark, sf_dir, whole).select("doc_id", "source_score", "relevance_score", "impact_score", "novelty_score", "recency_score", "priority_score", "level")


@query(SCORE_SQL + " SELECT level, count(*) AS n, max(priority_score) AS best FROM g GROUP BY level")
def level_counts(spark, sf_dir, whole=False):
    return _scored(spark, sf_dir, whole).groupBy("level").agg(F.count("*").alias("n"), F.max("priority_score").alias("best"))


@query(SCORE_SQL + " SELECT doc_id, priority_score, rank FROM (SELECT doc_id, priority_score, CAST(row_number() OVER (ORDER BY priority_score DESC, published_at DESC, doc_id) AS INT) AS rank FROM g) WHERE rank <= 5")
def priority_top5(spark, sf_dir, whole=False):
    best = _scored(spark, sf_dir, whole).orderBy(F.desc("priority_score"), F.desc("published_at"), "doc_id").limit(5)
    return select.ranked(best, "priority_score", "published_at", "doc_id").select("doc_id", "priority_score", "rank")


@query(SCORE_SQL + " SELECT count(*) AS total, count(*) FILTER (WHERE level = 'critical' AND lang <> 'es') AS critical, count(*) FILTER (WHERE level = 'high' AND lang <> 'es') AS high, count(*) FILTER (WHERE lang = 'es') AS conference FROM g")
def issue_metrics(spark, sf_dir, whole=False):
    rows = _scored(spark, sf_dir, whole)
    return store.metrics(rows.withColumn("category", F.when(F.col("lang") == "es", "conference").otherwise(F.col("category"))))


@query(f"""{A}, t AS (SELECT doc_id, source, {TOKENS} AS t FROM a), o AS (SELECT doc_id, t FROM t WHERE source = 'src0'), n AS (SELECT doc_id, t FROM t WHERE source <> 'src0'),
x AS (SELECT n.doc_id, o.doc_id AS old, len(list_intersect(n.t, o.t)) AS c, greatest(len(n.t), len(o.t)) AS m FROM n JOIN o ON list_has_any(n.t, o.t))
SELECT DISTINCT doc_id FROM x WHERE c >= 4 AND c * 4 >= m * 3""")
def novelty_repeats(spark, sf_dir):
    rows = dedupe.with_title_features(articles(spark, sf_dir)).select("doc_id", "source", F.col("title_tokens").alias("t"))
    return dedupe.repeated(rows.where("source <> 'src0'"), rows.where("source = 'src0'"), "doc_id", "t")


# --- selection, facets, sections --------------------------------------------------------------------


@query(f"{A} SELECT doc_id, lang, rank FROM (SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY length(title) DESC, published_at DESC, doc_id) AS INT) AS rank FROM a) WHERE rank <= 5")
def section_topk(spark, sf_dir):
    rows = articles(spark, sf_dir).withColumn("score", F.char_length("title"))
    return select.section_top(rows, 5, "lang", "score", "published_at", "doc_id").select("doc_id", "lang", "rank")


@query(f"{A}, k AS (SELECT doc_id, {KEY} AS k, CASE WHEN lang = 'en' THEN 0 WHEN lang IN ('de', 'fr') THEN 1 END AS i FROM a), m AS (SELECT k, min(i) AS i FROM k GROUP BY k) SELECT k.doc_id, CASE k.i WHEN 0 THEN 'north' WHEN 1 THEN 'centre' END AS section FROM k JOIN m USING (k) WHERE k.i IS NULL OR k.i = m.i")
def section_assignment(spark, sf_dir):
    rows = articles(spark, sf_dir).withColumns({"url": T.title_key(F.col("title")), "category": F.col("lang"), "primary_category": F.col("lang")})
    return select.assigned(rows, SECTIONS).select("doc_id", "section")


@query("""WITH l(label, terms) AS (VALUES ('forward', ['tion', 'ement']), ('sea', ['ea']), ('none', ['qqqq'])), d AS (SELECT lower(text) AS t FROM documents)
SELECT label, (SELECT count(*) FROM d WHERE len(list_filter(terms, lambda x: contains(t, x))) > 0) AS n FROM l UNION ALL SELECT 'all', count(*) FROM d""")
def topic_facets_by_substring(spark, sf_dir):
    keys = select.substring_keys(F.col("text"), {"forward": ["tion", "ement"], "sea": ["ea"], "none": ["qqqq"]})
    return select.facet_counts(table(spark, sf_dir, "documents"), keys, ["forward", "sea", "none"]).select("label", "n")


REGION = {"us": ["en"], "europe": ["de", "fr", "es"], "germany": ["de"], "asia": []}


@query("""WITH l(label, langs) AS (VALUES ('us', ['en']), ('europe', ['de', 'fr', 'es']), ('germany', ['de']), ('asia', []::VARCHAR[]))
SELECT label, (SELECT count(*) FROM documents WHERE list_contains(langs, lang)) AS n FROM l UNION ALL SELECT 'all', count(*) FROM documents""")
def region_counts(spark, sf_dir):
    keys = F.filter(F.array(*(F.when(F.col("lang").isin(*v) if v else F.lit(False), F.lit(k)) for k, v in REGION.items())), lambda x: x.isNotNull())
    return select.facet_counts(table(spark, sf_dir, "documents"), keys, list(REGION)).select("label", "n")


@query("SELECT source AS source_type, count(*) AS n FROM documents GROUP BY source")
def source_type_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("source_type")).agg(F.count("*").alias("n"))


@query("SELECT lang AS section, count(*) AS n FROM documents WHERE source IN ('src1') AND contains(lower(text), 'tion') AND lang IN ('de', 'fr', 'es') GROUP BY lang")
def facet_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumns(
        {"regions": F.when(F.col("lang") != "en", F.array(F.lit("europe"))).otherwise(F.array(F.lit("us"))), "topics": select.substring_keys(F.col("text"), {"forward": ["tion"]}), "source_type": F.col("source")}
    )
    return select.filtered(rows, "europe", "forward", "src1").groupBy(F.col("lang").alias("section")).agg(F.count("*").alias("n"))


AUTHORITIES = {"supplier 000000001": 95, "plier 00000000": 88, "9": 60}


@query("""WITH n AS (SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS c FROM supplier)
SELECT s_suppkey, CAST(CASE WHEN c = 'supplier 000000001' THEN 95 WHEN contains(c, 'supplier 000000001') OR contains('supplier 000000001', c) THEN 95
  WHEN contains(c, 'plier 00000000') OR contains('plier 00000000', c) THEN 88 WHEN contains(c, '9') THEN 60 ELSE 70 END AS INT) AS authority FROM n""")
def authority_lookup(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.authority(F.col("s_name"), AUTHORITIES).alias("authority"))


@query("""WITH n AS (SELECT doc_id, trim(regexp_replace(lower(source), '[^a-z0-9가-힣]+', ' ', 'g')) AS c, lang FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(c, 'nhtsa|dot gov|epa gov|acea|unece|euro ncap|european commission|iihs|regulator|safety commission') THEN 'regulator' WHEN lang = 'en' THEN 'media' WHEN lang = 'de' THEN 'official' ELSE 'media' END AS kind FROM n""")
def source_type_case(spark, sf_dir):
    feed = F.when(F.col("lang") == "de", "official").when(F.col("lang") == "fr", "aggregator")
    return table(spark, sf_dir, "documents").select("doc_id", S.kind(F.col("source"), feed).alias("kind"))


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) AS e FROM orders)
SELECT o_orderkey, year(s) || '년 ' || month(s) || '월 ' || day(s) || CASE WHEN s = e THEN '일' WHEN year(s) = year(e) AND month(s) = month(e) THEN '-' || day(e) || '일'
  WHEN year(s) = year(e) THEN '일-' || month(e) || '월 ' || day(e) || '일' ELSE '일-' || year(e) || '년 ' || month(e) || '월 ' || day(e) || '일' END AS dates FROM d""")
def date_ranges(spark, sf_dir):
    start = F.col("o_orderdate").cast("date")
    end = F.date_add(start, (F.col("o_orderkey") % 40).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", presentation.date_range(start, end).alias("dates"))


@query()
def briefing_mail(spark, sf_dir):
    """The text of a mail with the best five articles of each category, by their whole texts."""
    rows = _scored(spark, sf_dir, whole=True).withColumns({"id": F.col("doc_id"), "url": F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))})
    best = select.section_top(rows, 5, "category", "priority_score", "published_at", "doc_id")
    views = presentation.article_view(best).join(best.select(F.col("doc_id").alias("id"), F.col("rank").alias("position")), "id")
    return presentation.mail_text(views, REF_TIME[:10])


# --- store -----------------------------------------------------------------------------------------------


@query("SELECT max(CAST(o_orderdate AS DATE)) AS latest, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_dates FROM orders")
def latest_date(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").agg(F.max(day).alias("latest"), F.count_distinct(day).alias("n_dates"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-06-01' - 7 AND CAST(o_orderdate AS DATE) < DATE '1997-06-01'")
def recent_7_days(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return store.recent(rows, F.col("day"), F.lit("1997-06-01").cast("date"), 7)


@query("SELECT c_custkey, count(o_orderkey) AS n_articles FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def history_counts(spark, sf_dir):
    issues = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("issue_date"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("issue_date"))
    return store.history(issues, orders).select(F.col("issue_date").alias("c_custkey"), "n_articles")


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus <> 'P'), n AS (SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice + 1 AS o_totalprice, 'new' AS o_orderpriority FROM orders WHERE o_orderstatus <> 'F')
SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice, coalesce(o.o_orderpriority, n.o_orderpriority) AS o_orderpriority FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def upsert_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    new = orders.where("o_orderstatus <> 'F'").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("new").alias("o_orderpriority"))
    return store.merged(orders.where("o_orderstatus <> 'P'"), new, ["o_orderkey"], keep=["o_orderpriority"])


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS issue_date, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position FROM orders")
def issue_positions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("issue_date", F.col("o_orderdate").cast("date"))
    return store.with_positions(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "issue_date", "position")


# --- pages, conversations, streams ---------------------------------------------------------------------------


@query()
def page_texts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.page_text(F.col("html")).alias("text"))


@query("SELECT conv_id, count(*) AS n_turns, arg_min(text, turn) AS opening, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def thread_summary(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.min_by("text", "turn").alias("opening"), F.max_by("role", "turn").alias("last_role"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(round(sum(value) * 100) AS BIGINT) AS cents FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    rows = ingest.tumbling(table(spark, sf_dir, "events"), by=["event_type"])
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", F.round(F.col("total") * 100).cast("long").alias("cents"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def event_sessions(spark, sf_dir):
    return ingest.sessions(table(spark, sf_dir, "events")).select("user_id", F.col("w.start").alias("start"), "n")


# --- events ---------------------------------------------------------------------------------------------------------

HEADLINES = [
    (0, "Toyota and Nvidia announce autonomous driving chip partnership", "Wire A", "media", 0),
    (1, "Nvidia and Toyota partner on autonomous vehicle computing", "Wire B", "media", 2),
    (2, "Toyota expands autonomous driving road tests in Tokyo", "Trade", "media", 3),
    (3, "Ford recalls trucks over airbag inflator defect", "Agency", "regulator", 5),
    (4, "Ford recalls trucks over faulty airbag inflators", "Wire A", "media", 6),
    (5, "Ford recalls trucks over brake line defect", "Wire B", "media", 6),
    (6, "Ford invests $2 billion in Michigan plant", "Wire A", "media", 8),
    (7, "Ford invests $5 billion in Michigan plant", "Wire B", "media", 9),
]


def fixture(spark: SparkSession) -> DataFrame:
    """Headlines as scored articles."""
    rows = spark.createDataFrame(HEADLINES, "id long, title string, publisher string, source_type string, hour int")
    return rows.select(
        "id", "title", "publisher", "source_type", F.col("id").alias("position"), F.concat(F.lit("https://e.org/"), F.col("id").cast("string")).alias("url"), F.concat(F.lit("https://e.org/"), F.col("id").cast("string")).alias("canonical_url"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("hour") * 3600).alias("published_at"), F.lit("").alias("excerpt"), F.lit("").alias("content"), F.array().cast("array<string>").alias("tags"),
        (F.col("source_type") == "official").alias("is_official"), (F.col("source_type") == "regulator").alias("is_primary_source"), F.lit(500).alias("priority_score"), F.lit(None).cast("string").alias("discovered_via"),
    )


def event_articles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, E.Lexicon]:
    """All documents as scored articles with their whole text, and the lexicon; without a folder the headlines, for tests."""
    if not sf_dir:
        return fixture(spark), E.Lexicon.standard()
    url = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    rows = _scored(spark, sf_dir, whole=True, spread=True).select(
        F.col("doc_id").alias("id"), "title", "publisher", "source_type", F.col("doc_id").alias("position"), url.alias("url"), url.alias("canonical_url"), "published_at", "excerpt", F.lit("").alias("content"),
        F.array().cast("array<string>").alias("tags"), E.topics(F.col("excerpt"), LEXICON).alias("topics"), F.lit(False).alias("is_official"), (F.col("source_type") == "regulator").alias("is_primary_source"), "priority_score", F.lit(None).cast("string").alias("discovered_via"),
    )
    return rows, LEXICON


def _featured(spark, sf_dir) -> DataFrame:
    """Features are cut from their lineage: both sides of the pairs read them."""
    return dedupe.checkpointed(similarity.with_features(*event_articles(spark, sf_dir)).drop("excerpt", "content"))


@query()
def pair_similarity(spark, sf_dir):
    return similarity.scored_pairs(_featured(spark, sf_dir))


@query()
def event_clusters(spark, sf_dir):
    members, found = briefing.linked(*event_articles(spark, sf_dir))
    return found.select("event_id", "primary_id", "title", "source_count", "independent_sources", "has_regulator", "article_ids", "related_sources")


@query()
def event_coherence(spark, sf_dir):
    rows = _featured(spark, sf_dir)
    pairs = dedupe.checkpointed(similarity.scored_pairs(rows))
    members = dedupe.checkpointed(events.clusters(rows, pairs))
    return events.coherence(rows, members, pairs).select("primary_id", "n", "least", "mean", "common_entities", "common_themes", "weak_members", "incompatible_pairs", "doubts")


@query()
def event_coverage(spark, sf_dir):
    _, found = briefing.linked(*event_articles(spark, sf_dir))
    return presentation.coverage(found)


FEED_TEXT = r"trim(regexp_replace(string_split(text, chr(10))[1], '[\x00-\x1F]', ' ', 'g'))"


def _bronze(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Payloads and feeds of documents: each is a feed with its first line as an item; some payloads are cut short, some weren't found."""
    docs = table(spark, sf_dir, "documents")
    name, i = F.concat(F.lit("f"), F.col("doc_id").cast("string")), F.col("doc_id")
    title = presentation.escaped(F.regexp_replace(F.split("text", "\n")[0], "[\\x00-\\x1F]", " "))
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>https://e.org/"), i.cast("string"), F.lit("?utm_source=x</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item>"))
    whole = F.concat(F.lit('<rss version="2.0"><channel><title>T</title>'), item, F.lit("<item><title></title><link>https://e.org/x</link></item></channel></rss>"))
    payload = F.when(i % 11 == 0, F.lit(None)).when(i % 7 == 0, F.lit('<rss version="2.0"><channel><ti')).otherwise(whole)
    bronze = docs.select(name.alias("feed_id"), payload.alias("payload"), F.when(i % 11 == 0, 404).otherwise(200).alias("status"), F.lit(None).cast("string").alias("error"))
    dim = docs.select(
        name.alias("id"), F.concat(F.lit("Feed "), i.cast("string")).alias("name"), F.lit("big").alias("bucket"), F.lit("https://e.org/rss").alias("url"), F.lit("media").alias("source_type"), F.lit(80).alias("authority_score"), F.lit("rss").alias("discovery_method"),
    )
    return bronze, dim


@query(f"SELECT 'f' || doc_id AS feed_id, {FEED_TEXT} AS title, 'https://e.org/' || doc_id AS canonical_url, 'Feed ' || doc_id AS publisher, TIMESTAMP '2024-01-01 10:00:00' AS published_at FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND {FEED_TEXT} <> ''")
def feed_entries(spark, sf_dir):
    return feeds.entries(*_bronze(spark, sf_dir)).select("feed_id", "title", "canonical_url", "publisher", "published_at")


@query(f"""WITH f AS (SELECT doc_id, doc_id % 11 = 0 AS lost, doc_id % 7 = 0 AS cut, coalesce({FEED_TEXT}, '') <> '' AS titled FROM documents)
SELECT 'f' || doc_id AS feed_id, NOT lost AND NOT cut AS ok, CAST(CASE WHEN lost OR cut OR NOT titled THEN 0 ELSE 1 END AS BIGINT) AS n_entries,
  CASE WHEN lost THEN 'HTTP 404' WHEN cut THEN 'malformed' WHEN NOT titled THEN 'empty' ELSE 'ok' END AS diagnosis FROM f""")
def feed_health(spark, sf_dir):
    return feeds.health(*_bronze(spark, sf_dir)).select("feed_id", "ok", "n_entries", "diagnosis")


@query(SCORE_SQL + " SELECT doc_id, title, level, priority_score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY priority_score DESC, published_at DESC, doc_id) AS INT) AS rank FROM g) WHERE rank <= 5")
def briefing_sections(spark, sf_dir, whole=False):
    """The best five scored articles of each category."""
    return select.section_top(_scored(spark, sf_dir, whole), 5, "category", "priority_score", "published_at", "doc_id").select("doc_id", "title", "level", "priority_score", "rank")


def _whole(f: Query) -> None:
    """Registers a query over whole texts, beside the one over excerpts."""
    QUERIES[f"{f.__name__}_whole"] = partial(f, whole=True)
    SQL[f"{f.__name__}_whole"] = SQL[f.__name__].replace("substring(text, 1, 420) AS excerpt", "text AS excerpt")


for _f in (entity_match, topic_implications, entity_groups, taxonomy_categories, article_scores, level_counts, priority_top5, issue_metrics, briefing_sections):
    _whole(_f)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as entries of feeds in order of arrival, with their whole texts."""
    url = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    rows = articles(spark, sf_dir, whole=True)
    return rows.select(
        F.col("doc_id").alias("ord"), "title", "excerpt", "published_at", url.alias("url"), url.alias("canonical_url"), F.lit("oem").alias("bucket"), F.col("source").alias("publisher"),
        F.when(F.col("source") == "src1", "regulator").when(F.col("source") == "src2", "aggregator").otherwise("media").alias("source_type"), F.when(F.col("source") == "src3", 95).otherwise(70).alias("source_authority"),
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The briefing: documents de-duplicated against each other and the history (those of src0), classified, scored, linked to events; the best five primary articles of each category."""
    rows = entries(spark, sf_dir)
    history = rows.where("publisher = 'src0'").withColumn("title_key", T.title_key(F.col("title"))).select("canonical_url", "title", "title_key")
    scores = {"core": CORE, "signals": SIGNALS, "evergreen": EVERGREEN, "promotion": PROMOTION}
    kept = dedupe.checkpointed(briefing.articles(rows.where("publisher <> 'src0'"), LEXICON, F.lit(REF_TIME).cast("timestamp"), TAXONOMY, history, scores))
    members, _ = briefing.linked(kept, LEXICON)
    return briefing.presentation(kept, members).select(F.col("id").alias("doc_id"), "title", "category", "level", "priority_score", "rank")


@query()
def briefing_whole_plan(spark, sf_dir):
    return flagship(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {**QUERIES, **news.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**SQL, **news.SQL}
