"""Operator 10: URL filters, by a sort-merge range join.

A rule (host, path) fits a URL of its host or of a subdomain whose path starts
with the rule's.  Written with its labels reversed (``org.example.`` + NUL +
``/es/``) a rule is a prefix of the keys that it fits, and a prefix is an
interval of the sort order.  A URL has one key for each suffix of its host.

1. Distinct (host, path) pairs, pre-aggregated before the shuffle: a hot host or
   URL counts once.
2. Rules and keys are dealt into ranges of equal depth; the bounds come from a sample of
   ``SAMPLE`` keys (it affects the ranges' depth alone), each the shortest beginning that
   tells a key from the one before it, so keys that share hundreds of characters still
   part.  Where one key fills more than one range its rows are dealt among them, and a
   rule goes to every range that its interval meets.
3. Each range is sorted and swept once: the last rule opened before a key stands
   on top of the stack of nested rules; the stack (a rule with those whose
   intervals hold it) travels with the rule, and rules that have closed are taken
   off by comparing the key.
4. The longest rule of each pair (then the longest host, then the smaller verdict:
   allow before block) goes back to the rows by an equi-join on (host, path).

Results for special cases: a null URL or one without ``://`` has empty host and
path, no rule and the default verdict; hosts and paths may be empty; repeated
rows are judged each; rules with null host and path count as empty ones and fit
accordingly, a rule with an empty host fits no host; repeated rules count once;
an empty table of rules gives every row the default; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Verdict of a page that no rule speaks about.
DEFAULT = "allow"
#: Keys from which the bounds of ranges are taken, at least, and characters of a bound at most.
SAMPLE, BOUND_CHARS = 10_000, 8192


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit(".\0"), path)


def with_stacks(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) as distinct (key, stack); the stack has the rule and all that its key lies in."""
    own = rules.select(
        F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).where("host <> ''")
    own = own.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    own = own.select(_key(F.reverse(F.split("host", r"\.")), F.col("path")).alias("key"), F.struct("host", "path", "verdict").alias("rule"))
    # a rule lies in another of the same host whose path is a prefix of its own
    lengths = F.sequence(F.lit(0), F.length("rule.path"))
    start = F.length("key") - F.length("rule.path")
    above = own.select("key", F.explode(F.transform(lengths, lambda n: F.substring(F.col("key"), F.lit(1), start + n))).alias("above"))
    return above.join(own.select(F.col("key").alias("above"), "rule"), "above").groupBy("key").agg(F.collect_list("rule").alias("stack"))


def separators(ordered: list[str], n: int) -> list[str]:
    """n - 1 bounds of about equal depth: the shortest beginnings above the key before, or a repeated key whole."""
    bounds = []
    for i in range(1, n):
        at = len(ordered) * i // n
        key, before = ordered[at], ordered[at - 1] if at else ""
        common = next((k for k, (x, y) in enumerate(zip(key, before)) if x != y), min(len(key), len(before)))
        bounds.append(key[: common + 1])
    return bounds


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (host + path, or null) and verdict of every row of ``pages``."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    pairs = rows.where("host <> ''").select("host", "path").distinct()
    labels = F.reverse(F.split("host", r"\."))
    depths = F.sequence(F.lit(1), F.size(labels))
    keys = pairs.select("host", "path", F.explode(F.transform(depths, lambda n: _key(F.slice(labels, 1, n), F.col("path")))).alias("key"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sample = keys.select(F.substring("key", 1, BOUND_CHARS).alias("key"), F.xxhash64("host", "path", "key").alias("h")).orderBy("h", "key").limit(max(SAMPLE, 20 * n)).collect()
    ordered = sorted((r["key"] for r in sample), key=str.encode)
    bounds = separators(ordered, n) if ordered else []
    # two steps of about the root of their number: which stretch of bounds, and where in it
    step = max(1, int(len(bounds) ** 0.5))
    all_bounds = F.array(*map(F.lit, bounds)).cast("array<string>")
    ends = F.array(*map(F.lit, bounds[step - 1 :: step])).cast("array<string>")

    def bounds_where(holds: Callable[[Column], Column]) -> Column:
        """Number of bounds for which a condition holds that holds for the first ones only."""
        whole = F.size(F.filter(ends, holds)) * step
        return whole + F.size(F.filter(F.slice(all_bounds, whole + 1, F.lit(step)), holds))

    key = F.col("key")
    below, up_to, up_to_end = bounds_where(lambda b: b < key), bounds_where(lambda b: b <= key), bounds_where(lambda b: (b <= key) | b.startswith(key))
    spread = F.pmod(F.xxhash64("host", "path"), up_to - below + 1).cast("int")
    opened = with_stacks(rules).select(
        F.explode(F.sequence(below, up_to_end)).alias("range"), "key", "stack", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path")
    )
    asked = keys.select((below + spread).alias("range"), "key", F.lit(None).cast(opened.schema["stack"].dataType).alias("stack"), "host", "path")
    sweep = Window.partitionBy("range").orderBy("key", F.col("host").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stack = F.last("stack", ignorenulls=True).over(sweep)
    swept = opened.unionByName(asked).withColumn("stack", stack).where("host is not null and stack is not null")
    is_open = F.filter("stack", lambda r: F.col("key").startswith(_key(F.reverse(F.split(r["host"], r"\.")), r["path"])))
    order = lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("n"), F.length(r["host"]).alias("h"), (r["verdict"] == "allow").alias("a"), r.alias("rule"))
    longest = swept.select("host", "path", F.array_max(F.transform(is_open, order)).alias("best")).where("best is not null")
    best = longest.groupBy("host", "path").agg(F.max("best").alias("best")).select("host", "path", F.col("best.rule").alias("found"))
    return rows.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.concat("found.host", "found.path").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict")
    )
