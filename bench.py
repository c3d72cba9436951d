"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from storyline.plans import catalogue

HEADLINE = [
    "url_canonical",
    "title_features",
    "exact_dedupe",
    "near_title_pairs",
    "near_title_components",
    "entity_match",
    "taxonomy_categories",
    "article_scores",
    "section_topk",
    "briefing_sections",
    "upsert_merge",
    "event_windows",
    "pair_similarity",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.sql.shuffle.partitions", cpus)
    spark = builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    runs = catalogue.queries()
    runs["url_host_counts"](spark, sf_dir).count()  # start the session and read footers once
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        runs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
