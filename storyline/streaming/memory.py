"""De-duplication of a stream against what it kept in the last days: exact keys and near-equal titles."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.functions.text import title_key
from storyline.operators import dedupe
from storyline.operators.graph import checkpointed
from storyline.sources.log import CommitLog

#: Parts of the memory that are put together into one once there are as many.
MOST_PARTS = 32


class Memory:
    """What a stream has kept, as keys and an index of titles, for ``foreachBatch``.

    A batch loses what repeats an earlier row of the last ``days`` (by URL, title key or a
    near-equal title) or of itself; what stays is written with its part of the index, and one
    commit names both.  So a batch that is handled again after a failure gives the rows it gave, once.
    A batch meets the index by its own titles' words, so its work grows with the batch and the words'
    frequency in the last days, not with the pairs of titles remembered.  Parts that are older
    are no longer read.  Rows: ord, canonical_url, title, bucket and the time ``at``; conferences are
    neither remembered nor compared by near-equal titles.  Rows without a time aren't remembered.
    """

    def __init__(self, spark: SparkSession, folder: str, days: int = 7, at: str = "published_at"):
        self.spark, self.folder, self.days, self.at = spark, folder.rstrip("/"), days, at
        self.log = CommitLog(spark, f"{self.folder}/log")

    def _written(self, rows: DataFrame, name: str) -> str:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def _read(self, parts: list[dict], name: str, since: dt.datetime) -> DataFrame:
        return self.spark.read.parquet(*(p[name] for p in parts)).where(F.col("at") > F.lit(since))

    def handle(self, batch: DataFrame, number: int) -> DataFrame:
        """The rows of batch ``number`` (from 0) that stay."""
        if number + 1 in self.log.numbers():
            return self.spark.read.parquet(self.log.read(number + 1)["kept"])
        rows = checkpointed(batch.withColumn("title_key", title_key(F.col("title"))))
        latest = rows.agg(F.max(self.at)).first()[0]
        parts = self.log.last()[1].get("parts", [])
        since = None if latest is None else latest - dt.timedelta(days=self.days)
        if since is not None:
            parts = [p for p in parts if dt.datetime.fromisoformat(p["last"]) > since]
        if parts and since is not None:
            fresh = checkpointed(dedupe.unseen(rows, self._read(parts, "keys", since), ["canonical_url", "title_key"]))
            near = dedupe.near_index(fresh.where("bucket <> 'conference'"), self._read(parts, "index", since).drop("at"), "ord")
            rows = checkpointed(fresh.join(near, "ord", "left_anti"))
        kept = checkpointed(dedupe.deduped(rows.drop("title_key")))
        state = {"kept": self._written(kept, "kept"), "parts": parts}
        remembered = kept.where((F.col("bucket") != "conference") & F.col(self.at).isNotNull())
        last = remembered.agg(F.max(self.at)).first()[0]
        if last is not None:
            # an index row has the latest time of the titles that have its features
            of = dedupe.with_title_features(remembered).groupBy("title_tokens", "title_numbers").agg(F.max(self.at).alias("at"))
            index = dedupe.title_index(remembered).join(of, ["title_tokens", "title_numbers"])
            keys = remembered.select("canonical_url", "title_key", F.col(self.at).alias("at"))
            state["parts"] = [*parts, {"keys": self._written(keys, "keys"), "index": self._written(index, "index"), "last": last.isoformat()}]
            if len(state["parts"]) > MOST_PARTS:
                state["parts"] = [self._together(state["parts"], since)]
        self.log.commit(number + 1, state)
        return self.spark.read.parquet(self.log.read(number + 1)["kept"])

    def _together(self, parts: list[dict], since: dt.datetime) -> dict:
        """One part for several: each title's features once, with the latest time."""
        keys = self._read(parts, "keys", since).groupBy("canonical_url", "title_key").agg(F.max("at").alias("at"))
        index = self._read(parts, "index", since).groupBy("token", "title_numbers", "first", "title_tokens").agg(F.max("at").alias("at"))
        return {"keys": self._written(keys, "keys"), "index": self._written(index, "index"), "last": max(p["last"] for p in parts)}

    def kept(self) -> DataFrame:
        """All rows that stayed, of all batches."""
        return self.spark.read.parquet(*(self.log.read(n)["kept"] for n in self.log.numbers()))
