"""Operator 7: quality classifier by importance resampling.

Two generative models of hashed byte n-grams, one of the target text (labelled
documents of good quality that are not toxic) and one of the raw text (every
document), give each text a log importance weight: the mean log ratio of its
n-grams, for a text of ``LENGTH`` n-grams.  A Gumbel number from the document's
id is added and the k largest sums are kept.

* Raw counts cover the whole corpus: each task adds up its n-grams and sends the
  bucket counts in parts, which are summed part by part.
* Labels: ``FIT`` good ones (smallest hashes of their ids) train the target
  model; as many others, not among them, calibrate k: it is the number of
  documents whose weight is not below that which all but ``LOST`` of these reach.
* The k-th largest sum is found exactly by counting into ever narrower intervals.

Weights are added up in fixed point, so a document's weight doesn't depend on the
batch in which it stands, and the selection can be applied in a second pass
without joining anything to the texts.

Results for special cases: null texts and those with fewer than ``N`` bytes have
weight 0; a null id draws the number of id 0; rows that repeat an id and text are
kept or not together (so more than k rows stay at such a tie); without good labels
everything is kept; an empty table gives no rows; a labelled id counts once, as
bad if any of its labels says so, and calibrates by the least weight of its rows; labels of unknown ids are ignored; other columns
pass through :func:`resampled` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.llm import words as W
from storyline.llm.common import in_rounds, removed, written

N, BUCKET_BITS = 4, 18
#: Labelled documents that train the target model at most, and as many that calibrate.
FIT = 20_000
LOST = 0.005
LENGTH = 200
SEED = 11
#: Bytes of texts that are scored at a time, and buckets that travel together.
STEP, PART = 2 << 20, 1 << 13
ONE = 1 << 20  # fixed point


def ngram_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each byte, and begin and end of each text's (n-grams stay within a text)."""
    data, offsets = W.buffers(texts)
    n = max(0, len(data) - N + 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(N):
        h = h * np.uint64(257) + data[k : n + k]
    buckets = (W.mixed(h) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    begin = np.minimum(offsets[:-1], n)
    return buckets, begin, np.maximum(offsets[1:] - N + 1, begin)


def gumbel(ids: np.ndarray, seed: int = SEED) -> np.ndarray:
    """A Gumbel number for each id, the same wherever it is drawn."""
    bits = W.mixed(ids.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    u = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    return -np.log(-np.log(u))


def model_counts(docs: DataFrame, target_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts of all texts and of those with target ids."""
    target_ids = np.sort(target_ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << BUCKET_BITS, dtype=np.int64), np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in batches:
            ids = batch.column(0)
            chosen = np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), target_ids) & ids.is_valid().to_numpy(zero_copy_only=False)
            for i, j in W.slices(batch.column(1), STEP):
                buckets, begin, end = ngram_buckets(batch.column(1).slice(i, j - i))
                if not len(buckets):
                    continue
                # +1 where a text begins, -1 where it ends: n-grams over a border belong to none
                edge = np.zeros(len(buckets) + 1, dtype=np.int32)
                np.add.at(edge, begin, 1)
                np.add.at(edge, end, -1)
                raw += np.bincount(buckets[np.cumsum(edge)[:-1] > 0], minlength=1 << BUCKET_BITS)
                mine = np.flatnonzero(chosen[i:j])
                if len(mine):
                    target += np.bincount(np.concatenate([buckets[begin[m] : end[m]] for m in mine.tolist()]), minlength=1 << BUCKET_BITS)
        parts = range(0, 1 << BUCKET_BITS, PART)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(parts), pa.int32()), *(pa.array([x[p : p + PART].tobytes() for p in parts], pa.binary()) for x in (raw, target))], names=["at", "raw", "target"]
        )

    def add(table: pa.Table) -> list[bytes]:
        return [np.sum([np.frombuffer(b, np.int64) for b in table.column(c).to_pylist()], axis=0).tobytes() for c in ("raw", "target")]

    schema = "at int, raw binary, target binary"
    rows = in_rounds(docs.mapInArrow(count, schema), schema, add).collect()  # one row a part, whatever the corpus
    raw, target = np.zeros(1 << BUCKET_BITS, dtype=np.int64), np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for row in rows:
        raw[row["at"] : row["at"] + PART] = np.frombuffer(row["raw"], np.int64)
        target[row["at"] : row["at"] + PART] = np.frombuffer(row["target"], np.int64)
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the two models (half a count added to each bucket) in fixed point; 0 without a target."""
    if not target.any():
        return np.zeros(len(raw), dtype=np.int64)
    p, q = target + 0.5, raw + 0.5
    return np.round((np.log(p / p.sum()) - np.log(q / q.sum())) * ONE).astype(np.int64)


def log_weights(texts: pa.Array, ratios: np.ndarray) -> np.ndarray:
    out = np.zeros(len(texts))
    for i, j in W.slices(texts, STEP):
        buckets, begin, end = ngram_buckets(texts.slice(i, j - i))
        total = np.zeros(len(buckets) + 1, dtype=np.int64)
        np.cumsum(ratios[buckets], out=total[1:])
        out[i : i + len(begin)] = (total[end] - total[begin]) / np.maximum(end - begin, 1) * (LENGTH / ONE)
    return out


@dataclass(frozen=True)
class Selection:
    """What a fitted classifier holds: the table of log ratios and the k-th largest sum."""

    ratios: np.ndarray
    least: float

    def sums(self, ids: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        weights = log_weights(texts, self.ratios)
        return weights, weights + gumbel(ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))


def kth_largest(table: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The exact k-th largest value (-inf for k <= 0 or beyond the rows): intervals are counted, never rows gathered."""
    low, high, n = table.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0 or k >= n:
        return float("-inf") if k >= n else float("inf")
    above = 0
    while low < high:
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            break
        inside = table.where((F.col(column) >= low) & (F.col(column) <= high))
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).alias("bin")
        counts = inside.groupBy(place).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("bin")).collect()
        for row in counts:  # bins at most
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]
    return high


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Selection:
    """Trains on ``docs`` (all of them) and ``labels`` (doc_id, quality, toxic)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good")).where("good")
    picked = [r["doc_id"] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * FIT).select("doc_id").collect()]
    train, rest = np.array(picked[::2], dtype=np.int64), np.sort(np.array(picked[1::2], dtype=np.int64))
    ratios = log_ratios(*model_counts(rows, train))
    model = Selection(ratios, float("-inf"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights, sums = model.sums(batch.column(0), batch.column(1))
            check = np.isin(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), rest) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            known = pa.array(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), mask=~check)
            yield pa.RecordBatch.from_arrays([pa.array(weights), pa.array(sums), known], names=["weight", "sum", "calibrates"])

    scored = written(rows.mapInArrow(run, "weight double, sum double, calibrates long"), "weights")
    # an id that rows repeat calibrates once, by its least weight: so many numbers as ids were picked, at most
    held = np.sort([r["weight"] for r in scored.where("calibrates is not null").groupBy("calibrates").agg(F.min("weight").alias("weight")).select("weight").collect()])
    if len(held):
        k = scored.where(F.col("weight") >= float(held[int(LOST * len(held))])).count()
        model = Selection(ratios, kth_largest(scored, "sum", k))
    removed(docs.sparkSession, scored)
    return model


def selected(docs: DataFrame, model: Selection, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, log_weight and gumbel_sum of the rows that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights, sums = model.sums(batch.column(0), batch.column(1))
            mask = pa.array(sums >= model.least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), pa.array(weights).filter(mask), pa.array(sums).filter(mask)], names=["doc_id", "log_weight", "gumbel_sum"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, log_weight double, gumbel_sum double")


def resampled(docs: DataFrame, model: Selection, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    i, j = docs.columns.index(id_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, sums = model.sums(batch.column(i), batch.column(j))
            yield batch.filter(pa.array(sums >= model.least))

    return docs.mapInArrow(run, docs.schema)
