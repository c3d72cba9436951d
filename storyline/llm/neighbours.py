"""Operator 5: approximate nearest neighbours by an inverted multi-index.

* Vectors are scaled to unit length and split into two halves; each half has a
  codebook of ``k`` centroids, fitted by Lloyd rounds on a bounded sample
  (``FIT`` vectors with the smallest hashes of their ids, whatever the size of the table).
* Every vector is indexed: its cell is the pair of its halves' nearest
  centroids.  Equal vectors are one entry with their ``top + 1`` smallest ids,
  gathered with partial aggregation, so a vector that a third of the rows repeat
  is a handful of rows.
* A query walks over centroid pairs by their summed distance with a heap, counts
  the entries of the cells (one number for each of the k x k cells), and stops when it
  has met ``share`` of all entries.  The share is the price of recall: vectors
  without clusters need a large one (README has measured figures).
* Cells are gathered or split into chunks of about ``CHUNK`` entries; a query goes
  to the chunks of its cells, in blocks of about ``QUERIES`` queries, is reranked there in
  double precision on the original vectors, and the chunks' nearest are merged
  by query.

Entries that a query's cells hold are all reranked: no cell is cut short.
Results for special cases: null and zero vectors and those with null or
non-finite components take no part, nor do vectors of another length than most;
an id that several rows repeat is one item with all their vectors: it has one place at
most among a query's nearest, by its largest score, as a query it is one query with
the largest score over its vectors, and it is never its own neighbour; null ids take no part; with fewer candidates than asked
for all are returned; an empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyline.llm.common import written

TOP = 5
#: Vectors on which the codebooks are fitted, at most, and rounds of the fitting.
FIT, ROUNDS = 20_000, 12
#: Share of all entries, and number of entries, that a query meets at least; centroids of a half at most.
SHARE, FEWEST, MOST_CENTROIDS = 0.34, 2000, 256
#: Entries of a chunk and queries of a block, about: what one rerank call holds.
CHUNK, QUERIES = 4096, 2048


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and vec (array<double>) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where("vec_id is not null and vec is not null")
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return rows.where(sound)


def fitted(sample: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """k centroids (fewer if the sample has fewer different rows) by Lloyd's algorithm."""
    points = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    centres = points[rng.permutation(len(points))[: min(k, len(points))]]
    for _ in range(ROUNDS):
        near = nearest(sample, centres)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(1) - 2 * x @ centres.T + (x**2).sum(1)[:, None]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)


def even(x: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two, so that squares neither overflow nor vanish and no bit changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray | list[int], entries: int) -> list[int]:
    """Cells (a * k + b) in order of first[a] + second[b] until they hold ``entries``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    one, two = first[a].tolist(), second[b].tolist()
    a, b, counts_of = a.tolist(), b.tolist(), counts.tolist() if isinstance(counts, np.ndarray) else counts
    heap, out, met = [(one[0] + two[0], 0, 0)], [], 0
    while heap and met < entries:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * len(b) + b[j]
        if counts_of[cell]:
            out.append(cell)
            met += counts_of[cell]
        # each pair has one other from which it is reached: its left neighbour, or the one above in the first column
        if j + 1 < len(b):
            heapq.heappush(heap, (one[i] + two[j + 1], i, j + 1))
        if not j and i + 1 < len(a):
            heapq.heappush(heap, (one[i + 1] + two[0], i + 1, 0))
    return out


def nearest_entries(rough: np.ndarray, ids: list, query: int, top: int) -> np.ndarray:
    """Places of the entries that hold the ``top`` nearest ids other than the query's, and of all that tie with the last.

    Entries may share ids, so as many entries are taken as it needs for so many different ids.
    """
    take = top + 1
    while take < len(rough):
        part = np.argpartition(rough, -take)[-take:]
        if len({i for e in part.tolist() for i in ids[e]} - {query}) >= top:
            return np.flatnonzero(rough >= rough[part].min() - 1e-9)
        take *= 2
    return np.arange(len(rough))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def search(vectors: DataFrame, is_query, top: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding", share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest by cosine found for every row where ``is_query`` (a Column on vec_id)."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, id_col, vec_col)
    length = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], result)
    d = length["d"]
    half = max(1, d // 2)
    rows = rows.where(F.size("vec") == d)

    # one entry for each different vector, with its smallest ids
    partial = rows.select("vec_id", "vec", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt"))
    for group in (["vec", "salt"], ["vec"]):
        ids = F.array_sort(F.collect_set("vec_id")) if group[-1] == "salt" else F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids"))))
        partial = partial.groupBy(*group).agg(F.slice(ids, 1, top + 1).alias("ids"))
    entries_table = written(partial.select("vec", "ids"), "entries")
    total = entries_table.count()
    n_queries = rows.where(is_query(F.col("vec_id"))).count()

    sample = entries_table.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(FIT).select("vec").toArrow()
    x = unit(_matrix(sample.column("vec")))
    k = int(min(MOST_CENTROIDS, max(2, np.sqrt(2 * total))))
    books = fitted(x[:, :half], k), fitted(x[:, half:], k) if d > 1 else np.zeros((1, 0))
    width = len(books[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                u = unit(_matrix(batch.column(0)))
                cell = nearest(u[:, :half], books[0]) * width + nearest(u[:, half:], books[1])
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *batch.columns], names=["cell", "vec", "ids"])

    indexed = written(entries_table.mapInArrow(place, "cell int, vec array<double>, ids array<long>"), "cells")
    counts = np.zeros(len(books[0]) * width, dtype=np.int64)
    for row in indexed.groupBy("cell").count().collect():  # k x k numbers at most
        counts[row["cell"]] = row["count"]
    # small cells share a chunk, large ones have several of their own
    own = -(-counts // CHUNK)
    first = np.zeros(len(counts), dtype=np.int64)
    chunk, room = -1, 0
    for cell in np.flatnonzero(counts).tolist():
        if own[cell] == 1 and counts[cell] <= room:
            room -= int(counts[cell])
        else:
            chunk += 1
            room = CHUNK - int(counts[cell]) if own[cell] == 1 else 0
        first[cell] = chunk
        chunk += int(own[cell]) - 1
    enough = max(FEWEST, int(share * total)) + top

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = counts.tolist()
        for batch in batches:
            if not len(batch):
                continue
            u = unit(_matrix(batch.column(1)))
            one, two = distances(u[:, :half], books[0]), distances(u[:, half:], books[1])
            for i in range(len(batch)):
                cells = np.array(walk(one[i], two[i], numbers, enough), dtype=np.int64)
                many = own[cells]
                at = np.repeat(first[cells] - np.cumsum(many) + many, many) + np.arange(many.sum())
                cells = np.repeat(cells, many)
                order = np.argsort(at, kind="stable")
                at, cells = at[order], cells[order]
                chunks, starts = np.unique(at, return_index=True)
                same = pa.array([i] * len(chunks))
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)).astype(np.int32)), pa.array(cells.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(chunks.astype(np.int32)), batch.column(0).take(same), batch.column(1).take(same), lists], names=["chunk", "query_id", "vec", "cells"])

    block = F.floor(F.pmod(F.xxhash64("query_id"), F.lit(1 << 30)) / F.lit(max(1, (1 << 30) * QUERIES // max(1, n_queries)))).cast("int")
    asked = rows.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "vec")
    # a number of its own, for few bytes of queries are much work; rows of one query meet there
    asked = asked.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_queries // QUERIES), "query_id").dropDuplicates()
    visits = asked.mapInArrow(visit, "chunk int, query_id long, vec array<double>, cells array<int>").withColumn("block", block)
    visits = written(visits, "visits")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(5)
        for batch in batches:
            cell = batch.column(0).to_numpy()
            to = first[cell] + rng.integers(0, np.maximum(own[cell], 1))
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), *batch.columns], names=["chunk", "cell", "vec", "ids"])

    def rerank(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found: tuple[list, list, list] = ([], [], [])
        if len(asked) and len(held):
            v, ids, cell = even(np.array(held["vec"].tolist())), held["ids"].tolist(), held["cell"].to_numpy()
            norms = np.sqrt((v * v).sum(1))
            for begin in range(0, len(asked), 256):
                some = asked.iloc[begin : begin + 256]
                w = even(np.array(some["vec"].tolist()))
                lengths = np.sqrt((w * w).sum(1))
                rough = (w @ v.T) / lengths[:, None] / norms
                for n, (q, cells) in enumerate(zip(some["query_id"].tolist(), some["cells"], strict=True)):
                    here = np.flatnonzero(np.isin(cell, cells))
                    near = nearest_entries(rough[n, here], [ids[e] for e in here], q, top)
                    near = here[near]
                    score = (v[near] * w[n]).sum(1) / (norms[near] * lengths[n])
                    best: dict[int, float] = {}
                    for x, e in zip(score.tolist(), near.tolist(), strict=True):
                        for i in ids[e]:
                            if i != q and x > best.get(i, -2.0):
                                best[i] = x
                    for x, i in heapq.nsmallest(top, ((-x, i) for i, x in best.items())):
                        found[0].append(q)
                        found[1].append(i)
                        found[2].append(-x)
        return pd.DataFrame({"query_id": np.array(found[0], np.int64), "vec_id": np.array(found[1], np.int64), "score": np.array(found[2], np.float64)})

    dealt = indexed.mapInArrow(deal, "chunk int, cell int, vec array<double>, ids array<long>").join(visits.select(F.col("chunk").alias("chunk"), F.col("block").alias("block")).distinct(), "chunk")
    scored = visits.groupBy("chunk", "block").cogroup(dealt.groupBy("chunk", "block")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    best = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
