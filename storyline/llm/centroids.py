"""Operator 11: centroid clustering of integer vectors with Hamerly's bounds.

Components become integers ``floor(scale * x)``, so distances, sums and centroids are
exact and the result doesn't depend on how rows are dealt out.  Each vector carries
one upper bound (distance to its own centroid) and one lower bound (distance to the
second nearest).  A round loosens both by how far centroids drifted; where the upper
bound stays below the lower one, or below half the way from the own centroid to the
next, the nearest centroid can't have changed.  The other vectors get their upper bound
made exact and, if that doesn't settle it, a full exact integer scan.  Bounds are
rounded outwards, so a float never decides; ties go to the smaller number.

A round is one pass over the state, written to the shared folder without a shuffle (an
executor lost later costs nothing), and one aggregation to a row for each centroid.
What tasks get are ``k`` centroids; the state of the round before is deleted.

Results for special cases: vectors of another length, null vectors and those with a
null or non-finite component are left out, and so are those with a component beyond
+-131,072 (``MOST`` / 1024), whose squared distances no long is sure to hold; with fewer
kept vectors than ``k`` there are as many centroids as vectors; rows that repeat an id
are vectors of their own, and of those the smaller vector comes first as a start; null
ids come last as starts; a centroid without vectors stays; a sum of distances that no
long holds is null; an empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.llm.common import removed, written

LENGTH, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Largest magnitude of an integer component: 64 squared differences of it stay below 2^62.
MOST = 1 << 27
#: Outward rounding of bounds; far more than the error of the few float operations of a round.
UP, DOWN = 1 + 1e-12, 1 - 1e-12


def integers(vectors: DataFrame, id_col: str, vec_col: str, length: int = LENGTH, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array<int>) of the rows that take part."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    sound = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= float(MOST // scale)))
    kept = rows.where((F.size("x") == length) & sound)
    return kept.select("vec_id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale))).cast("int")).alias("v"))


def squared(v: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances (int64)."""
    apart = v - centre
    return np.einsum("ij,ij->i", apart, apart)


class Bounds:
    """What a round needs to know of the centroids and of their way since the round before."""

    def __init__(self, centres: list[list[int]], before: list[list[int]]):
        self.centres = np.array(centres, dtype=np.int64)
        k = len(centres)
        drift = np.sqrt(squared(self.centres, np.array(before, dtype=np.int64)).astype(np.float64)) * UP
        self.drift = drift
        #: the furthest drift of another centroid
        self.others = np.array([max((drift[j] for j in range(k) if j != i), default=0.0) for i in range(k)])
        apart = np.array([[np.inf if i == j else float(squared(self.centres[i : i + 1], self.centres[j])[0]) for j in range(k)] for i in range(k)])
        #: half the way to the next centroid
        self.half = np.sqrt(apart.min(axis=1)) / 2 * DOWN

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """cluster, upper and lower bound after this round, and how many vectors were scanned in full."""
        cluster, upper = cluster.copy(), (upper + self.drift[cluster]) * UP
        lower = np.maximum(lower - self.others[cluster], 0) * DOWN
        bar = np.maximum(lower, self.half[cluster])
        open_ = np.flatnonzero(~(upper < bar))
        upper[open_] = np.sqrt(squared(v[open_], self.centres[cluster[open_]]).astype(np.float64)) * UP
        open_ = open_[~(upper[open_] < bar[open_])]
        if len(open_):
            all_ = np.stack([squared(v[open_], c) for c in self.centres], axis=1)
            cluster[open_] = all_.argmin(axis=1)
            all_.sort(axis=1)
            upper[open_] = np.sqrt(all_[:, 0].astype(np.float64)) * UP
            lower[open_] = np.sqrt(all_[:, 1].astype(np.float64)) * DOWN if all_.shape[1] > 1 else np.inf
        return cluster, upper, lower, len(open_)


def _round(state: DataFrame, bounds: Bounds, length: int, last: bool) -> DataFrame:
    """The state after one assignment; the last one has the exact distance in place of vector and bounds."""
    id_type = state.schema["vec_id"].dataType
    fields = [T.StructField("vec_id", id_type), T.StructField("cluster", T.IntegerType())]
    if last:
        fields.append(T.StructField("distance", T.LongType()))
    else:
        fields += [T.StructField("v", T.ArrayType(T.IntegerType())), T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, length)
            cluster, upper, lower, _ = bounds.assign(v, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower")))
            out = [batch.column("vec_id"), pa.array(cluster, pa.int32())]
            if last:
                out.append(pa.array(squared(v, bounds.centres[cluster]), pa.int64()))
            else:
                out += [batch.column("v"), pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return state.mapInArrow(run, T.StructType(fields))


def _moved(state: DataFrame, centres: list[list[int]], length: int) -> list[list[int]]:
    """The floors of the means; a row for each centroid reaches the driver."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(length))).collect()
    out = list(centres)
    for row in sums:
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(length)]
    return out


def clustered(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", length: int = LENGTH, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    start = integers(vectors, id_col, vec_col, length, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centres = [list(r["v"]) for r in start.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()]
    found = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centres:
        return start.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).join(F.broadcast(spark.createDataFrame([], found)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    state = start.select("vec_id", F.lit(0).alias("cluster"), "v", F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
    before, made = centres, None
    for _ in range(rounds):
        after = written(_round(state, Bounds(centres, before), length, False), "vectors")
        if made is not None:
            removed(spark, made)
        state = made = after
        before, centres = centres, _moved(state, centres, length)
        if centres == before:  # nothing can change any more
            break
    final = written(_round(state, Bounds(centres, before), length, True), "vectors")
    if made is not None:
        removed(spark, made)
    sums = {r["cluster"]: int(r["s"]) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s")).collect()}
    held = lambda x: x if x < 1 << 63 else None
    total = held(sum(sums.values()))
    rows = [(c, held(s), total, hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for c, s in sorted(sums.items())]
    return final.join(F.broadcast(spark.createDataFrame(rows, found)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(length: int = LENGTH, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED, table: str = "embeddings", vec: str = "embedding") -> str:
    """The same in SQL: every vector meets every centroid in every round."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform({vec}, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM {table}
  WHERE len({vec}) = {length} AND len(list_filter({vec}, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) > {MOST // scale})) = 0
)""",
        f"k0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept ORDER BY c LIMIT {k})",
    ]
    for t in range(rounds + 1):
        parts.append(f"""a{t} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(d) AS d, arg_min(c, d * {k} + c) AS c FROM (
    SELECT r, vec_id, kept.v AS v, c, CAST(list_sum(list_transform(list_zip(kept.v, k{t}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS HUGEINT) AS d FROM kept, k{t}
  ) GROUP BY r
)""")
        if t < rounds:
            parts.append(f"""k{t + 1} AS MATERIALIZED (
  SELECT k.c, coalesce(m.v, k.v) AS v FROM k{t} k LEFT JOIN (
    SELECT c, list(f ORDER BY i) AS v FROM (
      SELECT c, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS f
      FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{t}) GROUP BY c, i
    ) GROUP BY c
  ) m ON m.c = k.c
)""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN k{rounds} k ON k.c = a.c"""
