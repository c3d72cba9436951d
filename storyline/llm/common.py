"""Helpers that the operators of this sub-package share."""

from __future__ import annotations

import os
import tempfile
import uuid
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a relation (as Catalyst estimates them) that one partition should hold.
PARTITION_BYTES = 64 << 20
#: Groups into which parts of one whole are put together before they become one.
ROUND_GROUPS = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent and the session runs in one process (tests,
    notebooks) a local folder is made and set for the session's lifetime.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or os.environ.get("STORYLINE_SHARED_DIR")
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="storyline-")
        os.environ["STORYLINE_SHARED_DIR"] = base
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/storyline/{name}-{uuid.uuid4().hex}"


def scratch(spark: SparkSession, path: str) -> None:
    """Has an existing folder deleted when the driver ends."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here, and lost executors cost nothing.

    What earlier jobs shuffled is of no use any more; Spark deletes it as soon as the
    driver's JVM has collected its handles, which is asked for here.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    scratch(spark, path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table made by :func:`written` that no plan reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        target = jvm.org.apache.hadoop.fs.Path(path)
        if "/storyline/" in path:
            target.getFileSystem(conf).delete(target, True)


def in_rounds(parts: DataFrame, schema: str, add) -> DataFrame:
    """One row for each value of the first column of ``parts`` (one int and binary columns).

    ``add`` (a table to a list of bytes, one for each binary column) puts the rows of a value together, first in
    ``ROUND_GROUPS`` groups, then those, so no task holds the parts of all tasks of a large input.
    """

    def run(key, table):
        names = [x.split()[0] for x in schema.split(", ")]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in add(table))], names=names)

    value = schema.split()[0]
    spread = parts.withColumn("_round", F.pmod(F.spark_partition_id(), F.lit(ROUND_GROUPS)))
    once = spread.groupBy(value, "_round").applyInArrow(lambda key, table: run(key, table.drop_columns(["_round"])), schema)
    return once.groupBy(value).applyInArrow(run, schema)


def partitions(df: DataFrame) -> int:
    """Partitions for a shuffle of ``df``: the session's setting, more where the input asks for it."""
    bytes_ = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    asked = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # an unknown size is reported as an absurdly large one
    return max(asked, min(100_000, bytes_ // PARTITION_BYTES) if bytes_ < 1 << 60 else 0)


def unused(columns: list[str], name: str) -> str:
    """``name`` or, where a column has it (in any case), a longer one that none has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: The place of null ids: before all others.
NO_ID = -(1 << 63)
#: Characters by which texts of one frequent id are told apart, and rows of such ids that are looked at for that, about.
BEGIN_CHARS, BEGIN_ROWS = 256, 1 << 16


def ranged(rows: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", falling: bool = False) -> DataFrame:
    """``rows`` with _id (``NO_ID`` for null), _begin and _range: ``n`` ranges of about equal row counts in the order of ids, then texts.

    Bounds are quantiles of the ids.  An id that is several of them (a frequent one, or the
    missing one) has the ranges between them to itself; its rows are spread over these by the beginning of
    their texts (_begin, null for other ids), with bounds from a sample.  Only rows of one id whose first
    ``BEGIN_CHARS`` characters are equal stay together.  With ``falling`` the greater texts of such an
    id have the lower ranges, for an order by falling ids and rising texts.
    """
    shares = [i / n for i in range(1, n)]
    keyed = rows.withColumn("_id", F.coalesce(F.col(id_col), F.lit(NO_ID)))
    found, total = keyed.agg(F.percentile_approx("_id", F.array(*map(F.lit, shares)) if shares else F.lit(0.5), max(10_000, 20 * n)), F.count(F.lit(1))).first()
    bounds = np.array([] if found is None or not shares else found, dtype=np.int64)
    values, times = np.unique(bounds, return_counts=True)
    frequent = values[times > 1].tolist()
    if not frequent:
        return keyed.withColumns({"_begin": F.lit(None).cast("string"), "_range": range_of(values, F.col("_id"))})
    often = F.col("_id").isin(frequent)
    keyed = keyed.withColumn("_begin", F.when(often, F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, BEGIN_CHARS)))
    some = F.pmod(F.xxhash64(text_col), F.lit(max(1, total // BEGIN_ROWS))) == 0
    begins: dict[int, list[str]] = {i: [] for i in frequent}
    for row in keyed.where(often & some).select("_id", "_begin").limit(4 * BEGIN_ROWS).collect():
        begins[row["_id"]].append(row["_begin"])
    cuts = {}
    for i, c in zip(values[times > 1].tolist(), times[times > 1].tolist(), strict=True):
        sample = sorted(begins[i])
        cuts[i] = [sample[len(sample) * j // c] for j in range(1, c)] if sample else []

    @F.pandas_udf("int")
    def place(ids: pd.Series, begin: pd.Series) -> pd.Series:
        k = ids.to_numpy(dtype=np.int64)
        low, high = np.searchsorted(bounds, k, side="left"), np.searchsorted(bounds, k, side="right")
        out = high.copy()
        for j in np.flatnonzero(high - low > 1):
            at = bisect_right(cuts[int(k[j])], begin.iat[j])
            out[j] = high[j] - at if falling else low[j] + 1 + at
        return pd.Series(out.astype(np.int32))

    return keyed.withColumn("_range", place("_id", "_begin"))


def range_of(bounds: np.ndarray, column: Column) -> Column:
    """The number of the range in which a long value that isn't null lies; only the key goes to Python."""

    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, values.to_numpy(dtype=np.int64), side="right").astype(np.int32))

    return place(column) if len(bounds) else F.lit(0)
