"""Operator 2: token-id files.

Documents are dealt into ranges of ascending ids (bounds from the id column
alone), each range is sorted and its worker writes three flat files into the
shared folder:

    NAME.bin  ids, little-endian unsigned, 2 bytes where the vocabulary allows it, else 4
    NAME.off  64-bit offsets into it: one for each document, and the end
    NAME.doc  64-bit document ids

A name is made of the range and the attempt that wrote it.  The manifest (one row
for each range) names the files of the attempts that ended well, so lost or doubled
attempts do no harm, and gives the bases of the ranges by prefix sums.  Reading
maps the files into memory; from a file system that can't, it reads stretches of them.

Results for special cases: null and empty texts hold the end id alone; null
document ids come first; rows that repeat an id stand side by side, in the order
of their texts; an empty table has no files; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.llm.bpe import encoder
from storyline.llm.common import new_path, partitions, ranged, scratch

MANIFEST = "part int, name string, n_docs long, n_tokens long, width int"
NULL_ID = np.iinfo(np.int64).min


class _Files:
    """The three open files of one range and attempt."""

    def __init__(self, folder: str, part: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.part, self.attempt = part, TaskContext.get().taskAttemptId()
        self.name = f"{part:06d}-{self.attempt}"
        self.out = {k: self.fs.open_output_stream(f"{self.folder}/{self.name}.{k}") for k in ("bin", "off", "doc")}
        self.docs = self.tokens = 0

    def add(self, ids: np.ndarray, doc_id: int) -> None:
        self.out["off"].write(np.int64(self.tokens).tobytes())
        self.out["doc"].write(np.int64(doc_id).tobytes())
        self.out["bin"].write(ids.tobytes())
        self.docs += 1
        self.tokens += len(ids)

    def close(self) -> tuple[int, int, int]:
        self.out["off"].write(np.int64(self.tokens).tobytes())
        for stream in self.out.values():
            stream.close()
        return self.part, self.name, self.docs, self.tokens


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and returns the manifest: part, name, n_docs, n_tokens, width, base_doc, base_token."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = partitions(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        tail = np.array([] if end_id is None else [end_id], dtype=bpe.dtype)
        files = None
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), bpe.encode_arrow(batch.column(1)), strict=True):
                files = files or _Files(folder, TaskContext.get().partitionId())
                files.add(np.concatenate([ids, tail]), NULL_ID if doc_id is None else doc_id)
        done = [files.close()] if files else []
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([x[0] for x in done], pa.int32()),
                "name": pa.array([x[1] for x in done], pa.string()),
                "n_docs": pa.array([x[2] for x in done], pa.int64()),
                "n_tokens": pa.array([x[3] for x in done], pa.int64()),
                "width": pa.array([bpe.dtype.itemsize for _ in done], pa.int32()),
            }
        )

    dealt = ranged(rows, n).repartitionById(n, F.col("_range"))
    made = dealt.sortWithinPartitions("_id", "text").select("doc_id", "text").mapInArrow(run, MANIFEST).collect()
    manifest, base_doc, base_token = [], 0, 0
    for row in sorted(made):  # one row for each range, bounded by their number
        manifest.append((*row, base_doc, base_token))
        base_doc, base_token = base_doc + row.n_docs, base_token + row.n_tokens
    return spark.createDataFrame(manifest, f"{MANIFEST}, base_doc long, base_token long")


class _Stretches:
    """A file as an array of which stretches are taken: mapped into memory where the file system is local."""

    def __init__(self, fs: pafs.FileSystem, name: str, dtype: str):
        self.dtype = np.dtype(dtype)
        self.size = fs.get_file_info(name).size // self.dtype.itemsize
        self.mapped = self.file = None
        if not isinstance(fs, pafs.LocalFileSystem):
            self.file = fs.open_input_file(name)
        elif self.size:
            self.mapped = np.memmap(name, dtype=dtype, mode="r")

    def take(self, begin: int, end: int) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[begin:end]
        if self.file is None or begin >= end:
            return np.zeros(0, dtype=self.dtype)
        self.file.seek(begin * self.dtype.itemsize)
        return np.frombuffer(self.file.read((end - begin) * self.dtype.itemsize), dtype=self.dtype)


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame, derive=None, schema: str = "ids array<long>") -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and what ``derive(ids)`` gives for each document."""
    derive = derive or (lambda ids: (ids.astype(np.int64),))
    names = [x.split()[0] for x in schema.split(", ")]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(f"doc_id long, start long, n_tokens long, {schema}")
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                ids, off, doc = (_Stretches(fs, f"{root}/{row['name']}.{k}", t) for k, t in (("bin", f"<u{row['width']}"), ("off", "<i8"), ("doc", "<i8")))
                for first in range(0, doc.size, 1000):
                    last = min(first + 1000, doc.size)
                    at = off.take(first, last + 1).astype(np.int64)
                    rows = [derive(ids.take(i, j)) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    columns = {
                        "doc_id": [None if x == NULL_ID else x for x in doc.take(first, last).tolist()],
                        "start": at[:-1] + row["base_token"],
                        "n_tokens": np.diff(at),
                    } | {k: [x[j] for x in rows] for j, k in enumerate(names)}
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    n = max(1, manifest.count())
    return manifest.repartition(n, "part").mapInArrow(run, out)


def crc32_of_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def token_file_digest(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Writes the files of ``docs``, reads them back, and returns doc_id, start, n_tokens and ids_crc32."""
    spark = docs.sparkSession
    folder = new_path(spark, "token-files")
    manifest = write_token_files(docs, path, folder, end_id)
    scratch(spark, folder)
    return read_token_files(spark, folder, manifest, lambda ids: (crc32_of_ids(ids),), "ids_crc32 long")
