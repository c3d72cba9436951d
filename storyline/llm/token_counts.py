"""Operator 3: token counts.

An Arrow function encodes batches and returns lengths only; ids never leave the
worker.  Batches are balanced by bytes: texts are grouped until they hold about
``BATCH_BYTES``, and a text longer than ``PIECE_CHARS`` is first split at safe
boundaries (white space, which ends a word for the vocabulary, so that the sum
of the pieces' counts is the whole text's).  No shuffle.

Results for special cases: null and empty texts have 0 bytes and 0 tokens;
special strings inside texts count as the library's default has it (one token);
a text without white space is one piece however long; repeated rows are counted
each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.llm.bpe import encoder

BATCH_BYTES = 1 << 20
PIECE_CHARS = 1 << 16
LIMIT = 2048

_SAFE = re.compile(r"(?<=[^\s])[ \n]")


def pieces(text: str) -> list[str]:
    """``text`` cut before white space, each piece as short as may be above PIECE_CHARS."""
    out, start = [], 0
    while len(text) - start > PIECE_CHARS:
        cut = _SAFE.search(text, start + PIECE_CHARS)
        if not cut:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


def batches_by_bytes(texts: list[str], n_bytes: list[int]) -> Iterator[tuple[list[int], list[str]]]:
    """(row numbers, pieces) of about BATCH_BYTES each."""
    rows: list[int] = []
    batch: list[str] = []
    held = 0
    for row, (text, size) in enumerate(zip(texts, n_bytes, strict=True)):
        cut = pieces(text)
        for piece in cut:
            if held and held + size // len(cut) > BATCH_BYTES:
                yield rows, batch
                rows, batch, held = [], [], 0
            rows.append(row)
            batch.append(piece)
            held += size // len(cut)
    if batch:
        yield rows, batch


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every row."""
    out = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            counts = np.zeros(len(texts), dtype=np.int64)
            for rows, cut in batches_by_bytes(texts.to_pylist(), n_bytes.to_pylist()):
                np.add.at(counts, rows, list(bpe.lengths(cut)))
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(counts)], names=[id_col, "n_bytes", "n_tokens"])

    counted = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, out)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
