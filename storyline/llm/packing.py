"""Operator 8: packing token streams into sequences, by an order-preserving dynamic programme.

Documents are dealt into ranges of ascending ids and packed in that order, each
range on its own.  In the token stream of a range, the places where a sequence
may end are the ends of documents, the ends of sentences, and (where a sentence
is longer than ``STRIDE``) every ``STRIDE`` tokens.  The programme finds the cuts
with the least sum of

* padding: a sequence is filled up to ``size`` unless its length is a power of two,
* the cost of the cut: none after a document, ``SENTENCE`` after a sentence,
  ``ANYWHERE`` elsewhere,
* ``SEQUENCE`` for each sequence, so that short powers of two don't win by number.

With g(i) = cost(i) + position(i) the transition from i to j at a distance of at
most ``size`` costs the smallest g in a window that only moves forward, which a
monotone queue yields in constant time; distances that are powers of two are looked up
one by one.  The programme runs over windows of ``HORIZON`` tokens: cuts before
its last sequences are settled and the rest is carried on, so memory is bounded
however long a range or a document is.

Results for special cases: null and empty texts are the end id alone; null ids
come first; rows that repeat an id are packed each, in the order of their texts; an
empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.llm.bpe import encoder
from storyline.llm.common import partitions, ranged

SIZE = 2048
SENTENCE, ANYWHERE, SEQUENCE = 16, 64, 256
STRIDE, HORIZON = 64, 1 << 18
#: Strings after which a sentence ends, where they are tokens of the vocabulary.
ENDS = (".</w>", "!</w>", "?</w>", ".", "!", "?", "。", "\n")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_cuts(places: list[int], costs: list[int], size: int = SIZE) -> list[int]:
    """The cheapest ends of sequences for a stream that begins at 0.

    ``places`` rise, at most ``size`` apart, and the last is the stream's end;
    ``costs`` are those of cutting there.
    """
    powers = [1 << k for k in range(size.bit_length()) if 1 << k <= size]
    at = [0, *places]
    g = [0] * len(at)  # cost so far + position
    before = [0] * len(at)
    index = {0: 0}
    queue: deque[int] = deque([0])
    for j in range(1, len(at)):
        here = at[j]
        low = here - size
        while at[queue[0]] < low:
            queue.popleft()
        best = queue[0]
        # cost(i) + size - (here - position(i)), plus position(here)
        least = g[best] + size
        for p in powers:
            i = index.get(here - p)
            if i is not None and g[i] + p < least:
                least, best = g[i] + p, i
        least += costs[j - 1] + SEQUENCE
        g[j], before[j] = least, best
        index[here] = j
        while queue and g[queue[-1]] >= least:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = before[j]
    return cuts[::-1]


def places_of(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Where the stream may be cut and the cost of each cut; ``ends`` are those of the documents."""
    cost = np.zeros(len(ids) + 1, dtype=np.int32)
    cost[1:][sentence_end[ids]] = SENTENCE
    cost[STRIDE::STRIDE] = np.where(cost[STRIDE::STRIDE] == 0, ANYWHERE, cost[STRIDE::STRIDE])
    cost[0] = 0
    cost[ends] = -1
    places = np.flatnonzero(cost)
    # a stride is a place only where no better one is within the stride
    better = np.flatnonzero((cost == -1) | (cost == SENTENCE))
    if len(better):
        mine = cost[places] == ANYWHERE
        k = np.minimum(np.searchsorted(better, places), len(better) - 1)
        near = np.minimum(np.abs(better[k] - places), np.abs(better[np.maximum(k - 1, 0)] - places)) < STRIDE
        places = places[~(mine & near)]
    return places, np.maximum(cost[places], 0)


class _Packer:
    """Packs the stream of one range; holds about HORIZON tokens."""

    def __init__(self, sentence_end: np.ndarray, first_sequence: int, size: int):
        self.sentence_end, self.sequence, self.size = sentence_end, first_sequence, size
        self.docs: deque = deque()  # (doc_id, ids, tokens already packed)
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append([doc_id, ids, 0])
        self.held += len(ids)
        if self.held >= HORIZON + 8 * self.size:
            yield from self.pack(False)

    def pack(self, last: bool) -> Iterator[tuple]:
        """Settles the cuts of what is held, but for the last sequences if more is to come."""
        while self.held:
            rest = [x[1][x[2] :] for x in self.docs]
            ids = np.concatenate(rest)
            ends = np.cumsum([len(x) for x in rest])
            window = min(len(ids), HORIZON + 8 * self.size)
            whole = window == len(ids)
            ends = ends[ends <= window]
            places, costs = places_of(ids[:window], ends, self.sentence_end, self.size)
            if places[-1] != window:
                places, costs = np.append(places, window), np.append(costs, ANYWHERE)
            cuts = best_cuts(places.tolist(), costs.tolist(), self.size)
            if not (whole and last):
                cuts = [c for c in cuts if c <= window - 4 * self.size]
            yield from self._emit(cuts)
            if whole:
                return

    def _emit(self, cuts: list[int]) -> Iterator[tuple]:
        begin = 0
        for cut in cuts:
            offset = 0
            while begin < cut:
                doc = self.docs[0]
                doc_id, ids, done = doc
                n = min(len(ids) - done, cut - begin)
                yield doc_id, done, n, zlib.crc32(ids[done : done + n].astype("<u4").tobytes()), len(ids), self.sequence, offset
                offset += n
                begin += n
                doc[2] += n
                if doc[2] == len(ids):
                    self.docs.popleft()
            self.sequence += 1
        self.held -= begin


def packed(docs: DataFrame, path: str, end_id: int = 1, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = partitions(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        vocabulary = bpe.library.get_vocab()
        sentence_end = np.zeros(bpe.size, dtype=bool)
        sentence_end[[vocabulary[x] for x in ENDS if x in vocabulary]] = True
        tail = np.array([end_id], dtype=bpe.dtype)
        packer = _Packer(sentence_end, TaskContext.get().partitionId() << 40, size)

        def out(pieces: list[tuple]) -> pa.RecordBatch:
            columns = zip(*pieces, strict=True) if pieces else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            pieces: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), bpe.encode_arrow(batch.column(1)), strict=True):
                pieces += packer.add(doc_id, np.concatenate([ids, tail]))
            yield out(pieces)
        yield out(list(packer.pack(True)))

    dealt = ranged(rows, n).repartitionById(n, F.col("_range"))
    return dealt.sortWithinPartitions("_id", "text").select("doc_id", "text").mapInArrow(run, PIECES)
