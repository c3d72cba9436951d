"""Operator 4: document fingerprints from improbable features.

* Every window of ``WINDOW`` bytes has an entropy, quantised to ``LEVELS`` levels.
  A level's rarity comes from the windows of all documents: the fewer windows have
  it, the earlier it ranks (counts are merged exactly, ``LEVELS`` numbers in all).
  Windows of hardly any or of nearly full entropy don't count.
* In each run of ``RUN`` windows the one of the rarest level (the first of equals)
  gets a vote; windows with ``VOTES`` votes or more are the document's features.
* A feature's 64-bit hash sets ``BITS`` bits of a Bloom filter of ``FILTER`` bits;
  after ``FULL`` features the next filter of the chain begins.
* Likeness: bits that two filters share, less those expected by chance, as a
  share of what they could share; each filter of the shorter chain takes its best
  match, and the mean over them counts as much of the longer chain as it covers.

Texts are taken together up to ``GROUP_BYTES``, longer ones are scored in stretches,
so memory is bounded by the longest text, not by the batch: window entropies follow from
counts of equal bytes at each of the distances 1 .. WINDOW - 1.  Entropies,
votes and hashes look at a document's own bytes only, so equal texts have equal
fingerprints wherever they stand.

Texts with fewer than ``WINDOW + RUN`` bytes have all their windows as features,
those shorter than a window have the whole text as one, empty texts have none.
Results for special cases: null texts are empty; two fingerprints without
features are alike (1) if both are empty, else not at all (0); null ids come
after all others in descending order; rows that repeat an id stand side by side
in the order of their texts; the only document is its own next one; an empty table
has no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.llm import words as W
from storyline.llm.common import partitions, ranged

WINDOW, RUN, VOTES = 32, 48, 12
LEVELS, LOWEST, HIGHEST = 1000, 100, 990
FILTER, BITS, FULL = 2048, 5, 160
#: Bytes that are scored at a time, positions whose votes are counted together, and bytes of texts held together.
BLOCK, VOTE_BLOCK, GROUP_BYTES = 1 << 16, 1 << 20, 4 << 20
#: Share of the possible overlap beyond chance that counts as none.
CHANCE = 0.1

_C = np.arange(WINDOW + 1, dtype=np.float64)
#: What adding the c-th equal byte to a window adds to sum(c log2 c), in fixed point.
GAIN = np.append(0, np.round(np.diff(_C * np.log2(np.maximum(_C, 1))) * (1 << 24))).astype(np.int64)
MOST = float(WINDOW * math.log2(WINDOW) * (1 << 24))


def levels(data: np.ndarray) -> np.ndarray:
    """The entropy level of the window that begins at each byte but the last WINDOW - 1."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int16)
    out = np.empty(n, dtype=np.int16)
    for begin in range(0, n, BLOCK):
        x = data[begin : begin + BLOCK + WINDOW - 1]
        ahead, behind = np.ones(len(x), dtype=np.uint8), np.ones(len(x), dtype=np.uint8)
        for d in range(1, WINDOW):
            same = (x[d:] == x[:-d]).view(np.uint8)
            ahead[:-d] += same
            behind[d:] += same
        total = np.cumsum(GAIN[behind])[WINDOW - 1 :]
        total[1:] -= np.cumsum(GAIN[ahead])[: len(total) - 1]
        out[begin : begin + len(total)] = (LEVELS * (1 - total / MOST)).astype(np.int16)
    return out


def _inside(offsets: np.ndarray, n: int, size: int) -> np.ndarray:
    """Whether the ``size`` bytes from each of the first n positions lie in one document."""
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    return np.arange(n) + size <= ends


def level_counts(texts: pa.Array) -> np.ndarray:
    """Windows of each level, within the texts."""
    data, offsets = W.buffers(texts)
    total = np.zeros(LEVELS + 1, dtype=np.int64)
    for begin, part, own in _stretches(data, offsets, 0, WINDOW - 1):
        found = levels(part)[: min(VOTE_BLOCK, len(data) - begin)]
        total += np.bincount(found[_inside(own, len(found), WINDOW)], minlength=LEVELS + 1)
    return total


def _stretches(data: np.ndarray, offsets: np.ndarray, before: int, after: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``VOTE_BLOCK`` bytes from each ``begin`` on with so many before and after them, and the offsets of the texts cut to these."""
    for begin in range(0, len(data), VOTE_BLOCK):
        low, high = max(0, begin - before), min(len(data), begin + VOTE_BLOCK + after)
        yield begin, data[low:high], _cut(offsets, low, high)


def _cut(offsets: np.ndarray, low: int, high: int) -> np.ndarray:
    i, j = int(np.searchsorted(offsets, low, side="right")) - 1, int(np.searchsorted(offsets, high, side="left"))
    return np.clip(offsets[i : j + 1], low, high) - low


def rarity_of(counts: np.ndarray) -> np.ndarray:
    """A rank for each level, the rarest 1; ``LEVELS + 2`` for levels that don't count."""
    rank = np.empty(LEVELS + 1, dtype=np.int64)
    rank[np.lexsort((np.arange(LEVELS + 1), counts))] = np.arange(1, LEVELS + 2)
    rank[:LOWEST] = rank[HIGHEST + 1 :] = LEVELS + 2
    return rank


def feature_places(data: np.ndarray, offsets: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Positions of the features, ascending."""
    small = np.diff(offsets) < WINDOW + RUN
    out = [np.zeros(0, dtype=np.int64)]
    for begin, part, own in _stretches(data, offsets, RUN - 1, RUN + WINDOW):
        low = max(0, begin - RUN + 1)
        first = int(np.searchsorted(offsets, low, side="right")) - 1
        places = _places(part, own, rarity, small[first : first + len(own) - 1]) + low
        out.append(places[(places >= begin) & (places < begin + VOTE_BLOCK)])
    return np.concatenate(out)


def _places(data: np.ndarray, offsets: np.ndarray, rarity: np.ndarray, small: np.ndarray) -> np.ndarray:
    rank = rarity[levels(data)]
    n = len(rank)
    if not n:
        return np.zeros(0, dtype=np.int64)
    own = _inside(offsets, n, WINDOW)
    key = (rank << 40) | np.arange(n)
    best = key
    covered = 1
    while covered < RUN <= n:
        # minima over exactly RUN windows: the last step overlaps
        step = min(covered, RUN - covered)
        best = np.minimum(best[:-step], best[step:])
        covered += step
    votes = np.zeros(n, dtype=np.int64)
    if n >= RUN:
        runs = best[_inside(offsets, len(best), WINDOW + RUN - 1)]
        votes = np.bincount(runs & ((1 << 40) - 1), minlength=n)
    chosen = own & (votes >= VOTES) & (rank <= LEVELS + 1)
    return np.flatnonzero(chosen | (own & np.repeat(small, np.diff(offsets))[:n]))


def fingerprints(texts: pa.Array, rarity: np.ndarray) -> list[np.ndarray]:
    """The chain of filters of each text: a (filters, FILTER / 8) array of bytes."""
    data, offsets = W.buffers(texts)
    places = feature_places(data, offsets, rarity)
    doc = np.searchsorted(offsets, places, side="right") - 1
    windows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[places] if len(places) else np.zeros((0, WINDOW), np.uint8)
    parts = np.ascontiguousarray(windows).view("<u8")
    h = np.zeros(len(places), dtype=np.uint64)
    for i in range(parts.shape[1]):
        h = W.mixed(h + parts[:, i] * np.uint64(2 * i + 0x9E3779B97F4A7C15 | 1))
    # texts shorter than a window: the whole text is the one feature
    short = np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) < WINDOW))
    if len(short):
        own = [int.from_bytes(hashlib.blake2b(data[offsets[i] : offsets[i + 1]].tobytes(), digest_size=8).digest(), "little") for i in short.tolist()]
        doc, h = np.append(doc, short), np.append(h, np.array(own, dtype=np.uint64))
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    counts = np.bincount(doc, minlength=len(texts))
    chain = -(-counts // FULL)
    first = np.cumsum(chain) - chain
    nth = np.arange(len(doc)) - (np.cumsum(counts) - counts)[doc]
    at = (first[doc] + nth // FULL) * FILTER
    bits = np.zeros(int(chain.sum()) * FILTER, dtype=np.uint8)
    for i in range(BITS):
        bits[at + (h >> np.uint64(11 * i) & np.uint64(FILTER - 1)).astype(np.int64)] = 1
    filters = np.packbits(bits).reshape(-1, FILTER // 8)
    return [filters[f : f + c] for f, c in zip(first.tolist(), chain.tolist(), strict=True)]


ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.int64)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """0 to 1; symmetric, and 1 for equal chains."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    if x.shape == y.shape and (x == y).all():
        return 1.0
    short, long_ = (x, y) if len(x) <= len(y) else (y, x)
    a, b = ONES[short].sum(1), ONES[long_].sum(1)
    total = 0.0
    for i in range(len(short)):
        both = ONES[short[i] & long_].sum(1)
        most, chance = np.maximum(a[i], b), a[i] * b / FILTER
        floor = chance + CHANCE * np.maximum(np.minimum(a[i], b) - chance, 0) * np.minimum(a[i], b) / most
        total += float(np.clip((both - floor) / np.maximum(most - floor, 1e-9), 0, 1).max())
    mean = total / len(short)
    return mean * 2 * len(short) / (len(short) + len(long_))


def as_text(chain: np.ndarray) -> str:
    """Number of filters, then their bytes in base64."""
    return f"{len(chain)}:{base64.b64encode(chain.tobytes()).decode()}"


def rarities(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Ranks of the levels by the windows of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, dtype=np.int64)
        for batch in batches:
            for i, j in W.slices(batch.column(0), GROUP_BYTES):
                total += level_counts(batch.column(0).slice(i, j - i))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["level", "n"])

    counts = np.zeros(LEVELS + 1, dtype=np.int64)
    for row in docs.select(text_col).mapInArrow(count, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[row["level"]] = row["n"]
    return rarity_of(counts)


def edited(text: str, other: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of ``other``."""
    k = len(text) // 2
    return text[: len(text) - k] + other[:k]


def compared(docs: DataFrame, rarity: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to it and to the next document's."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if rarity is None:
        rarity = rarities(rows)
    n = partitions(rows)
    # ranges of descending ids: null ids last, so they are given the lowest
    placed = ranged(rows, n, falling=True)
    # the first of a range has its greatest id and, of these, the least text
    mark = F.min(F.struct(F.bitwise_not("_id").alias("id"), "_begin")).alias("first")
    firsts = {r["_range"]: (~r["first"]["id"], r["first"]["_begin"]) for r in placed.groupBy("_range").agg(mark).collect()}
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not firsts:
        return spark.createDataFrame([], schema)
    # a range's last document is followed by the first of the next lower range that has any, the last of all by the first of all
    used = sorted(firsts)
    guest = {firsts[r]: used[(i + 1) % len(used)] for i, r in enumerate(used)}
    # one row for each range, so the broadcast is bounded by their number
    lent = spark.createDataFrame([(*first, to) for first, to in guest.items()], "lent_id long, lent_begin string, to int")
    held = placed.join(F.broadcast(lent), (F.col("_id") == F.col("lent_id")) & F.col("_begin").eqNullSafe(F.col("lent_begin")), "left")
    # of rows that repeat a lent id the first by text stands first
    copies = F.when(F.col("to").isNull(), F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("lent")))).otherwise(
        F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("lent")), F.struct(F.col("to").alias("r"), F.lit(True).alias("lent")))
    )
    dealt = held.withColumn("copy", F.explode(copies)).select(F.col("copy.r").alias("range"), F.col("copy.lent").alias("lent"), "_id", "doc_id", "text")
    dealt = dealt.repartitionById(n, F.col("range")).sortWithinPartitions(F.asc("lent"), F.desc("_id"), "text").select("lent", "doc_id", "text")

    def rows_of(ids: list, texts: list[str], own: list[np.ndarray], changed: list[str], theirs: list[np.ndarray], after: list[np.ndarray]) -> pa.RecordBatch:
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([len(x) for x in texts], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
            pa.array([as_text(x) for x in own], pa.string()),
            pa.array([as_text(x) for x in theirs], pa.string()),
            pa.array([likeness(x, y) for x, y in zip(own, theirs, strict=True)], pa.float64()),
            pa.array([likeness(x, y) for x, y in zip(own, after, strict=True)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the document whose next one hasn't come yet: id, text, fingerprint
        over = False
        for batch in batches:
            for i, j in W.slices(batch.column(2), GROUP_BYTES):
                part = batch.slice(i, j - i)
                lent, ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()
                if over:
                    break
                chains = fingerprints(part.column(2), rarity)
                if True in lent:  # the first lent document closes the range
                    k = lent.index(True) + 1
                    ids, texts, chains, over = ids[:k], texts[:k], chains[:k], True
                if waiting:
                    ids, texts, chains = [waiting[0], *ids], [waiting[1], *texts], [waiting[2], *chains]
                changed = [edited(x, y) for x, y in zip(texts, texts[1:], strict=False)]
                theirs = fingerprints(pa.array(changed, pa.string()), rarity) if changed else []
                yield rows_of(ids[:-1], texts[:-1], chains[:-1], changed, theirs, chains[1:])
                waiting = ids[-1], texts[-1], chains[-1]

    return dealt.mapInArrow(run, schema)
