"""Operator 12: near duplicates by SimHash fingerprints and BK-trees.

A fingerprint bit is 1 if it is set in over half the XXH64 values of a text's word
shingles (repeats count).  Documents of one fingerprint are one class, so copies are
compared once.  Classes within ``radius`` bits link.

The search is by BK-trees: a node's children are keyed by their integer Hamming
distance to it, and a query at distance d follows only the edges d - radius to
d + radius.  A single tree of all classes would have to reach every task and grow
with the data, so classes are dealt to shards first, without loss: the open bits are
cut into ``radius + 1`` stretches, and two fingerprints that differ in ``radius`` bits at
most agree on a whole stretch, hence on its beginning.  A class goes to one shard for
each stretch; the stretch's beginning is as wide as it takes for about ``TREE``
classes in a shard (a search visits a large part of its tree, so trees are small).  A shard that holds more (many classes with one beginning) is
cut again, by whole stretches of its open bits, until none does or few bits are open (``FEW_BITS``, which
bound a shard by themselves).  So each tree, and what its queries meet, has a bounded
size; a shard's tree goes to the task that has this shard's queries and nowhere else.
Most shards that were cut hold one class or few, so a task gets many whole shards at once and
builds and searches all their trees level by level together (a forest).

A shard returns a star for each of its own components (at most one edge for each
class), not all pairs; components of the stars' union are those of all links.

Results for special cases: null and empty texts and those without words have
fingerprint zero, which links like any other; null ids keep a row each, with their
component's smallest id (null if it has none); rows that repeat an id are documents
of their own; an empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.llm import words as W
from storyline.llm.common import partitions, removed, written
from storyline.llm.components import components

SHINGLE, SEED, RADIUS, BITS = 3, 42, 2, 64
#: Classes that a shard holds about, and open bits from which a shard isn't cut any more.
TREE, FEW_BITS = 512, 16
#: Bytes of texts, shingles and queries that are handled together.
GROUP, BLOCK, QUERIES = 1 << 19, 1 << 16, 2048
#: Classes of whole shards that are handled in one call, about.
FOREST = 16384


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words with one byte of white space between: the bytes, words' begins and ends, first word of each text."""
    begin, end = W.word_spans(data, offsets)
    first = np.searchsorted(begin, offsets)
    keep = ~W.WHITE[data]
    keep[end[end < len(data)]] = True  # what follows a word: white space, or the next text's first byte
    place = np.cumsum(keep) - keep
    low = np.where(W.WHITE[data], np.uint8(32), W.LOWERED[data])[keep]
    return low.tobytes(), place[begin], place[begin] + end - begin, first


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, words: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint (uint64) of each text."""
    raw, begin, end, first = _spaced(data, offsets)
    n = np.diff(first)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    starts = np.cumsum(count) - count
    total = int(count.sum())
    which = np.repeat(np.arange(len(n)), count)
    at = first[which] + np.arange(total) - starts[which]
    last = np.where(n[which] >= words, at + words - 1, first[which + 1] - 1) if total else at
    set_ = np.zeros((len(n), BITS), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, total, BLOCK):
        spans = zip(begin[at[k : k + BLOCK]].tolist(), end[last[k : k + BLOCK]].tolist(), strict=True)
        hashes = np.array([digest(raw[i:j], seed) for i, j in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        owner = which[k : k + BLOCK]
        edges = np.flatnonzero(np.diff(owner, prepend=-1))
        set_[owner[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int32)
    over = 2 * set_ > count[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every row; no shuffle."""
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints_of(data, offsets, words, seed) for data, offsets in W.groups(*W.buffers(batch.column(1)), GROUP)]
            fp = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, out)


class BKTree:
    """BK-trees over 64-bit values that differ within a tree, built and searched level by level with numpy.

    ``root`` has the place of each value's root, the first value of its tree (one tree without it).
    """

    def __init__(self, values: np.ndarray, root: np.ndarray | None = None):
        self.values = values
        self.root = np.zeros(len(values), dtype=np.int64) if root is None else root
        #: child[node, distance]: the child on the edge of this distance, or -1
        self.child = np.full((len(values), BITS + 1), -1, dtype=np.int32)
        waiting = np.flatnonzero(self.root != np.arange(len(values)))
        parent = self.root[waiting]
        while len(waiting):
            distance = np.bitwise_count(values[waiting] ^ values[parent])
            edge = parent * (BITS + 1) + distance
            new = self.child[parent, distance] < 0
            taken, first = np.unique(edge[new], return_index=True)
            self.child.reshape(-1)[taken] = waiting[new][first]
            parent = self.child[parent, distance].astype(np.int64)
            waiting, parent = waiting[parent != waiting], parent[parent != waiting]

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of query, node) of all pairs within ``radius``, in the first value's tree."""
        who = np.arange(len(queries) if len(self.values) else 0)
        return self._walk(queries, who, np.zeros(len(who), dtype=np.int64), radius)

    def earlier(self, places: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of place, node) of all pairs within ``radius`` of values at ``places`` and those before them in their trees.

        A node's children come after it, so a search stops where its own place is reached; the later value of a pair finds the earlier one.
        """
        who = np.flatnonzero(self.root[places] < places)
        return self._walk(self.values[places], who, self.root[places[who]], radius, places)

    def _walk(self, queries: np.ndarray, who: np.ndarray, node: np.ndarray, radius: int, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(who):
            distance = np.bitwise_count(queries[who] ^ self.values[node]).astype(np.int64)
            near = distance <= radius
            found.append((who[near], node[near]))
            edges = distance[:, None] + np.arange(-radius, radius + 1)
            child = np.where((edges >= 0) & (edges <= BITS), self.child[node[:, None], np.clip(edges, 0, BITS)], -1)
            i, j = np.nonzero(child >= 0 if before is None else (child >= 0) & (child < before[who][:, None]))
            who, node = who[i], child[i, j].astype(np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (who, node)


def merge(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unites the sets of i and j; ``parent`` names the smallest member of each set, before and after."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def stars(values: np.ndarray, radius: int, shard: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (u, v) that join exactly what links of at most ``radius`` bits join among ``values``; with ``shard`` (a number for each value), among those of a shard."""
    shard = np.zeros(len(values), dtype=np.int64) if shard is None else shard
    order = np.lexsort((values, shard))
    values, shard = values[order], shard[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (shard[1:] != shard[:-1])
    values, shard = values[new], shard[new]
    root = np.searchsorted(shard, shard)
    # what is alone in its shard has no links there
    alone = np.bincount(root, minlength=len(values))[root] == 1
    values, shard = values[~alone], shard[~alone]
    tree, parent = BKTree(values, np.searchsorted(shard, shard)), np.arange(len(values))
    for k in range(0, len(values), QUERIES):
        who, node = tree.earlier(np.arange(k, min(k + QUERIES, len(values))), radius)
        merge(parent, who + k, node)
    child = np.flatnonzero(parent != np.arange(len(values)))
    return values[parent[child]], values[child]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cuts(mask: int, parts: int, width: int) -> list[int]:
    """Masks that take in besides the bits of ``mask`` the first ``width`` bits of each stretch of the open ones."""
    open_ = [b for b in range(BITS) if not mask >> b & 1]
    ends = [len(open_) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << b for b in open_[i:j][:width]) for i, j in zip(ends[:-1], ends[1:], strict=True)]


def shards(classes: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """fp, mask and value (the bits of fp under mask): what links shares some (mask, value)."""
    parts, masks = radius + 1, {0}
    rows = classes.select("fp", F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("value"))
    while True:
        hot = rows.groupBy("mask", "value").count().where(F.col("count") > tree)
        most = {r["mask"] & (1 << BITS) - 1: r["most"] for r in hot.groupBy("mask").agg(F.max("count").alias("most")).collect()}
        most = {m: n for m, n in most.items() if m in masks and BITS - m.bit_count() > FEW_BITS}
        if not most:
            return rows
        finer = {m: _cuts(m, parts, BITS if m else math.ceil(math.log2(n / tree))) for m, n in most.items()}
        masks = {x for cut in finer.values() for x in cut}
        again = F.expr(f"CASE mask {' '.join(f'WHEN {_signed(m)} THEN array({", ".join(f"{_signed(x)}L" for x in cut)})' for m, cut in finer.items())} END")
        if 0 in most:  # all classes are one shard: no join is needed to say so
            split = rows.withColumn("finer", again)
        else:
            split = rows.join(hot.select("mask", "value", F.lit(True).alias("cut")), ["mask", "value"], "left").withColumn("finer", F.when(F.col("cut"), again))
        split = split.select("fp", F.explode(F.coalesce("finer", F.array("mask"))).alias("mask"))
        before, rows = rows, written(split.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))), "shards")
        if 0 not in most:
            removed(rows.sparkSession, before)


def links(classes: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Edges (u, v) between fingerprints whose components are those of all links."""

    def search(table: pa.Table) -> pa.Table:
        mask, value = (table.column(c).to_numpy() for c in ("mask", "value"))
        order = np.lexsort((value, mask))
        shard = np.zeros(len(order), dtype=np.int64)
        shard[order[1:]] = np.cumsum((np.diff(mask[order]) != 0) | (np.diff(value[order]) != 0))
        u, v = stars(table.column("fp").to_numpy().view(np.uint64), radius, shard)
        return pa.table([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    rows = shards(classes, radius, tree)
    forest = F.pmod(F.xxhash64("mask", "value"), F.lit(max(1, rows.count() // FOREST)).cast("long"))
    return rows.withColumn("forest", forest).groupBy("forest").applyInArrow(search, "u long, v long")


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = SHINGLE, seed: int = SEED, tree: int = TREE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    held = written(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    classes = written(held.groupBy("fp").agg(F.min("doc_id").alias("first")).repartition(partitions(held)), "classes")
    linked = components(links(classes, radius, tree)).select(F.col("node").alias("fp"), "component")
    named = classes.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = written(named.join(least, "component").select("fp", "component_id"), "named")
    return held.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
