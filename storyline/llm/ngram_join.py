"""Operator 1: n-gram Jaccard join of documents, exact.

The incidence of documents and shingles is a sparse matrix A; links are the
entries of A A' that reach a bound which follows from the two sizes.  The product
is taken block by block: blocks of columns say which entries can be large enough,
blocks of rows add up their overlap counts.

1. ``_digested``: shingle sets of whole texts (numpy on Arrow batches), of which a
   name of 128 bits, the size and a sketch are written.  Rows of A are made from the
   texts where they are needed; written out they take twice the input's
   space.  Equal sets are one class from here on, so exact copies cost one row each.  Shingles that recur within a batch are counted;
   the ``HOT`` most frequent are ranked last.
2. ``_blocks``: of a set of n shingles only the first n - ceil(t n) + 1 in rank
   order are dealt out: two sets that reach t share one of them.  They travel as
   packed arrays, one row for each (batch, block of columns); a class is sent once
   a batch.  Within a block, columns with the same members are one; members are
   written out as (members' signature, first member, member).  Columns that
   very many classes share (``HEAVY``) don't go to one task: they travel as plain
   rows, their first member comes from a partial aggregation and an equi-join.
3. Entries are wanted along stars: each member against its block's first.  Pairs
   whose sizes exclude the bound go at once, then pairs for which a parity
   sketch (one bit a shingle) proves too many differing shingles.
   The first is drawn by a hash with one of ``FIRSTS`` salts, so a large group is
   met from several of its members.
4. ``_product``: the rows of the remaining members are dealt to their first's row, at
   most about ``ROWS`` to a block, and multiplied with it column block by column block:
   overlap counts accumulate, and after each block a pair goes whose count, with
   all that its row has left, stays below what the two sizes ask for.
5. Components of these links.  Blocks whose members are all in one component are
   done.  In the others every pair of members in different components follows,
   but for pairs that are excluded by size, by the triangle inequality of the
   Jaccard distance to the block's first member, or by the sketches, all within
   the join, where of the large blocks only the first that two members share brings them
   together.  So a group of thousands of near copies costs a few pairs a member,
   and no link between components is lost.
6. Components of all links; a document's component is named by its smallest id.

Shingles are known by 64 bits (6 of them their length) under a key drawn for each
run (see ``words``): for two given sequences of words they agree with a
probability of about 2^-58, and no text can be made to agree with another.

Results for special cases: null, empty and blank texts have an empty set, are
linked with nothing and are their own component; a text with fewer words than a
shingle has one shingle, the whole sequence; rows that repeat an id are rows of
their own in the result; a null id can't name a component, so such a row is
linked with nothing and its component is null; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.llm import words as W
from storyline.llm.common import in_rounds, removed, written
from storyline.llm.components import components

THRESHOLD = Fraction(3, 4)
#: A shingle recurs in a batch if two of its documents and one in so many have it; it is frequent if so many do in batches where it recurs.
RECURS, FREQUENT = 20_000, 4
#: Parts in which a batch's shingles are counted, and postings that a worker packs together.
PARTS, PACKED = 4, 300_000
#: Bytes of texts whose sets are held together.
SLICE = 8 << 20
#: Frequent shingles that are ranked last at most.  This bounds the broadcast (8 bytes each); the ranking affects cost only.
HOT = 1_000_000
#: Postings of one block, about, and bits of a sketch at most.
BLOCK_POSTINGS, SKETCH_BITS = 1_000_000, 1 << 17
#: Members from which a column counts as heavy, rows multiplied with one first together, and column blocks of that product.
HEAVY, ROWS, COLUMN_BLOCKS = 100_000, 1024, 4
#: Tasks over which a block's members are dealt where it is looked at whole.
SALTS = 16
#: Different firsts of blocks with the same members, about, and members from which a block counts as large.
FIRSTS, LARGE = 8, 64
#: Bits of the Bloom filter that keeps sets of unneeded documents from being shuffled.  This bounds the broadcast.
BLOOM_BITS = 1 << 25


def _name(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    return tuple(int(W.mixed(shingles ^ np.uint64(salt)).sum(dtype=np.uint64).view(np.int64)) for salt in (0x51ED270B, 0xA3EC4EC5F1D2B7))


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity of the shingles that fall on each bit, with two to four bits for each shingle."""
    bits = min(SKETCH_BITS, max(64, 2 << (len(shingles) - 1).bit_length()))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _digested(docs: DataFrame, key: int, words: int) -> DataFrame:
    """Rows of documents (kind 0: doc_id, n, a, b; of each class the first of a batch also cid and sketch) and of recurring shingles (kind 1: a = shingle, n = documents)."""
    schema = "kind int, doc_id long, n long, a long, b long, cid long, sketch array<long>"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = TaskContext.get().partitionId() << 33
        for batch in batches:
            for begin, end in W.slices(batch.column(1), SLICE):
                part = batch.slice(begin, end - begin)
                sets = list(W.shingles(part.column(1), key, words))
                known = [_name(x) for x in sets]
                once = {name: i for i, name in reversed(list(enumerate(known))) if len(sets[i])}
                new = [once.get(name) == i for i, name in enumerate(known)]
                none = pa.array([None if x else True for x in new], pa.bool_()).is_valid()
                full = W.lists([_sketch(x) if y else np.zeros(0, np.int64) for x, y in zip(sets, new, strict=True)], pa.int64())
                sketch = pa.ListArray.from_arrays(full.offsets, full.values, mask=none)
                cid = pa.array([done + i if x else None for i, x in enumerate(new)], pa.int64())
                done += len(part)
                columns = [pa.array(np.zeros(len(part), dtype=np.int32)), part.column(0), pa.array([len(x) for x in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x[0] for x in known], pa.int64()), pa.array([x[1] for x in known], pa.int64()), cid, sketch], names=names)
                sets = [x for x, y in zip(sets, new, strict=True) if y]
                for k in range(PARTS):  # a part of the shingles at a time
                    mine = [x[x % np.uint64(PARTS) == np.uint64(k)] for x in sets]
                    found, count = np.unique(np.concatenate([*mine, np.zeros(0, np.uint64)]), return_counts=True)
                    again = count >= max(2, len(part) // RECURS)
                    if again.any():
                        m = int(again.sum())
                        columns = [pa.array(np.ones(m, dtype=np.int32)), pa.nulls(m, pa.int64()), pa.array(count[again], pa.int64()), pa.array(found[again].view(np.int64))]
                        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int64()))], names=names)

    return docs.mapInArrow(run, schema)


def _prefix(n: np.ndarray | int, t: Fraction):
    """Shingles of a set of n of which a set that reaches t shares one at least."""
    return n - -(-n * t.numerator // t.denominator) + 1


def _blocks(docs: DataFrame, key: int, words: int, hot: np.ndarray, heavy: np.ndarray, n_blocks: int, t: Fraction) -> DataFrame:
    """sig, lead, lead_n, member, n: members of each distinct set of members that share a shingle of their prefixes."""

    def prefixes(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        sent: set[tuple[int, int]] = set()
        for x in W.shingles(batch.column(0), key, words):
            if not len(x) or (name := _name(x)) in sent:
                continue
            sent.add(name)
            if len(hot):
                late = _among(x, hot)
                x = np.concatenate([x[~late], x[late]])
            yield name[0], len(x), x[: _prefix(len(x), t)].copy()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(keys: list[np.ndarray], names: list[int], sizes: list[int]) -> pa.RecordBatch:
            counts = [len(x) for x in keys]
            key, name, size = np.concatenate(keys), np.repeat(np.array(names, np.int64), counts), np.repeat(np.array(sizes, np.int32), counts)
            block = (key % np.uint64(n_blocks)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            key, name, size, block = key[order], name[order], size[order], block[order]
            cut = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block)).tolist()
            packed = [[x[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)] for x in (key, name, size)]
            return pa.RecordBatch.from_arrays([pa.array(block[cut[:-1]]), *(pa.array(x, pa.binary()) for x in packed)], names=["block", "keys", "names", "sizes"])

        for batch in batches:
            keys, names, sizes, held = [], [], [], 0
            for name, n, x in prefixes(batch):
                x = x[~_among(x, heavy)] if len(heavy) else x
                if not len(x):
                    continue
                keys.append(x)
                names.append(name)
                sizes.append(n)
                held += len(x)
                if held >= PACKED:
                    yield pack(keys, names, sizes)
                    keys, names, sizes, held = [], [], [], 0
            if keys:
                yield pack(keys, names, sizes)

    def write_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(name, n, x[_among(x, heavy)]) for name, n, x in prefixes(batch)]
            counts = [len(x) for _, _, x in found]
            columns = [np.concatenate([np.zeros(0, np.uint64), *(x for _, _, x in found)]).view(np.int64), *(np.repeat(np.array(x, np.int64), counts) for x in ([f[0] for f in found], [f[1] for f in found]))]
            for i in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in columns], names=["sig", "member", "n"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = [[], [], []]
        for batch in batches:
            for i in range(3):
                held[i] += batch.column(i + 1).to_pylist()
        key, name, size = (np.frombuffer(b"".join(x), dtype=d) for x, d in zip(held, (np.uint64, np.int64, np.int32), strict=True))
        del held
        order = np.lexsort((name, key))
        key, name, size = key[order], name[order], size[order]
        first = np.ones(len(key), dtype=bool)
        first[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        key, name, size = key[first], name[first], size[first]
        cut = np.append(np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1))), len(key))
        shared = np.diff(cut) > 1
        starts, ends = cut[:-1][shared], cut[1:][shared]
        # a signature of the members: their names are sorted within a shingle
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mixed(name.view(np.uint64)))])
        sig = W.mixed(sums[ends] - sums[starts]) + (ends - starts).astype(np.uint64)
        _, kept = np.unique(sig, return_index=True)
        for part in np.array_split(kept, max(1, len(kept) // 20_000)):
            lengths = ends[part] - starts[part]
            at = np.repeat(starts[part] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum()) if len(part) else np.zeros(0, np.int64)
            # the first of a block: by a salted hash, so that large groups are met from several sides
            salt = W.mixed(sig[part] % np.uint64(FIRSTS) + np.uint64(1))
            key = W.mixed(name[at].view(np.uint64) ^ np.repeat(salt, lengths))
            least = np.minimum.reduceat(key, np.cumsum(lengths) - lengths) if len(part) else key
            lead = np.repeat(at[key == np.repeat(least, lengths)], lengths)
            columns = [np.repeat(sig[part].view(np.int64), lengths), name[lead], size[lead].astype(np.int64), name[at], size[at].astype(np.int64)]
            for i in range(0, len(at), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in columns], names=["sig", "lead", "lead_n", "member", "n"])

    rows = docs.select("text")
    dealt = rows.mapInArrow(deal, "block int, keys binary, names binary, sizes binary")
    light = dealt.repartitionById(n_blocks, F.col("block")).mapInArrow(multiply, "sig long, lead long, lead_n long, member long, n long").distinct()
    if not len(heavy):
        return light
    members = written(rows.mapInArrow(write_out, "sig long, member long, n long").distinct(), "heavy")
    salted = F.xxhash64("member", F.pmod("sig", F.lit(FIRSTS)))
    firsts = members.groupBy("sig").agg(F.min(F.struct(salted.alias("h"), F.col("member").alias("lead"), F.col("n").alias("lead_n"))).alias("first"))
    return light.unionByName(members.join(firsts, "sig").select("sig", "first.lead", "first.lead_n", "member", "n"))


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the ascending array ``known``."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _least_overlap(n: Column, m: Column, t: Fraction) -> Column:
    """overlap / (n + m - overlap) >= t, solved for the overlap (times t.numerator + t.denominator)."""
    return (n + m) * t.numerator


def _sizes_allow(n: Column, m: Column, t: Fraction) -> Column:
    return F.least(n, m) * t.denominator >= F.greatest(n, m) * t.numerator


def _differing(x: Column, y: Column) -> Column:
    """A number of shingles that differ at least, by the sketches; the longer is folded to the shorter's bits."""

    def fold(a: Column, b: Column) -> Column:
        half = F.size(b)
        return F.when(F.size(a) > half, F.zip_with(F.slice(a, F.lit(1), half), F.slice(a, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(a)

    apart = F.zip_with(fold(x, y), fold(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(apart, F.lit(0), lambda s, v: s + v)


def _bloom(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter (two bits an id) of long ids as a bit array of fixed size, put together in parts of 64 KiB."""
    part = 1 << 19

    def places(values: np.ndarray) -> np.ndarray:
        h = W.mixed(values.astype(np.int64).view(np.uint64))
        return np.concatenate([h & np.uint64(bits - 1), h >> np.uint64(32) & np.uint64(bits - 1)]).astype(np.int64)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(bits, dtype=np.uint8)
        for batch in batches:
            on[places(batch.column(0).to_numpy(zero_copy_only=False))] = 1
        used = [i for i in range(0, bits, part) if on[i : i + part].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([np.packbits(on[i : i + part]).tobytes() for i in used], pa.binary())], names=["at", "bits"])

    def union(table: pa.Table) -> list[bytes]:
        return [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()]).tobytes()]

    parts = in_rounds(ids.mapInArrow(fill, "at int, bits binary"), "at int, bits binary", union).collect()
    on = np.zeros(bits // 8, dtype=np.uint8)
    for row in parts:
        on[row["at"] // 8 : row["at"] // 8 + part // 8] = np.frombuffer(row["bits"], np.uint8)
    return on


def _in_bloom(on: np.ndarray, values: np.ndarray) -> np.ndarray:
    bits = len(on) * 8
    h = W.mixed(values.astype(np.int64).view(np.uint64))
    found = np.ones(len(values), dtype=bool)
    for at in (h & np.uint64(bits - 1), h >> np.uint64(32) & np.uint64(bits - 1)):
        at = at.astype(np.int64)
        found &= (on[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
    return found


def _needed_sets(docs: DataFrame, key: int, words: int, needed: DataFrame) -> DataFrame:
    """cid and set of the classes in ``needed`` (cid, doc, a, b); a Bloom filter leaves the other documents out."""
    bits = min(BLOOM_BITS, max(1 << 19, 1 << (16 * needed.count()).bit_length()))
    on = docs.sparkSession.sparkContext.broadcast(_bloom(needed.select("doc"), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_in_bloom(on.value, batch.column(0).to_numpy(zero_copy_only=False))))
            for begin, end in W.slices(batch.column(1), SLICE):
                part = batch.slice(begin, end - begin)
                sets = list(W.shingles(part.column(1), key, words))
                known = [_name(x) for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([x[i] for x in known], pa.int64()) for i in (0, 1)), W.lists(sets, pa.int64())], names=["doc", "a", "b", "set"])

    found = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc long, a long, b long, set array<long>")
    return found.join(needed, ["doc", "a", "b"]).select("cid", "set")


def overlaps(row: np.ndarray, values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that ``row`` has in common with each set, and how many of the set weren't looked at.

    Counts accumulate over blocks of columns; a set is given up once its count and
    what it has left stay below ``need``.
    """
    count, seen, alive = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64), np.arange(len(sizes))
    for k in range(1, COLUMN_BLOCKS + 1):
        until = -(-sizes[alive] * k // COLUMN_BLOCKS)
        width = until - seen[alive]
        ends = np.cumsum(width)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[alive] + seen[alive] - ends + width, width)
        hits = np.concatenate([[0], np.cumsum(_among(values[at], row))])
        count[alive] += hits[ends] - hits[ends - width]
        seen[alive] = until
        alive = alive[count[alive] + sizes[alive] - seen[alive] >= need[alive]]
    return count, sizes - seen


def _product(sets: DataFrame, pairs: DataFrame, t: Fraction) -> DataFrame:
    """x, y, common, left: accumulated overlap of each pair (lead, member, nl, nm), and the member's shingles that were not needed."""
    many = pairs.groupBy("lead").agg(F.count("*").alias("k")).where(F.col("k") > ROWS)
    dealt = pairs.join(many, "lead", "left").withColumn("salt", F.when(F.col("k").isNull(), 0).otherwise(F.pmod(F.xxhash64("member"), F.ceil(F.col("k") / ROWS))).cast("int"))
    members = dealt.select("lead", "salt", F.col("member").alias("cid"), "nl", F.lit(1).alias("kind"))
    leads = dealt.select("lead", "salt", F.col("lead").alias("cid"), "nl", F.lit(0).alias("kind")).distinct()
    rows = members.unionByName(leads).join(sets, "cid").select("lead", "salt", "kind", "cid", "nl", "set")
    rows = rows.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "kind")
    up, down = t.numerator, t.numerator + t.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            lead, kind, cid, nl = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 4))
            offsets, values = batch.column(5).offsets.to_numpy().astype(np.int64), batch.column(5).values.to_numpy().view(np.uint64)
            # each row of A that heads a block of rows stands before it, maybe in an earlier batch
            heads = np.flatnonzero(kind == 0)
            common, left = np.zeros(len(lead), dtype=np.int64), np.zeros(len(lead), dtype=np.int64)
            for h, i, j in zip([-1, *heads.tolist()], [0, *(heads + 1).tolist()], [*heads.tolist(), len(lead)], strict=True):
                if h >= 0:
                    row = values[offsets[h] : offsets[h + 1]].copy()
                if i < j:
                    sizes = offsets[i + 1 : j + 1] - offsets[i:j]
                    need = -(-(sizes + len(row)) * up // down)
                    common[i:j], left[i:j] = overlaps(row, values, offsets[i:j], sizes, need)
            who = kind == 1
            yield pa.RecordBatch.from_arrays([pa.array(v[who]) for v in (lead, cid, common, left)], names=["lead", "member", "common", "left"])

    # rows of documents that repeat an id and text are there twice
    return rows.mapInArrow(run, "lead long, member long, common long, left long").dropDuplicates(["lead", "member"])


def _verified(docs: DataFrame, key: int, words: int, classes: DataFrame, pairs: DataFrame, t: Fraction) -> DataFrame:
    """Of different pairs (lead, member of cid) those that link; and for each pair a bound ``low`` of the distance from below, ``high`` from above.

    Result: x, y (x < y), linked, low, high.
    """
    side = lambda k, n, s: classes.select(F.col("cid").alias(k), F.col("n").alias(n), F.col("sketch").alias(s))
    both = pairs.join(side("lead", "nl", "sl"), "lead").join(side("member", "nm", "sm"), "member").select("lead", "member", "nl", "nm", _differing(F.col("sl"), F.col("sm")).alias("apart"))
    # |x| + |y| - 2 overlap >= apart
    most = F.least(F.floor((F.col("nl") + F.col("nm") - F.col("apart")) / 2), "nl", "nm")
    enough = lambda overlap: overlap * (t.numerator + t.denominator) >= _least_overlap(F.col("nl"), F.col("nm"), t)
    both = written(both.withColumn("most", most).withColumn("maybe", enough(F.col("most"))), "pairs")
    maybe = both.where("maybe")
    ends = written(maybe.select(F.col("lead").alias("cid")).unionByName(maybe.select(F.col("member").alias("cid"))).distinct().join(classes.select("cid", "doc", "a", "b"), "cid"), "needed")
    counted = _product(_needed_sets(docs, key, words, ends), maybe.select("lead", "member", "nl", "nm"), t).join(maybe.select("lead", "member", "nl", "nm"), ["lead", "member"])
    distance = lambda overlap: 1 - overlap / (F.col("nl") + F.col("nm") - overlap)
    x, y = F.least("lead", "member").alias("x"), F.greatest("lead", "member").alias("y")
    links = counted.select(x, y, ((F.col("left") == 0) & enough(F.col("common"))).alias("linked"), distance(F.col("common") + F.col("left")).alias("low"), distance(F.col("common")).alias("high"))
    rest = both.where("not maybe").select(x, y, F.lit(False).alias("linked"), distance(F.col("most")).alias("low"), F.lit(1.0).alias("high"))
    out = written(links.unionByName(rest), "verified")
    for table in (both, ends):
        removed(classes.sparkSession, table)
    return out


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = W.WORDS, t: Fraction = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    key = W.new_key()
    digested = written(_digested(rows, key, words), "digested")
    own = digested.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "a", "b", "n")
    linkable = digested.where("kind = 0 and n > 0 and doc_id is not null")
    classes = written(linkable.groupBy("a", "b").agg(F.min("doc_id").alias("doc"), F.min("n").alias("n"), F.min("cid").alias("cid"), F.first("sketch", ignorenulls=True).alias("sketch")), "classes")

    often = digested.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    often = often.orderBy(F.desc("n"), "a").limit(HOT).select("a", "n").toArrow()
    hot = often.column("a").to_numpy().view(np.uint64)
    heavy = np.sort(hot[often.column("n").to_numpy() >= HEAVY])
    postings = classes.agg(F.sum(F.col("n") * float(1 - t) + 1)).first()[0] or 0
    n_blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(postings) // BLOCK_POSTINGS)
    blocks = written(_blocks(rows, key, words, np.sort(hot), heavy, n_blocks, t), "blocks")
    named = classes.select("cid", "a")

    # stars: each pair once, with one of its two as the first
    stars = blocks.where(_sizes_allow(F.col("lead_n"), F.col("n"), t) & (F.col("lead") != F.col("member"))).select("lead", "member").distinct()
    by_name = lambda k, c: named.select(F.col("a").alias(k), F.col("cid").alias(c))
    pairs = stars.join(by_name("lead", "p"), "lead").join(by_name("member", "q"), "member")
    pairs = pairs.groupBy(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).agg(F.min("p").alias("lead")).select("lead", F.when(F.col("lead") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("member"))
    first = _verified(rows, key, words, classes, pairs, t)
    links = first.where("linked").select(F.col("x").alias("u"), F.col("y").alias("v"))
    found = written(components(links), "components")

    # blocks that hold more than one component
    members = blocks.join(by_name("member", "cid"), "member").join(found.withColumnRenamed("node", "cid"), "cid", "left")
    members = written(members.join(by_name("lead", "head"), "lead").select("sig", "cid", "n", "head", F.coalesce("component", "cid").alias("component")), "members")
    removed(spark, blocks)
    by_component = members.groupBy("sig", "component").agg(F.count("*").alias("k"))
    largest = by_component.groupBy("sig").agg(F.max(F.struct("k", "component")).alias("top"), F.count("*").alias("parts"), F.sum("k").alias("size")).where("parts > 1").select("sig", F.col("top.component").alias("main"), "size")
    # as a table of its own, so that both sides of the joins below are plain shuffles; a large block is dealt to several tasks
    largest = written(largest, "main")
    dealt = largest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    to_head = first.select("x", "y", "low", "high")
    to_head = to_head.unionByName(to_head.select(F.col("y").alias("x"), F.col("x").alias("y"), "low", "high")).select(F.col("x").alias("head"), F.col("y").alias("cid"), "low", "high")
    open_ = members.where("cid <> head").withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int")).join(dealt, ["sig", "salt"]).join(to_head, ["head", "cid"], "left")
    # of the large blocks, those that a member is in, ascending; no more than its prefix has shingles
    large = open_.where(F.col("size") >= LARGE).groupBy("cid").agg(F.array_sort(F.collect_set("sig")).alias("large"))
    open_ = open_.join(large, "cid", "left").join(classes.select("cid", "sketch"), "cid")
    none = F.array().cast("array<long>")
    open_ = written(
        open_.select("sig", "cid", "n", "component", "main", F.ceil(F.col("size") / ROWS).cast("int").alias("parts"), F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(1.0)).alias("high"), F.coalesce("large", none).alias("large"), "sketch"), "open"
    )
    removed(spark, members)
    # members outside the main component go to all parts of their block, each member stands in one
    l = open_.where("component <> main").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("l")
    r = open_.withColumn("salt", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).alias("r")
    limit = float(1 - t) + 1e-9
    cross = l.join(
        r,
        (F.col("l.sig") == F.col("r.sig"))
        & (F.col("l.salt") == F.col("r.salt"))
        & (F.col("l.component") != F.col("r.component"))
        & ((F.col("r.component") == F.col("r.main")) | (F.col("l.cid") < F.col("r.cid")))
        & _sizes_allow(F.col("l.n"), F.col("r.n"), t)
        & (F.col("l.low") - F.col("r.high") <= limit)
        & (F.col("r.low") - F.col("l.high") <= limit)
        & ((F.col("l.n") + F.col("r.n")) * (t.denominator - t.numerator) >= _differing(F.col("l.sketch"), F.col("r.sketch")) * (t.numerator + t.denominator))
        & (~F.array_contains("l.large", F.col("l.sig")) | (F.array_min(F.array_intersect("l.large", "r.large")) == F.col("l.sig"))),
    )
    second = cross.select(F.least("l.cid", "r.cid").alias("x"), F.greatest("l.cid", "r.cid").alias("y")).distinct()
    more = _verified(rows, key, words, classes, second.join(first.select("x", "y"), ["x", "y"], "left_anti").select(F.col("x").alias("lead"), F.col("y").alias("member")), t)
    for table in (open_, largest, found):
        removed(spark, table)
    links = links.unionByName(more.where("linked").select(F.col("x").alias("u"), F.col("y").alias("v")))
    found = components(links)

    smallest = classes.select("cid", "a", "b", "doc").join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = smallest.groupBy("component").agg(F.min("doc").alias("component_id"))
    labels = smallest.join(least, "component").select("a", "b", "component_id")
    labelled = own.where("n > 0 and doc_id is not null").join(labels, ["a", "b"]).select("doc_id", "n_shingles", "component_id")
    return labelled.unionByName(own.where("n = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
