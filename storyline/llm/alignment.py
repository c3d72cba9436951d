"""Operator 13: alignment of the tokens of two tokenizers.

Tokens are byte intervals of one text (a space and the document's text).  Byte offsets
at which tokens of both tokenizers end cut them into groups; all A and B tokens of a
group are linked.

* Texts are cut into fragments at places where neither tokenizer can merge (white space
  after something else, where that pair of bytes is inside no token of either), so a
  fragment's tokens and groups are the same wherever it stands.  Each different fragment
  of a chunk (neighbouring rows of about ``CHUNK`` bytes of an Arrow batch) is encoded
  once, and a worker remembers up to ``REMEMBERED`` of them.
* DuckDB, in the worker and with bounded memory, aligns them: tables of token intervals,
  an equi-join of their ends for the cuts, a window sum that numbers the groups, an ASOF
  join that finds each token's group, a range join that finds each group's
  fragment, and the pairs (document, A id, B id) with how often they are linked.
* A chunk leaves a row for each document, with its pairs as positions in the chunk's list
  of different pairs, and one row with this list and how many documents of the chunk
  hold each.  These partial counts are merged in Spark; every chunk's pairs then get
  their counts and whether they are their A id's highest, and go back to the chunk's
  documents.  What is shuffled are the different pairs of chunks and the documents'
  positions, not token pairs; the most frequent pair has one row for each chunk.

Results for special cases: null and empty texts, and texts whose joined token bytes
differ from space and text for A or B, have no tokens: zeros and an empty
``groups_sha256``, and they count for no pair; special strings inside texts are
plain text; a text without white space is one fragment however long; rows that repeat
an id are documents of their own; an empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.llm import words as W
from storyline.llm.bpe import CALL_FRAGMENTS, SEPARATORS, byte_of_char
from storyline.llm.common import written

#: Bytes of texts in a chunk, fragments that a worker remembers, and memory of its DuckDB.
CHUNK, REMEMBERED, DUCKDB_MEMORY = 2 << 20, 200_000, "128MB"
SPACE = "▁"


class Pieces:
    """B: a sentencepiece model, by fragments."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]

    def encode(self, fragments: list[str]) -> list[list[int]]:
        """The library puts a space before each text that isn't empty; most fragments have it already.

        Before the others comes a line end, which no piece holds together with anything (else
        no fragment begins otherwise); its id and the space's go again.
        """
        led = [f[0] == " " and len(f) > 1 for f in fragments]
        found = self.library.encode([f[1:] if x else "\n" + f for x, f in zip(led, fragments, strict=True)], num_threads=1)
        return [ids if x else ids[2:] for x, ids in zip(led, found, strict=True)]


class Bytes:
    """A: a byte-level tokenizers file whose special strings are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.library.encode_special_tokens = True
        as_byte = byte_of_char()
        self.bytes_of = [b""] * self.library.get_vocab_size(with_added_tokens=True)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.bytes_of[i] = bytes(as_byte[c] for c in token if c in as_byte)

    def encode(self, fragments: list[str]) -> list[list[int]]:
        parts = (fragments[i : i + CALL_FRAGMENTS] for i in range(0, len(fragments), CALL_FRAGMENTS))
        return [x.ids for part in parts for x in self.library.encode_batch_fast(part, add_special_tokens=False)]


def pairs_inside(tokens: list[bytes]) -> np.ndarray:
    """inside[a, b]: byte b follows byte a inside some token."""
    inside = np.zeros((256, 256), dtype=bool)
    for token in tokens:
        body = np.frombuffer(token, dtype=np.uint8)
        inside[body[:-1], body[1:]] = True
    return inside


#: Interval tables of tokens to groups: cuts where both end, then each token's cut, the first at or after its end.
#: Every fragment ends in a cut, so no group reaches over one; frag has the fragments' intervals.
GROUPS_SQL = """
CREATE OR REPLACE TEMP TABLE cuts AS SELECT a.stop, sum(1) OVER (ORDER BY a.stop) - 1 AS g FROM ra a JOIN rb b ON a.stop = b.stop;
CREATE OR REPLACE TEMP TABLE ga AS SELECT t.place, t.id, c.g FROM ra t ASOF JOIN cuts c ON t.stop <= c.stop;
CREATE OR REPLACE TEMP TABLE gb AS SELECT t.place, t.id, c.g FROM rb t ASOF JOIN cuts c ON t.stop <= c.stop;
CREATE OR REPLACE TEMP TABLE groups AS SELECT c.g, f.fragment FROM cuts c JOIN frag f ON c.stop > f.start AND c.stop <= f.stop;
"""

LINKS_SQL = """
WITH a AS (SELECT g, id, count(*) AS n FROM ga GROUP BY ALL), b AS (SELECT g, id, count(*) AS n FROM gb GROUP BY ALL)
SELECT fragment, CAST(a.id AS BIGINT) << 32 | b.id AS pair, a.n * b.n AS n FROM a JOIN b USING (g) JOIN groups USING (g)
"""

PAIRS_SQL = """
WITH held AS (SELECT doc, fragment, count(*) AS n FROM placed GROUP BY ALL)
SELECT h.doc, l.pair, CAST(sum(h.n * l.n) AS BIGINT) AS n FROM held h JOIN links l USING (fragment) GROUP BY ALL ORDER BY h.doc
"""


class Aligner:
    """Aligns the texts of chunks; remembers fragments."""

    def __init__(self, path_a: str, path_b: str):
        import duckdb

        self.a, self.b = Bytes(path_a), Pieces(path_b)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY})
        self.sizes = [np.array([len(x) for x in side.bytes_of], dtype=np.int64) for side in (self.a, self.b)]
        most = max(map(len, self.sizes))
        #: decimal ids with what follows them: the group's next id, its B ids, the next group, nothing
        self.decimal = np.array([f"{i}{after}" for after in (",", "|", ";", "") for i in range(most)], dtype=object).reshape(4, most)
        inside = pairs_inside(self.b.bytes_of)
        joint = pairs_inside(self.a.bytes_of) | inside
        border = np.zeros((256, 256), dtype=bool)
        if not inside[10].any() and not inside[:, 10].any():  # see Pieces.encode; else each text is one fragment
            border[np.ix_([c for c in range(256) if not (c < 128 and chr(c).isspace())], list(SEPARATORS))] = True
            border[np.ix_([c for c in range(128) if chr(c).isalnum()], [c for c in range(33, 127) if not chr(c).isalnum()])] = True
        self.cut = (border & ~joint).reshape(-1)
        self.known: dict[bytes, int] = {}
        self.strings: list[str] = []
        self.sound = np.zeros(0, dtype=bool)
        self.counts = np.zeros((0, 4), dtype=np.int64)
        self.links = {c: np.zeros(0, dtype=np.int64) for c in ("fragment", "pair", "n")}

    def fragments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the fragments of texts."""
        first = np.zeros(len(data) + 1, dtype=bool)
        first[offsets] = True
        first[1 : len(data)] |= self.cut[data[:-1].astype(np.uint16) << 8 | data[1:]]
        places = np.flatnonzero(first)
        return places[:-1], places[1:]

    def spelt(self, side: Bytes | Pieces, text: bytes) -> bytes:
        return b"".join([side.bytes_of[i] for i in side.encode([text.decode()])[0]])

    def learn(self, new: list[bytes]) -> None:
        """Encodes and aligns fragments that weren't known."""
        texts, base = [x.decode() for x in new], len(self.strings)
        ids = [side.encode(texts) for side in (self.a, self.b)]
        sound = np.array([all(b"".join([side.bytes_of[i] for i in found]) == raw for side, found in zip((self.a, self.b), both, strict=True)) for raw, *both in zip(new, *ids, strict=True)], dtype=bool)
        good = np.flatnonzero(sound)
        ends = np.cumsum([len(new[i]) for i in good], dtype=np.int64)
        con = self.con
        flat = [np.fromiter(chain.from_iterable(found if sound.all() else compress(found, sound)), dtype=np.int32) for found in ids]
        for name, x, size in zip("ab", flat, self.sizes, strict=True):
            con.register(f"r{name}", pa.table({"place": np.arange(len(x)), "id": x, "stop": np.cumsum(size[x])}))
        con.register("frag", pa.table({"fragment": good + base, "start": ends - np.diff(ends, prepend=0), "stop": ends}))
        con.execute(GROUPS_SQL)
        links = con.sql(LINKS_SQL).to_arrow_table()
        fragment = con.sql("SELECT fragment FROM groups ORDER BY g").to_arrow_table().column(0).to_numpy() - base
        group = [con.sql(f"SELECT g FROM g{name} ORDER BY place").to_arrow_table().column(0).to_numpy().astype(np.int64) for name in "ab"]
        con.execute("DROP TABLE ga; DROP TABLE gb; DROP TABLE cuts; DROP TABLE groups")
        n_a, n_b = (np.bincount(g, minlength=len(fragment)) for g in group)
        sums = [np.bincount(fragment, x, len(new)).astype(np.int64) for x in (n_a, n_b, np.ones(len(fragment)))]
        linked = np.zeros(len(new), dtype=np.int64)
        np.add.at(linked, fragment, n_a * n_b)
        self.known.update(zip(new, range(base, base + len(new)), strict=True))
        self.strings += self._strings(flat, group, n_a, n_b, fragment, len(new))
        self.sound = np.concatenate([self.sound, sound])
        self.counts = np.concatenate([self.counts, np.stack([*sums, linked], axis=1)])
        self.links = {c: np.concatenate([x, links.column(c).to_numpy()]) for c, x in self.links.items()}

    def _strings(self, flat: list[np.ndarray], group: list[np.ndarray], n_a: np.ndarray, n_b: np.ndarray, fragment: np.ndarray, n: int) -> list[str]:
        """Each fragment's groups as text: A's tokens of a group stand before B's, groups in order."""
        before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        last = np.append(np.diff(fragment) != 0, True) if len(fragment) else np.zeros(0, dtype=bool)
        out = np.empty(len(flat[0]) + len(flat[1]), dtype=object)
        place = np.arange(len(flat[0]))
        out[place + before_b[group[0]]] = self.decimal[(place == (before_a + n_a - 1)[group[0]]).astype(np.int8), flat[0]]
        place = np.arange(len(flat[1]))
        ending = place == (before_b + n_b - 1)[group[1]]
        out[place + (before_a + n_a)[group[1]]] = self.decimal[np.where(ending, np.where(last[group[1]], 3, 2), 0), flat[1]]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(fragment, n_a + n_b, n))]).astype(np.int64).tolist()
        parts = out.tolist()
        return ["".join(parts[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def forget(self, held: int) -> None:
        """Goes back to the first ``held`` fragments."""
        for raw in list(islice(reversed(self.known), len(self.known) - held)):
            del self.known[raw]
        del self.strings[held:]
        self.sound, self.counts = self.sound[:held], self.counts[:held]
        of = self.links["fragment"] < held
        self.links = {c: x[of] for c, x in self.links.items()}

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """For each text (n_a, n_b, n_groups, n_links, sha256, positions, times); the different pairs; how many texts hold each.

        ``data`` has the space before each text that isn't empty.
        """
        begin, end = self.fragments(data, offsets) if len(data) else (np.zeros(0, np.int64),) * 2
        raw, held, known, new = data.tobytes(), len(self.known), self.known, {}
        kind = np.fromiter((known[x] if (x := raw[i:j]) in known else held + new.setdefault(x, len(new)) for i, j in zip(begin.tolist(), end.tolist(), strict=True)), dtype=np.int64, count=len(begin))
        if new:
            self.learn(list(new))
        at = np.searchsorted(begin, offsets)
        has, doc = np.diff(at) > 0, np.repeat(np.arange(len(at) - 1), np.diff(at))
        for i in np.unique(doc[~self.sound[kind]]).tolist():
            text = raw[offsets[i] : offsets[i + 1]]
            if all(self.spelt(side, text) == text for side in (self.a, self.b)):
                raise ValueError("fragments spell a text otherwise than they do together")
            has[i] = False
        sums = np.zeros((len(kind) + 1, 4), dtype=np.int64)
        np.cumsum(self.counts[kind], axis=0, out=sums[1:])
        sums = np.where(has[:, None], sums[at[1:]] - sums[at[:-1]], 0)
        taken = has[doc]
        self.con.register("placed", pa.table({"doc": doc[taken], "fragment": kind[taken]}))
        here = np.zeros(len(self.strings) + 1, dtype=bool)
        here[kind] = True
        here = here[self.links["fragment"]]
        self.con.register("links", pa.table({c: x[here] for c, x in self.links.items()}))
        found = self.con.sql(PAIRS_SQL).to_arrow_table()
        for name in ("placed", "links"):
            self.con.unregister(name)
        pair, place, holders = np.unique(found.column("pair").to_numpy(), return_inverse=True, return_counts=True)
        times, cuts = found.column("n").to_numpy(), np.searchsorted(found.column("doc").to_numpy(), np.arange(len(has) + 1))
        rows = []
        for i, (one, k) in enumerate(zip(sums.tolist(), np.split(kind, at[1:-1]), strict=True)):
            sha = hashlib.sha256(";".join([self.strings[x] for x in k.tolist()]).encode()).hexdigest() if has[i] else ""
            part = slice(cuts[i], cuts[i + 1])
            rows.append((*one, sha, place[part].astype(np.int32), times[part]))
        if len(self.known) > REMEMBERED:
            self.forget(max(held, min(len(self.known), REMEMBERED) if held < REMEMBERED // 2 else held))
        return rows, pair, holders


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _spaced(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets with a space before each text that isn't empty."""
    data, offsets = W.buffers(texts)
    size = np.diff(offsets)
    with_ = size + (size > 0)
    out = np.zeros(len(offsets), dtype=np.int64)
    np.cumsum(with_, out=out[1:])
    spaced = np.full(int(out[-1]), 32, dtype=np.uint8)
    keep = np.ones(len(spaced), dtype=bool)
    keep[out[:-1][size > 0]] = False
    spaced[keep] = data
    return spaced, out


CHUNKS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, positions array<int>, times array<long>"


def _chunks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """A row for each document, and one for each chunk (``pairs`` and ``holders`` not null); both have ``chunk``."""
    fields = [T.StructField("chunk", T.LongType()), T.StructField("doc_id", docs.schema[id_col].dataType), *T._parse_datatype_string(CHUNKS).fields]
    fields += [T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("holders", T.ArrayType(T.LongType()))]
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j in W.slices(batch.column(1), CHUNK):
                rows, pair, holders = own.chunk(*_spaced(batch.column(1).slice(i, j - i)))
                n = j - i
                *plain, places, times = zip(*rows, strict=True)
                columns = [[number] * n, batch.column(0).slice(i, n), *plain, W.lists(list(places), pa.int32()), W.lists(list(times), pa.int64()), [None] * n, [None] * n]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                columns = [[number], *([[None]] * (len(schema) - 3)), W.lists([pair], pa.int64()), W.lists([holders], pa.int64())]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                number += 1

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, T.StructType(fields))


def pair_counts(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunk, position, a, b) of the chunks' pairs; (a, b, count, best) corpus-wide, best: the highest of its A id."""
    own = chunks.where("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "holders")).alias("position", "x"))
    own = own.select("chunk", "position", F.shiftright("x.pairs", 32).cast("int").alias("a"), F.col("x.pairs").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), F.col("x.holders").alias("holders"))
    counts = own.groupBy("a", "b").agg(F.sum("holders").alias("count"))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return own.drop("holders"), counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    chunks = written(_chunks(docs, path_a, path_b, id_col, text_col), "chunks")
    own, counts = pair_counts(chunks)
    looked = own.join(counts, ["a", "b"]).select(F.col("chunk").alias("of"), "position", "count", "best")
    rows = chunks.where("pairs is null").drop("pairs", "holders")
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())])

    def put(table: pa.Table, found: pa.Table) -> pa.Table:
        count, best = np.zeros(len(found), dtype=np.int64), np.zeros(len(found), dtype=np.int64)
        place = found.column("position").to_numpy()
        count[place], best[place] = found.column("count").to_numpy(), found.column("best").to_numpy(zero_copy_only=False)
        positions, times = table.column("positions").combine_chunks(), table.column("times").combine_chunks()
        size = np.array(positions.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        at, n = positions.flatten().to_numpy(), times.flatten().to_numpy()
        ends = np.cumsum(size)
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (best[at] * n, count[at] * n)]
        n_best, count_sum = (x[ends] - x[ends - size] for x in sums)
        columns = [table.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.table([*columns, pa.array(n_best), pa.array(count_sum), table.column("groups_sha256")], names=out.names)

    return rows.groupBy("chunk").cogroup(looked.groupBy("of")).applyInArrow(put, out)
