"""Operator 9: BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no token of the vocabulary can never be merged,
so a cut between its two bytes is certain: the ids of the two sides, encoded on
their own, follow each other in the ids of the whole.  A table of 256 x 256 pairs
says where to cut: pairs that are certain and at which the pre-tokeniser begins
a new piece whatever stands around (before white space, and between a letter or
digit and a mark).  What lies between two cuts, mostly one word, is encoded
independently by the ``tokenizers`` library.

As words recur, each worker keeps a bounded table of fragments that it has met, from
the fragment's bytes to its ids: a hash finds the place, then all bytes are
compared, so no two fragments can be taken for each other.  Cutting, hashing,
comparing and looking up run over whole Arrow batches with numpy.  Texts never leave
their partition: no shuffle, and memory is bounded by one Arrow batch.

Results for special cases: null and empty texts have no ids and decode to the
empty text; special strings inside texts are special tokens, as by the library's
default; repeated rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.llm import words as W

SEPARATORS = b" \n\t\r"
#: ASCII and the letters and signs of Latin-1.
PLAIN = re.compile(rb"(?:[\x00-\x7f]|\xc2[\xa1-\xbf]|\xc3[\x80-\xbf])+").fullmatch
#: Fragments that one worker remembers (a power of two of places, half of them used), and bytes that one has at most.
PLACES, SHORT = 1 << 20, 64
#: Fragments that go to the library in one call, and bytes of texts handled together.
CALL_FRAGMENTS, GROUP_BYTES = 4096, 1 << 20


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins by which byte-level vocabularies spell bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memory:
    """From fragments to ids: open addressing in flat arrays, read and filled by whole arrays."""

    def __init__(self, dtype: np.dtype):
        self.secret = W.new_key()
        self.keys = np.zeros(PLACES, dtype=np.uint64)
        self.start = np.zeros(PLACES, dtype=np.int32)
        self.length = np.zeros(PLACES, dtype=np.int16)
        self.size = np.zeros(PLACES, dtype=np.int16)
        self.lane_at = np.zeros(PLACES, dtype=np.int32)
        self.lanes = np.zeros(1 << 20, dtype=np.uint64)
        self.pool = np.zeros(1 << 20, dtype=dtype)
        self.held = self.used = self.lanes_used = 0

    def hashes(self, spans: W.Spans) -> np.ndarray:
        return np.maximum(W.mixed(spans.hashes(self.secret)), np.uint64(1))

    def find(self, spans: W.Spans, hashes: np.ndarray) -> np.ndarray:
        """The place that holds each fragment, -1 if there is none."""
        mask = np.uint64(PLACES - 1)
        at = (hashes & mask).astype(np.int64)
        out = np.full(len(hashes), -1, dtype=np.int64)
        open_ = np.arange(len(hashes))
        while len(open_):
            key = self.keys[at]
            hit = key == hashes[open_]
            out[open_[hit]] = at[hit]
            on = ~hit & (key != 0)
            open_, at = open_[on], (at[on] + 1) & (PLACES - 1)
        # equal hashes don't suffice: lengths and all bytes must agree
        differs = (out >= 0) & (self.size[out] != spans.length)
        which = np.flatnonzero((out >= 0) & ~differs)
        j = 0
        while len(which):
            differs[which] |= spans.lane(j, which) != self.lanes[self.lane_at[out[which]] + j]
            j += 1
            which = which[spans.length[which] > 8 * j]
        out[differs] = -1
        return out

    def add(self, hashes: np.ndarray, fragments: Sequence[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Different unknown fragments with their ids, one after the other; what doesn't fit any more is left out."""
        room = PLACES // 2 - self.held
        hashes, fragments, lengths = hashes[:room], fragments[:room], lengths[:room]
        ids = ids[: int(lengths.sum())]
        lanes = np.frombuffer(b"".join([f.ljust(-(-len(f) // 8) * 8, b"\0") for f in fragments]), dtype="<u8")
        self.pool = _with_room(self.pool, self.used + len(ids))
        self.lanes = _with_room(self.lanes, self.lanes_used + len(lanes) + 1)
        self.pool[self.used : self.used + len(ids)] = ids
        self.lanes[self.lanes_used : self.lanes_used + len(lanes)] = lanes
        size = np.array([len(f) for f in fragments], dtype=np.int64)
        start = self.used + np.cumsum(lengths) - lengths
        lane_at = self.lanes_used + np.cumsum(-(-size // 8)) - -(-size // 8)
        self.used += len(ids)
        self.lanes_used += len(lanes)
        self.held += len(hashes)
        at, open_ = (hashes & np.uint64(PLACES - 1)).astype(np.int64), np.arange(len(hashes))
        while len(open_):
            free = self.keys[at] == 0
            taken, first = np.unique(at[free], return_index=True)
            who = open_[free][first]
            self.keys[taken], self.start[taken], self.length[taken] = hashes[who], start[who], lengths[who]
            self.size[taken], self.lane_at[taken] = size[who], lane_at[who]
            on = self.keys[at] != hashes[open_]
            open_, at = open_[on], (at[on] + 1) & (PLACES - 1)


def _with_room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(len(x), n - len(x)), dtype=x.dtype)])


def joined_ids(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """pool[start : start + length] of all, one after the other."""
    ends = np.cumsum(length)
    return pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + length, length)]


class FragmentEncoder:
    """Encodes texts by a tokenizers file, fragment by fragment, to exactly the library's ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.bytes_of = self._token_bytes()
        self.spelt = np.array([len(b) for b in self.bytes_of])
        self.never = ~self._pairs()
        self.cuts = self._cuts()
        self.closing = {b for b in range(256) if all(self.cuts[b << 8 | c] for c in SEPARATORS)}
        self.memory = Memory(self.dtype)
        # a vocabulary of words spells both cases alike
        self.values = W.LOWERED if self.suffix else None

    def _token_bytes(self) -> list[bytes]:
        as_byte = byte_of_char()
        table = [b""] * self.size
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            if token in self.special:
                table[i] = token.encode()
            else:
                body = token.removesuffix(self.suffix) if self.suffix else token
                table[i] = bytes(as_byte[c] for c in body if c in as_byte)
        return table

    def _pairs(self) -> np.ndarray:
        """pairs[a, b]: byte b follows byte a inside some token."""
        pairs = np.zeros((256, 256), dtype=bool)
        for i, token in enumerate(self.bytes_of):
            if len(token) > 1 and i not in self.special.values():
                body = np.frombuffer(token, dtype=np.uint8)
                pairs[body[:-1], body[1:]] = True
        return pairs

    def _cuts(self) -> np.ndarray:
        """cuts[a << 8 | b]: a cut between bytes a and b is certain and a border of the pre-tokeniser."""
        border = np.zeros((256, 256), dtype=bool)
        white = [ord(c) for c in map(chr, range(128)) if c.isspace()]
        solid = [b for b in range(256) if b not in white]
        border[np.ix_(solid, list(SEPARATORS))] = True
        letters = [b for b in range(128) if chr(b).isalnum()]
        marks = [b for b in range(33, 127) if not chr(b).isalnum()]
        border[np.ix_(letters, marks)] = True
        return (border & self.never).reshape(-1)

    def specials(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Begin and end of the special strings that stand within a text."""
        raw, found = data.tobytes(), []
        for text in self.special:
            want = text.encode()
            at = raw.find(want)
            while at >= 0:
                if np.searchsorted(offsets, at, side="right") == np.searchsorted(offsets, at + len(want), side="left"):
                    found.append((at, at + len(want)))
                at = raw.find(want, at + 1)
        return found

    def spans(self, data: np.ndarray, offsets: np.ndarray, specials: Sequence[tuple[int, int]] = ()) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the fragments; none ends inside a special string."""
        if self.suffix:  # words end at white space, which has no ids
            return W.word_spans(data, offsets)
        first = np.zeros(len(data) + 1, dtype=bool)
        first[offsets] = True
        first[1 : len(data)] |= self.cuts[data[:-1].astype(np.uint16) << 8 | data[1:]]
        for i, j in specials:
            first[i + 1 : j] = False
        first[len(data)] = True
        places = np.flatnonzero(first)
        return places[:-1], places[1:]

    def _each(self, fragments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.library.encode_batch_fast(fragments, add_special_tokens=False)]
        return np.array([i for x in found for i in x], dtype=self.dtype), np.array([len(x) for x in found], dtype=np.int64)

    def _together(self, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """One call for many fragments; the ids are dealt out by the bytes that they spell.

        None if some id reaches over a joint (then the fragments were not fit to be joined).
        """
        text = (b" " if self.suffix else b"").join(fragments).decode()
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)
        ends = np.cumsum([len(f) for f in fragments])
        spelt = np.cumsum(self.spelt[ids])
        cuts = np.searchsorted(spelt, ends, side="left")
        if not len(ids) or cuts[-1] != len(ids) - 1 or (spelt[cuts] != ends).any():
            return None
        return ids, np.diff(cuts, prepend=-1)

    def _fit(self, fragment: bytes) -> bool:
        """Whether a fragment may stand between others in one text for the library."""
        if self.suffix:  # only characters that normalising neither composes nor makes longer or shorter
            return PLAIN(fragment) is not None
        # it must bring the white space before which the cut is certain, and end so that the next cut is
        return fragment[0] in SEPARATORS and fragment[-1] in self.closing

    def _learn(self, hashes: np.ndarray, known: list[bytes], fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, ids, lengths) of unknown fragments, ``known`` as they will be compared; they are remembered while there is room."""
        fit = [i for i, f in enumerate(fragments) if self._fit(f)]
        rest = sorted(set(range(len(fragments))).difference(fit))
        ids, lengths = [], []
        for k in range(0, len(fit), CALL_FRAGMENTS):
            part = [fragments[i] for i in fit[k : k + CALL_FRAGMENTS]]
            a, b = self._together(part) or self._each([f.decode() for f in part])
            ids.append(a)
            lengths.append(b)
        for k in range(0, len(rest), CALL_FRAGMENTS):
            a, b = self._each([fragments[i].decode() for i in rest[k : k + CALL_FRAGMENTS]])
            ids.append(a)
            lengths.append(b)
        order, all_ids, all_lengths = np.array(fit + rest), np.concatenate(ids), np.concatenate(lengths)
        self.memory.add(hashes[order], [known[i] for i in order.tolist()], all_ids, all_lengths)
        return order, all_ids, all_lengths

    def _encode_group(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin."""
        specials = self.specials(data, offsets)
        begin, end = self.spans(data, offsets, specials)
        memory = self.memory
        known = data if self.values is None else self.values[data]
        spans = W.Spans(known, begin, end)
        hashes = memory.hashes(spans)
        # long fragments and those with a special string go to the library each by each
        alone = end - begin > SHORT
        for i, _ in specials:
            alone[np.searchsorted(begin, i, side="right") - 1] = True
        at = memory.find(spans, hashes)
        at[alone] = -1
        start, length, pool = memory.start[at].astype(np.int64), memory.length[at].astype(np.int64), memory.pool
        missing = np.flatnonzero((at < 0) & ~alone)
        extra: list[np.ndarray] = []
        base = memory.used
        if len(missing):
            raw, new = known.tobytes(), {}
            inverse = np.array([new.setdefault(raw[i:j], len(new)) for i, j in zip(begin[missing].tolist(), end[missing].tolist(), strict=True)])
            first = np.empty(len(new), dtype=np.int64)
            first[inverse[::-1]] = missing[::-1]
            order, ids, lengths = self._learn(hashes[first], list(new), [data[i:j].tobytes() for i, j in zip(begin[first].tolist(), end[first].tolist(), strict=True)])
            where, size = np.empty(len(new), dtype=np.int64), np.empty(len(new), dtype=np.int64)
            where[order], size[order] = np.cumsum(lengths) - lengths, lengths
            start[missing], length[missing] = where[inverse] + base, size[inverse]
            extra.append(ids)
        single = np.flatnonzero(alone)
        if len(single):
            ids, lengths = self._each([data[begin[i] : end[i]].tobytes().decode() for i in single.tolist()])
            start[single] = np.cumsum(lengths) - lengths + base + sum(map(len, extra))
            length[single] = lengths
            extra.append(ids)
        pool = np.concatenate([pool[:base], *extra]) if extra else pool
        bounds = np.zeros(len(begin) + 1, dtype=np.int64)
        np.cumsum(length, out=bounds[1:])
        return joined_ids(pool, start, length), bounds[np.searchsorted(begin, offsets)]

    def encode_arrow(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text (null: none), in the smallest unsigned type that holds the vocabulary."""
        for data, offsets in W.groups(*W.buffers(texts), GROUP_BYTES):
            ids, at = self._encode_group(data, offsets)
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                yield ids[i:j]

    def encode_batch(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        return self.encode_arrow(pa.array(texts, pa.large_string()))

    def lengths(self, texts: Sequence[str]) -> Iterator[int]:
        return map(len, self.encode_batch(texts))

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        if self.suffix:
            return self.library.decode(ids.tolist(), skip_special_tokens=False)
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> FragmentEncoder:
    """One encoder for each file and worker, with what it remembers."""
    return FragmentEncoder(path)


def map_ids(docs: DataFrame, path: str, derive: Callable, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes ``text_col`` and returns ``id_col`` with the columns of ``schema``.

    ``derive(encoder, text, ids)`` gives the values of one row, in the order of
    ``schema`` (a DDL string), from the text and its ids.
    """
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T._parse_datatype_string(schema).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            rows = [derive(bpe, text, ids) for text, ids in zip(texts, bpe.encode_arrow(batch.column(1)), strict=True)]
            columns = [batch.column(0), *(list(x) for x in zip(*rows))] if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, out)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array<int>) of every row."""
    return map_ids(docs, path, lambda bpe, text, ids: (ids.astype(np.int32),), "ids array<int>", id_col, text_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and the ``text`` that the ids spell; null ids spell the empty text."""
    out = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, out)


def _digest(bpe: FragmentEncoder, text: str, ids: np.ndarray) -> tuple:
    return (
        len(ids),
        hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest(),
        hashlib.sha256(bpe.decode(ids).encode()).hexdigest(),
    )


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, in one pass."""
    return map_ids(docs, path, _digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")
