"""Operators 11 to 13 against brute-force versions, over small tables with odd rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from storyline.llm import alignment, centroids, queries, simhash
from storyline.llm.bpe import byte_of_char
from tests.llm.test_operators import BASE, ODD

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- 11 -------------------------------------------------------------------------------------------


def plain_clusters(rows, length, k, rounds):
    """Every vector meets every centroid, in Python integers."""
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == length and all(x is not None and np.isfinite(x) and abs(x) <= 131072 for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=key)[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min(range(len(centres)), key=lambda j: (apart(v, centres[j]), j))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        for j in set(own):
            members = [v for (_, v), c in zip(kept, own, strict=True) if c == j]
            centres[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    own = [(i, c, apart(v, centres[c])) for i, v in kept for c in [near(v)]]
    inertia = Counter()
    for _, c, d in own:
        inertia[c] += d
    return sorted([(i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in own], key=repr)


def test_clusters_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(i % 7, 1.5, 4)]) for i in range(300)]
    rows += [(7, rows[7][1]), (7, [0.0] * 4), (None, [1.0, -2.0, 3.0, -4.5]), (1000, None), (1001, []), (1002, [1.0]), (1003, [1.0, None, 1.0, 1.0])]
    rows += [(1004, [float("nan"), 0.0, 0.0, 0.0]), (1005, [float("inf"), 0.0, 0.0, 0.0]), (1006, [131072.0, -131072.0, 0.5, 1e-9]), (1007, [1e300, 0.0, 0.0, 0.0])]
    rows += [(2000 + i, [0.25, 0.25, 0.25, 0.25]) for i in range(150)]  # one vector that a third of the rows repeat
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    assert rows_of(centroids.clustered(df, length=4, rounds=6)) == plain_clusters(rows, 4, 8, 6)


def test_few_vectors_ties_and_none(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert rows_of(centroids.clustered(df, length=2)) == plain_clusters(rows, 2, 8, 10)
    assert rows_of(centroids.clustered(df, length=2, k=1)) == plain_clusters(rows, 2, 1, 10)
    assert centroids.clustered(df.where("false"), length=2).collect() == []
    assert centroids.clustered(df).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_save_scans_without_changing_results():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(-40, 40, (500, 8)) + 500 * j for j in range(4)])
    centres = [v[500 * j].tolist() for j in range(4)]
    cluster, upper, lower, scanned = centroids.Bounds(centres, centres).assign(v, np.zeros(2000, dtype=np.int64), np.full(2000, np.inf), np.zeros(2000))
    assert scanned == 1500  # the first cluster's vectors are nearer than half the way to the next centroid
    moved = [(v[cluster == j].sum(0) // 500).tolist() for j in range(4)]
    after, upper, lower, scanned = centroids.Bounds(moved, centres).assign(v, cluster, upper, lower)
    assert scanned == 0 and (after == cluster).all()
    exact = np.array([((v - np.array(c)) ** 2).sum(1) for c in moved])
    assert (after == exact.argmin(0)).all() and (upper >= np.sqrt(exact.min(0))).all()


# --- 12 -------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius):
    out = {v: v for v in values}
    while True:
        before = dict(out)
        for v in values:
            near = [w for w in values if (v ^ w).bit_count() <= radius]
            least = min(out[w] for w in near)
            for w in near:
                out[w] = least
        if out == before:
            return out


def test_simhash_of_odd_texts(spark):
    rows = [(i * 3 - 4, t) for i, t in enumerate(ODD)] + [(None, " ".join(BASE)), (5, "x y z"), (5, "z y x"), (None, None), (None, "alone here")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int").repartition(3)
    found = {t: plain_fingerprint(t) for _, t in rows}
    parts = plain_components(sorted(set(found.values())), 2)
    least = {}
    for i, t in rows:
        if i is not None:
            part = parts[found[t]]
            least[part] = min(least.get(part, i), i)
    expected = sorted([(i, f"{found[t]:016x}", least.get(parts[found[t]])) for i, t in rows], key=repr)
    assert rows_of(simhash.simhash(df)) == expected
    assert simhash.simhash(df.where("false")).collect() == []


def near_values(n, seed):
    """Groups of fingerprints in chains of 1 to 4 differing bits, and one large group that shares 40 bits."""
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        value = int(rng.integers(0, 1 << 63)) if len(out) % 3 else int(rng.integers(0, 1 << 24))
        for _ in range(int(rng.integers(1, 6))):
            out.append(value)
            for b in rng.integers(0, 64, int(rng.integers(1, 5))).tolist():
                value ^= 1 << b
    return sorted(set(out))


def test_tree_finds_all_within_radius():
    values = np.array(near_values(600, 3), dtype=np.uint64)
    tree = simhash.BKTree(values)
    for radius in (0, 2, 5):
        who, node = tree.search(values[:200], radius)
        expected = {(i, j) for i in range(200) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius).tolist()}
        assert set(zip(who.tolist(), node.tolist(), strict=True)) == expected and len(who) == len(expected)


@pytest.mark.parametrize("tree", [30, 10_000])
def test_shards_lose_no_link(spark, tree):
    values = near_values(500, 11)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    edges = [(u & (1 << 64) - 1, v & (1 << 64) - 1) for u, v in simhash.links(df, 2, tree).collect()]
    assert all((u ^ v).bit_count() > 0 for u, v in edges)
    out = {v: v for v in values}
    for _ in range(40):
        for u, v in edges:
            out[u] = out[v] = min(out[u], out[v])
    assert out == plain_components(values, 2)
    most = simhash.shards(df, 2, tree).groupBy("mask", "value").count().agg({"count": "max"}).first()[0]
    assert most <= tree


# --- 13 -------------------------------------------------------------------------------------------


def plain_alignment(rows):
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    chars = byte_of_char()
    spelt_a = {i: bytes(chars[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if all(c in chars for c in t)}
    spelt_b = {i: bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in range(b.get_piece_size()) for p in [b.id_to_piece(i)]}
    docs, count = [], Counter()
    for i, text in rows:
        raw = (" " + text).encode() if text else b""
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        spelt = [[table[x] for x in side] for table, side in zip((spelt_a, spelt_b), ids, strict=True)]
        if not text or any(b"".join(x) != raw for x in spelt):
            docs.append((i, None))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in spelt]
        groups, at = [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            after = [stop.index(cut, k) + 1 for stop, k in zip(ends, at, strict=True)]
            groups.append(tuple(side[i:j] for side, i, j in zip(ids, at, after, strict=True)))
            at = after
        links = Counter((x, y) for one, other in groups for x in one for y in other)
        count.update(links.keys())
        docs.append((i, (len(ids[0]), len(ids[1]), groups, links)))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for i, found in docs:
        if found is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = found
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sums = sum(links.values()), sum(n for k, n in links.items() if count[k] == best[k[0]]), sum(n * count[k] for k, n in links.items())
        out.append((i, n_a, n_b, len(groups), *sums, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


HARD = [
    "a<|endoftext|>b <s> <unk> <0x41> x",
    " lead  two   three \n\n\t x\r\ny ",
    "▁x y",
    "日本語テキスト、です。句読点！",
    "x" * 3000,
    "…—“quoted” don't 's we're, a,b;c  ,  d\n,e",
    "\x00 nul \x01",
    "🙂🙃👨‍👩‍👧 a​b",
    " ",
    "\n",
    "a b　c d e",
    "1234567,890.12 $5 a_b __init__ ```",
]


def test_alignment_of_odd_texts(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate([t[:9000] if t else t for t in ODD] + HARD)] + [(3, "again the id"), (None, "no id"), (3, "again the id")]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, chunk int, pairs int").repartition(3)
    assert rows_of(alignment.aligned(df, BYTE, PIECE)) == plain_alignment(rows)
    assert alignment.aligned(df.where("false"), BYTE, PIECE).collect() == []


def test_alignment_of_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows_of(queries.op13_alignment(spark, SF)) == plain_alignment([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_chunks_and_forgetting_change_nothing(monkeypatch):
    import pyarrow as pa

    texts = pa.array([t for t in HARD if t] * 3 + [f"word{i} of many, number {i * i}" for i in range(300)])
    one = alignment.Aligner(BYTE, PIECE)
    whole, pairs, holders = one.chunk(*alignment._spaced(texts))
    monkeypatch.setattr(alignment, "REMEMBERED", 40)
    few = alignment.Aligner(BYTE, PIECE)
    parts, held = [], Counter()
    for k in range(0, len(texts), 7):
        rows, own, n = few.chunk(*alignment._spaced(texts.slice(k, 7)))
        parts += rows
        held.update(dict(zip(own.tolist(), n.tolist(), strict=True)))
    assert len(few.known) <= 40 + 400
    assert [r[:5] for r in parts] == [r[:5] for r in whole]
    assert held == dict(zip(pairs.tolist(), holders.tolist(), strict=True))


def test_trees_stay_small(spark):
    """A shard's tree holds a few hundred classes, whatever their number."""
    values = np.random.default_rng(5).integers(-(1 << 63), (1 << 63) - 1, 3000).tolist()
    sizes = [r["count"] for r in simhash.shards(spark.createDataFrame([(v,) for v in values], "fp long")).groupBy("mask", "value").count().collect()]
    assert max(sizes) <= 512 and sum(sizes) >= 3 * len(values)


def test_many_trees_are_searched_together():
    """Trees of many shards, most of one value, in one call: what each shard's own call finds; a link lies within a shard."""
    values = np.array(near_values(600, 8), dtype=np.uint64)
    rng = np.random.default_rng(8)
    shard = np.where(rng.random(len(values)) < 0.2, rng.permutation(len(values)) + 3, rng.integers(0, 3, len(values)))
    found = list(zip(*(x.tolist() for x in simhash.stars(values, 2, shard)), strict=True))
    apart = [pair for k in np.unique(shard) for pair in zip(*(x.tolist() for x in simhash.stars(values[shard == k], 2)), strict=True)]
    assert sorted(found) == sorted(apart) and len(found) > 20
    root = np.searchsorted(np.sort(shard), np.sort(shard))
    tree = simhash.BKTree(values[np.argsort(shard, kind="stable")], root)
    who, node = tree.earlier(np.arange(len(values)), 2)
    v = tree.values
    expected = {(i, j) for i in range(len(v)) for j in range(root[i], i) if (int(v[i]) ^ int(v[j])).bit_count() <= 2}
    assert set(zip(who.tolist(), node.tolist(), strict=True)) == expected and len(who) == len(expected)
