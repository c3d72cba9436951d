"""Every operator against a brute-force version, over small tables with odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from storyline.llm import bpe, fingerprints, line_dedup, neighbours, ngram_join, packing, quality, queries, token_counts, token_files, url_filters
from storyline.llm import words as W
from storyline.llm.common import new_path
from storyline.llm.components import components

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BASE = "the quick brown fox jumps over the lazy dog while ten small birds sing in an old tree near our white house today".split()
ODD = [
    None,
    "",
    " \n\t ",
    "one",
    "Two words",
    " ".join(BASE),
    " ".join(BASE).upper(),
    " ".join([*BASE[:-1], "tomorrow"]),
    " ".join(["Now", *BASE]),
    " ".join(BASE[:12] + ["cat"] * 30),
    "a line that stands in several texts\nfirst\nA LINE that stands in several texts  ",
    "own\n  a line that stands in several texts\nlast line of this text",
    "été à la plage, l'eau d'où? à  bientôt\u00a0!\r\nfoo-bar <|endoftext|> end x<|endoftext|>y",
    "日本語のテキスト 😀😀 İstanbul ΣΑΣ e\u0301 \x1c\x85",
    "word " * 30_000,
    "z" * 9000,
    " ".join(BASE),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 - 4, t, "extra", i) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, a int".replace("n long", "gone string")).withColumn("range", F.lit(1)).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


# --- 1 --------------------------------------------------------------------------------------------


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, x in enumerate(keys):
        for y in keys[i + 1 :]:
            common = len(sets[x] & sets[y])
            if common and 100 * common >= 75 * (len(sets[x]) + len(sets[y]) - common):
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    return {i: find(i) for i in keys}


def check_join(df):
    sets = {i: shingle_set(t) for i, t in texts(df).items()}
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(df).collect()}
    assert found == {i: (len(sets[i]), c) for i, c in brute_components(sets).items()}


def test_ngram_join_of_odd_rows(docs):
    check_join(docs)


def test_ngram_join_of_near_copies(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(6):
        base = [f"w{x}" for x in rng.integers(0, 400, 60)]
        for _ in range(60 if g == 0 else 6):
            t = list(base)
            for at in rng.integers(0, 60, rng.integers(0, 4)):
                t[at] = f"w{rng.integers(0, 400)}"
            rows.append(" ".join(t))
    check_join(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4))


def test_ngram_join_without_rows_or_ids(spark, empty):
    assert ngram_join.ngram_join(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, "a b c d e f")], "doc_id long, text string")
    assert sorted(((r["doc_id"] or -1), (r["component_id"] or -1)) for r in ngram_join.ngram_join(df).collect()) == [(-1, -1), (5, 5), (5, 5), (7, 5)]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51)], "u long, v long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert found == {**dict.fromkeys(range(31), 0), 50: 50, 51: 50}


def test_shingles_are_distinct_and_equal_for_equal_words():
    import pyarrow as pa

    a, b, c = W.shingles(pa.array(["A b c d e f a b c d e", "a\tb\nc d e f A b c d e", None]), W.new_key())
    assert a.tolist() == b.tolist() and len(a) == 6 and len(c) == 0


def test_one_row_of_each_group_with_repeated_ids(spark):
    a, b, c = " ".join(BASE), " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    near = " ".join([*BASE[:-1], "tomorrow"])
    rows = [(1, a), (5, near), (5, b), (7, c), (7, c), (7, a), (8, c), (9, ""), (9, ""), (None, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    clashing = docs.withColumns({"row": F.lit(1), "component_id": F.lit(2), "with.dot": F.lit(3)})
    assert corpus_pipeline.one_of_each_group(spark, clashing, "").columns == clashing.columns
    found = sorted(map(tuple, corpus_pipeline.one_of_each_group(spark, docs, "").collect()), key=repr)
    assert found == sorted([(1, a), (5, b), (7, c), (9, ""), (9, ""), (None, a), (None, a)], key=repr)


#: Two words that a polynomial hash with a known multiplier takes for one.
FORGED = ("oolmlmlommnlmlnnkmnlmn", "lknmomoknmlonnmlonmoml")


def test_forged_words_are_told_apart(spark):
    df = spark.createDataFrame([(1, FORGED[0]), (2, FORGED[1])], "doc_id long, text string")
    check_join(df)
    for path in (BYTE, WORD):
        lib, mine = Tokenizer.from_file(path), bpe.FragmentEncoder(path)
        for _ in range(2):
            assert [x.tolist() for x in mine.encode_batch(FORGED)] == [lib.encode(x, add_special_tokens=False).ids for x in FORGED]


def test_equal_hashes_of_fragments_are_no_hit(monkeypatch):
    lib, mine = Tokenizer.from_file(BYTE), bpe.FragmentEncoder(BYTE)
    monkeypatch.setattr(bpe.Memory, "hashes", lambda self, spans: np.full(len(spans.begin), 7, dtype=np.uint64))
    text = " ".join(BASE * 3) + " Wörter, 12 and some more"
    for _ in range(2):
        assert next(mine.encode_batch([text])).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_span_hashes_depend_on_bytes_alone():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 256, n).astype(np.uint8) for n in [0, 1, 7, 8, 9, 64, 255, 256, 257, 300, 301, 5000]]
    data = np.concatenate([*parts, *parts])
    ends = np.cumsum([len(x) for x in [*parts, *parts]])
    begins = ends - [len(x) for x in [*parts, *parts]]
    h = W.Spans(data, begins, ends).hashes(99)
    assert h[: len(parts)].tolist() == h[len(parts) :].tolist() and len(set(h.tolist())) == len(parts)
    alone = [int(W.Spans(x, np.array([0]), np.array([len(x)])).hashes(99)[0]) for x in parts]
    assert alone == h[: len(parts)].tolist()


def test_overlaps_accumulate_and_give_up():
    rng = np.random.default_rng(9)
    row = np.unique(rng.integers(0, 900, 200).astype(np.uint64))
    sets = [np.unique(rng.integers(0, 900, n).astype(np.uint64)) for n in rng.integers(1, 300, 50)]
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    sizes = np.array([len(x) for x in sets])
    need = rng.integers(0, 120, 50)
    count, left = ngram_join.overlaps(row, np.concatenate(sets), starts, sizes, need)
    for x, n, c, r in zip(sets, need, count, left, strict=True):
        true = len(np.intersect1d(row, x))
        assert c <= true <= c + r and (r == 0 or c + r < n) and (r or c == true)


@pytest.mark.parametrize("heavy", [2, 20])
def test_ngram_join_splits_heavy_columns(spark, monkeypatch, heavy):
    monkeypatch.setattr(ngram_join, "HEAVY", heavy)
    monkeypatch.setattr(ngram_join, "ROWS", 5)
    test_ngram_join_of_near_copies(spark)


# --- 2, 3, 9 ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_is_the_library(path):
    lib = Tokenizer.from_file(path)
    mine = bpe.FragmentEncoder(path)
    sample = [t or "" for t in ODD] + ["à <|endoftext|>à", "<|ENDOFTEXT|>", "''s !'s don't", "\n\n  x", "a" * 70]
    for _ in range(2):
        for text, ids in zip(sample, mine.encode_batch(sample), strict=True):
            true = lib.encode(text, add_special_tokens=False).ids
            assert ids.tolist() == true
            assert mine.decode(ids) == lib.decode(true, skip_special_tokens=False)


def test_cuts_never_part_a_token():
    mine = bpe.FragmentEncoder(BYTE)
    for i, token in enumerate(mine.bytes_of):
        if i not in mine.special.values():
            assert not any(mine.cuts[a << 8 | b] for a, b in zip(token, token[1:], strict=False))


def test_bpe_digests_and_round_trip(docs, empty):
    lib = Tokenizer.from_file(BYTE)
    found = {r["doc_id"]: tuple(r)[1:] for r in bpe.digests(docs, BYTE).collect()}
    for i, t in texts(docs).items():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert found[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()}
    assert back == {i: t or "" for i, t in texts(docs).items()}
    assert bpe.digests(empty, BYTE).count() == 0


def test_token_files(spark, docs, empty):
    lib = Tokenizer.from_file(BYTE)
    found = sorted(tuple(r) for r in token_files.token_file_digest(docs, BYTE).collect())
    start, expected = 0, []
    for i, t in sorted(texts(docs).items()):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert found == expected
    assert token_files.token_file_digest(empty, BYTE).count() == 0
    twice = spark.createDataFrame([(None, "b"), (None, "a"), (2, "x"), (2, "x")], "doc_id long, text string")
    folder = new_path(spark, "files")
    rows = token_files.read_token_files(spark, folder, token_files.write_token_files(twice, BYTE, folder)).collect()
    assert sorted((r["start"], r["doc_id"], r["ids"]) for r in rows) == [(0, None, [64, 0]), (2, None, [65, 0]), (4, 2, [87, 0]), (6, 2, [87, 0])]


def test_token_counts(docs, empty, monkeypatch):
    lib = Tokenizer.from_file(WORD)
    found = {r["doc_id"]: tuple(r)[1:] for r in token_counts.token_counts(docs, WORD).collect()}
    for i, t in texts(docs).items():
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert found[i] == (len((t or "").encode()), n, n > 2048)
    assert token_counts.token_counts(empty, WORD).count() == 0
    monkeypatch.setattr(token_counts, "PIECE_CHARS", 10)
    assert "".join(token_counts.pieces("some words of  a text\nin pieces")) == "some words of  a text\nin pieces"


# --- 4 ------------------------------------------------------------------------------------------------------


def test_fingerprints(spark, docs, empty):
    rows = {r["doc_id"]: r for r in fingerprints.compared(docs).collect()}
    own = texts(docs)
    order = sorted(own, reverse=True)
    assert set(rows) == set(own)
    for i, nxt in zip(order, order[1:] + order[:1], strict=True):
        a, b = own[i] or "", own[nxt] or ""
        k = len(a) // 2
        assert rows[i]["n_chars"] == len(a)
        assert rows[i]["edited_sha256"] == hashlib.sha256((a[: len(a) - k] + b[:k]).encode()).hexdigest()
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
    by_text = {}
    for i, r in rows.items():
        assert by_text.setdefault(own[i] or "", r["fingerprint"]) == r["fingerprint"]
    assert fingerprints.compared(empty).count() == 0
    single = fingerprints.compared(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).first()
    assert single["near_next"] == 1.0


def test_levels_are_entropies_and_likeness_orders():
    import math
    from collections import Counter

    rng = np.random.default_rng(1)
    prose = " ".join(rng.choice(BASE, 400)).encode()
    data = np.frombuffer(prose, np.uint8)
    n = fingerprints.WINDOW
    for i, level in list(enumerate(fingerprints.levels(data).tolist()))[::97]:
        h = -sum(c / n * math.log2(c / n) for c in Counter(prose[i : i + n]).values())
        assert abs(level - h / math.log2(n) * 1000) <= 1
    import pyarrow as pa

    other = " ".join(rng.choice(BASE[::-1], 400))
    text = prose.decode()
    rank = fingerprints.rarity_of(fingerprints.level_counts(pa.array([text, other])))
    a, b, c = fingerprints.fingerprints(pa.array([text, text[:1500] + other[:500], other]), rank)
    assert fingerprints.likeness(a, a) == 1.0
    assert fingerprints.likeness(a, b) > fingerprints.likeness(a, c)


def brute_fingerprint(text, counts, size=2048):
    """Features and chain of filters by their definition, window by window."""
    import math
    from collections import Counter

    raw, w, run = (text or "").encode(), fingerprints.WINDOW, fingerprints.RUN
    level = [
        int(1000 * (1 - sum(int(round((c * math.log2(c) - (c - 1) * math.log2(max(c - 1, 1))) * (1 << 24))) for n in Counter(raw[i : i + w]).values() for c in range(2, n + 1)) / fingerprints.MOST))
        for i in range(len(raw) - w + 1)
    ]
    if counts is None:
        return Counter(level)
    order = {v: r for r, v in enumerate(sorted(range(fingerprints.LEVELS + 1), key=lambda v: (counts[v], v)))}
    counts_at = [100 <= v <= 990 for v in level]
    rank = [order[v] if ok else 10_000 for v, ok in zip(level, counts_at, strict=True)]
    if len(raw) < w + run:
        places = range(len(level))
    else:
        votes = Counter(min(range(i, i + run), key=lambda j: (rank[j], j)) for i in range(len(rank) - run + 1))
        places = sorted(i for i, n in votes.items() if n >= 12 and counts_at[i])
    if 0 < len(raw) < w:
        hashes = [int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")]
    else:
        hashes = []
        for i in places:
            h = 0
            for k in range(4):
                lane = int.from_bytes(raw[i + 8 * k : i + 8 * k + 8], "little")
                h = int(W.mixed(np.array([(h + lane * ((2 * k + 0x9E3779B97F4A7C15) | 1)) % (1 << 64)], dtype=np.uint64))[0])
            hashes.append(h)
    chain = [{h >> 11 * k & size - 1 for h in hashes[f : f + 160] for k in range(5)} for f in range(0, len(hashes), 160)]
    return chain


def brute_likeness(x, y):
    if not x or not y:
        return float(x == y)
    if x == y:
        return 1.0
    short, long_ = (x, y) if len(x) <= len(y) else (y, x)

    def match(a, b):
        low, most = min(len(a), len(b)), max(len(a), len(b))
        chance = len(a) * len(b) / 2048
        floor = chance + 0.1 * max(low - chance, 0) * low / most
        return min(1.0, max(0.0, (len(a & b) - floor) / max(most - floor, 1e-9)))

    return sum(max(match(a, b) for b in long_) for a in short) / len(short) * 2 * len(short) / (len(short) + len(long_))


def test_fingerprints_are_those_of_the_definition(spark, monkeypatch):
    import base64
    from collections import Counter

    rng = np.random.default_rng(12)
    prose = [" ".join(rng.choice(BASE, n)) for n in (3, 8, 12, 14, 16, 40, 200, 900)]
    prose += [None, "", "abc", "abc", prose[6], prose[7][:3000] + prose[6], "x" * 300, "été " * 60, prose[7] + prose[7]]
    ids = [3, 9, 4, 1, 7, 7, 12, 0, 30, 31, 32, 33, 34, 35, 36, 37, None]
    df = spark.createDataFrame(list(zip(ids, prose, strict=True)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(fingerprints, "VOTE_BLOCK", 700)
    monkeypatch.setattr(fingerprints, "GROUP_BYTES", 2000)
    counts = sum((brute_fingerprint(t, None) for t in prose), Counter())
    chains = {t: brute_fingerprint(t, counts) for t in prose}
    found = fingerprints.compared(df).collect()
    order = sorted(zip(ids, prose, strict=True), key=lambda r: (-(r[0] if r[0] is not None else -99), r[1] or ""))
    expected = []
    for (i, a), (_, b) in zip(order, order[1:] + order[:1], strict=True):
        a, b = a or "", b or ""
        changed = fingerprints.edited(a, b)
        own, theirs, after = chains.get(a, []), brute_fingerprint(changed, counts), chains.get(b, [])
        expected.append((i, len(a), hashlib.sha256(changed.encode()).hexdigest(), own, theirs, brute_likeness(own, theirs), brute_likeness(own, after)))

    def parsed(x):
        n, body = x.split(":")
        bits = np.unpackbits(np.frombuffer(base64.b64decode(body), np.uint8)).reshape(int(n), 2048)
        return [set(np.flatnonzero(r).tolist()) for r in bits]

    key = lambda r: (repr(r[0]), r[2])
    assert len(found) == len(expected)
    for r, e in zip(sorted(found, key=key), sorted(expected, key=key), strict=True):
        assert tuple(r)[:3] == e[:3]
        assert parsed(r["fingerprint"]) == e[3] and parsed(r["edited_fingerprint"]) == e[4]
        assert abs(r["near_edited"] - e[5]) < 1e-9 and abs(r["near_next"] - e[6]) < 1e-9


def test_fingerprints_of_long_texts_ignore_neighbours():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    prose = [" ".join("".join(rng.choice(list("abcdefghijklmnop .,"), rng.integers(2, 9))) for _ in range(rng.integers(60, 300))) for _ in range(40)]
    prose[5:9] = [prose[i][: fingerprints.WINDOW + fingerprints.RUN + k] for i, k in zip(range(5, 9), (-1, 0, 1, 16), strict=True)]  # few windows
    rank = fingerprints.rarity_of(fingerprints.level_counts(pa.array(prose)))
    alone = [fingerprints.as_text(fingerprints.fingerprints(pa.array([t]), rank)[0]) for t in prose]
    for order in (list(range(40)), list(range(39, -1, -1)), rng.permutation(40).tolist()):
        found = fingerprints.fingerprints(pa.array([prose[i] for i in order]), rank)
        assert [fingerprints.as_text(x) for x in found] == [alone[i] for i in order]
    # votes by their definition
    for texts in ([x.encode() for x in prose[:3]], *([prose[i].encode()] for i in (6, 7, 8))):
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        expected = []
        for text, start in zip(texts, offsets.tolist(), strict=False):
            ranks = rank[fingerprints.levels(np.frombuffer(text, np.uint8))]
            votes = np.zeros(len(ranks), int)
            for i in range(len(ranks) - fingerprints.RUN + 1):
                votes[i + np.argmin(ranks[i : i + fingerprints.RUN])] += 1
            expected += (np.flatnonzero((votes >= fingerprints.VOTES) & (ranks <= fingerprints.LEVELS + 1)) + start).tolist()
        assert fingerprints.feature_places(data, offsets, rank).tolist() == expected


# --- 5 --------------------------------------------------------------------------------------------------------


def exact_nearest(ids, vectors, top):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for n in [n for n, i in enumerate(ids) if i % 50 == 0]:
        score = unit @ unit[n]
        order = sorted((-round(float(s), 12), i) for s, i in zip(score, ids, strict=True) if i != ids[n])
        out[ids[n]] = [i for _, i in order[:top]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(900, 16))
    v[100:400] = v[100]  # a group of copies
    ids = list(range(900))
    odd = [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [1.0] * 15 + [None]), (1200, [1.0, 2.0]), (None, [1.0] * 16), (1250, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame([(i, x.tolist(), "x") for i, x in zip(ids, v, strict=True)] + [(i, x, "x") for i, x in odd], "vec_id long, embedding array<double>, cell string")
    found = {}
    for r in sorted(neighbours.search(df, lambda i: i % 50 == 0).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    truth = exact_nearest(ids, v, 5)
    assert found == truth  # so few entries are all met
    recall = [len(set(found[q]) & set(truth[q])) / 5 for q in truth]
    assert np.mean(recall) >= 0.9
    assert neighbours.search(df.where("vec_id < 0"), lambda i: i % 50 == 0).count() == 0
    assert neighbours.search(df.where("vec_id in (0, 1)"), lambda i: i % 50 == 0).count() == 1


def test_neighbours_of_repeated_ids(spark):
    """An id that several rows repeat has one place, as a candidate and as a query."""
    rows = [(0, [1.0, 0.0, 0.0]), *((7, [1.0, 0.001 * k, 0.0]) for k in range(1, 13)), *((i, [1.0, 0.1 * i, 0.2]) for i in range(11, 31))]
    rows += [(50, [0.0, 1.0, 0.0]), (50, [0.0, 0.0, 1.0]), (50, [0.0, 1.0, 0.0]), (60, [0.0, 0.9, 0.1]), (61, [0.0, 0.1, 0.95]), (50, [0.0, 0.99, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cosine = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    expected = {}
    for q in (0, 50):
        score = {}
        for i, v in rows:
            if i != q:
                score[i] = max([score.get(i, -2.0), *(cosine(w, v) for j, w in rows if j == q)])
        expected[q] = [i for _, i in sorted((-x, i) for i, x in score.items())[:5]]
    found = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.search(df, lambda i: i % 50 == 0).collect())
    assert found == [(q, n + 1, i) for q in (0, 50) for n, i in enumerate(expected[q])]
    assert len(expected[0]) == 5 and expected[0][0] == 7


def test_recall_where_not_all_entries_are_met(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(9000, 32))
    assert len(v) > 4 * neighbours.FEWEST
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    found = {}
    for r in neighbours.search(df, lambda i: i % 50 == 0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    truth = exact_nearest(list(range(9000)), v, 5)
    assert set(found) == set(truth) and all(len(x) == 5 for x in found.values())
    recall = np.mean([len(found[q] & set(truth[q])) / 5 for q in truth])
    assert 0.9 <= recall < 1  # an index, not a scan


def test_walk_meets_cells_in_order():
    one, two = np.array([0.5, 0.1, 0.9]), np.array([0.3, 0.2])
    counts = np.array([1, 1, 0, 1, 1, 1])
    sums = [(one[i] + two[j], i * 2 + j) for i in range(3) for j in range(2) if counts[i * 2 + j]]
    assert neighbours.walk(one, two, counts, 99) == [c for _, c in sorted(sums)]


# --- 6, 10 -----------------------------------------------------------------------------------------------------------


def test_line_dedup(spark, docs, empty):
    own = texts(docs)
    blank = " \t\n\x0b\x0c\r"
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(blank))
    holders = {}
    for i, t in own.items():
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    found = {r["doc_id"]: tuple(r)[1:] for r in line_dedup.line_dedup_digest(docs).collect()}
    for i, t in own.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        assert found[i] == (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    assert line_dedup.line_dedup_digest(empty).count() == 0
    nulls = spark.createDataFrame([(None, "one long line here"), (None, "one long line here"), (3, "one long line here"), (3, "one long line here")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in line_dedup.line_dedup_digest(nulls).collect()) == [(0, 1), (0, 1), (3, 0), (3, 0)]
    assert line_dedup.line_dedup(docs).columns == docs.columns
    assert line_dedup.line_dedup(docs, counts=("n_lines", "n_dropped")).columns == [*docs.columns, "n_lines", "n_dropped"]


def test_line_dedup_of_rows_that_share_an_id_or_have_none(spark):
    long = [f"a line of some length {i}" for i in range(6)]
    rows = [(1, "\n".join(long[:2])), (2, "\n".join([long[0], "x", long[2], long[0]])), (2, "\n".join([long[2], long[1], ""])), (2, "\n".join([long[2], long[1], ""]))]
    rows += [(None, "\n".join([long[3], long[0]])), (None, "\n".join([long[3], "y"])), (None, long[2]), (9, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = [(1, rows[0][1]), (2, "\n".join(["x", long[2]])), (2, "\n".join([long[2], ""])), (2, "\n".join([long[2], ""])), (None, long[3]), (None, "\n".join([long[3], "y"])), (None, ""), (9, None), (9, "")]
    assert sorted(map(repr, map(tuple, line_dedup.line_dedup(df).collect()))) == sorted(map(repr, expected))


def test_line_dedup_is_linear_in_a_documents_lines(spark):
    """Two equal documents of 200,000 lines: with steps that grow with the square this never ends."""
    df = spark.range(2).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: F.concat(F.lit("line number "), i.cast("string"))), "\n").alias("text"))
    found = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.line_dedup_digest(df).collect()}
    assert found == {0: (200_000, 0), 1: (200_000, 200_000)}


def test_line_dedup_leaves_columns_of_any_name_alone(spark):
    names = ["_doc", "_gone", "_left", "_n_lines", "_n_dropped", "doc", "gone", "left", "Left_", "line", "a", "b", "with.dot"]
    long = "a line that is long enough"
    rows = [(i, f"{long}\nown {i}", "en", "s", 9, *(f"{n}{i}" for n in names)) for i in range(4)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    expected = sorted((r[0], r[1] if not r[0] else f"own {r[0]}", *r[2:]) for r in rows)
    assert sorted(map(tuple, line_dedup.line_dedup(df).collect())) == expected
    found = corpus_pipeline.dedup_lines(spark, df, "")
    assert found.columns == df.columns
    assert sorted(map(tuple, found.collect())) == [(*r[:4], len(r[1]), *r[5:]) for r in expected]
    with pytest.raises(ValueError):
        line_dedup.line_dedup(df, counts=("LINE", "n"))


def fits(url, rules):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[2]), m[3]) if m else ("", "")
    best = sorted(((len(h + p), len(h)), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p))
    return host, path, best[-1][1] if best else None, best[-1][2] if best else "allow"


def test_url_filters_of_a_hot_host_and_nested_rules(spark):
    rng = np.random.default_rng(2)
    paths = ["", "/", *("/" + "/".join(rng.choice(["a", "b", "ab", "é", "b" * 300], rng.integers(1, 5))) for _ in range(300))]
    hosts = ["hot.example.org"] * 6 + ["a.com", "b.com", "example.org", "x.hot.example.org"]
    urls = [f"http://{hosts[rng.integers(0, len(hosts))]}{paths[rng.integers(0, len(paths))]}" for _ in range(1500)]
    rules = [(hosts[rng.integers(0, len(hosts))], p[: rng.integers(0, len(p) + 1)], str(rng.choice(["allow", "block"]))) for p in rng.choice(paths, 60)]
    best = {}
    for h, p, v in rules:  # of a rule's verdicts the smaller counts
        best[h, p] = min(v, best.get((h, p), v))
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r["page_id"]: tuple(r)[1:] for r in url_filters.judged(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert found == {i: fits(u, [(h, p, v) for (h, p), v in best.items()]) for i, u in enumerate(urls)}
    assert url_filters.judged(df.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_bounds_part_keys_that_share_long_beginnings():
    keys = sorted(f"org.example.\0/{'a' * 300}/{i:05d}" for i in range(4000))
    bounds = url_filters.separators(keys, 8)
    depth = np.bincount([sum(b <= k for b in bounds) for k in keys], minlength=8)
    assert depth.max() <= 2 * np.median(depth) and len(set(bounds)) == 7
    assert url_filters.separators(["k"] * 10, 4) == ["k"] * 3 and url_filters.separators(["a"], 3) == ["a", "a"]


def test_url_filters_of_long_common_paths(spark):
    urls = [f"https://h.example.org/{'p' * 220}/{i}" for i in range(900)]
    rules = [("example.org", "/" + "p" * 220 + "/1", "block"), ("example.org", "/" + "p" * 220 + "/12", "allow"), ("org", "/", "allow"), ("h.example.org", "/" + "p" * 100, "block")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r["page_id"]: tuple(r)[1:] for r in url_filters.judged(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert found == {i: fits(u, rules) for i, u in enumerate(urls)}


def test_url_filters(spark):
    rules = [*queries.RULES, ("a.example.org", "", "block"), ("net", "/x", "block"), ("net", "/x/y", "allow"), ("", "/", "block"), ("net", "/x", "block")]
    urls = [None, "", "no scheme", "http://", "http://ORG", "http://org/", "https://Example.org/es/1", "https://m.example.org/en/12?q#f", "https://x.a.example.org?p", "ftp://notorg/", "http://b.net/x/yz", "http://net/x/", "http://x.com/de/1", "a://b://c/d"] * 2
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, key string")
    found = {r["page_id"]: tuple(r)[1:] for r in url_filters.judged(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert found == {i: fits(u, rules) for i, u in enumerate(urls)}
    none = url_filters.judged(df, spark.createDataFrame([], "host string, path string, verdict string")).collect()
    assert {r["verdict"] for r in none} == {"allow"} and len(none) == len(urls)


# --- 7 -------------------------------------------------------------------------------------------------------------------


def test_quality(spark, empty):
    rng = np.random.default_rng(8)
    good = [" ".join(rng.choice(BASE, 60)) for _ in range(300)]
    bad = ["".join(rng.choice(list("#$%&*xqz"), 300)) for _ in range(60)]
    rows = [(i, t, "a") for i, t in enumerate(good + bad)] + [(900, None, "a"), (901, "", "a"), (None, good[0], "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, weight string").repartition(4)
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 360, 2)] + [(5000, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    kept = {r["doc_id"] for r in quality.selected(docs, model).collect()}
    assert len(kept & set(range(300))) >= 285 and not kept & set(range(300, 360))
    whole = quality.resampled(docs, model)
    assert whole.columns == docs.columns and {r["doc_id"] for r in whole.collect()} == kept
    assert quality.selected(empty, model).count() == 0
    assert quality.selected(docs, quality.fit(docs, labels.limit(0))).count() == docs.count()


def test_quality_is_that_of_the_definition(spark):
    """Counts, ratios, weights, calibration and the kept set, text by text."""
    from collections import Counter

    rng = np.random.default_rng(3)
    texts_ = [" ".join(rng.choice(BASE, rng.integers(1, 40))) for _ in range(120)] + ["".join(rng.choice(list("#$%&*xqz"), rng.integers(1, 200))) for _ in range(40)] + [None, "", "abc", "é" * 50]
    rows = [(i, t) for i, t in enumerate(texts_)] + [(5, texts_[9]), (5, texts_[5]), (None, texts_[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 120), int(i % 13 == 0)) for i in range(160)] + [(7, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    good = [i for i in range(120) if i % 13 and i != 7]
    order = [r["i"] for r in spark.createDataFrame([(i,) for i in good], "i long").orderBy(F.xxhash64("i"), "i").collect()]
    train, rest = set(order[::2]), set(order[1::2])

    def grams(t):
        raw = (t or "").encode()
        out = []
        for i in range(len(raw) - 3):
            h = 0
            for b in raw[i : i + 4]:
                h = h * 257 + b
            out.append(int(W.mixed(np.array([h], dtype=np.uint64))[0]) >> 46)
        return out

    raw = Counter(g for _, t in rows for g in grams(t))
    target = Counter(g for i, t in rows if i in train for g in grams(t))
    size = 1 << 18
    p, q = sum(target.values()) + size / 2, sum(raw.values()) + size / 2
    ratio = {g: round((np.log((target[g] + 0.5) / p) - np.log((raw[g] + 0.5) / q)) * (1 << 20)) for g in raw}
    weight = [sum(ratio[g] for g in grams(t)) / max(len(grams(t)), 1) * (quality.LENGTH / (1 << 20)) for _, t in rows]
    sums = [w + float(quality.gumbel(np.array([i or 0]))[0]) for w, (i, _) in zip(weight, rows, strict=True)]
    by_id = {}
    for w, (i, _) in zip(weight, rows, strict=True):
        if i in rest:
            by_id[i] = min(w, by_id.get(i, w))
    least = sorted(by_id.values())[int(quality.LOST * len(by_id))]
    k = sum(w >= least for w in weight)
    bar = sorted(sums, reverse=True)[k - 1]
    model = quality.fit(docs, labels)
    assert abs(model.least - bar) < 1e-6
    found = sorted((repr(r["doc_id"]), round(r["log_weight"], 6), round(r["gumbel_sum"], 6)) for r in quality.selected(docs, model).collect())
    assert found == sorted((repr(i), round(w, 6), round(x, 6)) for (i, _), w, x in zip(rows, weight, sums, strict=True) if x >= bar)


def test_kth_largest(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=500), np.full(300, 0.25), [1e9, -1e9]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for k in (1, 2, 250, 400, 801):
        assert quality.kth_largest(df, "v", k, 16) == np.sort(values)[-k]


# --- 8 ----------------------------------------------------------------------------------------------------------------------


def test_best_cuts_are_the_cheapest():
    rng = np.random.default_rng(6)
    for _ in range(40):
        size, places = 32, np.cumsum(rng.integers(1, 10, rng.integers(1, 30))).tolist()
        costs = rng.choice([0, 16, 64], len(places)).tolist()
        at = [0, *places]
        least = [0]
        price = lambda d: 0 if d & (d - 1) == 0 else size - d
        for j in range(1, len(at)):
            least.append(min(least[i] + price(at[j] - at[i]) + costs[j - 1] + packing.SEQUENCE for i in range(j) if at[j] - at[i] <= size))
        total, before, cost = 0, 0, dict(zip(places, costs, strict=True))
        for c in packing.best_cuts(places, costs, size):
            assert c - before <= size
            total, before = total + price(c - before) + cost[c] + packing.SEQUENCE, c
        assert before == places[-1] and total == least[-1]


def check_pieces(rows, own, lib):
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    for i, t in own.items():
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    return sequences


def test_packing(docs, empty, monkeypatch):
    lib = Tokenizer.from_file(WORD)
    check_pieces(packing.packed(docs, WORD).collect(), texts(docs), lib)
    assert packing.packed(empty, WORD).count() == 0


def test_packing_over_many_horizons(monkeypatch):
    monkeypatch.setattr(packing, "HORIZON", 6000)
    rng = np.random.default_rng(3)
    ends = np.zeros(100, dtype=bool)
    ends[7] = True
    docs = [rng.integers(0, 100, n).astype(np.uint16) for n in rng.integers(1, 5000, 60)]
    packer, out = packing._Packer(ends, 0, 2048), []
    for i, x in enumerate(docs):
        out += packer.add(i, x)
    out += packer.pack(True)
    length = {}
    for _, _, n, _, _, sequence, offset in out:
        assert length.get(sequence, 0) == offset
        length[sequence] = offset + n
    assert sum(length.values()) == sum(map(len, docs)) and max(length.values()) <= 2048
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in length.values())
    assert padding < 0.03 * sum(length.values())


# --- pipeline -------------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(8)
    good = [" ".join(rng.choice(BASE, 80)) + f"\nown line number {i}" for i in range(200)]
    bad = ["".join(rng.choice(list("#$%&*xqz"), 300)) for _ in range(40)]
    near = good[0].replace("own line number 0", "own line number zero")
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*good, *bad, near])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(not 200 <= i < 240), 0) for i in range(0, 240, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert len(set(seen[0]) & set(range(200))) >= 188 and not set(seen[0]) & set(range(200, 240))
    assert set(seen[1]) == set(seen[0])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_pieces(packed, seen[2], Tokenizer.from_file(WORD))


def test_pipeline_stages_of_empty_tables_and_repeated_ids(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (None, None, None, None, None), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, schema)
    assert corpus_pipeline.classify(spark, docs, str(tmp_path)).count() == 4  # no labels: everything stays
    assert corpus_pipeline.dedup_lines(spark, docs, str(tmp_path)).count() == 4
    assert sorted(r["doc_id"] or 0 for r in corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path)).collect()) == [0, 1, 2]


def test_registered_queries():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]
    assert set(queries.oracle_sql()) <= set(names)


def test_frequent_ids_are_spread_in_order(spark):
    """A missing id, or one that repeats, has ranges to itself; ranges follow ids and texts."""
    from storyline.llm.common import NO_ID, ranged

    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i:05}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for falling in (False, True):
        found = ranged(df, 12, falling=falling).collect()
        sizes = Counter(r["_range"] for r in found)
        # the first range is for ids before the first bound: there are none
        assert len(sizes) >= 11 and max(sizes.values()) <= 2 * 6000 / 12
        order = sorted(sorted(found, key=lambda r: r["text"], reverse=falling), key=lambda r: r["_id"])
        assert [r["_range"] for r in order] == sorted(sizes.elements())
        assert all((r["_id"] == NO_ID) == (r["doc_id"] is None) and (r["_begin"] is not None) == (r["doc_id"] in (None, 7)) for r in found)
    assert ranged(df.limit(0), 4).collect() == []


def test_results_over_many_ranges_of_frequent_ids(spark):
    """Files, pieces and neighbours are whole where most ids are missing or repeat."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"A text of number {i}, with some words that fill it. " * (1 + i % 5)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    library, words = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    found = sorted(token_files.token_file_digest(docs, BYTE).collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"]) for r in found) == Counter((i, len(library.encode(t, add_special_tokens=False).ids) + 1) for i, t in rows)
    assert [r["start"] for r in found] == [0, *np.cumsum([r["n_tokens"] for r in found]).tolist()][:-1]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in found]
    assert ids == sorted(ids)
    pieces = packing.packed(docs, WORD).collect()
    assert sum(r["length"] for r in pieces) == sum(len(words.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
    held = Counter()
    for r in pieces:
        held[r["sequence_id"]] += r["length"]
    assert max(held.values()) <= 2048
    near = fingerprints.compared(docs).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in near) == Counter((i, len(t)) for i, t in rows)
    # the next document: the next by falling ids, then rising texts
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -99), r[1]))
    after = [fingerprints.edited(x[1], order[(i + 1) % len(order)][1]) for i, x in enumerate(order)]
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in near) == Counter((x[0], hashlib.sha256(t.encode()).hexdigest()) for x, t in zip(order, after, strict=True))
