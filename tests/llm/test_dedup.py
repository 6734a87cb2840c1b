import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from hushframe.llm import embedding_dedup, minhash_dedup, substring_dedup
from hushframe.llm.components import components
from tests.llm.fixtures import documents, rows


def find_all(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_random_graphs(spark):
    pick = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(pick.randrange(200, 260), pick.randrange(200, 260)) for _ in range(45)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {n: c for n, c in find_all(edges, {x for e in edges for x in e}).items() if n != c}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# Substrings. -----------------------------------------------------------------------------------------------------------------


def brute_substrings(data, length):
    count = Counter(t[i : i + length] for _, text in data for t in [(text or "").encode()] for i in range(len(t) - length + 1))
    out = []
    for doc_id, text in data:
        t = (text or "").encode()
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                cover[i : i + length] = b"\x01" * length
        runs = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        kept = bytes(b for b, c in zip(t, cover) if not c)
        out.append((doc_id, len(t), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def passages(seed=4):
    pick = random.Random(seed)
    make = lambda n: "".join(pick.choice("abcdefgh éß中 \n") for _ in range(n))
    shared, other = make(300), make(120)
    out = [(i, make(pick.randrange(0, 300)) + shared[pick.randrange(60) : 300 - pick.randrange(60)] + make(pick.randrange(0, 200))) for i in range(25)]
    out += [(30, shared), (31, shared), (32, shared[:-1] + "x"), (33, "x" + shared[1:150] + "!" + shared[151:]), (34, None), (35, ""), (36, "ab" * 300), (37, "a" * 500), (38, make(80) + "ab" * 70)]
    out += [(39, make(50) + other + make(50) + other), (40, out[3][1]), (41, out[3][1]), (41, out[3][1]), (None, shared[20:]), (42, other[:64]), (43, other[:63]), (44, make(64))]
    return out


@pytest.mark.parametrize(("length", "chunk"), [(64, 1 << 20), (100, 256)])
def test_substrings_against_brute_force(spark, monkeypatch, length, chunk):
    data = passages()
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    for doc_id, text in data:  # the ranges of a text hold each of its strings once, however it is cut in chunks
        m, near, far, _, _ = substring_dedup.ranges(substring_dedup.Bytes(text or ""), length)
        starts = sorted(p - k for p, a, b in zip(m, near, far) for k in range(a, b + 1))
        assert starts == list(range(max(0, len((text or "").encode()) - length + 1)))
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in data], "doc_id long, text string, spans string, n_chars long")
    got = Counter(tuple(r) for r in substring_dedup.digests(docs, length).collect())
    assert got == brute_substrings(data, length)


def brute_passages(data, length):
    """Texts without the words covered by a run of so many words that another document holds too."""
    holders = defaultdict(set)
    for doc in set(data):
        words = (doc[1] or "").split()
        for i in range(len(words) - length + 1):
            holders[tuple(words[i : i + length])].add(doc)
    out = []
    for doc_id, text in data:
        words, cover = (text or "").split(), set()
        for i in range(len(words) - length + 1):
            if len(holders[tuple(words[i : i + length])]) > 1:
                cover.update(range(i, i + length))
        out.append((doc_id, [w for i, w in enumerate(words) if i not in cover]))
    return Counter((i, tuple(w)) for i, w in out)


def test_passages_against_brute_force(spark):
    pick = random.Random(12)
    vocabulary = [pick.choice("abcdefghij中é") * pick.randrange(1, 4) + str(pick.randrange(40)) for _ in range(300)]
    make = lambda n: [pick.choice(vocabulary) for _ in range(n)]
    shared, own = make(70), make(60)
    data = [(k, make(pick.randrange(0, 90)) + shared[: pick.randrange(45, 71)] + make(pick.randrange(0, 60))) for k in range(20)]
    data += [(50, own + make(5) + own), (51, own + make(9) + own + own[:20]), (52, shared[:49]), (53, shared[:50]), (54, shared[3:]), (55, make(300)), (56, ["w"] * 200), (57, make(40) + shared[10:65] + make(20) + own[:49])]
    data = [(i, " ".join(w[:7]) + " \n" + "  ".join(w[7:])) for i, w in data] + [(58, None), (59, ""), (60, " \t\n"), (None, " ".join(shared))]
    data.append(data[3])  # a repeated row is the same document
    data.append((70, "only " + " ".join(own[:50])))
    docs = spark.createDataFrame([(i, t, "x", 3, 1) for i, t in data], "doc_id long, text string, spans string, n_chars long, c0 int")
    out = substring_dedup.keep_unrepeated(docs, 50, substring_dedup.Words, across=True)
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter((r.doc_id, tuple(r.text.split())) for r in got) == brute_passages(data, 50)
    assert {(r.spans, r.c0) for r in got} == {("x", 1)} and all(r.n_chars == len(r.text) for r in got)
    untouched = {i: t for i, t in data if i in (52, 55, 56, 60)}
    assert all(r.text == untouched[r.doc_id] for r in got if r.doc_id in untouched)


def test_repeated_400_byte_strings_against_brute_force(spark):
    pick = random.Random(31)
    make = lambda n: "".join(pick.choice("abcdefgh é中 \n") for _ in range(n))
    shared = make(900)
    data = [(i, make(pick.randrange(0, 500)) + shared[pick.randrange(300) : 900 - pick.randrange(300)] + make(pick.randrange(0, 300))) for i in range(14)]
    cut = next(n for n in range(len(shared)) if len(shared[:n].encode()) >= 400)
    data += [(20, shared), (21, shared[:cut]), (22, shared[1:cut]), (23, "ab" * 900), (24, "\x00" * 1000), (25, "z" + shared[:450] + "!" + shared[451:]), (26, "thue" * 99), (27, data[2][1]), (27, data[2][1])]
    docs = spark.createDataFrame([(i, t) for i, t in data], "doc_id long, text string")
    assert Counter(tuple(r) for r in substring_dedup.digests(docs).collect()) == brute_substrings(data, 400)


def test_substring_stage_keeps_rows_and_columns(spark):
    docs = documents(spark)
    out = substring_dedup.keep_unrepeated(docs, 64)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert substring_dedup.digests(documents(spark, []), 64).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.repeats(docs, 16)


# Embeddings. -----------------------------------------------------------------------------------------------------------------


def vectors():
    make = np.random.default_rng(8)
    out, n = [], 0
    for _ in range(40):
        base = make.standard_normal(16)
        for _ in range(int(make.integers(1, 9))):
            out.append((n, [float(np.float32(x)) for x in base + make.standard_normal(16) * 0.045], int(make.integers(0, 2))))
            n += 1
    out += [(n, out[0][1], out[0][2]), (n + 1, out[0][1], out[0][2]), (n + 1, out[0][1], out[0][2]), (n + 2, [2 * x for x in out[0][1]], out[0][2])]
    n += 3
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0]]
    return out + [(n + k, v, 1) for k, v in enumerate(odd)] + [(n + 20, out[0][1], None)]


@pytest.mark.parametrize("block", [4, 512])
def test_embeddings_against_brute_force(spark, block):
    data = vectors()
    frame = spark.createDataFrame([(*v, 0.5) for v in data], "vec_id long, embedding array<float>, label int, weight double")
    got = Counter(tuple(r) for r in embedding_dedup.near_duplicates(frame, block=block).collect())
    good = [k for k, (_, v, label) in enumerate(data) if label is not None and v and None not in v and all(math.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(data[k][1]) / np.linalg.norm(data[k][1]) for k in good}
    links = [(a, b) for a in good for b in good if a < b and data[a][2] == data[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    n = Counter(x for pair in links for x in pair)
    root = find_all(links, range(len(data)))
    least = {}
    for k, r in root.items():
        least[r] = min(least.get(r, data[k][0]), data[k][0])
    want = Counter((data[k][0], n[k], least[root[k]], data[k][0] == least[root[k]]) for k in range(len(data)))
    assert got == want
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_one_projection_agrees_as_often_as_the_theory_says():
    make = np.random.default_rng(3)
    a = make.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = a + make.standard_normal(a.shape) * 0.025
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = (a * b).sum(1) >= 0.98
    hit = (embedding_dedup.keys_of(a) == embedding_dedup.keys_of(b)).any(1)
    assert near.sum() > 500 and hit[near].mean() > 0.999


# MinHash. --------------------------------------------------------------------------------------------------------------------


def variants(seed=6):
    pick = random.Random(seed)
    vocabulary = ["".join(pick.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    out, n = [], 0
    for _ in range(12):
        words = [pick.choice(vocabulary) for _ in range(pick.randrange(60, 160))]
        for _ in range(pick.randrange(1, 12)):
            copy = list(words)
            for _ in range(pick.randrange(0, 5)):
                copy[pick.randrange(len(copy))] = pick.choice(vocabulary)
            out.append((n, " ".join(copy)))
            n += 1
    loop = "one two three four five six "
    out += [(n, loop * 30), (n + 1, loop * 33), (n + 2, loop * 60), (n + 3, "a b c"), (n + 4, "a  b\nc"), (n + 5, "a b d"), (n + 6, ""), (n + 7, None), (n + 8, " \n"), (n + 9, out[0][1]), (n + 9, out[0][1]), (None, out[0][1] + " ")]
    return out


def brute_bag(text):
    words = (text or "").split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


@pytest.mark.parametrize(("block", "star"), [(3, 2), (128, 256)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, block, star):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    monkeypatch.setattr(minhash_dedup, "STAR", star)
    data = variants()
    bags = [brute_bag(t) for _, t in data]
    links = []
    for a in range(len(data)):
        for b in range(a):
            both = sum((bags[a] & bags[b]).values())
            if both and both * 5 >= 4 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                links.append((b, a))
    root = find_all(links, range(len(data)))
    groups = defaultdict(list)
    for k, r in root.items():
        groups[r].append(data[k][0])
    docs = spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in data], "doc_id long, text string, key string, bands string, n_chars long, node int")
    got = minhash_dedup.near_duplicates(docs).collect()
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    want = Counter((data[k][0], least[r], len(groups[r])) for k, r in root.items())
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    stay = minhash_dedup.keep_first(docs)
    assert stay.columns == docs.columns and Counter(r.doc_id for r in stay.collect()) == Counter(least.values())


def test_signature_agreement_is_the_weighted_similarity():
    make = np.random.default_rng(5)
    errors = []
    for _ in range(60):
        keys = make.integers(1, 1 << 62, 80).astype(np.uint64)
        a, b = (make.integers(0, 9, 80) * make.integers(0, 2, 80) for _ in range(2))
        a[:10], b[:10] = 40, make.integers(30, 50, 10)
        pair = [(keys[w > 0], w[w > 0]) for w in (a, b)]
        s = minhash_dedup.signatures(pair, 400)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_near_duplicates_of_nothing(spark):
    assert minhash_dedup.near_duplicates(documents(spark, [])).count() == minhash_dedup.keep_first(documents(spark, [])).count() == 0
    assert len(rows()) == minhash_dedup.near_duplicates(documents(spark)).count()


def test_components_of_hubs_chains_and_repeats(spark):
    from hushframe.llm.components import components

    rng = random.Random(8)
    pairs = [(500, k) for k in range(501, 900)] + [(k, k + 1) for k in range(1000, 1040)] + [(7, 7), (3, 9), (9, 3), (3, 9), (None, 4)] + [(rng.randint(2000, 2060), rng.randint(2000, 2060)) for _ in range(40)]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in pairs:
        if u is not None:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
