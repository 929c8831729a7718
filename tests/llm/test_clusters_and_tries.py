import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import clustering, covering, prefix_trie
from quire.llm.jaccard_join import components

# --- op13 ------------------------------------------------------------------------------------------


def brute_clusters(rows, clusters, rounds, dimensions):
    kept = [(i, [int(np.floor(1024 * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == dimensions and all(c is not None and np.isfinite(c) for c in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    x = np.array([v for _, v in kept], np.int64)
    centroids = x[:clusters].copy()
    nearest = lambda: np.array([((x - c) ** 2).sum(1) for c in centroids])
    for _ in range(rounds):
        own = nearest().argmin(0)
        centroids = np.array([x[own == j].sum(0) // (own == j).sum() if (own == j).any() else centroids[j] for j in range(len(centroids))])
    d = nearest()
    own, far = d.argmin(0), d.min(0)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return [(i, int(own[n]), int(far[n]), int(far[own == own[n]].sum()), int(far.sum()), sha[own[n]]) for n, (i, _) in enumerate(kept)]


def vectors(seed, n, dimensions, whole):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, dimensions)) * 3
    rows = []
    for i in range(n):
        v = middles[rng.integers(12)] + rng.normal(size=dimensions) * rng.choice([0.1, 1.0])
        rows.append((i, [float(np.float32(round(c) / 1024 if whole else c)) for c in v]))
    odd = [(-1, None), (-2, []), (-3, [1.0] * (dimensions - 1)), (-4, [float("nan")] + [0.0] * (dimensions - 1)), (-5, [float("inf")] * dimensions), (-6, [None] + [0.0] * (dimensions - 1)), (None, [0.5] * dimensions), (7, rows[7][1]), (7, [0.25] * dimensions)]
    return rows + odd + [(10_000 + i, [1.5] * dimensions) for i in range(n // 3)]


def clustered(spark, rows, clusters, rounds, dimensions, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, cluster string, distance int").repartition(5)
    out = clustering.cluster_vectors(df, clusters=clusters, rounds=rounds, dimensions=dimensions, **how).collect()
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize(("clusters", "dimensions", "whole"), [(8, 6, False), (20, 3, True), (1, 4, False)])
def test_clusters_equal_plain_rounds(spark, clusters, dimensions, whole):
    rows = vectors(clusters, 400, dimensions, whole)  # small whole numbers give many ties
    assert clustered(spark, rows, clusters, 10, dimensions) == sorted(brute_clusters(rows, clusters, 10, dimensions), key=repr)


@pytest.mark.parametrize("stored", [1, 19])
def test_clusters_with_few_and_all_bounds(spark, stored):
    rows = vectors(5, 300, 4, False)
    assert clustered(spark, rows, 20, 6, 4, stored=stored) == sorted(brute_clusters(rows, 20, 6, 4), key=repr)


def test_clusters_of_few_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [4.0, 5.0])]
    assert clustered(spark, rows, 8, 3, 2) == sorted(brute_clusters(rows, 8, 3, 2), key=repr)
    assert clustered(spark, [(1, None)], 8, 3, 2) == [] and clustered(spark, [], 8, 3, 2) == []


def test_bounds_spare_distances():
    """After the first rounds most vectors are certified without a look, and every assignment is exact."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-3000, 3000, 8) * 10 + rng.integers(-900, 900, (300, 8)) for _ in range(24)]).astype(np.int64)
    centroids = x[:: len(x) // 24][:24].copy()
    state = clustering.Bounds.scanned(x, centroids, 6)
    doubts = []
    for _ in range(12):
        then = np.array([x[state.cluster == j].sum(0) // max(1, (state.cluster == j).sum()) for j in range(len(centroids))])
        moved = np.sqrt(((then - centroids) ** 2).sum(1)) * (1 + 1e-9)
        centroids = then
        state.move(moved, 6)
        doubts.append(int((state.upper >= np.minimum(state.lower.min(1), state.rest)).sum()))
        state.settle(x, centroids, 6)
        d = clustering.distances(x, centroids)
        assert (state.cluster == d.argmin(1)).all()
        root = np.sqrt(d)
        assert (state.upper >= root[np.arange(len(x)), state.cluster]).all() and (state.lower <= np.take_along_axis(root, state.near.astype(int), 1)).all()
    assert doubts[-1] < len(x) / 4


# --- op12 ------------------------------------------------------------------------------------------


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        full[c] = own.get(base, [])[:h] + v[h:]
    members, kids = defaultdict(list), defaultdict(set)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
            if d:
                kids[tuple(v[: d - 1])].add(tuple(v[:d]))
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(full[c]) == len(p)).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], ends(p)) for p, m in members.items()), key=repr)


TURNS = "conv_id long, turn long, role string, text string"


def tried(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], f"{TURNS}, depth string, n_convs int").repartition(5)
    return sorted(map(tuple, prefix_trie.trie(df).collect()), key=repr)


def odd_turns():
    rng = random.Random(2)
    rows = []
    for c in [*range(-45, 60), None]:
        for i in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([None, i, i]), rng.choice(["user", None]), rng.choice(["a b", "c", "", None, " \t"])))
    return rows + [(c, i, "user", "the same") for c in range(100, 400) for i in range(3)] + rows[:20]


def test_trie_equals_plain(spark):
    rows = odd_turns()
    assert tried(spark, rows) == brute_trie(rows)


def test_trie_of_long_conversations(spark, monkeypatch):
    """Conversations that agree for hundreds of turns, over several bands and rounds, and a very long text."""
    monkeypatch.setattr(prefix_trie, "BAND_BITS", 5)
    said = [("user", f"turn {i}") for i in range(500)]
    rows = [(c, i, *said[i]) for c, n in ((20, 480), (21, 480), (22, 500), (43, 300)) for i in range(n)]
    rows += [(22, 500, "user", "word " * 200_000), (23, 0, None, "alone")]
    assert tried(spark, rows) == brute_trie(rows)


def test_trie_of_one_and_none(spark):
    assert tried(spark, []) == [] and tried(spark, [(None, 1, "a", "b")]) == []
    assert tried(spark, [(3, 0, "user", "x y")]) == brute_trie([(3, 0, "user", "x y")])


# --- op11 ------------------------------------------------------------------------------------------


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    made = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in made]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_links(prints, radius):
    """Least of the class for each distinct fingerprint."""
    distinct = sorted(set(prints))
    x = np.array(distinct, np.int64).view(np.uint64)
    parent = list(range(len(x)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(x)):
        for j in (np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1 :]) <= radius) + i + 1).tolist():
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return {p: distinct[find(i)] for i, p in enumerate(distinct)}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("radius", [2, 4])
def test_covering_misses_no_pair(radius):
    masks = covering.covering(list(range(64)), radius)
    rng = random.Random(4)
    for _ in range(3000):
        apart = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not m & apart for m in masks)
    assert all(26 <= m.bit_count() <= 38 for m in masks)


def test_fingerprints_equal_plain(odd_docs):
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    got = {r["doc_id"]: r["print"] for r in covering.fingerprints(odd_docs).collect()}
    assert got == {i: signed(plain_print(t)) for i, t in texts.items()}
    long = " ".join(f"W{i % 9999}É" for i in range(300_000))  # over a piece
    assert covering.fingerprint(long.encode()) == plain_print(long)


@pytest.mark.parametrize("full", [256, 16])
def test_classes_of_crowded_buckets(spark, full):
    """Fingerprints that crowd on few bits, beside chains and loners; small buckets make every way of splitting work."""
    rng = random.Random(full)
    prints = {0}
    base = rng.getrandbits(64)
    for _ in range(700):
        x = base
        for b in rng.sample(range(18), rng.randrange(9)):
            x ^= 1 << b
        prints.add(x)
    for _ in range(40):
        x = rng.getrandbits(64)
        prints.add(x)
        for b in rng.sample(range(64), 5 if rng.random() < 0.5 else 4):
            x ^= 1 << b
        prints.add(x)
    prints = [signed(x) for x in prints]
    links = covering.near_links(spark.createDataFrame([(x,) for x in prints], "print long").repartition(4), 4, full)
    assert links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 4).isEmpty()
    labels = {r["node"]: r["label"] for r in components(links).collect()}
    assert {p: labels.get(p, p) for p in prints} == brute_links(prints, 4)


def test_simhash_of_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    prints = [signed(plain_print(r["text"])) for r in rows]
    of = brute_links(prints, 4)
    least = {}
    for r, p in zip(rows, prints, strict=True):
        if r["doc_id"] is not None:
            least[of[p]] = min(least.get(of[p], r["doc_id"]), r["doc_id"])
    want = sorted(((r["doc_id"], f"{p & (1 << 64) - 1:016x}", least.get(of[p])) for r, p in zip(rows, prints, strict=True)), key=repr)
    assert sorted(map(tuple, covering.simhash_classes(odd_docs).collect()), key=repr) == want
    assert covering.simhash_classes(no_docs).count() == 0
