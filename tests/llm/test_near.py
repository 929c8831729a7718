import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from quire.llm import jaccard_join as J
from quire.llm import minhash
from quire.llm.shingles import shingle_sets, shingles


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))


def true_set(text, k):
    w = words(text or "")
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def similar(a, b, percent):
    """percent: a whole number, or a share of two."""
    low, high = percent if isinstance(percent, tuple) else (percent, 100)
    both = len(a & b)
    return bool(a) and bool(b) and high * both >= low * (len(a) + len(b) - both)


def brute_classes(rows, k, percent):
    sets = {i: true_set(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if similar(sets[i], sets[j], percent):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i in ids:
        least[find(i)].append(i)
    return {i: (len(sets[i]), min(v)) for v in least.values() for i in v}


def near_copies(seed, groups=6, each=25, length=60):
    """Groups of copies with a few edits each, at and around the threshold, beside shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(each):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(w))
    rows += [" ".join([*passage, *[rng.choice(vocabulary) for _ in range(rng.randrange(3, 30))]]) for _ in range(40)]
    rows += ["", None, "One", "one", "one two three", "ONE two  three", "a b c d"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed, least", [(1, 64), (2, 4), (3, 2)])
def test_join_against_brute_force(spark, monkeypatch, seed, least):
    monkeypatch.setattr(J, "LEAST_FREQUENT", least)
    monkeypatch.setattr(J.frequent_tokens, "__defaults__", (least, J.MAX_FREQUENT))
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.link_classes(docs, k=4, threshold=0.85).collect()}
    assert got == brute_classes(rows, 4, 85)


def test_join_with_few_frequent_tokens_allowed(spark, monkeypatch):
    monkeypatch.setattr(J.frequent_tokens, "__defaults__", (2, 5))
    rows = near_copies(7, groups=3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.link_classes(docs, k=5, threshold=0.8).collect()} == brute_classes(rows, 5, 80)


@pytest.mark.parametrize("share", [(4, 5), (17, 20), (1, 2), (3, 10)])
def test_similar_sets_share_a_key(share):
    """Any mix of rare and frequent tokens, short and long sets."""
    rng, scheme, met = np.random.default_rng(3), J.PREFIX_COMBINATIONS(share), 0
    for _ in range(1500):
        n = int(rng.integers(1, rng.choice([8, 40, 300])))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * 2)
        lost = int(rng.integers(0, len(a) * (share[1] - share[0]) // share[1] + 2))
        kept = a[rng.permutation(len(a))[: max(0, len(a) - lost)]]
        b = np.unique(np.concatenate([kept, rng.integers(0, 2**63, int(rng.integers(0, lost + 2))).astype(np.uint64)]))
        if not len(b) or np.array_equal(a, b) or not J.reaches(a, b, share):
            continue
        both = np.union1d(a, b)
        often = np.unique(both[rng.random(len(both)) < rng.choice([0.3, 0.8, 0.95, 1, 1])] >> np.uint64(20))
        kinds = (often % np.uint64(5)).astype(np.uint8)
        met += 1
        assert len(np.intersect1d(scheme.keys(a, often, kinds, 44)[2], scheme.keys(b, often, kinds, 44)[2]))
    assert met > 300


def test_keys_grow_with_the_length_only():
    rng = np.random.default_rng(4)
    for n in (30, 300, 3_000, 300_000):
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * 2)
        often = np.unique(s >> np.uint64(20))
        for share in ((4, 5), (17, 20)):
            assert len(J.PREFIX_COMBINATIONS(share).keys(s, often, np.zeros(len(often), np.uint8), 44)[2]) <= 2 * n


def test_long_near_copies(spark):
    """Eighty near copies of a long text, all of whose shingles are frequent."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(6_000)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(20):
            w[rng.randrange(len(w))] = f"e{i}x{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([*rows, (99, " ".join(base[:3_000]))], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in J.link_classes(docs, k=5, threshold=0.8).collect()}
    assert got == {i: 0 for i in range(80)} | {99: 99}


def test_join_of_odd_rows(odd_docs, no_docs):
    got = J.link_classes(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 4)} == {1}
    assert J.link_classes(no_docs).count() == 0


def test_thresholds_are_taken_as_written(spark, monkeypatch):
    """Low ones, where one shared token is enough, and ones between whole percents."""
    assert J.share_of(0.855) == (171, 200) and J.share_of(1) == (1, 1)
    monkeypatch.setattr(J.frequent_tokens, "__defaults__", (2, J.MAX_FREQUENT))
    rng = random.Random(11)
    small = [" ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(1, 5))) for _ in range(25)] + ["solo", "solo pair", "pair solo third"]
    long = [f"x{i}" for i in range(200)]
    long_rows = [" ".join([*long[: 200 - cut], *[f"e{cut}_{i}" for i in range(cut)]]) for cut in (0, 14, 15, 16, 17, 30)]
    for texts, k, threshold, share in ((small, 1, 0.5, (1, 2)), (small, 1, 0.3, (3, 10)), (long_rows, 1, 0.855, (171, 200)), (long_rows, 1, 0.86, (43, 50))):
        rows = list(enumerate(texts))
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.link_classes(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), k=k, threshold=threshold).collect()}
        assert got == brute_classes(rows, k, share)


def test_rows_without_ids_and_with_one_id(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda x: " ".join([*base[:-1], x])
    far = " ".join(f"v{i}" for i in range(60))
    docs = spark.createDataFrame([(None, near("a")), (None, near("b")), (7, far), (7, near("c")), (9, far + " more"), (None, "nothing like it at all"), (3, None), (3, "")], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"] or 0) for r in J.link_classes(docs, k=4, threshold=0.85).collect())
    assert got == [(False, 3, 3), (False, 3, 3), (False, 7, 7), (False, 7, 7), (False, 9, 7), (True, 0, 0), (True, 0, 7), (True, 0, 7)]
    kept = Counter(r["text"] for r in J.remove_near_duplicates(docs, k=4, threshold=0.85).collect())
    assert kept == Counter([near("c"), far, "nothing like it at all", None, ""])
    without = J.remove_near_duplicates(docs.where("doc_id is null"), k=4, threshold=0.85).collect()
    assert len(without) == 2


def test_counts_of_a_bounded_number_of_tokens(spark, monkeypatch):
    rows = near_copies(13, groups=3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for held in (50, J.MOST_HELD):
        for range_bits in (7, 9):
            texts = pa.RecordBatch.from_pylist([{"doc_id": i, "row_key": i, "text": t or ""} for i, t in rows])
            monkeypatch.setattr(J, "MOST_HELD", held)
            out = [b for b in J._profile(4, 0, 40, range_bits, True)(iter([texts.slice(0, 60), texts.slice(60)])) if b.column("token_range").null_count == 0]
            found = Counter()
            for b in out:
                for r in b.to_pylist():
                    tokens = J.unpacked(r["tokens"])
                    assert set((tokens >> np.uint64(40 - range_bits)).tolist()) == {r["token_range"]}
                    for t, c in zip(tokens.tolist(), np.frombuffer(zstandard.decompress(r["counts"]), "<u4").tolist(), strict=True):
                        found[t] += c
            true = Counter(t for s in {frozenset((s >> np.uint64(24)).tolist()) for s in shingle_sets(pa.array([t or "" for _, t in rows]), 4)} for t in s)
            assert found == true if held > 50 else set(found) == set(true)
    monkeypatch.setattr(J, "MOST_HELD", 50)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.link_classes(docs).collect()} == brute_classes(rows, 4, 85)


def test_bounds_are_exact():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(2, 2000))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = a[rng.random(len(a)) < rng.choice([0.5, 0.9, 0.99])]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(1, 50))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        apart = len(a) + len(b) - 2 * both
        assert int(np.bitwise_count((J.sketch(a) ^ J.sketch(b)).view(np.uint64)).sum()) <= apart
        if 100 * both >= 85 * (len(a) + len(b) - both):
            assert J.may_reach(len(a), J.bitmap(a), len(b), J.bitmap(b), (17, 20))


@pytest.mark.parametrize("k", [1, 4, 5])
def test_shingles_are_true_to_words(k):
    texts = ["", " ", "A b c", "a B  c\t", "a b", "é É x y z q r", "x" * 3000, "w " * 500, "a b c d e f g a b c d e f g"]
    sets = shingle_sets(pa.array(texts), k)
    true = [true_set(t, k) for t in texts]
    assert [len(s) for s in sets] == [len(t) for t in true]
    for i, a in enumerate(true):
        for j, b in enumerate(true):
            assert len(np.intersect1d(sets[i], sets[j])) == len(a & b)
    _, at = shingles(pa.array(texts), k)
    assert np.diff(at).tolist() == [max(0, len(words(t)) - k + 1) or min(1, len(words(t))) for t in texts]


def test_fingerprints_estimate_similarity(spark, odd_docs, no_docs):
    rows = [(i, t or "") for i, t in near_copies(4)]
    got = {r["doc_id"]: r for r in minhash.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        e = minhash.edited(t, after)
        assert got[i]["n_chars"] == len(t)
        a, b, c = true_set(t, 5), true_set(e, 5), true_set(after, 5)
        for value, other in ((got[i]["near_edited"], b), (got[i]["near_next"], c)):
            true = len(a & other) / len(a | other) if a | other else 1.0
            assert abs(value - true) < 0.25
    assert minhash.compare_with_edits(odd_docs).count() == odd_docs.count()
    assert minhash.compare_with_edits(no_docs).count() == 0


def test_ranges_meet(spark, monkeypatch):
    rows = [(i * 7 % 1001, f"text {i}") for i in range(1001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    whole = {r["doc_id"]: r["edited_sha256"] for r in minhash.compare_with_edits(docs).collect()}
    monkeypatch.setattr(minhash.with_next_text, "__defaults__", ("doc_id", "text", 10))
    assert {r["doc_id"]: r["edited_sha256"] for r in minhash.compare_with_edits(docs).collect()} == whole


def test_bands_find_near_copies(spark):
    rows = near_copies(9, groups=3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, threshold=0.8).collect()}
    true = brute_classes(rows, 5, 80)
    assert sum(got[i] == true[i] for i in true) >= 0.98 * len(true)
