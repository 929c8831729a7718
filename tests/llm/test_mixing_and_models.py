import math
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import language_model as M
from quire.llm import mixing, toxicity
from quire.llm.boosting import Boosted, Isotonic


def test_targets_share_the_excess():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    t = mixing.targets([10, 1000, 1000], [5, 1, 1])
    assert t[0] == 30 and t[1] == t[2] == Fraction(1980, 2)
    assert mixing.targets([0, 0], [1, 2]) == [0, 0] and mixing.targets([], []) == []


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_tree_splits_quotas_exactly(shards):
    quotas = np.array([17, 0, 230, 5])
    out = mixing.split_quotas(quotas, shards, 3)
    assert out.sum(axis=0).tolist() == quotas.tolist() and out.sum(axis=1).max() - out.sum(axis=1).min() <= math.ceil(math.log2(shards)) + 1
    assert (out == mixing.split_quotas(quotas, shards, 3)).all()


def corpus(spark):
    rows = [(i, "w " * (5 + i * 37 % 60), [None, "b", "a", "c"][i % 4 if i % 3 else 1]) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def test_mix_comes_near_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 100)
    planned = mixing.plan_mix(corpus(spark)).collect()
    assert len(planned) == 400
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in planned:
        assert r["size"] == len(r["text"].split()) and len(r["draws"]) <= 3
        taken[r["source"]] += r["size"] * len(r["draws"])
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        assert len({d["epoch"] for d in r["draws"]}) == len(r["draws"])
    order = ["a", "b", "c", None]
    assert [round(target[s], 3) for s in order] == [round(float(t), 3) for t in mixing.targets([size[s] for s in order], [1, 2, 3, 1])]
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in order)
    again = {(r["doc_id"], str(r["draws"])) for r in mixing.plan_mix(corpus(spark).repartition(7)).collect()}
    assert again == {(r["doc_id"], str(r["draws"])) for r in planned}
    mixed = mixing.mix(corpus(spark)).collect()
    assert Counter(r["doc_id"] for r in mixed) == Counter({r["doc_id"]: len(r["draws"]) for r in planned if r["draws"]})


def test_mix_fills_the_room_of_a_long_document(spark, monkeypatch):
    """The target's end falls on a document longer than many blocks, and those after it do not fill the room."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 100)
    for long_id in (1000, 1001, 1002, 1003):
        rows = [(long_id, "w " * 2000, "a"), *[(i, "w " * 5, "a") for i in range(800)], *[(i, "w " * 5, "b") for i in range(2000, 2800)]]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        mixed = mixing.plan_mix(docs).where("source = 'a'").agg(F.sum(F.col("size") * F.size("draws")).alias("taken"), F.first("target").alias("target")).first()
        assert abs(mixed["taken"] - mixed["target"]) <= 5


def test_mix_of_odd_rows(odd_docs, no_docs):
    assert mixing.plan_mix(odd_docs).count() == odd_docs.count()
    assert mixing.mix(odd_docs).where("source = 'c'").count() >= 1
    assert mixing.plan_mix(no_docs).count() == mixing.mix(no_docs).count() == 0
    own = ["_source", "_hash", "_block", "_d", "_key", "_sub", "_row", "_part", "size", "target", "epoch", "shard"]
    clash = odd_docs.withColumns({n: F.lit("mine") for n in own})
    mixed = mixing.mix(clash, places=False)
    assert mixed.columns == clash.columns and {tuple(r[0]) for r in mixed.select(F.array_distinct(F.array(*own))).collect()} == {("mine",)}
    planned = mixing.plan_mix(clash)
    assert {tuple(r[0]) for r in planned.select(F.array_distinct(F.array(*own[:8]))).collect()} == {("mine",)} and dict(planned.dtypes)["size"] == "bigint"


def test_more_sources_than_the_driver_holds_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    with pytest.raises(ValueError, match="sources"):
        mixing.plan_mix(corpus(spark))


def brute_probability(texts, text):
    """Interpolated modified Kneser-Ney over 4-grams, by dictionaries."""
    code = lambda t: list(t.encode())
    counts = {4: Counter()}
    for t in texts:
        c = [255, 255, 255, *code(t)]
        counts[4].update(tuple(c[i : i + 4]) for i in range(len(c) - 3))
    for o in (3, 2, 1):
        counts[o] = Counter(g[1:] for g in counts[o + 1])
    d = {o: (0.0, *M.discounts(*[sum(v == k for v in counts[o].values()) for k in (1, 2, 3, 4)])) for o in counts}
    totals, freed = defaultdict(float), defaultdict(float)
    for o in counts:
        for g, n in counts[o].items():
            totals[o, g[:-1]] += n
            freed[o, g[:-1]] += d[o][min(n, 3)]

    def p(g):
        o = len(g)
        lower = p(g[1:]) if o > 1 else 1 / 256
        if not totals[o, g[:-1]]:
            return lower
        n = counts[o][g]
        return (n - d[o][min(n, 3)] + freed[o, g[:-1]] * lower) / totals[o, g[:-1]]

    c = [255, 255, 255, *code(text)]
    return sum(math.log(p(tuple(c[i : i + 4]))) for i in range(len(c) - 3))


@pytest.mark.parametrize("rows_a_shard", [2_000_000, 40])
def test_model_against_brute_force(spark, monkeypatch, rows_a_shard):
    monkeypatch.setattr(M, "SHARD_ROWS", rows_a_shard)
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "é ü 日本", "x"]
    docs = spark.createDataFrame([(False, "en", t) for t in texts], "calibrates boolean, lang string, text string").repartition(2)
    model = M.train(docs.mapInArrow(M._count, "gram long, c long, lang string, text string").select("gram", "c"))
    assert (model.n_shards > 1) is (rows_a_shard == 40)
    asked = [*texts, "the mat sat", "zzz", "", None, "日"]
    got = M.add_log_probability(spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "i int, text string"), model).orderBy("i").collect()
    for r, t in zip(got, asked, strict=True):
        assert r["_lm"] == pytest.approx(brute_probability(texts, t or ""), abs=len((t or "").encode()) / M.STEPS)


@pytest.mark.parametrize("rows_a_shard", [2_000_000, 60])
def test_model_of_six_against_brute_force(spark, monkeypatch, rows_a_shard):
    monkeypatch.setattr(M, "SHARD_ROWS", rows_a_shard)
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "é ü 日本", "x"]
    code = lambda t: [255] * 5 + list(t.encode())
    counts = {6: Counter(tuple(c[i : i + 6]) for c in map(code, texts) for i in range(len(c) - 5))}
    for o in range(5, 0, -1):
        counts[o] = Counter(g[1:] for g in counts[o + 1])
    d = {o: (0.0, *M.discounts(*[sum(v == k for v in counts[o].values()) for k in (1, 2, 3, 4)])) for o in counts}

    def p(g):
        same = [n for h, n in counts[len(g)].items() if h[:-1] == g[:-1]]
        lower, off = p(g[1:]) if len(g) > 1 else 1 / 256, d[len(g)]
        n = counts[len(g)][g]
        return (n - off[min(n, 3)] + sum(off[min(m, 3)] for m in same) * lower) / sum(same) if same else lower

    docs = spark.createDataFrame([(False, "en", t) for t in texts], "calibrates boolean, lang string, text string").repartition(2)
    model = M.train(docs.mapInArrow(lambda b: M._count(b, 6), "gram long, c long, lang string, text string").select("gram", "c"), 6)
    assert (model.n_shards > 1) is (rows_a_shard == 60)
    asked = [*texts, "the mat sat", "zzz", "", None, "日"]
    got = M.add_log_probability(spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "i int, text string").coalesce(1), model).orderBy("i").collect()
    for r, c in zip(got, [code(t or "") for t in asked], strict=True):
        assert r["_lm"] == pytest.approx(sum(math.log(p(tuple(c[i : i + 6]))) for i in range(len(c) - 5)), abs=len(c) / M.STEPS)


def test_classifier_rejects_a_repeated_word(spark):
    """Each run of four characters in it is common in good text, runs of six are not."""
    rng = np.random.default_rng(3)
    vocabulary = ["theory", "thesis", "thermal", "bathe", "lathe", "soothe", "a"]
    good = [(i, " ".join(rng.choice(vocabulary, 60)), "en") for i in range(400)]
    docs = spark.createDataFrame([*good, (1000, "the " * 300, "en")], "doc_id long, text string, lang string")
    scored = M.classify(docs, M.fit(docs, spark.range(400).toDF("id")))
    assert not scored.where("doc_id = 1000").first()["kept"] and scored.where("doc_id < 1000 and kept").count() >= 380


def test_classifier_rejects_what_is_strange(spark, odd_docs, no_docs):
    rng = np.random.default_rng(2)
    vocabulary = ["the", "cat", "dog", "sat", "on", "a", "mat", "ran", "far", "away"]
    good = [(i, " ".join(rng.choice(vocabulary, 60)), "en") for i in range(300)]
    bad = [(1000 + i, " ".join("!#%&*@QXZ"[j % 9] * 3 for j in range(60)), "en") for i in range(20)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    c = M.fit(docs, spark.range(200).toDF("id"))
    kept = {r["doc_id"]: r["kept"] for r in M.classify(docs, c).collect()}
    assert not any(kept[i] for i, _, _ in bad) and sum(kept[i] for i, _, _ in good) >= 295
    assert M.classify(odd_docs, c).count() == odd_docs.count() and M.classify(no_docs, c).count() == 0
    clash = odd_docs.withColumns({n: F.lit("mine") for n in ("_lm", "_mean", "_lang_key", "_threshold", "lang_key", "mean", "chunk")})
    assert {r[0] for r in M.classify(clash, c).select(F.array("_lm", "_mean", "_lang_key", "_threshold", "lang_key", "mean", "chunk").cast("string")).collect()} == {"[" + ", ".join(["mine"] * 7) + "]"}
    none = M.fit(docs, spark.range(0).toDF("id"))
    assert M.classify(docs, none).where("kept").count() == docs.count()


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.6) & (x[:, 1] < 0.5)).astype(float)
    t = Boosted(trees=30).fit(x[:3000], y[:3000])
    m = t.margin(x[3000:])
    assert ((m > 0) == y[3000:]).mean() > 0.98
    p = Isotonic().fit(m, y[3000:])(np.sort(m))
    assert (np.diff(p) >= 0).all() and 0 <= p.min() and p.max() <= 1


def plain_lexicon(rows):
    """Log odds of words and beginnings, kept by the likelihood ratio of their counts in toxic and other texts."""
    sides, n = (Counter(), Counter()), [0, 0]
    for text, label in rows:
        words, hidden = toxicity.words_of(text.lower())
        tokens = {*words, *hidden}
        tokens |= {"^" + w[:k] for w in tokens for k in (4, 5, 6) if len(w) > k}
        sides[label].update(tokens)
        n[label] += 1
    out, share = {}, n[1] / sum(n)
    for t in sides[0].keys() | sides[1].keys():
        a, b = sides[1][t], sides[0][t]
        g = 2 * sum(x * np.log(x / e) for x, e in ((a, (a + b) * share), (b, (a + b) * (1 - share))) if x)
        odds = np.log((a + 0.5) / (n[1] + 1)) - np.log((b + 0.5) / (n[0] + 1))
        if a > 2 and a * n[0] > b * n[1] and g >= toxicity.LEAST_RATIO and odds > 1:
            out[t] = odds
    return out


def test_lexicon_equals_plain_counts(spark):
    rng = np.random.default_rng(9)
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}word" for i in range(60)] + ["stupid", "1d10t", "sc.um"]
    rows = []
    for i in range(400):
        some = list(rng.choice(words[:60], 12)) + (list(rng.choice(words[60:], 2)) if i % 4 == 0 or rng.random() < 0.02 else [])
        rows.append((" ".join(some), int(i % 4 == 0)))
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int").repartition(3))
    want = plain_lexicon(rows)
    assert got.keys() == want.keys() and {"stupid", "idiot", "scum", "^stup"} <= got.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want)


def test_features_by_hand():
    lexicon = {"fool": 3.0, "idiot": 2.0, "^fool": 1.5}
    text = "You FOOL, you 1d10t now!! Foolish ones... heyyy"
    got = toxicity.features([text, ""], lexicon)
    # Words: you fool you d t now foolish ones heyyy (digits part words); idiot is read from its disguise.
    n, chars = 9, len(text)
    want = [1 / n, np.log1p(1), 3.0, 3.0, 1, 1 / n, np.log1p(1), 1.5, 1.5, 2 / n, 1, (1 + 4 + 1) / chars, 1 / n, 2 / n, 6 / chars, 1 / n, 1, 2 / n]
    assert got[0] == pytest.approx(want) and not got[1].any()


def test_calibration_is_the_least_squares_step():
    """Pools equal the minimax form of isotonic regression: max over beginnings of the min over ends of means."""
    rng = np.random.default_rng(2)
    for _ in range(20):
        m = np.sort(rng.normal(size=40))
        y = (rng.random(40) < 1 / (1 + np.exp(-2 * m))).astype(float)
        best = [max(min(y[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
        fitted = Isotonic().fit(m, y)
        assert np.unique(fitted.value) == pytest.approx(np.unique(np.round(best, 12)), abs=1e-9)


def test_trees_are_what_their_arrays_say():
    """Margins by walking each tree node by node, and the first tree's first split by trying every cut."""
    rng = np.random.default_rng(3)
    x, y = rng.random((300, 3)), (rng.random(300) < 0.4).astype(float)
    y[x[:, 1] > 0.7] = 1
    t = Boosted(trees=5).fit(x, y)
    for row, margin in zip(x[:40], t.margin(x[:40]), strict=True):
        total = t.base
        for feature, cut, value in t.forest:
            node = 0
            for level in range(t.depth):
                at = (1 << level) - 1 + node
                f = feature[at]
                node = 2 * node + int(f >= 0 and np.searchsorted(t.edges[f], row[f], side="left") > cut[at])
            total += value[node]
        assert total == pytest.approx(margin)
    p = y.mean()
    g, h = p - y, np.full(300, p * (1 - p))
    gains = {}
    for f in range(3):
        for k, edge in enumerate(t.edges[f]):
            left = x[:, f] <= edge
            if min(h[left].sum(), h[~left].sum()) >= t.least:
                gains[f, k] = g[left].sum() ** 2 / (h[left].sum() + t.ridge) + g[~left].sum() ** 2 / (h[~left].sum() + t.ridge)
    best = max(gains.values())
    assert gains[t.forest[0][0][0], t.forest[0][1][0]] == pytest.approx(best)


def test_margins_are_out_of_fold():
    """A row whose own label alone gives it away does not profit from it."""
    rng = np.random.default_rng(1)
    x, y, fold = rng.random((400, 2)), (rng.random(400) < 0.5).astype(float), np.arange(400) % 4
    margins = toxicity.out_of_fold_margins(x, y, fold)
    for f in range(4):
        assert margins[fold == f] == pytest.approx(Boosted().fit(x[fold != f], y[fold != f]).margin(x[fold == f]))
    assert len(toxicity.out_of_fold_margins(x[:9], np.eye(9)[0], np.arange(9))) == 9


def test_toxicity_learns_words_and_disguises(spark, odd_docs, no_docs):
    rng = np.random.default_rng(4)
    plain = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]

    def text(i):
        w = list(rng.choice(plain, 40))
        if i % 5 == 0:
            w[int(rng.integers(40))] = rng.choice(["idiot", "scum", "1d10t", "loser"])
        return " ".join(w)

    rows = [(i, text(i), int(i % 5 == 0)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.drop("toxic"), docs.where("doc_id < 1000").select("doc_id", "toxic"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(1000, 1500)]
    assert np.mean([(got[i] >= 0.5) == (i % 5 == 0) for i in held]) > 0.97
    scores = toxicity.score(odd_docs, model).collect()
    assert len(scores) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert toxicity.score(no_docs, model).count() == 0
    blank = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", F.lit(None).cast("int").alias("toxic")))
    assert {r["score"] for r in toxicity.score(docs.limit(3), blank).collect()} == {0.0}
