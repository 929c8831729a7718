import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import exact_dedup, line_dedup, sharding
from quire.llm.sharding import feistel, place, shard_rows, sides


def test_exact_against_brute_force(odd_docs):
    rows = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    ids = defaultdict(list)
    for i, t in rows:
        ids[t].append(i)
    got = exact_dedup.mark_exact_duplicates(odd_docs).collect()
    assert len(got) == len(rows)
    for r in got:
        t = r["text"] or ""
        best = max((i for i in ids[t] if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (best, len(ids[t]), r["doc_id"] == best, hashlib.sha256(t.encode()).hexdigest())


def test_weak_digest_never_merges_texts(spark):
    docs = spark.createDataFrame([(i, f"t{i % 7}") for i in range(40)], "doc_id long, text string")
    got = exact_dedup.mark_exact_duplicates(docs, digest=lambda t: F.lit("one"))
    assert {(r["text"], r["keep_id"], r["group_size"]) for r in got.collect()} == {(f"t{k}", max(i for i in range(40) if i % 7 == k), sum(i % 7 == k for i in range(40))) for k in range(7)}


def test_removal_keeps_whole_rows(odd_docs, no_docs):
    kept = exact_dedup.remove_exact_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r["text"] or "" for r in kept.collect()) == Counter({r["text"] or "" for r in odd_docs.collect()})
    assert exact_dedup.remove_exact_duplicates(no_docs).count() == exact_dedup.mark_exact_duplicates(no_docs).count() == 0


def brute_lines(rows, min_docs):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    n = Counter(k for t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and n[key(x)] >= min_docs)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("min_docs", [2, 3, 10])
def test_lines_against_brute_force(spark, odd_docs, min_docs):
    more = spark.createDataFrame([(100 + i, f"line {i}\n SAME Line\x0b\nÀ\nà\n\nlast") for i in range(12)], "doc_id long, text string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True)
    got = line_dedup.drop_repeated_lines(docs, min_docs=min_docs)
    assert Counter((r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()) == brute_lines([r["text"] for r in docs.collect()], min_docs)


def test_texts_of_a_million_lines(spark):
    """Every step is linear in the lines of one text: distinct lines, repeated ones and dropped ones."""
    rows = spark.range(1_000_000).select(F.col("id"), F.concat(F.lit("own line "), F.col("id")).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n")
    one = rows.coalesce(1).agg(text.alias("text")).select(F.lit(1).cast("long").alias("doc_id"), "text")
    half = rows.where("id % 2 = 0").coalesce(1).agg(text.alias("text")).select(F.lit(2).cast("long").alias("doc_id"), "text")
    docs = one.unionByName(half)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["sha"]) for r in line_dedup.drop_repeated_lines(docs, min_docs=2).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("sha")).collect()}
    odd = "\n".join(f"own line {i}" for i in range(1, 1_000_000, 2))
    assert got == {1: (1_000_000, 500_000, hashlib.sha256(odd.encode()).hexdigest()), 2: (500_000, 500_000, hashlib.sha256(b"").hexdigest())}


def test_lines_of_nothing(no_docs):
    assert line_dedup.drop_repeated_lines(no_docs).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 100, 1009])
def test_feistel_permutes(n):
    a, b = sides(n)
    assert a * b >= n > a * b - a
    assert sorted(feistel(x, n, 5) for x in range(a * b)) == list(range(a * b))
    assert sorted(place(x, n, 5) for x in range(n)) == list(range(n))


def test_shards_are_even_gapless_and_computable(spark):
    rows = spark.range(1003).select((F.col("id") * 3).alias("doc_id")).repartition(5)
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in shard_rows(rows, 8, ["doc_id"], 17).collect()}
    for i, d in enumerate(sorted(got)):
        y = place(i, 1003, 17)
        assert got[d] == (y % 8, y // 8)


def test_shards_of_odd_rows(odd_docs, no_docs):
    got = sharding.shard_rows(odd_docs, 4, ["doc_id", "text"]).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert sum(map(len, slots.values())) == odd_docs.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_rows(no_docs, 4, ["doc_id"]).count() == 0
