"""Each opN_ query on the smallest tables against a plain version of its contract, or its SQL."""

import hashlib
import os
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import mixing, tokens
from quire.llm.oracles import oracles
from quire.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(documents):
    encode = Tokenizer.from_file(tokens.default_path()).encode
    return {i: np.array([*encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4") for i, r in documents.items()}


def test_op1_pieces(spark, ids):
    rows = QUERIES["op1_packing"](spark, SF).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] >= 1 and len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(ids)
    for spans, whole in [(s, len(ids[i])) for i, s in by_doc.items()] + [(s, None) for s in by_sequence.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == whole if whole is not None else at <= 4096
    sizes = [sum(n for _, n in s) for s in by_sequence.values()]
    assert sum(4096 - n for n in sizes if n & (n - 1)) == 0 and sorted(by_sequence) == list(range(len(by_sequence)))


def test_op2_reads_back(spark, ids):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op2_content_store"](spark, SF).collect()}
    at, want = 0, {}
    for i in sorted(ids):
        want[i] = (at, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        at += len(ids[i])
    assert got == want


@pytest.mark.parametrize("name", sorted(oracles()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{file}')")
    df, expected = QUERIES[name](spark, SF), con.sql(oracles()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    order = [expected.columns.index(c) for c in df.columns]
    assert sorted(tuple(map(repr, r)) for r in df.collect()) == sorted(tuple(repr(r[i]) for i in order) for r in expected.fetchall())


def test_op5_has_every_document(spark, documents):
    rows = QUERIES["op5_quality_classifier"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    assert all(r["kept"] == (r["log_perplexity"] <= r["threshold"]) for r in rows)
    labels = spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("q")).collect()
    good = {r["doc_id"] for r in labels if r["q"] == 1}
    assert sum(r["kept"] for r in rows if r["doc_id"] in good) >= 0.9 * len(good)


def test_op6_folds_and_predictions(spark, documents):
    rows = QUERIES["op6_toxicity"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op8_edits(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op8_minhash"](spark, SF).collect()}
    order = sorted(documents)
    assert sorted(got) == order
    prints = defaultdict(set)
    for i, after in zip(order, [*order[1:], order[0]], strict=True):
        text, other = documents[i]["text"] or "", documents[after]["text"] or ""
        half = len(text) // 2
        edit = text[: len(text) - half] + other[:half]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        sign = lambda h: np.array([int(h[k : k + 4], 16) for k in range(0, len(h), 4)])
        assert got[i]["near_edited"] == pytest.approx((sign(got[i]["fingerprint"]) == sign(got[i]["edited_fingerprint"])).mean())
        assert got[i]["near_next"] == pytest.approx((sign(got[i]["fingerprint"]) == sign(got[after]["fingerprint"])).mean())
        prints[text].add(got[i]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_op9_components(spark, documents):
    from test_near import brute_classes

    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op9_jaccard_join"](spark, SF).collect()}
    assert got == brute_classes([(i, r["text"]) for i, r in documents.items()], 4, 85)


def test_op10_targets(spark, documents):
    rows = QUERIES["op10_mixing"](spark, SF).collect()
    again = {r["doc_id"]: (r["taken"], r["shards"]) for r in QUERIES["op10_mixing"](spark, SF).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for i, r in documents.items()}
    of_source, taken = defaultdict(int), defaultdict(int)
    for i, r in documents.items():
        of_source[r["source"]] += size[i]
    names = sorted(of_source, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, mixing.targets([of_source[s] for s in names], [1 + k % 3 for k in range(len(names))]), strict=True))
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    for r in rows:
        source, times = documents[r["doc_id"]]["source"], len(r["shards"].split(",")) if r["shards"] else 0
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], of_source[source]) and r["target"] == pytest.approx(float(target[source]))
        assert r["taken"] == times * r["size"] <= 3 * r["size"] and again[r["doc_id"]] == (r["taken"], r["shards"])
        taken[source] += r["taken"]
    longest = defaultdict(int)
    for i, r in documents.items():
        longest[r["source"]] = max(longest[r["source"]], size[i])
    # Sources of ten documents: whole ones come no nearer than half the longest.
    assert all(abs(taken[s] - target[s]) <= max(0.01 * float(target[s]), longest[s] / 2) for s in names)


def test_op11_components(spark, documents):
    from test_clusters_and_tries import brute_links, plain_print, signed

    rows = QUERIES["op11_simhash_near_dedup"](spark, SF).collect()
    prints = {i: signed(plain_print(r["text"])) for i, r in documents.items()}
    of = brute_links(list(prints.values()), 4)
    least = {}
    for i in sorted(documents):
        least.setdefault(of[prints[i]], i)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{p & (1 << 64) - 1:016x}", least[of[p]]) for i, p in prints.items()}
