import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_stages_follow_each_other(spark):
    import numpy as np
    from tokenizers import Tokenizer

    from quire.llm import tokens
    from quire.llm.common import materialise

    from test_near import brute_classes

    names = spark.read.parquet(f"{SF}/documents.parquet").columns
    results, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "test")
        results.append(docs.toPandas())
    good, exact, near, mixed, packed = results
    assert all(list(r.columns) == names for r in results[:4])
    assert len(set(exact["text"])) == len(exact) == good["text"].nunique()
    assert set(exact["doc_id"]) == set(good.groupby("text")["doc_id"].max())
    classes = brute_classes(list(zip(exact["doc_id"], exact["text"], strict=True)), 5, 80)
    assert set(near["doc_id"]) == {c for _, c in classes.values()}
    assert set(mixed["doc_id"]) <= set(near["doc_id"])
    encode = Tokenizer.from_file(tokens.default_path()).encode
    length = {r.doc_id: len(encode(r.text, add_special_tokens=False).ids) + 1 for r in near.itertuples()}
    assert packed["length"].sum() == sum(length[i] for i in mixed["doc_id"])
    full = packed.groupby("sequence_id")["length"].sum()
    assert np.all((full == 4096) | (full & (full - 1) == 0))


def test_run_equals_plain_stages(spark):
    """run() itself: quality by the classifier's own decision, then exact, near and packed by plain versions."""
    from collections import Counter

    from tokenizers import Tokenizer

    from quire.llm import language_model, tokens

    from test_near import brute_classes

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    classifier = language_model.fit(docs, language_model.trusted_ids(spark, SF))
    kept = {r["doc_id"]: r["text"] or "" for r in language_model.classify(docs, classifier).where("log_perplexity <= threshold").collect()}
    last = {}
    for i in sorted(kept):
        last[kept[i]] = i
    unique = {i: t for t, i in last.items()}
    near = {c for _, c in brute_classes(list(unique.items()), 5, 80).values()}
    encode = Tokenizer.from_file(tokens.default_path()).encode
    length = {i: len(encode(unique[i], add_special_tokens=False).ids) + 1 for i in near}
    pieces = corpus_pipeline.run(spark, SF).collect()
    total = Counter()
    for p in pieces:
        total[p["doc_id"]] += p["length"]
    assert set(total) <= near
    # Each document as often as the mix takes it, at most three times, and whole each time.
    assert all(n % length[i] == 0 and n // length[i] in (1, 2, 3) for i, n in total.items())
    again = Counter()
    for p in corpus_pipeline.run(spark, SF).collect():
        again[p["doc_id"]] += p["length"]
    assert again == total


def test_stages_of_odd_and_no_rows(spark, odd_docs, no_docs):
    """Nulls, ties, repeated rows, clashing names and no rows at all; the classifier knows no trusted row here."""
    for docs in (odd_docs, no_docs):
        names, n = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES[1:]:
            docs = stage(spark, docs, SF)
            if name != "packing":
                assert docs.columns == names
        assert docs.count() >= bool(n)
