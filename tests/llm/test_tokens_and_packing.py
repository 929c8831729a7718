import hashlib
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import content_store, packing, tokens
from quire.llm.mixture import Schedule, sequence_of

TOKENIZER = Tokenizer.from_file(tokens.default_path())


def ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aB'stredvml 19²\n\t.!—é ßΣς日\x1c\x85́𝔸"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=8))
def test_encoder_equals_the_tokenizer(texts):
    got = tokens.encoder(tokens.default_path()).encode(texts, 2)
    assert [g.tolist() for g in got] == [ids(t) for t in texts]


def test_encoder_on_fixed_texts():
    texts = ["don't we'll it's 'tis I'M 'RE", "<|endoftext|> a<|startoftext|>b", "''s ,'s 's's", "x" * 700 + " y", "", " ", "İI ıi ǅ ª º × ÷", "Ⱥ", "aȾb Ɓx yƂ1ɃɄ Ɏ"]
    got = tokens.encoder(tokens.default_path()).encode(texts)
    assert [g.tolist() for g in got] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_on_each_code_point_of_its_table():
    texts = [f"a{chr(c)}b {chr(c)}" for c in range(0x2200)]
    got = tokens.encoder(tokens.default_path())
    assert [c for c, t in enumerate(texts) if got.encode([t])[0].tolist() != TOKENIZER.encode(t, add_special_tokens=False).ids] == []


def test_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_PIECES", 5)
    e = tokens.PieceEncoder(tokens.default_path())
    for text in ("one two three four", "five six seven one", "one two nine ten eleven twelve"):
        assert e.encode([text])[0].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=7), st.one_of(st.none(), st.lists(st.integers(0, 5), min_size=7, max_size=7)), st.sampled_from([8, 16, 64]))
def test_schedule_places_every_token_once(totals, weights, width):
    s = Schedule.make(totals, weights and [Fraction(w) for w in weights[: len(totals)]], width)
    used = []
    for lane, n in enumerate(totals):
        at = 0
        while at < n:  # in uneven runs, as documents come
            run = min(n - at, 1 + (at * 7 + lane) % 23)
            spots = list(s.pieces(lane, at, run))
            assert sum(p[1] for p in spots) == run
            used += [x for _, k, tape in spots for x in range(tape, tape + k)]
            at += run
    assert sorted(used) == list(range(sum(totals)))


def test_schedule_keeps_proportions():
    totals, width = [10_000, 5_000, 2_500], 64
    s = Schedule.make(totals, None, width)
    lane_at = {}
    for lane, n in enumerate(totals):
        for _, k, tape in s.pieces(lane, 0, n):
            lane_at |= {x: lane for x in range(tape, tape + k)}
    for w in range(1, sum(totals) // width + 1):
        seen = Counter(lane_at[x] for x in range(w * width))
        assert all(abs(seen[i] - w * width * t / sum(totals)) < 1 for i, t in enumerate(totals))


def test_weights_hold_until_a_queue_is_dry():
    s = Schedule.make([1000, 1000], [Fraction(3), Fraction(1)], 40)
    lane_at = {x: lane for lane in (0, 1) for _, k, tape in s.pieces(lane, 0, 1000) for x in range(tape, tape + k)}
    assert abs(sum(lane_at[x] == 0 for x in range(400)) - 300) <= 1
    assert all(lane_at[x] == 1 for x in range(1400, 2000))


def test_a_small_source_keeps_its_weight(spark):
    """A source of less than a token a window, with the weight of a large one, is served at its rate from the start."""
    docs = spark.createDataFrame([(i, "many words stand in this long source " * 20, "large") for i in range(150)] + [(900 + i, "few words", "small") for i in range(4)] + [(990, "no weight at all", "none")], "doc_id long, text string, source string").repartition(3)
    pieces = packing.pack(docs, width=64, weights={"large": 1.0, "small": 1.0}).collect()
    sizes = Counter()
    for p in pieces:
        sizes[p["doc_id"]] += p["length"]
    small, total = sum(n for d, n in sizes.items() if 900 <= d < 990), sum(sizes.values())
    assert small * 64 < 2 * total  # below two tokens a window
    assert max(p["sequence_id"] * 64 + p["offset"] + p["length"] for p in pieces if 900 <= p["doc_id"] < 990) <= 2 * small + 64
    assert min(p["sequence_id"] for p in pieces if p["doc_id"] == 990) >= total // 64 - 1


def test_sequences_need_no_padding():
    total, width = 4 * 64 + 45, 64
    sizes = Counter(sequence_of(x, total, width)[0] for x in range(total))
    assert all(n == width or n & (n - 1) == 0 for n in sizes.values()) and sizes[4] == 32


def test_packing_covers_odd_documents(odd_docs, no_docs):
    pieces = packing.pack(odd_docs, width=128).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"], p["doc_tokens"]].append((p["start"], p["length"], p["ids"]))
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    expected = Counter()
    for r in odd_docs.collect():
        expected[r["doc_id"], len(ids(r["text"]))] += len(ids(r["text"]))
    assert {k: sum(x[1] for x in v) for k, v in by_doc.items()} == dict(expected)
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 128 or at & (at - 1) == 0
    text = next(r for r in odd_docs.collect() if r["doc_id"] == 7)["text"]
    whole = b"".join(x[2] for x in sorted(by_doc[7, len(ids(text))]))
    assert np.frombuffer(whole, "<u4").tolist() == ids(text)
    assert packing.pack(no_docs).count() == 0


def test_sequences_join_pieces(odd_docs):
    rows = packing.sequences(packing.pack(odd_docs, width=256)).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in rows) and sum(r["n_tokens"] for r in rows) == sum(len(ids(r["text"])) for r in odd_docs.collect())


def test_store_round_trip(spark, odd_docs, tmp_path):
    root = f"file://{tmp_path}/store"
    content_store.write_store(odd_docs, root)
    got = content_store.read_store(spark, root).collect()
    assert Counter((r["doc_id"], zlib.crc32(r["ids"])) for r in got) == Counter((r["doc_id"], zlib.crc32(np.array(ids(r["text"]), "<u4").tobytes())) for r in odd_docs.collect())
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert order == sorted(order)
    chunks = spark.read.parquet(f"{root}/chunks")
    assert chunks.count() == chunks.select("hash").distinct().count()
    corpus = spark.read.parquet(f"{root}/manifest/corpus").first()
    assert (corpus["n_docs"], corpus["n_tokens"]) == (len(got), at)


def test_store_finds_damage(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    docs = spark.createDataFrame([(i, f"text number {i} " * 50) for i in range(4)], "doc_id long, text string")
    content_store.write_store(docs, root)
    tables = {part: spark.read.parquet(f"{root}/{part}") for part in ("chunks", "recipes", "manifest/files", "manifest/corpus")}
    last = tables["recipes"].agg(F.max("doc_id")).first()[0]
    changes = [
        ("missing", {"chunks": tables["chunks"].where(F.col("hash") != F.lit(bytes(tables["chunks"].first()["hash"])))}),
        ("damaged", {"chunks": tables["chunks"].withColumn("payload", F.lit(bytes(tables["chunks"].first()["payload"]))).withColumn("width", F.lit(2))}),
        ("manifest", {"recipes": tables["recipes"].where(F.col("doc_id") != last)}),
        ("manifest", {"recipes": tables["recipes"].withColumn("local_start", F.col("local_start") + 1)}),
        ("manifest", {"recipes": tables["recipes"].limit(0)}),
        ("corpus", {"manifest/corpus": tables["manifest/corpus"].withColumn("n_docs", F.col("n_docs") + 1)}),
    ]
    for i, (word, change) in enumerate(changes):
        moved = f"{tmp_path}/store{i}"
        for part, df in (tables | change).items():
            df.write.parquet(f"{moved}/{part}")
        with pytest.raises(Exception, match=word):
            content_store.read_store(spark, moved).collect()


def test_merkle_roots_by_levels():
    """The tree of leaves that come one by one is that of whole levels."""
    for n in range(1, 40):
        level = [hashlib.sha256(b"\0" + bytes([i])).digest() for i in range(n)]
        while len(level) > 1:
            level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        assert content_store.merkle_root([bytes([i]) for i in range(n)]) == level[0]


def test_equal_passages_share_chunks():
    rng = np.random.default_rng(0)
    shared = rng.integers(3, 40_000, 20_000).astype(np.uint32)
    one, two = np.concatenate([rng.integers(3, 40_000, 777).astype(np.uint32), shared]), np.concatenate([rng.integers(3, 40_000, 1234).astype(np.uint32), shared])

    def chunks(x):
        ends = content_store.cuts(x)
        assert ends[-1] == len(x) and all(b - a <= content_store.MOST for a, b in zip([0, *ends], ends, strict=False))
        return {x[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)}

    assert len(chunks(one) & chunks(two)) > 0.8 * len(chunks(one))
