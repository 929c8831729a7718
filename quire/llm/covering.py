"""SimHash fingerprints and their exact classes by covering locality-sensitive hashing.

A covering of bits for a radius r gives every bit a code of r+1 bits and has one mask for each non-zero vector of
r+1 bits: the bits whose code has an odd product with it. The codes of any r bits leave some non-zero vector
orthogonal to all of them, and that vector's mask touches none of these bits: two
fingerprints within the radius agree on it, so they collide in some table.

Buckets are compared inside. A bucket too full for that is split again by a covering of the bits its
mask leaves open, so nothing is dropped; once few bits are open, its fingerprints meet at the points
within half the radius instead, which two of them share if and only if they are within the radius.
Equal fingerprints are one, so a group of copies costs nothing here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, join_counted, materialise, slices, text_of
from .jaccard_join import components

BITS, RADIUS, SHINGLE_WORDS, SEED = 64, 4, 4, 42
#: Fingerprints of a bucket that are compared with one another; fuller ones are split.
FULL = 256
#: Open bits from which on half-radius points take the place of another split.
FEW_BITS = 20
_U64 = np.uint64


# --- fingerprints ----------------------------------------------------------------------------------

_PIECE = 1 << 20


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, A-Z lowered, a piece of the text at a time; bytes.split() knows the same six blanks as the contract."""
    at = 0
    while at < len(text):
        end = at + _PIECE
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end].lower().split()
        at = end


def fingerprint(text: bytes, k: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of the k-word shingles, repeats included: a bit is set if over half their XXH64 have it."""
    from xxhash import xxh64_intdigest

    counts, n, rest = np.zeros(BITS, np.int64), 0, []
    hashes: list[int] = []
    for words in _words(text):
        words = rest + words
        if len(words) >= k:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            line = memoryview(b" ".join(words))
            starts = [0, *ends[: len(words) - k].tolist()]
            hashes = [xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)]
            counts, n = counts + _bit_counts(hashes), n + len(hashes)
        rest = words[-(k - 1) :] if k > 1 else []
    if not n and rest:  # fewer words than a shingle has
        counts, n = _bit_counts([xxh64_intdigest(b" ".join(rest), seed)]), 1
    return sum(1 << i for i in np.flatnonzero(counts * 2 > n).tolist())


def _bit_counts(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit, lowest first."""
    out = np.zeros(BITS, np.int64)
    h = np.array(hashes, "<u8")
    for at in range(0, len(h), 1 << 15):
        out += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


def _fingerprints(k: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            prints = np.array([fingerprint(t.as_buffer().to_pybytes(), k, seed) for t in batch.column("text")], _U64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, print (the 64 bits as a signed long) of each row. Null or blank text has fingerprint zero."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(frugal(_fingerprints(k, seed)), "doc_id long, print long")


# --- coverings -------------------------------------------------------------------------------------


def covering(free: list[int], radius: int) -> list[int]:
    """Masks over the free bits: for any `radius` of them, some mask touches none. Codes go round the non-zero vectors, so masks are alike in size."""
    codes = [1 + i % ((1 << (radius + 1)) - 1) for i in range(len(free))]
    return [sum(1 << b for b, c in zip(free, codes, strict=True) if (c & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def open_bits(mask: int) -> list[int]:
    return [b for b in range(BITS) if not mask >> b & 1]


def half_points(free: list[int], radius: int) -> list[int]:
    """Differences of the points within half the radius: fingerprints up to an even radius apart share such a point, and no others do."""
    return [sum(1 << b for b in chosen) for size in range(radius // 2 + 1) for chosen in combinations(free, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _deal(radius: int) -> Callable:
    """(mask, print) -> (bucket's mask, its masked bits, print) for each mask of the next covering."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for whole in batches:
            for batch in slices(iter([whole]), "print", 1 << 16, 1 << 13):
                masks = batch.column("mask").to_numpy().view(_U64)
                prints = batch.column("print").to_numpy().view(_U64)
                for m in np.unique(masks).tolist():
                    if m not in known:
                        known[m] = np.array([m | x for x in covering(open_bits(m), radius)], _U64)
                    mine = prints[masks == _U64(m)]
                    for deeper in known[m]:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), deeper).view(np.int64)), pa.array((mine & deeper).view(np.int64)), pa.array(mine.view(np.int64))], names=["mask", "part", "print"])

    return run


def _meet(radius: int) -> Callable:
    """(mask, print) -> (mask, point, print) for the points within half the radius in the open bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for whole in batches:
            for batch in slices(iter([whole]), "print", 1 << 12, 1 << 9):
                masks = batch.column("mask").to_numpy().view(_U64)
                prints = batch.column("print").to_numpy().view(_U64)
                for m in np.unique(masks).tolist():
                    if m not in known:
                        known[m] = np.array(half_points(open_bits(m), radius), _U64)
                    mine = prints[masks == _U64(m)]
                    points = (mine[:, None] ^ known[m]).ravel().view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(points), _signed(m), np.int64)), pa.array(points), pa.array(np.repeat(mine, len(known[m])).view(np.int64))], names=["mask", "point", "print"])

    return run


def _bucket_links(radius: int) -> Callable:
    """Rows sorted by bucket -> links that join all fingerprints of a bucket that can reach one another in it; at most one fewer than it has rows."""

    def links(prints: np.ndarray) -> list[tuple[int, int]]:
        near = np.bitwise_count(prints[:, None] ^ prints) <= radius
        out, left = [], np.ones(len(prints), bool)
        for start in range(len(prints)):
            if not left[start]:
                continue
            left[start] = False
            edge = [start]
            while edge:
                i = edge.pop()
                for j in np.flatnonzero(near[i] & left).tolist():
                    left[j] = False
                    edge.append(j)
                    out.append((i, j))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("mask", "part", "print")])
            if held:
                rows = np.concatenate([held.pop(), rows], axis=1)
            if not rows.shape[1]:
                continue
            cuts = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1
            at = [0, *cuts.tolist()]
            held.append(rows[:, at[-1] :])  # a bucket may go on in the next batch
            yield from found(rows, at)
        if held:
            yield from found(held[0], [0, held[0].shape[1]])

    def found(rows: np.ndarray, at: list[int]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for lo, hi in zip(at, at[1:], strict=False):
            own = rows[2, lo:hi]
            if hi - lo == 2:
                if int(np.bitwise_count((own[:1] ^ own[1:]).view(_U64))[0]) <= radius:
                    a.append(own[0])
                    b.append(own[1])
            elif hi - lo > 2:
                for i, j in links(own.view(_U64)):
                    a.append(own[i])
                    b.append(own[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_links(prints: DataFrame, radius: int = RADIUS, full: int = FULL) -> DataFrame:
    """(a, b): links between distinct fingerprints (`print`) whose classes are those of all pairs within an even radius."""
    spark = prints.sparkSession
    found = []
    rows = prints.select(F.lit(0).cast("long").alias("mask"), "print")
    depth, few = BITS, False
    staged = []
    while True:
        dealt = materialise(rows.mapInArrow(frugal(_deal(radius)), "mask long, part long, print long"), "covering")
        staged.append(dealt)
        depth //= 2  # a mask takes about half of the open bits
        sizes = dealt.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = materialise(sizes, "bucket-sizes")
        staged.append(sizes)
        some = dealt.join(sizes.where(F.col("n") <= full).select("mask", "part"), ["mask", "part"])
        inside = some.repartition("mask", "part").sortWithinPartitions("mask", "part")
        found.append(materialise(inside.mapInArrow(frugal(_bucket_links(radius)), "a long, b long").distinct(), "bucket-links"))
        crowded = sizes.where(F.col("n") > full).select("mask", "part")
        if crowded.isEmpty():
            break
        rows = dealt.join(crowded, ["mask", "part"]).select("mask", "print")
        if depth <= FEW_BITS:
            few = True
            break
    if few:
        points = materialise(rows.mapInArrow(frugal(_meet(radius)), "mask long, point long, print long"), "half-points")
        staged.append(points)
        least = points.groupBy("mask", "point").agg(F.min("print").alias("a"), F.max("print").alias("z")).where("a < z").select("mask", "point", "a")
        found.append(materialise(points.join(least, ["mask", "point"]).where("a < print").select("a", F.col("print").alias("b")).distinct(), "point-links"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    result = materialise(out.distinct(), "near-links")
    for done in staged + found:
        discard(done)
    return result


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, radius: int = RADIUS, seed: int = SEED, full: int = FULL) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row.

    Rows link when their fingerprints differ in at most `radius` bits (an even number); component_id is the least id reachable,
    null if all ids there are null. Null and blank texts have fingerprint zero, which links like any other. Rows with
    equal fingerprints, repeated rows among them, share a component. Other columns are not read. An empty table gives no rows.
    """
    if radius % 2 or not 0 < radius < 8:
        raise ValueError("radius: 2, 4 or 6")
    rows = materialise(fingerprints(docs, id_col, text_col, k, seed), "fingerprints")
    prints = materialise(rows.groupBy("print").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")), "prints")
    links = near_links(prints, radius, full)
    labels = materialise(components(links), "labels")
    firsts = labels.join(prints.select(F.col("print").alias("node"), "first_doc"), "node").groupBy("label").agg(F.min("first_doc").alias("component_id"))
    named = prints.join(labels.withColumnRenamed("node", "print"), "print", "left").join(firsts, "label", "left")
    named = materialise(named.select("print", "n", F.coalesce("component_id", "first_doc").alias("component_id")), "print-classes")
    for done in (links, labels, prints):
        discard(done)
    out = join_counted(rows, named, "print", "n")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
