"""MinHash fingerprints: universal hash permutations over shingles in numpy.

fingerprints() makes the signatures; near_duplicates() joins their bands in Spark and keeps a pair
only when the Jaccard similarity of its shingle sets, computed in full, is high enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, slices, text_of
from .hashing import splitmix
from .shingles import shingles

PERMUTATIONS, SHINGLE_WORDS, SEED = 128, 5, 1
_U64 = np.uint64


def permutations(count: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets: x -> a*x + b modulo 2**64 permutes the 64-bit numbers."""
    a = splitmix(np.arange(count, dtype=_U64) + _U64(seed * 1_000_003)) | _U64(1)
    b = splitmix(np.arange(count, dtype=_U64) + _U64(seed * 2_000_003 + 77))
    return a, b


def signatures(texts: pa.Array, count: int = PERMUTATIONS, k: int = SHINGLE_WORDS) -> np.ndarray:
    """(texts, count) 16-bit minima, mixed. A text without words has all zeros."""
    hashes, at = shingles(texts, k)
    a, b = permutations(count)
    out = np.zeros((len(texts), count), np.uint16)
    most = 1 << 11  # shingles at once: the matrix stays in cache
    for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if lo == hi:
            continue
        least = None
        for x in range(lo, hi, most):
            m = np.multiply.outer(a, hashes[x : min(hi, x + most)])
            m += b[:, None]
            part = m.min(axis=1)
            least = part if least is None else np.minimum(least, part)
        out[i] = (splitmix(least) >> _U64(48)).astype(np.uint16)
    return out


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Share of equal places, row by row: an unbiased estimate of the Jaccard similarity."""
    return (one == other).mean(axis=1)


def hexed(signature: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in signature]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: int = PERMUTATIONS, k: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, signature (array of ints) for each row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = signatures(batch.column("text"), count, k)
            flat = pa.array(s.astype(np.int32).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(0, s.size + 1, count, dtype=np.int32)), flat)], names=["doc_id", "signature"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text")).mapInArrow(frugal(run), "doc_id long, signature array<int>")


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_a_range: int = 4000) -> DataFrame:
    """_range, doc_id, text, _ghost, sorted inside partitions: each range ends with a ghost, the row after it.

    Ranges are cut at approximate quantiles of the id, so the row after any row is in its own range;
    the last range's ghost is the first row of all. Rows of one id go by text.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    n = docs.count()
    ranges = int(max(1, min(10_000, n // rows_a_range)))
    marks = rows.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20_000)).first()[0] if ranges > 1 else []
    marks = sorted(set(marks or []))
    at = F.lit(0) if not marks else F.coalesce(F.size(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: m < F.col("doc_id"))), F.lit(0))
    if len(marks) > 64:  # a search tree instead of a long list
        at = _tree(F.col("doc_id"), marks, 0)
    rows = rows.withColumn("_range", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(at).cast("int"))
    firsts = rows.groupBy("_range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("set"), "doc_id", "text")).alias("f"))
    # The range before each, the last for the first; at most 10,000 numbers. Texts stay out of it.
    found = sorted(r[0] for r in rows.select("_range").distinct().collect())
    before = F.broadcast(docs.sparkSession.createDataFrame(list(zip(found, [*found[-1:], *found[:-1]], strict=True)), "_range int, _before int"))
    ghosts = firsts.join(before, "_range").select(F.col("_before").alias("_range"), F.col("f.doc_id").alias("doc_id"), F.col("f.text").alias("text"), F.lit(True).alias("_ghost"))
    both = rows.withColumn("_ghost", F.lit(False)).unionByName(ghosts.select("doc_id", "text", "_range", "_ghost"))
    return both.repartition(max(1, ranges), "_range").sortWithinPartitions("_range", "_ghost", "doc_id", "text")


def _tree(x, marks: list[int], base: int):
    """The number of marks below x, as nested comparisons."""
    if not marks:
        return F.lit(base)
    mid = len(marks) // 2
    return F.when(x > marks[mid], _tree(x, marks[mid + 1 :], base + mid + 1)).otherwise(_tree(x, marks[:mid], base))


def edited(text: str, after: str) -> str:
    """The last half of a text replaced by the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: int = PERMUTATIONS, k: int = SHINGLE_WORDS) -> DataFrame:
    """Fingerprints of each row and of its edited text, and their likeness: see the query op8_minhash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        held: pa.Table | None = None  # the last row waits for the one after it
        for batch in slices(batches, "text"):
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows]).combine_chunks()
            held = rows.slice(rows.num_rows - 1)
            text, ghost, ids = rows.column("text").to_pylist(), rows.column("_ghost").to_pylist(), rows.column("doc_id").to_pylist()
            use = [i for i in range(len(text) - 1) if not ghost[i]]
            if not use:
                continue
            edits = [edited(text[i], text[i + 1]) for i in use]
            own = signatures(pa.array(text, pa.large_string()), count, k)
            new = signatures(pa.array(edits, pa.large_string()), count, k)
            picked, following = own[use], own[[i + 1 for i in use]]
            columns = [
                pa.array([ids[i] for i in use], pa.int64()), pa.array([len(text[i]) for i in use], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits]), pa.array(hexed(picked)), pa.array(hexed(new)),
                pa.array(likeness(picked, new)), pa.array(likeness(picked, following)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    rows = with_next_text(docs, id_col, text_col).select("doc_id", "text", "_ghost")
    return rows.mapInArrow(frugal(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, k: int = SHINGLE_WORDS, count: int = PERMUTATIONS, band_rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of near-duplicate classes.

    Candidates share a band of band_rows minima; the class graph, its verification and its
    components are those of the exact join (jaccard_join.py), which reads bands instead of prefixes.
    With the defaults a pair at 0.8 shares one of 25 bands with probability 0.9999.
    """
    from .jaccard_join import SIMILAR_BANDS, link_classes

    return link_classes(docs, id_col, text_col, k, threshold, SIMILAR_BANDS(count, band_rows))
