"""A content-addressed store of token ids.

A rolling hash over the ids cuts each document into chunks at places that depend on content alone,
so copies and shared passages give equal chunks. A chunk is named by the SHA-256 of its ids
(little-endian, 32 bits) and stored once. A recipe lists a document's chunks and carries the root of
a Merkle tree over them; manifests carry a root for each file of recipes and one for the corpus, over
all that their recipes say.

Layout under a root folder, all Parquet:
  chunks/    hash, n_ids, width (bytes an id), payload (zstd)
  recipes/   part, at, doc_id, local_start, n_tokens, root, hashes; a file for each part, in ascending doc_id order
  manifest/  files: part, start (ids of all parts before it), n_docs, n_tokens, root; corpus: the same of all, as part -1
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, frugal, materialise, partition_id, slices, text_of
from .hashing import Powers, splitmix
from .tokens import END_ID, default_path, encoder

WINDOW, LEAST, MEAN_BITS, MOST = 32, 256, 10, 8192
_U64 = np.uint64


_POWERS = Powers(0x9E3779B97F4A7C15)


def rolling(ids: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Polynomial hash of the `window` ids that end at each place (fewer at the beginning)."""
    n = len(ids)
    sums = np.cumsum(splitmix(ids) * _POWERS.up(n), dtype=_U64)
    out = sums.copy()
    out[window:] -= sums[:-window] if n > window else sums[:0]
    shift = np.maximum(np.arange(n) - (window - 1), 0)
    return out * _POWERS.down(n)[shift]


def cuts(ids: np.ndarray, least: int = LEAST, most: int = MOST, mean_bits: int = MEAN_BITS, window: int = WINDOW) -> list[int]:
    """Ends of the chunks of one document."""
    n = len(ids)
    if n <= least:
        return [n]
    marks = np.flatnonzero((splitmix(rolling(ids, window)) >> _U64(64 - mean_bits)) == 0) + 1
    out, last = [], 0
    for end in [*marks.tolist(), n]:
        while end - last > most:
            last += most
            out.append(last)
        if end - last >= least or end == n:
            if end > last:
                out.append(end)
            last = end
    return out


class Merkle:
    """The root of a Merkle tree over leaves that come one by one; holds one node for each level.

    Pairs are hashed upwards; an odd one goes up as it is. Leaf and inner nodes are told apart by a prefix.
    """

    def __init__(self):
        self.nodes: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        level, node = 0, hashlib.sha256(b"\0" + leaf).digest()
        while self.nodes and self.nodes[-1][0] == level:
            level, node = level + 1, hashlib.sha256(b"\1" + self.nodes.pop()[1] + node).digest()
        self.nodes.append((level, node))

    def root(self) -> bytes:
        if not self.nodes:
            return hashlib.sha256(b"").digest()
        *rest, (_, node) = self.nodes
        for _, left in reversed(rest):
            node = hashlib.sha256(b"\1" + left + node).digest()
        return node


def merkle_root(leaves: list[bytes]) -> bytes:
    tree = Merkle()
    for x in leaves:
        tree.add(x)
    return tree.root()


_RECIPE, _CHUNK = 0, 1
_ENCODED = "kind int, doc_id long, n_tokens long, root binary, hashes array<binary>, hash binary, n_ids int, width int, payload binary"
#: Chunks that a worker remembers as already handed on; beyond them it starts anew.
MOST_REMEMBERED = 200_000


def encode_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Rows of two kinds: a recipe for each document, and chunks, most once a partition. Null text is empty: the end id alone."""
    path = tokenizer_path or default_path()
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    names = [f.split()[0] for f in _ENCODED.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.int32(), pa.int32(), pa.binary()]

    def rows_of(kind: int, columns: dict) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        columns = {"kind": np.full(n, kind, np.int32)} | columns
        return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c not in columns else columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], k) for c, k in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encode, compress = encoder(path).encode, zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        seen: set[bytes] = set()
        for batch in slices(batches, "text"):
            recipes: list[list] = [[], [], []]
            new: list[list] = [[], [], [], []]
            for ids in encode(batch.column("text").to_pylist(), end_id):
                raw, lo, hashes = ids.astype("<u4").tobytes(), 0, []
                for hi in cuts(ids):
                    hashes.append(name := hashlib.sha256(raw[4 * lo : 4 * hi]).digest())
                    if name not in seen:
                        seen.add(name)
                        width = 2 if ids[lo:hi].max() < 65536 else 4
                        for column, value in zip(new, (name, hi - lo, width, compress(ids[lo:hi].astype(f"<u{width}").tobytes())), strict=True):
                            column.append(value)
                    lo = hi
                for column, value in zip(recipes, (len(ids), merkle_root(hashes), hashes), strict=True):
                    column.append(value)
            yield rows_of(_RECIPE, {"doc_id": batch.column("doc_id")} | dict(zip(("n_tokens", "root", "hashes"), recipes, strict=True)))
            if new[0]:
                yield rows_of(_CHUNK, dict(zip(("hash", "n_ids", "width", "payload"), new, strict=True)))
            if len(seen) > MOST_REMEMBERED:
                seen.clear()

    return rows.mapInArrow(frugal(run), _ENCODED)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, the place in it and the tokens before it."""
    part, at, before = partition_id(), 0, 0
    for batch in batches:
        n = np.asarray(batch.column("n_tokens").to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = np.cumsum(n)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(at + np.arange(len(n), dtype=np.int64)), pa.array(before + ends - n)],
            names=[*batch.schema.names, "part", "at", "local_start"],
        )
        at, before = at + len(n), before + int(ends[-1]) if len(n) else before


_LEAF = ["doc_id", "local_start", "n_tokens", "root"]


def _file_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each part of recipes that come in order: a leaf is all that a recipe says, by its own root for its chunks."""

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((part, docs, tokens, tree.root()), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "n_docs", "n_tokens", "root"])

    part, docs, tokens, tree = None, 0, 0, Merkle()
    for batch in batches:
        for own, *leaf in zip(*(batch.column(c).to_pylist() for c in ("part", *_LEAF)), strict=True):
            if own != part:
                if part is not None:
                    yield done()
                part, docs, tokens, tree = own, 0, 0, Merkle()
            docs, tokens = docs + 1, tokens + leaf[2]
            tree.add(repr(leaf).encode())
    if part is not None:
        yield done()


def file_roots(recipes: DataFrame) -> DataFrame:
    """part, n_docs, n_tokens, root of each file of recipes."""
    ordered = recipes.select("part", "at", *_LEAF).repartition("part").sortWithinPartitions("part", "at")
    return ordered.mapInArrow(frugal(_file_roots), "part int, n_docs long, n_tokens long, root binary")


def corpus_root(files: DataFrame) -> DataFrame:
    """The files' roots in order as the leaves of one more tree: a row for each file of recipes, in one task."""
    whole = files.select(F.lit(-1).alias("part"), F.col("part").cast("long").alias("doc_id"), "n_docs", "n_tokens", "root").coalesce(1).sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, tokens, tree = 0, 0, Merkle()
        for batch in batches:
            for part, d, t, root in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_docs", "n_tokens", "root")), strict=True):
                docs, tokens = docs + d, tokens + t
                tree.add(repr((part, d, t, root)).encode())
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((-1, docs, tokens, tree.root()), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "n_docs", "n_tokens", "root"])

    return whole.mapInArrow(run, "part int, n_docs long, n_tokens long, root binary")


def write_store(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = END_ID) -> None:
    """Encode docs into a new store at `root`, a folder all executors share.

    Rows alike get a recipe each and share their chunks. Rows that tie in id are ordered by Merkle
    root. An empty table gives an empty store.
    """
    staged = materialise(encode_chunks(docs, id_col, text_col, tokenizer_path, end_id), "chunked", by="kind")
    # A chunk comes from a partition about once, so no hash has more rows than there are partitions.
    chunks = staged.where(F.col("kind") == _CHUNK).select("hash", "n_ids", "width", "payload")
    first = F.lag("width").over(Window.partitionBy("hash").orderBy("n_ids")).isNull()
    materialise(chunks.withColumn("_first", first).where("_first").drop("_first"), "chunks", f"{root}/chunks")

    recipes = staged.where(F.col("kind") == _RECIPE).select("doc_id", "n_tokens", "root", "hashes")
    recipes = recipes.repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root")
    kinds = "doc_id long, n_tokens long, root binary, hashes array<binary>, part int, at long, local_start long"
    recipes = materialise(recipes.mapInArrow(frugal(_number), kinds), "recipes", f"{root}/recipes")
    discard(staged)
    # One row for each file of recipes.
    start = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = materialise(file_roots(recipes).withColumn("start", start), "manifest", f"{root}/manifest/files")
    materialise(corpus_root(files), "manifest", f"{root}/manifest/corpus")


def check_manifest(spark: SparkSession, root: str) -> None:
    """Fails if the recipes are not those that the manifests speak of: one lost, changed, moved or added."""
    recipes, files, corpus = (spark.read.parquet(f"{root}/{x}") for x in ("recipes", "manifest/files", "manifest/corpus"))
    found = materialise(file_roots(recipes), "found-roots")
    start = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = ["part", "start", "n_docs", "n_tokens", "root"]
    found_files = found.withColumn("start", start).select(same)
    if not found_files.exceptAll(files.select(same)).isEmpty() or not files.select(same).exceptAll(found_files).isEmpty():
        raise ValueError("a file of recipes does not match its manifest")
    if corpus_root(found).collect() != corpus.select("part", "n_docs", "n_tokens", "root").collect():  # a row each
        raise ValueError("the recipes do not match the corpus manifest")
    discard(found)


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document, put together from its chunks.

    Recipes are checked against the manifests first, then each chunk against its name and each document
    against its Merkle root and length; a mismatch or a missing chunk fails the read.
    """
    check_manifest(spark, root)
    recipes, chunks = spark.read.parquet(f"{root}/recipes"), spark.read.parquet(f"{root}/chunks")
    starts = F.broadcast(spark.read.parquet(f"{root}/manifest/files").select("part", "start"))  # one row for each file of recipes
    rid = F.shiftleft(F.col("part").cast("long"), 40) + F.col("at")
    refs = recipes.join(starts, "part").select(rid.alias("rid"), "doc_id", (F.col("start") + F.col("local_start")).alias("start"), "n_tokens", "root", F.posexplode("hashes").alias("pos", "hash"))
    # Chunks meet their references once; rows of one chunk each then meet by document, and no document is gathered in the JVM.
    found = refs.join(chunks.select("hash", "width", "payload"), "hash", "left").repartition("rid").sortWithinPartitions("rid", "pos")
    return found.mapInArrow(frugal(_rebuild), "doc_id long, start long, n_tokens long, ids binary")


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    columns = ("rid", "doc_id", "start", "n_tokens", "root", "hash", "width", "payload")
    rid, head, names, parts = None, (), [], []
    out: list[list] = [[], [], [], []]
    size = 0

    def close() -> None:
        nonlocal size
        doc, start, n, root = head
        whole = b"".join(parts)
        if len(whole) != 4 * n or merkle_root(names) != root:
            raise ValueError(f"document {doc} does not match its recipe")
        for column, value in zip(out, (doc, start, n, whole), strict=True):
            column.append(value)
        size += len(whole)

    def batch_of() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids"])

    for whole in batches:
        for batch in slices(iter([whole]), "payload"):
            for own, doc, start, n, root, name, width, payload in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if own != rid:
                    if rid is not None:
                        close()
                    rid, head, names, parts = own, (doc, start, n, root), [], []
                    if size > 1 << 20:
                        yield batch_of()
                        out, size = [[], [], [], []], 0
                if payload is None:
                    raise ValueError(f"document {doc}: chunk {name.hex()} is missing")
                raw = np.frombuffer(expand(payload), f"<u{width}").astype("<u4").tobytes()
                if hashlib.sha256(raw).digest() != name:
                    raise ValueError(f"document {doc}: chunk {name.hex()} is damaged")
                names.append(name)
                parts.append(raw)
    if rid is not None:
        close()
        yield batch_of()
