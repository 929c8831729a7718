"""Exact Jaccard join of word-shingle sets by token-combination prefixes, and its classes.

Tokens (shingles) stand in one global order: rare ones by hash, then frequent ones by document
frequency and hash. Similar sets share a token of their prefixes. A set whose prefix is all rare is indexed by
its tokens alone. A set whose prefix reaches into the frequent tokens is indexed by all its rare tokens, and its prefix is
extended over all its frequent tokens, which are indexed in combinations: tokens fall into classes by hash, and the tokens
that a set has in a class make one key. Two such sets without a rare token in common differ in all their rare tokens,
so what their frequent tokens may differ in is bounded; there are more classes than that, so some class
holds the same tokens in both. The number of classes grows with the sets' size, a set has about as many keys as
tokens, and how many tokens a combination has (four to six in general) follows from the threshold. Where so many classes of a
set are empty that only empty ones might agree, its pairs of frequent tokens (short sets) or its empty classes (long ones) are keys too.
Each candidate is verified on whole sets, after an exact bound from parity bitmaps has thrown out what cannot reach the threshold.

Equal sets are one node. In a bucket every node meets the bucket's pivot (the node with the fewest rare
tokens); only nodes that this leaves outside the pivot's component then meet the others of
the bucket. Pairs inside one component are never needed for the classes, so a large group of near
copies costs its size, not its square, and no link between components is missed.

Whoever is indexed by combinations has all its rare tokens indexed too. So two such sets
that share no rare token need to meet only if their counts allow a link: they differ in all rare
tokens of both, and in as many frequent ones as one has more than the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, materialise, seen_ids, slices, text_of
from .hashing import packed, splitmix, unpacked
from .shingles import shingle_sets

_U64 = np.uint64
#: A token is frequent from this many documents, or from more where over MAX_FREQUENT tokens would be.
LEAST_FREQUENT = 64
#: Bits of the sketch that joins test pairs by: parities of tokens, in 64-bit words.
SKETCH_WORDS = 4
SKETCH = tuple(f"s{i}" for i in range(SKETCH_WORDS))
#: Bound of the broadcast table of frequent tokens (9 bytes each).
MAX_FREQUENT = 1_000_000
#: Bytes of text counted in one range of tokens, some ten million tokens; and the least number of ranges, as a power of two.
RANGE_BYTES, LEAST_RANGE_BITS = 64 << 20, 7
#: Tokens counted in a worker before it hands them on, and sets it remembers.
MOST_HELD = 3_000_000


#: A threshold as whole numbers: similar means share[1] * intersection >= share[0] * union.
Share = tuple[int, int]


def share_of(threshold: float) -> Share:
    """The decimal fraction as it is written: 0.855 is 171/200."""
    share = Fraction(str(threshold))
    if not 0 < share <= 1:
        raise ValueError("a threshold lies above 0 and is at most 1")
    return share.numerator, share.denominator


def needed(n: int, share: Share) -> int:
    """Least overlap of a set of n with any set that is similar enough."""
    return -(-share[0] * n // share[1])


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the set's tokens in as many bits as it has tokens, rounded up to a power of two."""
    bits = 1 << max(8, int(len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & _U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the set's tokens in SKETCH_WORDS words."""
    bits = 64 * SKETCH_WORDS
    parity = (np.bincount((s >> _U64(40) & _U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def node_of(s: np.ndarray, seed: int) -> tuple[int, bytes]:
    """(64-bit name of a set, 128-bit digest)"""
    digest = hashlib.blake2b(s.tobytes(), digest_size=16, salt=str(seed).encode()[:16]).digest()
    return int.from_bytes(digest[:8], "little", signed=True), digest


def may_reach(n: int, x: bytes, m: int, y: bytes, share: Share) -> bool:
    """False only if the sets cannot be similar enough.

    Bits that differ are at most the size of the symmetric difference; the longer bitmap folds onto the shorter.
    """
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    apart = int(np.bitwise_count(a ^ b).sum())
    # intersection <= (n + m - apart) / 2 and union >= (n + m + apart) / 2
    return share[1] * (n + m - apart) >= share[0] * (n + m + apart)


def reaches(a: np.ndarray, b: np.ndarray, share: Share) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return share[1] * both >= share[0] * (len(a) + len(b) - both)


# --- pass A: sets, nodes, token counts -------------------------------------------------------------

_PROFILE = "doc_id long, row_key long, n int, node long, digest binary, bitmap binary, sketch array<long>, token_range int, tokens binary, counts binary"


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    tokens, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(tokens, kind="stable")
    tokens, counts = tokens[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    return tokens[first], np.add.reduceat(counts, first)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted parts as one, in up to 128 pieces of rising tokens of `bits` bits, so that little is held twice."""
    marks = np.arange(1, 128, dtype=_U64) << _U64(bits - 7)
    cuts = [np.concatenate([[0], np.searchsorted(t, marks), [len(t)]]) for t, _ in parts]
    for i in range(128):
        some = [(t[c[i] : c[i + 1]], n[c[i] : c[i + 1]]) for (t, n), c in zip(parts, cuts, strict=True) if c[i] < c[i + 1]]
        if some:
            yield _merge(some)


def _profile(k: int, seed: int, bits: int, range_bits: int, with_counts: bool) -> Callable:
    """Rows of two kinds: documents, and token counts by range, summed over a bounded number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=1).compress
        parts: list = []
        held, seen = 0, set()
        names = [f.split()[0] for f in _PROFILE.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary()]

        def counted() -> Iterator[pa.RecordBatch]:
            for tokens, counts in _merged(parts, bits):
                ranges = tokens >> _U64(bits - range_bits)
                cuts = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]])).tolist()
                rows = [(int(ranges[lo]), packed(tokens[lo:hi]), compress(counts[lo:hi].astype("<u4").tobytes())) for lo, hi in zip(cuts, [*cuts[1:], len(tokens)], strict=True)]
                columns = [pa.nulls(len(rows), t) for t in kinds[:7]] + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds[7:], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), k)
            named = [node_of(s, seed) for s in sets]
            digests = [d for _, d in named]
            nodes = [n if len(s) else None for s, (n, _) in zip(sets, named, strict=True)]
            none = [None] * len(sets)
            columns = [batch.column("doc_id"), batch.column("row_key"), [len(s) for s in sets], nodes, digests, [bitmap(s) if len(s) else b"" for s in sets], [sketch(s) for s in sets], none, none, none]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
            if with_counts:
                new = []
                for s, node in zip(sets, nodes, strict=True):
                    if node is not None and node not in seen:
                        seen.add(node)
                        new.append(s)
                if new:
                    t, c = np.unique(np.concatenate(new) >> _U64(64 - bits), return_counts=True)
                    parts.append((t, c.astype(np.uint32)))
                    held += len(t)
                if held > MOST_HELD:
                    yield from counted()
                    parts.clear()
                    seen.clear()  # a set met again counts again, which only changes its tokens' places in the order
                    held = 0
        if parts:
            yield from counted()

    return run


def _count_range(least: int, bits: int, range_bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for i in range(whole.num_rows):
                batch = whole.slice(i, 1)
                base, inner = _U64(batch.column("token_range")[0].as_py() << (bits - range_bits)), bits - range_bits
                parts = []
                for t, c in zip(batch.column("tokens")[0], batch.column("counts")[0], strict=True):
                    parts.append((unpacked(t.as_py()) - base, np.frombuffer(expand(c.as_py()), "<u4")))
                for u, n in _merged(parts, inner):
                    keep = n >= least
                    yield pa.RecordBatch.from_arrays([pa.array((u[keep] + base).astype(np.int64)), pa.array(n[keep].astype(np.int64))], names=["token", "df"])

    return run


def frequent_tokens(profile: DataFrame, bits: int, range_bits: int, least: int = LEAST_FREQUENT, most: int = MAX_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(truncated tokens, classes) of at most `most` tokens: those in at least `least` documents, or in more."""
    blobs = profile.where("token_range is not null").groupBy("token_range").agg(F.collect_list("tokens").alias("tokens"), F.collect_list("counts").alias("counts"))
    table = materialise(blobs.mapInArrow(frugal(_count_range(least, bits, range_bits)), "token long, df long"), "token-counts")
    sizes = table.groupBy(F.floor(F.log2("df") * 2).alias("class")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("class")).collect()  # under 130 rows
    total, lowest = 0, None
    for row in sizes:
        if total + row["n"] > most:
            break
        total, lowest = total + row["n"], row["class"]
    if lowest is None:
        return np.zeros(0, _U64), np.zeros(0, np.uint8)
    rows = table.where(F.floor(F.log2("df") * 2) >= lowest).toPandas()  # at most `most` rows
    tokens = rows["token"].to_numpy(np.int64).astype(_U64)
    order = np.argsort(tokens)
    return tokens[order], np.floor(np.log2(rows["df"].to_numpy(np.float64)[order]) * 2).astype(np.uint8)


# --- pass B: index keys ----------------------------------------------------------------------------


#: Sizes of sets rise by this factor from level to level (a ratio); sets up to SHORT tokens may be indexed by pairs.
LEVEL_RATIO = 1.1
SHORT = 80


def level_of(n: int) -> int:
    """The least level whose largest size is at least n."""
    i = max(0, int(np.log(max(n, 1)) / np.log(LEVEL_RATIO)) - 2)
    while largest(i) < n:
        i += 1
    return i


def largest(level: int) -> int:
    return int(LEVEL_RATIO**level)


def classes_of(level: int, share: Share) -> tuple[int, int]:
    """(classes of tokens, how many of them may be empty) for pairs whose larger set is of this level.

    Such sets differ in at most `apart` tokens; with `spare` classes more than one beyond that, a set with no more than `spare` empty
    classes has one with tokens in which it agrees with any similar set. No classes: similar sets are equal.
    """
    apart = (share[1] - share[0]) * 2 * largest(level) // (share[1] + share[0])
    spare = 1 + apart // 3
    return (apart + 1 + spare, spare) if apart else (0, 0)


class PREFIX_COMBINATIONS:  # noqa: N801  a scheme of candidate keys
    """Keys of a set by rare single tokens and combinations of frequent ones."""

    counts = True

    def __init__(self, share: Share):
        self.share = share

    def keys(self, s: np.ndarray, frequent: np.ndarray, classes: np.ndarray, bits: int) -> tuple[int, int, np.ndarray]:
        """(rare tokens of the set, how many keys are single tokens, keys)."""
        n, t = len(s), needed(len(s), self.share)
        if len(frequent):
            cut = s >> _U64(64 - bits)
            at = np.minimum(np.searchsorted(frequent, cut), len(frequent) - 1)
            often = frequent[at] == cut
        else:
            at, often = np.zeros(n, np.int64), np.zeros(n, bool)
        singles = s[~often]
        n_rare = len(singles)
        if n_rare > n - t:  # the prefix is all rare
            return n_rare, n - t + 1, singles[: n - t + 1]
        tokens = s[often]
        out, short_of = [], False
        for level in range(level_of(n), level_of(n * self.share[1] // self.share[0]) + 1):
            count, spare = classes_of(level, self.share)
            if not count:
                continue
            kind = (splitmix(tokens + _U64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> _U64(32)) * _U64(count) >> _U64(32)
            order = np.argsort(kind, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], kind[order][1:] != kind[order][:-1]]))
            own = kind[order][starts]
            name = splitmix(own + _U64(level << 40))
            out.append(splitmix(np.add.reduceat(splitmix(tokens)[order], starts) * _U64(0xD6E8FEB86659FD93) + name))
            if count - len(own) > spare + n_rare:
                short_of = True
                if n > SHORT:
                    empty = np.setdiff1d(np.arange(count, dtype=_U64), own, assume_unique=True)
                    out.append(splitmix(splitmix(empty + _U64(level << 40)) ^ _U64(0xA0761D6478BD642F)))
        if short_of and n * self.share[0] <= SHORT * self.share[1]:
            if t == 1:  # one token may be all that it shares with its like, a frequent one too
                singles = s
            kinds = classes[at[often]]
            first = tokens[np.lexsort((tokens, kinds))][: n - t + 2 - n_rare]
            i, j = np.triu_indices(len(first), 1)
            out.append(splitmix(first[i] * _U64(0x9E3779B97F4A7C15) + first[j] * _U64(0xC2B2AE3D27D4EB4F)))
        return n_rare, len(singles), np.concatenate([singles, *out])


class SIMILAR_BANDS:  # noqa: N801
    """Keys of a set by bands of MinHash minima."""

    counts = False

    def __init__(self, count: int, band_rows: int):
        self.count, self.band_rows = count, band_rows

    def keys(self, s: np.ndarray, frequent: np.ndarray, classes: np.ndarray, bits: int) -> tuple[int, int, np.ndarray]:
        from .minhash import permutations

        a, b = permutations(self.count)
        least = np.full(self.count, np.iinfo(np.uint64).max, _U64)
        for x in range(0, len(s), 2048):
            least = np.minimum(least, (np.multiply.outer(a, s[x : x + 2048]) + b[:, None]).min(axis=1))
        bands = self.count // self.band_rows
        rows = splitmix(least[: bands * self.band_rows].reshape(bands, self.band_rows) + np.arange(bands, dtype=_U64)[:, None])
        return 0, bands, splitmix((rows * (splitmix(np.arange(self.band_rows, dtype=_U64)) | _U64(1))).sum(axis=1, dtype=_U64))


def _index(scheme, k: int, seed: int, bits: int, frequent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, classes = frequent.value
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            out: list[list] = [[], [], [], [], []]
            for s in shingle_sets(batch.column("text"), k):
                if not len(s):
                    continue
                node = node_of(s, seed)[0]
                if node in seen:
                    continue
                if len(seen) > MOST_HELD:
                    seen.clear()
                seen.add(node)
                rare, singles, keys = scheme.keys(s, tokens, classes, bits)
                for column, value in zip(out, (node, len(s), rare, singles, keys.view(np.int64)), strict=True):
                    column.append(value)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out[4]])]).astype(np.int32)), pa.array(np.concatenate(out[4]) if out[4] else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.int32()) for c in out[1:4]), lists], names=["node", "n", "rare", "singles", "keys"])

    return run


# --- verification ----------------------------------------------------------------------------------


def _filter_pairs(test: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(iter([whole]), "x"):
                keep = [test(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("n", "x", "m", "y")), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return run


def _node_sets(k: int, seed: int) -> Callable:
    """Sets of nodes; a row that only shares the key of a node's row, not its set, is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), k)
            own = [i for i, (s, n) in enumerate(zip(sets, batch.column("node").to_pylist(), strict=True)) if node_of(s, seed)[0] == n]
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(own, pa.int64())), pa.array([sets[i].astype("<u8").tobytes() for i in own], pa.binary())], names=["node", "set"])

    return run


def _similar(rows: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, seed: int, share: Share) -> DataFrame:
    """Of candidate pairs (a, b), a < b: those that reach the threshold."""
    maps = nodes.select("node", "n", "bitmap")
    with_maps = rows.join(maps.toDF("a", "n", "x"), "a").join(maps.toDF("b", "m", "y"), "b")
    hopeful = materialise(with_maps.select("a", "b", "n", "x", "m", "y").mapInArrow(frugal(_filter_pairs(lambda n, x, m, y: may_reach(n, x, m, y, share))), "a long, b long"), "hopeful-pairs")
    used = materialise(hopeful.select(F.col("a").alias("node")).union(hopeful.select("b")).distinct().join(nodes.select("node", "row_key"), "node"), "hopeful-nodes")
    texts = seen_ids(docs, "row_key", used.select("row_key")).join(used, "row_key")
    sets = materialise(texts.select("node", "text").mapInArrow(frugal(_node_sets(k, seed)), "node long, set binary").dropDuplicates(["node"]), "hopeful-sets")
    both = hopeful.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", F.lit(0).alias("n"), "x", F.lit(0).alias("m"), "y")
    test = lambda n, x, m, y: reaches(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), share)
    links = materialise(both.mapInArrow(frugal(_filter_pairs(test)), "a long, b long").distinct(), "links")
    for done in (sets, used, hopeful):
        discard(done)
    return links


# --- components ------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the least node it can reach.

    Large-star and small-star steps in turn until nothing changes. Each step sends a node to the
    least of its neighbours with one aggregation and one join; lineage ends in a written table each round.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "star")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = materialise(small, "star")
        discard(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct())


# --- the operator ----------------------------------------------------------------------------------


def _classes(docs: DataFrame, id_col: str, text_col: str, k: int, threshold: float, scheme) -> DataFrame:
    """doc_id, row_key, n_shingles, label (the class; null without words), component_id for each row.

    row_key is a hash of the row's id and text.
    """
    spark = docs.sparkSession
    share = share_of(threshold)
    scheme = scheme or PREFIX_COMBINATIONS(share)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), row_key(docs, id_col, text_col).alias("row_key"), text_of(docs, text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    range_bits = max(LEAST_RANGE_BITS, int(size // RANGE_BYTES).bit_length())
    # Truncated tokens: at most one in some thousands meets another by chance, which only changes its class.
    bits = min(63, max(40, int(size // 4).bit_length() + 13))
    seed = 0
    while True:
        profile = materialise(rows.mapInArrow(frugal(_profile(k, seed, bits, range_bits, scheme.counts)), _PROFILE), "profile")
        owned = profile.where("token_range is null and n > 0")
        nodes = materialise(owned.groupBy("node").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), *[F.first(F.col("sketch")[i]).alias(c) for i, c in enumerate(SKETCH)], F.min("doc_id").alias("first_doc"), F.min("row_key").alias("row_key"), F.min("digest").alias("d0"), F.max("digest").alias("d1")), "nodes")
        if nodes.where("d0 <> d1").isEmpty():
            break
        seed += 1  # two sets met in 64 bits of their digests
    frequent = spark.sparkContext.broadcast(frequent_tokens(profile, bits, range_bits) if scheme.counts else (np.zeros(0, _U64), np.zeros(0, np.uint8)))
    index = materialise(rows.mapInArrow(frugal(_index(scheme, k, seed, bits, frequent)), "node long, n int, rare int, singles int, keys array<long>").dropDuplicates(["node"]), "index")
    frequent.unpersist()
    links = _links(index, nodes, rows, k, seed, share)
    labels = components(links)
    discard(links)
    firsts = labels.join(nodes.select("node", "first_doc"), "node").groupBy("label").agg(F.min("first_doc").alias("component_id"))
    named = materialise(nodes.select("node", "first_doc").join(labels, "node", "left").join(firsts, "label", "left").select("node", F.coalesce("label", "node").alias("label"), F.coalesce("component_id", "first_doc").alias("component_id")), "classes")
    discard(nodes)
    documents = profile.where("token_range is null").select("doc_id", "row_key", F.col("n").cast("long").alias("n_shingles"), "node")
    return documents.join(named, "node", "left").select("doc_id", "row_key", "n_shingles", "label", F.coalesce("component_id", "doc_id").alias("component_id"))


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.xxhash64(docs[id_col].cast("long"), text_of(docs, text_col))


def link_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, threshold: float = 0.85, scheme=None) -> DataFrame:
    """doc_id, n_shingles, component_id for each row.

    Null text is empty; a text without words links with nothing and is its own class, and so is any row
    without a partner. component_id is the least id in the class, null if all ids there are null. Rows
    alike are one node. Rows that share an id and differ in text are nodes of their own, and so are rows
    without an id. The threshold is a decimal fraction above 0, at most 1, taken as written. An empty table gives no rows.
    """
    return _classes(docs, id_col, text_col, k, threshold, scheme).select("doc_id", "n_shingles", "component_id")


def remove_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, scheme=None) -> DataFrame:
    """Of each class of near duplicates the row with the least id (null last; of one id the one with the least hash). Same columns as docs.

    Rows without words all stay, and rows alike in id and text stay or go together.
    """
    classes = _classes(docs, id_col, text_col, k, threshold, scheme).where("label is not null")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    best = classes.groupBy("label").agg(F.min(rank).alias("best"), F.max(rank).alias("last")).where("best <> last").drop("last")
    dropped = materialise(classes.join(best, "label").where(rank != F.col("best")).select("row_key", "doc_id").distinct(), "near-dropped")
    same = (row_key(docs, id_col, text_col) == dropped["row_key"]) & docs[id_col].cast("long").eqNullSafe(dropped["doc_id"])
    return docs.join(dropped, same, "left_anti")


def _links(index: DataFrame, nodes: DataFrame, rows: DataFrame, k: int, seed: int, share: Share) -> DataFrame:
    entries = index.select("node", "n", "rare", "singles", F.posexplode("keys").alias("pos", "key")).select("node", "n", "rare", (F.col("pos") < F.col("singles")).alias("single"), "key")
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    hits = materialise(entries.join(shared, "key").join(nodes.select("node", *SKETCH), "node"), "hits")
    discard(index)
    best = F.min(F.struct("rare", "node", "n", *SKETCH)).alias("p")
    theirs = {"node": "other", "n": "m", "rare": "other_rare"} | {c: f"other_{c}" for c in SKETCH}
    pivots = materialise(hits.groupBy("key").agg(best).select("key", *[F.col(f"p.{c}").alias(o) for c, o in theirs.items()]), "pivots")
    low, high = (F.lit(x).cast("long") for x in share)
    sizes_allow = F.least("n", "m") * high >= F.greatest("n", "m") * low
    most_apart = (F.col("n") + F.col("m")) * (high - low)  # a link's symmetric difference, times high + low
    by_counts = F.col("rare") + F.col("other_rare") + F.abs((F.col("n") - F.col("rare")) - (F.col("m") - F.col("other_rare")))
    by_sketch = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"other_{c}"))) for c in SKETCH), F.lit(0))
    allowed = sizes_allow & (F.col("single") | (by_counts * (high + low) <= most_apart)) & (by_sketch * (high + low) <= most_apart)
    pair = (F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    star = hits.join(pivots, "key").where(F.col("node") != F.col("other")).where(allowed).select(*pair).distinct()
    links = _similar(star, nodes, rows, k, seed, share)
    # What the pivots left outside their component meets the rest of its buckets.
    labels = materialise(components(links), "labels")
    marked = hits.join(pivots.select("key", F.col("other").alias("pivot")), "key").where("node <> pivot").join(labels.toDF("node", "label"), "node", "left").join(labels.toDF("pivot", "pivot_label"), "pivot", "left")
    marked = materialise(marked.select("key", "single", *theirs, F.coalesce("label", "node").alias("label"), F.coalesce("pivot_label", "pivot").alias("pivot_label")), "marked")
    outside = marked.where("label <> pivot_label").drop("pivot_label")
    rest = marked.select("key", F.col("label").alias("other_label"), *[F.col(c).alias(o) for c, o in theirs.items()])
    cross = outside.join(rest, "key").where("label <> other_label").where(allowed).select(*pair).distinct()
    more = _similar(cross, nodes, rows, k, seed, share)
    both = materialise(links.unionByName(more), "all-links")
    for done in (hits, pivots, labels, marked, links, more):
        discard(done)
    return both
