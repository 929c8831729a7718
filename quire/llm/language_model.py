"""A quality classifier: interpolated modified Kneser-Ney n-grams of UTF-8 bytes, trained on trusted text.

Trusted rows are split by id: most give counts, a fifth calibrates. Counts of all their n-grams of the
highest order are gathered by key; continuation counts, context totals, discounts and interpolated
probabilities follow by joins of count tables. Probabilities of orders 1 and 2 are dense (256 symbols).
Those of higher orders are cut by the two symbols before the last, which every table that a position
needs has in common, into shards of bounded size.

Scores are sharded count joins. Each run of texts (a chunk) sends every shard its distinct n-grams once,
sorted and packed; a shard answers with their log probabilities; the answers meet the chunk's rows again and are
summed over the places of each text. So no task, and never the driver, holds more of the model than a shard.
A document whose perplexity is above its language's quantile of trusted text is rejected.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import discard, fresh, frugal, materialise, partition_id, seen_ids, slices, text_of
from .hashing import packed, unpacked
from .shingles import utf8

#: ORDER is the classifier's; single functions take any from 3 to 7.
ORDER, SYMBOLS = 6, 256
#: Stands before each text; no byte of UTF-8.
PAD = 255
#: Entries of a shard; one more pair of middle symbols may come on top (at most SYMBOLS**4 entries at order 6).
SHARD_ROWS = 500_000
#: Text whose n-grams are asked for together, and chunks that one copy of a shard answers.
CHUNK_BYTES, CHUNKS_A_COPY = 32 << 20, 2048
#: Distinct n-grams counted in a worker before it hands them on.
MOST_HELD = 1_000_000
#: Log probabilities travel in steps of 1 / STEPS, as 16 bits; none is below -32.
STEPS = 1024
#: Share of trusted text that stays below the threshold: on held-out labels the least sum of both error rates (README).
KEEP_QUANTILE = 0.98
#: Bytes of its language's mean perplexity that each document is given, so that short ones vary less.
PRIOR_BYTES = 200
#: Calibration documents of all languages that each language is given, so that rare ones lean on the others.
PRIOR_ROWS = 10
_PAIR = (1 << 16) - 1
_ROWS = -1


def symbols(texts: pa.Array, order: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with order - 1 PADs before each text, where each text's PADs begin and the end); no nulls."""
    data, offsets = utf8(texts)
    at = offsets + (order - 1) * np.arange(len(offsets))
    codes = np.full(at[-1], PAD, np.uint8)
    codes[np.arange(len(data)) + np.repeat((order - 1) * np.arange(1, len(texts) + 1), np.diff(offsets))] = data
    return codes, at


def grams(codes: np.ndarray, order: int = 4) -> np.ndarray:
    """The n-gram that ends at each place from order - 1 on."""
    n = max(0, len(codes) - order + 1)
    out = np.zeros(n, np.int64)
    for k in range(order):
        out <<= 8
        out |= codes[k : k + n]
    return out


def inside(at: np.ndarray, n: int, order: int = 4) -> np.ndarray:
    """Which of n grams end inside a text and not in the PADs between texts."""
    ok = np.ones(n, bool)
    for k in range(order - 1):
        later = at[1:-1] + k - (order - 1)
        ok[later[(later >= 0) & (later < n)]] = False
    return ok


def _strings(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.string()), "")


def _count(batches: Iterator[pa.RecordBatch], order: int = 4) -> Iterator[pa.RecordBatch]:
    """Calibration rows as they are; of the others n-gram counts, summed over a bounded number of n-grams."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    names = ["gram", "c", "lang", "text"]

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts), pa.nulls(len(keys), pa.string()), pa.nulls(len(keys), pa.string())], names=names)

    for batch in slices(batches, "text"):
        calibrates = batch.column("calibrates")
        kept = batch.filter(calibrates)
        if kept.num_rows:
            none = pa.nulls(kept.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, kept.column("lang"), kept.column("text")], names=names)
        codes, at = symbols(_strings(batch.filter(pc.invert(calibrates)).column("text")), order)
        g = grams(codes, order)
        if len(g):
            new, n = np.unique(g[inside(at, len(g), order)], return_counts=True)
            both, sums = np.concatenate([keys, new]), np.concatenate([counts, n])
            keys, where = np.unique(both, return_inverse=True)
            counts = np.bincount(where, sums, len(keys)).astype(np.int64)
        if len(keys) > MOST_HELD:
            yield done()
            keys, counts = keys[:0], counts[:0]
    if len(keys):
        yield done()


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the counts of counts."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(float(min(max(d, 0.05 * (i + 1)), 0.95 * (i + 1))) for i, d in enumerate(raw))


def _counts_of_counts(level: DataFrame) -> tuple[float, float, float]:
    row = level.agg(*[F.coalesce(F.sum((F.col("c") == k).cast("long")), F.lit(0)) for k in (1, 2, 3, 4)]).first()
    return discounts(*row)


def _discount(d: tuple[float, float, float]) -> Column:
    return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


@dataclass
class HashTable:
    """64-bit keys to float32 values by open addressing, looked up by whole arrays."""

    keys: np.ndarray
    values: np.ndarray
    bits: int

    @classmethod
    def make(cls, keys: np.ndarray, values: np.ndarray) -> HashTable:
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        out = cls(np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32), bits)
        todo, slot = np.arange(len(keys)), out._slot(keys)
        while len(todo):
            free = out.keys[slot] == -1
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            out.keys[slot[put]] = keys[todo[put]]
            out.values[slot[put]] = values[todo[put]]
            todo, slot = todo[~put], (slot[~put] + 1) & ((1 << bits) - 1)
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray, absent: float) -> np.ndarray:
        out = np.full(len(keys), absent, np.float32)
        slot = self._slot(keys)
        got = self.keys[slot]
        hit = got == keys
        out[hit] = self.values[slot[hit]]
        todo = np.flatnonzero(~hit & (got != -1))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot]
            hit = got == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (got != -1)
            todo, slot = todo[go], slot[go]
        return out


@dataclass
class Shard:
    order: int
    p: dict[int, HashTable]  # order -> log probability of seen grams, below the highest order by continuation
    back: dict[int, HashTable]  # length -> log weight that a seen context leaves to the order of its length
    back2: np.ndarray  # dense: of contexts of two to order 2
    p2: np.ndarray  # dense: order 2, interpolated with 1

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Of n-grams whose middle pair this shard has."""
        out = np.zeros(len(keys), np.float64)
        places = np.arange(len(keys))
        for o in range(self.order, 2, -1):
            found = self.p[o].find(keys & ((1 << 8 * o) - 1), np.nan)
            miss = np.isnan(found)
            out[places[~miss]] += found[~miss]
            places, keys = places[miss], keys[miss]
            context = (keys >> 8) & ((1 << 8 * (o - 1)) - 1)
            out[places] += self.back[o - 1].find(context, 0.0) if o > 3 else self.back2[context]
        out[places] += self.p2[keys & _PAIR]
        return out


#: What a row of a shard's stream is: tables come before the questions they answer.
_P, _BACK, _ASKED = 0, 100, 200


class Model:
    """Tables of interpolated probabilities, cut into shards."""

    def __init__(self, order: int, p: dict[int, DataFrame], back: dict[int, DataFrame], back2: np.ndarray, p2: np.ndarray):
        self.order = order
        self.tables = {_P + o: (df, F.shiftright("gram", 8).bitwiseAND(_PAIR)) for o, df in p.items()}
        self.tables |= {_BACK + n: (df, F.col("gram").bitwiseAND(_PAIR)) for n, df in back.items()}
        self.back2, self.p2 = back2, p2
        sizes = np.zeros(_PAIR + 1, np.int64)
        pairs = reduce(DataFrame.unionByName, [df.select(pair.cast("int").alias("pair")) for df, pair in self.tables.values()])
        found = pairs.groupBy("pair").count().toPandas()  # at most 65,536 rows
        sizes[found["pair"].to_numpy(np.int64)] = found["count"]
        self.bins = np.zeros(_PAIR + 1, np.int32)
        held = current = 0
        for pair in np.flatnonzero(sizes):
            if held and held + sizes[pair] > SHARD_ROWS:
                current, held = current + 1, 0
            self.bins[pair], held = current, held + sizes[pair]
        self.n_shards = current + 1

    def rows(self) -> DataFrame:
        """shard, kind, gram, value of all tables."""
        spark = next(iter(self.tables.values()))[0].sparkSession
        binned = F.broadcast(spark.createDataFrame(pd.DataFrame({"pair": np.arange(_PAIR + 1), "shard": self.bins})))  # 65,536 rows
        rows = [df.select(F.lit(kind).alias("kind"), "gram", F.col("value").cast("float").alias("value"), pair.cast("long").alias("pair")) for kind, (df, pair) in self.tables.items()]
        return reduce(DataFrame.unionByName, rows).join(binned, "pair").select("shard", "kind", "gram", "value")

    def discard(self) -> None:
        for df, _ in self.tables.values():
            discard(df)


def train(counts: DataFrame, order: int = 4) -> Model:
    """The model of a table of n-gram counts (gram, c) of the given order."""
    g = {order: materialise(counts.groupBy("gram").agg(F.sum("c").alias("c")), f"grams-{order}")}
    for o in range(order - 1, 2, -1):
        g[o] = materialise(g[o + 1].groupBy(F.col("gram").bitwiseAND((1 << 8 * o) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("c")), f"grams-{o}")
    two = g[3].groupBy(F.col("gram").bitwiseAND(_PAIR).alias("gram")).agg(F.count(F.lit(1)).alias("c")).toPandas()  # at most 65,536 rows

    # Orders 1 and 2, dense.
    c2 = np.zeros(SYMBOLS * SYMBOLS)
    c2[two["gram"].to_numpy(np.int64)] = two["c"]
    c2 = c2.reshape(SYMBOLS, SYMBOLS)
    c1 = (c2 > 0).sum(axis=0).astype(float)

    def interpolated(c: np.ndarray, lower: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *discounts(*[int((c == k).sum()) for k in (1, 2, 3, 4)])])[np.minimum(c, 3).astype(int)]
        total = c.sum(axis=-1, keepdims=True)
        whole = np.maximum(total, 1)
        return np.where(total > 0, (c - d) / whole + d.sum(axis=-1, keepdims=True) / whole * lower, lower)

    p1 = interpolated(c1, np.full(SYMBOLS, 1 / SYMBOLS))
    p2 = interpolated(c2, np.broadcast_to(p1, (SYMBOLS, SYMBOLS)))

    context = F.shiftright("gram", 8)

    def contexts(level: DataFrame, d: tuple[float, float, float]) -> DataFrame:
        return level.groupBy(context.alias("context")).agg(F.sum("c").alias("total"), F.sum(_discount(d)).alias("freed"))

    spark = counts.sparkSession
    lower = F.broadcast(spark.createDataFrame(pd.DataFrame({"low": np.arange(SYMBOLS * SYMBOLS), "low_p": p2.ravel()})))
    p, back = {}, {}
    for o in range(3, order + 1):
        d = _counts_of_counts(g[o])
        left = contexts(g[o], d)
        by = g[o].withColumns({"context": context, "low": F.col("gram").bitwiseAND((1 << 8 * (o - 1)) - 1)}).join(left, "context").join(lower, "low")
        p[o] = materialise(by.select("gram", F.log((F.col("c") - _discount(d) + F.col("freed") * F.col("low_p")) / F.col("total")).cast("float").alias("value")), f"p{o}")
        lower = p[o].select(F.col("gram").alias("low"), F.exp("value").alias("low_p"))
        if o == 3:
            two_back = left.toPandas()  # at most 65,536 rows
        else:
            back[o - 1] = materialise(left.select(F.col("context").alias("gram"), F.log(F.col("freed") / F.col("total")).cast("float").alias("value")), f"back{o - 1}")
    back2 = np.zeros(SYMBOLS * SYMBOLS, np.float32)
    back2[two_back["context"].to_numpy(np.int64)] = np.log(two_back["freed"] / two_back["total"])
    for df in g.values():
        discard(df)
    return Model(order, p, back, back2, np.log(p2).astype(np.float32).ravel())


class Grams:
    """The distinct n-grams of a chunk whose texts come in slices; no more than some slices' are held twice."""

    def __init__(self, order: int):
        self.order, self.every, self.parts, self.held = order, np.zeros(0, np.int64), [], 0

    def add(self, texts: pa.Array) -> None:
        codes, at = symbols(texts, self.order)
        g = grams(codes, self.order)
        self.parts.append(np.unique(g[inside(at, len(g), self.order)], sorted=False))
        self.held += len(self.parts[-1])
        if self.held > max(MOST_HELD, len(self.every)):
            self.merge()

    def merge(self) -> None:
        self.every, self.parts, self.held = np.unique(np.concatenate([self.every, *self.parts])), [], 0

    def by_shard(self, bins: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, its n-grams in order) for each shard that has some."""
        self.merge()
        shard = bins[self.every >> 8 & _PAIR]
        for i in np.unique(shard).tolist():
            yield i, self.every[shard == i]


_CHUNKS = "chunk long, kind int, place int, content binary"


def _ask(bins: np.ndarray, order: int, column: str):
    """Rows of two kinds, by chunk: a shard's questions (packed n-grams), and the chunk's rows as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=6).compress  # texts lie in the shared folder and move once

        def row(kind: int, place: int, content: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([kind], pa.int32()), pa.array([place], pa.int32()), pa.array([content], pa.binary())], names=["chunk", "kind", "place", "content"])

        chunk, found, place, size = partition_id() << 32, Grams(order), 0, 0
        for batch in slices(batches, column):
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield row(_ROWS, place, compress(sink.getvalue()))
            texts = _strings(batch.column(column))
            found.add(texts)
            place, size = place + 1, size + texts.nbytes
            if size >= CHUNK_BYTES:
                for i, keys in found.by_shard(bins):
                    yield row(_ASKED, i, packed(keys))
                chunk, found, place, size = chunk + 1, Grams(order), 0, 0
        if place:
            for i, keys in found.by_shard(bins):
                yield row(_ASKED, i, packed(keys))

    return run


def _answer(order: int, back2: np.ndarray, p2: np.ndarray):
    """Log probabilities of what each chunk asks a shard for. A shard's tables come first, then its questions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=3).compress
        at, parts, shard = None, {}, None

        def built() -> Shard:
            none = (np.zeros(0, np.int64), np.zeros(0, np.float32))
            tables = {kind: HashTable.make(*(np.concatenate(x) for x in zip(*rows, strict=True))) for kind, rows in parts.items()}
            parts.clear()
            at_least = lambda kind: tables.get(kind) or HashTable.make(*none)
            return Shard(order, {o: at_least(_P + o) for o in range(3, order + 1)}, {n: at_least(_BACK + n) for n in range(3, order)}, back2, p2)

        for batch in batches:
            if not batch.num_rows:
                continue
            where = np.stack([batch.column(c).to_numpy() for c in ("shard", "copy", "kind")])
            cuts = np.flatnonzero(np.concatenate([[True], (np.diff(where) != 0).any(axis=0)])).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                *own, kind = where[:, lo].tolist()
                if own != at:
                    at, shard = own, None
                    parts.clear()
                some = batch.slice(lo, hi - lo)
                if kind != _ASKED:
                    parts.setdefault(kind, []).append((some.column("gram").to_numpy().copy(), some.column("value").to_numpy().copy()))
                    continue
                shard = shard or built()
                for chunk, content in zip(some.column("chunk").to_pylist(), some.column("content").to_pylist(), strict=True):
                    found = np.maximum(shard.log_probabilities(unpacked(content).view(np.int64)) * -STEPS, 0)
                    reply = compress(np.minimum(np.rint(found), 32 * STEPS - 1).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([0], pa.int32()), pa.array([own[0]], pa.int32()), pa.array([reply], pa.binary())], names=["chunk", "kind", "place", "content"])

    return run


def _sum(bins: np.ndarray, order: int, column: str, names: list[str]):
    """A chunk's answers come first, by shard, then its rows: each row with the sum over its text's places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress

        def summed(replies: dict[int, bytes], rows: list[bytes]) -> Iterator[pa.RecordBatch]:
            opened = lambda: (b for content in rows for b in pa.ipc.open_stream(expand(content)))  # noqa: E731  read twice, not held
            found, keys, values = Grams(order), [], []
            for b in opened():
                found.add(_strings(b.column(column)))
            for i, some in found.by_shard(bins):
                reply = np.frombuffer(expand(replies[i]), np.uint8).reshape(2, -1).T
                if len(reply) != len(some):
                    raise ValueError("a shard's answer does not fit its question")
                keys.append(some)
                values.append(np.ascontiguousarray(reply).view("<u2").ravel())
            table = HashTable.make(np.concatenate(keys), np.concatenate(values) / np.float32(-STEPS)) if keys else None
            for batch in opened():
                codes, at = symbols(_strings(batch.column(column)), order)
                g = grams(codes, order)
                ok = inside(at, len(g), order)
                each = np.zeros(len(g))
                if ok.any():
                    each[ok] = table.find(g[ok], np.nan)
                total = np.concatenate([[0.0], np.cumsum(each)])
                sums = total[np.minimum(at[1:] - (order - 1), len(g)).clip(0)] - total[np.minimum(at[:-1], len(g))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums)], names=names)

        chunk, replies, rows = None, {}, []
        for batch in batches:
            for own, kind, place, content in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "place", "content")), strict=True):
                if own != chunk:
                    if rows:
                        yield from summed(replies, rows)
                    chunk, replies, rows = own, {}, []
                if kind == 0:
                    replies[place] = content
                else:
                    rows.append(content)
        if rows:
            yield from summed(replies, rows)

    return run


def add_log_probability(docs: DataFrame, model: Model, text_col: str = "text", to: str = "_lm") -> DataFrame:
    """docs with `to` (summed log probability of the text's bytes) added; null counts as empty, 0."""
    return _scored(docs, model, text_col, to)[0]


def _scored(docs: DataFrame, model: Model, text_col: str, to: str) -> tuple[DataFrame, list[DataFrame]]:
    """The scored rows and the staged tables that they are read from."""
    order, bins = model.order, model.bins
    asked = materialise(docs.mapInArrow(frugal(_ask(bins, order, text_col)), _CHUNKS), "lm-chunks", by="kind")
    questions = asked.where(F.col("kind") == _ASKED)
    copies = max(1, -(-questions.count() // (model.n_shards * CHUNKS_A_COPY)))
    tables = model.rows().withColumns({"copy": F.explode(F.sequence(F.lit(0), F.lit(copies - 1))), "chunk": F.lit(0).cast("long"), "content": F.lit(None).cast("binary")})
    asks = questions.select(F.col("place").alias("shard"), "kind", F.lit(0).cast("long").alias("gram"), F.lit(0).cast("float").alias("value"), F.pmod(F.hash("chunk"), F.lit(copies)).alias("copy"), "chunk", "content")
    stream = tables.unionByName(asks).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    answers = materialise(stream.mapInArrow(frugal(_answer(order, model.back2, model.p2)), _CHUNKS), "lm-answers")
    discard(asked, f"kind={_ASKED}")
    rows = asked.where(F.col("kind") == _ROWS).select("chunk", F.lit(1).alias("kind"), "place", "content")
    both = answers.unionByName(rows).repartition("chunk").sortWithinPartitions("chunk", "kind", "place")
    kinds = StructType(docs.schema.fields.copy()).add(to, DoubleType())
    return both.mapInArrow(frugal(_sum(bins, order, text_col, [*docs.columns, to])), kinds), [asked, answers]


def calibration_row(id_col: Column) -> Column:
    """The fifth of trusted rows that sets thresholds instead of giving counts."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


@dataclass
class Classifier:
    model: Model | None
    thresholds: DataFrame | None  # lang_key, mean, threshold
    mean: float
    threshold: float


def _key(lang: Column) -> Column:
    return F.when(lang.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), lang.cast("string")))


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = KEEP_QUANTILE, order: int = ORDER) -> Classifier:
    """A classifier from the rows of docs whose id is in `trusted` (one column of ids). All of them are used."""
    ids = trusted.toDF("id").where("id is not null").distinct()
    rows = docs.select(docs[id_col].alias("id"), docs[lang_col].alias("lang"), text_of(docs, text_col).alias("text"))
    # Texts of other rows stay where they are; a merge join at every size, as labels grow with the corpus.
    rows = seen_ids(rows, "id", ids).join(ids.hint("merge"), "id").select("lang", "text", calibration_row(F.col("id")).alias("calibrates"))
    gathered = materialise(rows.mapInArrow(frugal(partial(_count, order=order)), "gram long, c long, lang string, text string"), "lm-counts")
    counts = gathered.where("gram is not null").select("gram", "c")
    if counts.isEmpty():
        return Classifier(None, None, 0.0, float("inf"))
    model = train(counts, order)
    held, staged = _scored(gathered.where("gram is null").select("lang", "text"), model, "text", "_lm")
    held = materialise(held.select(_key(F.col("lang")).alias("lang_key"), (-F.col("_lm")).alias("cost"), F.octet_length("text").alias("n")), "lm-calibration")
    for done in (gathered, *staged):
        discard(done)
    total = held.agg(F.sum("cost") / F.sum("n")).first()[0]
    if total is None:
        return Classifier(model, None, 0.0, float("inf"))
    score = lambda mean: (F.col("cost") + PRIOR_BYTES * mean) / (F.col("n") + PRIOR_BYTES)
    means = held.groupBy("lang_key").agg(((F.sum("cost") + PRIOR_BYTES * total) / (F.sum("n") + PRIOR_BYTES)).alias("mean"))
    everyone = held.agg(F.percentile_approx(score(F.lit(total)), quantile, 100_000)).first()[0]
    top = F.percentile_approx(score(F.col("mean")), quantile, 100_000)
    n = F.count(F.lit(1))
    thresholds = held.join(means, "lang_key").groupBy("lang_key").agg(F.first("mean").alias("mean"), ((n * top + PRIOR_ROWS * everyone) / (n + PRIOR_ROWS)).alias("threshold"))
    thresholds = materialise(thresholds, "lm-thresholds")
    discard(held)
    return Classifier(model, thresholds, float(total), float(everyone))


def classify(docs: DataFrame, classifier: Classifier, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with log_perplexity (per byte, with the prior), threshold and kept added; columns of these names are replaced.

    Null text is empty and scores its language's mean; a null language is one of its own, and one without
    trusted rows has the threshold of all. Without trusted text everything is kept. Rows alike score
    alike; an empty table gives no rows.
    """
    docs = docs.drop("log_perplexity", "threshold", "kept")
    if classifier.model is None:
        return docs.withColumns({"log_perplexity": F.lit(None).cast("double"), "threshold": F.lit(None).cast("double"), "kept": F.lit(True)})
    names = docs.columns
    lm, key, mean, top = fresh(names, "_lm"), fresh(names, "_lang_key"), fresh(names, "_mean"), fresh(names, "_threshold")
    out = add_log_probability(docs, classifier.model, text_col, lm)
    if classifier.thresholds is None:
        out = out.withColumns({mean: F.lit(classifier.mean), top: F.lit(classifier.threshold)})
    else:
        table = classifier.thresholds.select(F.col("lang_key").alias(key), F.col("mean").alias(mean), F.col("threshold").alias(top))
        out = out.join(table, _key(out[lang_col]) == table[key], "left")
        out = out.withColumns({mean: F.coalesce(mean, F.lit(classifier.mean)), top: F.coalesce(top, F.lit(classifier.threshold))})
    n = F.octet_length(text_of(out, text_col))
    score = (-F.col(lm) + PRIOR_BYTES * F.col(mean)) / (n + PRIOR_BYTES)
    return out.select(*[F.col(f"`{c}`") for c in names], score.alias("log_perplexity"), F.col(top).alias("threshold"), (score <= F.col(top)).alias("kept"))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
