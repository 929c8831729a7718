"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's rows fall into hash blocks. A source's target fixes how many whole passes over its
blocks and which part of one more pass the mix takes, to within a small document: its quota of blocks. A
binary tree over the output shards splits the vector of quotas: each node draws how many blocks of
each source go left from the multivariate hypergeometric distribution, so shards are as random as if all
blocks had been dealt at once, and the quotas come out exactly. A shard then owns a range of each
source's permuted blocks, disjoint from all others, and shuffles its rows locally.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_REGEX, materialise, null_safe, text_of

BLOCK_WORDS, MAX_BLOCKS, MAX_REPEATS = 4096, 4096, 3
#: Bound of the rows that the driver holds and broadcasts, one for each source; more are an error, not a sample.
MAX_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_REGEX)).cast("long")


def cycle_weights(keys: list[str]) -> list[int]:
    """1, 2, 3 in turn."""
    return [1 + i % 3 for i in range(len(keys))]


def targets(sizes: list[int], weights: list[int], total: int | None = None, repeats: int = MAX_REPEATS) -> list[Fraction]:
    """Shares of `total` (the sum of sizes) by weight; none above repeats * size, the excess shared again by weight."""
    left = Fraction(sum(sizes) if total is None else total)
    out: dict[int, Fraction] = {}
    active = list(range(len(sizes)))
    while active:
        whole = sum(weights[i] for i in active)
        share = {i: left * weights[i] / whole if whole else Fraction(0) for i in active}
        over = [i for i in active if share[i] > repeats * sizes[i]]
        if not over:
            out |= share
            break
        for i in over:
            out[i] = Fraction(repeats * sizes[i])
            left -= out[i]
        active = [i for i in active if i not in set(over)]
    return [out[i] for i in range(len(sizes))]


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): blocks of each source for each shard. Columns sum to the quotas; rows are equal to within one block."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def descend(node: int, lo: int, hi: int, quota: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = quota
            return
        mid = (lo + hi) // 2
        total = int(quota.sum())
        left_total = total * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, node]).multivariate_hypergeometric(quota, left_total, method="marginals") if total else quota * 0
        descend(2 * node, lo, mid, left)
        descend(2 * node + 1, mid, hi, quota - left)

    descend(1, 0, shards, np.asarray(quotas, np.int64))
    return out


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=cycle_weights, shards: int = 8, seed: int = 11, repeats: int = MAX_REPEATS) -> DataFrame:
    """docs with size, source_size, target and draws added: draws lists (epoch, shard) for each time the row is taken.

    Columns of these names are replaced. Size is the number of words, of null text 0. Rows of size 0 are
    taken with their block, the one that the target cuts included, and count nothing. Null is a source, the last one. Rows alike fall into one
    block and tie; which of them an edge takes is open, but they are alike. One summary row per source reaches the
    driver, at most MAX_SOURCES. An empty table gives no rows.
    """
    added = ["size", "source_size", "target", "draws"]
    planned = _plan(docs, id_col, text_col, source_col, weights, shards, seed, repeats)
    return planned.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in added], *added)


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, shards: int, seed: int, repeats: int) -> DataFrame:
    """_row (the whole row of docs), _key (a hash of id and text), size, source_size, target, draws."""
    spark = docs.sparkSession
    text = text_of(docs, text_col)
    row_hash = F.xxhash64(docs[id_col], text, F.lit(seed))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), word_count(text).alias("size"), null_safe(docs[source_col]).alias("_source"), row_hash.alias("_hash"))
    # Words are counted once for the plan: rows alike are one row here, of their summed size.
    sizes_of = materialise(rows.groupBy("_source", "_hash").agg(F.sum("size").alias("size")), "mix-sizes")
    found = sizes_of.groupBy("_source").agg(F.sum("size").alias("s")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them first")
    # Sources by code point, null last.
    sizes = {r["_source"]: r["s"] for r in found}
    names = sorted(sizes, key=lambda s: (s == "0", s))
    size = [sizes[s] for s in names]
    target = targets(size, weights(names), repeats=repeats)
    blocks_of = [int(max(1, min(MAX_BLOCKS, -(-s // BLOCK_WORDS)))) for s in size]
    passes = [int(t // s) if s else 0 for t, s in zip(target, size, strict=True)]
    rest = [float(t - p * s) for t, p, s in zip(target, passes, size, strict=True)]
    plan = spark.createDataFrame(
        list(zip(names, size, [float(t) for t in target], blocks_of, passes, rest, strict=True)),
        "_source string, source_size long, target double, _blocks long, _passes int, _rest double",
    )
    plan = F.broadcast(plan)  # at most MAX_SOURCES rows, made on the driver
    rows = rows.join(plan, "_source").withColumn("_block", F.pmod("_hash", "_blocks"))
    sizes_of = sizes_of.join(plan, "_source").withColumn("_block", F.pmod("_hash", "_blocks"))

    # Whole blocks of the last pass, and the one that its end cuts: at most MAX_BLOCKS rows a source, however large it is.
    sums = materialise(sizes_of.groupBy("_source", "_block", "_blocks", "_passes", "_rest").agg(F.sum("size").alias("_words")), "mix-blocks")
    order = F.xxhash64("_source", "_block", "_passes", F.lit(seed))
    last = Window.partitionBy("_source").orderBy(order, "_block")
    sums = sums.withColumns({"_upto": F.sum("_words").over(last), "_rank": F.row_number().over(last)})
    cut_rank = F.min(F.when(F.col("_upto") > F.col("_rest"), F.col("_rank"))).over(Window.partitionBy("_source"))
    sums = sums.withColumn("_cut", F.when(F.col("_rest") > 0, cut_rank))
    part = F.when(F.col("_cut").isNull(), F.when(F.col("_upto") <= F.col("_rest"), "whole").otherwise("none"))
    part = part.when(F.col("_rank") < F.col("_cut"), "whole").when(F.col("_rank") == F.col("_cut"), "cut").otherwise("later")
    room = F.max(F.when(F.col("_rank") == F.col("_cut"), F.col("_rest") - (F.col("_upto") - F.col("_words")))).over(Window.partitionBy("_source"))
    sums = materialise(sums.withColumn("_part", part).withColumn("_room", room), "mix-parts")

    # The end of a target: documents of the cut block in hash order up to the end, by a running sum that can spill;
    # then whole documents from it and all later blocks, while they fit. Only sizes are gathered.
    tail = sums.where("_part in ('cut', 'later')").select("_source", "_block", "_rank", "_cut", "_room")
    sized = sizes_of.where("size > 0").select("_source", "_block", "_hash", "size")
    edge = F.broadcast(tail.where("_rank = _cut").select("_source", "_block", "_room"))  # one row a source
    running = F.sum("size").over(Window.partitionBy("_source").orderBy("_hash"))
    taken = sized.join(edge, ["_source", "_block"]).withColumn("_upto", running).where("_upto <= _room").select("_source", "_block", "_hash", "size")
    taken = materialise(taken, "mix-edge")
    kinds = "_source string, _block long, _hash long, size long"
    taken = materialise(taken.unionByName(_rest_of_room(sized, tail, taken).groupBy("_source").applyInPandas(_fill, kinds)), "mix-taken")
    met = taken.select("_source", "_block").distinct().withColumn("_met", F.lit(True))
    sums = sums.join(met, ["_source", "_block"], "left")
    sums = sums.withColumn("_part", F.when(F.col("_part") != "later", F.col("_part")).when(F.col("_met"), "edge").otherwise("none")).drop("_met", "_cut", "_room")
    taken = taken.drop("size").withColumn("_in", F.lit(True))

    # Draws: each pass has its own permutation of the blocks; draw numbers run through the passes.
    drawn = sums.withColumn("_epoch", F.explode(F.sequence(F.lit(0), "_passes"))).where((F.col("_epoch") < F.col("_passes")) | (F.col("_part") != "none"))
    place = F.row_number().over(Window.partitionBy("_source", "_epoch").orderBy(F.xxhash64("_source", "_block", "_epoch", F.lit(seed)), "_block"))
    number = F.row_number().over(Window.partitionBy("_source").orderBy("_epoch", "_place")) - 1
    drawn = materialise(drawn.withColumn("_place", place).withColumn("_number", number), "mix-draws")
    quota = {r["_source"]: r["n"] for r in drawn.groupBy("_source").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = split_quotas(np.array([quota.get(s, 0) for s in names], np.int64), shards, seed) if names else np.zeros((shards, 0), np.int64)
    ends = np.cumsum(counts, axis=0)
    ranges = spark.createDataFrame([(s, ends[:, i].tolist()) for i, s in enumerate(names)], "_source string, _ends array<long>")
    shard = F.size(F.filter("_ends", lambda e: e <= F.col("_number")))
    dealt = drawn.join(F.broadcast(ranges), "_source").groupBy("_source", "_block").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_epoch").alias("epoch"), shard.alias("shard")))).alias("draws"), F.first("_part").alias("_part")
    )
    dealt = materialise(dealt, "mix-dealt")
    rows = rows.join(dealt, ["_source", "_block"], "left").withColumn("draws", F.coalesce("draws", F.array().cast("array<struct<epoch:int,shard:int>>")))
    keep = ["_row", F.col("_hash").alias("_key"), "size", "source_size", "target", "draws"]
    plain = rows.where("_part is null or _part not in ('cut', 'edge')")
    cut = rows.where("_part in ('cut', 'edge')").join(taken, ["_source", "_block", "_hash"], "left")
    cut = cut.withColumn("draws", F.when(F.col("_in") | ((F.col("_part") == "cut") & (F.col("size") == 0)), F.col("draws")).otherwise(F.filter("draws", lambda d: d["epoch"] < F.col("_passes"))))
    return plain.select(*keep).unionByName(cut.select(*keep))


def _rest_of_room(sized: DataFrame, tail: DataFrame, taken: DataFrame) -> DataFrame:
    """Rivals for the room that the cut block's first documents leave, from all blocks of the tail: what may still be taken, no more.

    If a document does not fit, no later one of its size does; so of each size the first room / size + 1
    are enough. The one more may come nearest to the end.
    """
    used = taken.groupBy("_source").agg(F.sum("size").alias("_used"))
    left = tail.where("_rank = _cut").select("_source", "_room").join(used, "_source", "left").select("_source", (F.col("_room") - F.coalesce("_used", F.lit(0))).alias("_room"))
    may = sized.join(F.broadcast(left), "_source").where(F.col("size") < 2 * F.col("_room"))  # one row a source
    may = may.join(tail.select("_source", "_block", "_rank"), ["_source", "_block"]).join(taken.select("_source", "_block", "_hash"), ["_source", "_block", "_hash"], "left_anti")
    # Counts by block first (at most MAX_BLOCKS rows a size), so that only documents of the blocks in question are put in order.
    held = may.groupBy("_source", "size", "_block", "_rank", "_room").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_source", "size").orderBy("_rank")) - F.col("_n")
    enough = F.floor(F.col("_room") / F.col("size"))
    first = held.withColumn("_before", before).where(F.col("_before") <= enough).select("_source", "size", "_block")
    place = F.row_number().over(Window.partitionBy("_source", "size").orderBy("_rank", "_hash"))
    return may.join(first, ["_source", "size", "_block"]).withColumn("_place", place).where(F.col("_place") <= enough + 1).drop("_place")


def _fill(rivals: pd.DataFrame) -> pd.DataFrame:
    """The rivals that a source's last words go to: in order while they fit, then the one that comes nearest."""
    rivals = rivals.sort_values(["_rank", "_hash"])
    sizes, room, take = rivals["size"].to_numpy(), float(rivals["_room"].iloc[0]), np.zeros(len(rivals), bool)
    for i, size in enumerate(sizes.tolist()):
        if size <= room:
            take[i], room = True, room - size
    left = np.where(take, np.inf, np.abs(sizes - room))
    if len(left) and left.min() < room:
        take[int(left.argmin())] = True
    return rivals.loc[take, ["_source", "_block", "_hash", "size"]]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=cycle_weights, shards: int = 8, seed: int = 11, repeats: int = MAX_REPEATS, places: bool = True) -> DataFrame:
    """The mix itself: a row of docs for each time it is taken, shuffled inside its shard.

    With `places`, epoch and shard are added; columns of these names are replaced.
    """
    names = [c for c in docs.columns if not places or c.lower() not in ("epoch", "shard")]
    planned = _plan(docs, id_col, text_col, source_col, weights, shards, seed, repeats)
    taken = planned.select("_row", "_key", F.explode("draws").alias("_d")).withColumn("_key", F.xxhash64("_key", "_d.epoch", "_d.shard", F.lit(seed + 1)))
    spread = taken.withColumn("_sub", F.pmod("_key", F.lit(64))).repartition("_d.shard", "_sub").sortWithinPartitions("_d.shard", "_sub", "_key")
    return spread.select(*[F.col("_row")[c].alias(c) for c in names], *([F.col("_d.epoch").alias("epoch"), F.col("_d.shard").alias("shard")] if places else []))
