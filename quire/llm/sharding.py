"""Reproducible shuffle and sharding by a Feistel permutation. DataFrame functions only.

Rows are numbered 0..n-1 in id order. A keyed Feistel network permutes [0, a*b), the least
near-square that holds n; rows that land outside [0, n) walk on along their cycle until they are
inside. Shard and slot follow from the permuted number by one division, so the place of any row
number can be computed without data, and the row of any place by the inverse.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Prime modulus of the round function, below 2**31 so that products stay inside 64 bits.
PRIME = 2147483647
ROUNDS = 6


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    out, x = [], seed % PRIME
    for _ in range(rounds):
        x = (x * 48271 + 11) % PRIME
        out.append(1 + x % (PRIME - 1))
    return out


def sides(n: int) -> tuple[int, int]:
    """(a, b) with a*b >= n > a*b - a: fewer than a numbers lie outside."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def scramble(x: int, key: int) -> int:
    """The round function: twice a keyed square modulo a prime."""
    y = (x % PRIME + key) % PRIME
    y = (y * y + key) % PRIME
    return (y * y + x % PRIME) % PRIME


def feistel(x: int, n: int, seed: int) -> int:
    """One pass of the network over [0, a*b)."""
    a, b = sides(n)
    left, right = x // b, x % b
    for i, key in enumerate(round_keys(seed)):
        if i % 2 == 0:
            left = (left + scramble(right, key)) % a
        else:
            right = (right + scramble(left, key)) % b
    return left * b + right


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def feistel_column(x: Column, n: int, seed: int) -> Column:
    """feistel() as one expression, for use inside a lambda."""
    a, b = sides(n)

    def mixed(v: Column, key: int) -> Column:
        return let(v, lambda u: let((u % PRIME + key) % PRIME, lambda y: let((y * y + key) % PRIME, lambda z: (z * z + u % PRIME) % PRIME)))

    left, right = ((x - x % b) / b).cast("long"), x % b
    for i, key in enumerate(round_keys(seed)):
        if i % 2 == 0:
            left = (left + mixed(right, key)) % a
        else:
            right = (right + mixed(left, key)) % b
    return left * b + right


def with_feistel(df: DataFrame, source: str, to: str, n: int, seed: int) -> DataFrame:
    """feistel() of a column, a projection for each step so that nothing is evaluated twice."""
    a, b = sides(n)
    x = F.col(source)
    df = df.withColumns({"_l": ((x - x % b) / b).cast("long"), "_r": x % b})
    for i, key in enumerate(round_keys(seed)):
        half, other, size = ("_l", "_r", a) if i % 2 == 0 else ("_r", "_l", b)
        v = F.col(other)
        df = df.withColumn("_t", (v % PRIME + key) % PRIME)
        df = df.withColumn("_t", (F.col("_t") * F.col("_t") + key) % PRIME)
        df = df.withColumn(half, (F.col(half) + (F.col("_t") * F.col("_t") + v % PRIME) % PRIME) % size)
    return df.withColumn(to, F.col("_l") * b + F.col("_r")).drop("_l", "_r", "_t")


def place(x: int, n: int, seed: int) -> int:
    """The permuted number of row number x, without Spark."""
    y = feistel(x, n, seed)
    while y >= n:
        y = feistel(y, n, seed)
    return y


def row_numbers(df: DataFrame, order: list[str]) -> DataFrame:
    """df with _row_number, 0..n-1 by `order`: ranges are sorted apart, then shifted by the counts before them.

    Ties are numbered in no particular order unless `order` breaks them.
    """
    width = 33  # bits of the place within a partition in monotonically_increasing_id
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    table = materialise(ranged.withColumn("_part", F.shiftright("_at", width)), "row-numbers")
    from pyspark.sql import Window

    counts = table.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each partition of the table, so a broadcast no larger than the list of its files.
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    out = table.join(F.broadcast(before), "_part")
    return out.withColumn("_row_number", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << width) - 1))).drop("_at", "_part", "_before")


def shard_rows(df: DataFrame, n_shards: int, order: list[str], seed: int = 17) -> DataFrame:
    """df with shard (int) and slot (long, gapless from 0 in its shard); columns of these names are replaced.

    Shard sizes differ by one row at most. The law is `rows`: single rows are permuted, so equal texts may
    go to different shards. Null keys sort first; rows that tie in all of `order`
    are interchangeable. An empty table gives no rows.
    """
    keys = [f"k{i}" for i in range(len(order))]
    own = df.drop("shard", "slot")
    packed = df.select(F.struct(*[df[c] for c in own.columns]).alias("row"), *[df[c].alias(k) for c, k in zip(order, keys, strict=True)])
    numbered = row_numbers(packed, keys)
    n = numbered.count()
    a, b = sides(n)
    out = with_feistel(numbered, "_row_number", "_y", n, seed)
    # At most a*b - n < a numbers lie outside, so a walk is no longer than that; it is only built for rows outside.
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, a * b - n))), F.col("_y"), lambda y, _: F.when(y >= n, feistel_column(y, n, seed)).otherwise(y))
    out = out.withColumn("_y", F.when(F.col("_y") >= n, walk).otherwise(F.col("_y")))
    shard = F.pmod("_y", F.lit(n_shards))
    return out.select(*[F.col("row")[c].alias(c) for c in own.columns], shard.cast("int").alias("shard"), ((F.col("_y") - shard) / n_shards).cast("long").alias("slot"))


def feistel_sql(x: str, n: str, a: str, b: str, seed: int) -> list[str]:
    """The network as a list of DuckDB select lists, one for each round: columns l and r."""
    steps = [f"({x}) // {b} AS l, ({x}) % {b} AS r"]
    for i, key in enumerate(round_keys(seed)):
        v, m = ("r", a) if i % 2 == 0 else ("l", b)
        y0 = f"(({v} % {PRIME} + {key}) % {PRIME})"
        y1 = f"(({y0} * {y0} + {key}) % {PRIME})"
        f = f"(({y1} * {y1} + {v} % {PRIME}) % {PRIME})"
        steps.append(f"(l + {f}) % {a} AS l, r" if i % 2 == 0 else f"l, (r + {f}) % {b} AS r")
    return steps


def nested(columns: list[str], steps: list[str], source: str) -> str:
    """Wrap select lists around a source, one subquery each, keeping `columns`."""
    return reduce(lambda inner, step: f"SELECT {', '.join(columns)}, {step} FROM ({inner})", steps, source)
