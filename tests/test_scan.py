import random
from collections import defaultdict

from pyspark.sql import functions as F

from quire.operators.scan import scan


def plain(rows, per):
    """rows: (key, pos, value or None) -> running sum, xor, last; sum, last and max before; sum of all."""
    out, groups = {}, defaultdict(list)
    for k, p, v in rows:
        groups[k].append((p, v))
    for k, g in groups.items():
        g.sort(key=lambda r: r[0])
        seen = []
        every = [v for _, v in g if v is not None]
        for p, v in g:
            prior = list(seen)
            if v is not None:
                seen.append(v)
            x = None
            for s in seen:
                x = s if x is None else x ^ s
            out[(k, p)] = (sum(seen) if seen else None, x, seen[-1] if seen else None, sum(prior) if prior else None, prior[-1] if prior else None, max(prior) if prior else None, sum(every) if every else None)
    return out


def scanned(df, band):
    v = F.col("v")
    return scan(df, ["k"], band, ["p"], {"s": ("sum", v), "x": ("xor", v), "l": ("last", v)}, {"bs": ("sum", v), "bl": ("last", v), "bm": ("max", v)}, {"w": ("sum", v)})


def test_scan_equals_plain(spark):
    rng = random.Random(3)
    rows = [(k, p, rng.choice([None, rng.randrange(1000)])) for k in ("a", "b", None) for p in range(60)] + [("lone", 5, None), ("one", 7, 3)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, p long, v long").repartition(5)
    for width in (1, 7, 1000):
        got = {(r["k"], r["p"]): tuple(r[c] for c in ("s", "x", "l", "bs", "bl", "bm", "w")) for r in scanned(df, F.floor(F.col("p") / width)).collect()}
        assert got == plain(rows, width)


def test_scan_of_nothing(spark):
    assert scanned(spark.createDataFrame([], "k string, p long, v long"), F.col("p")).count() == 0


def test_one_long_group_is_many_tasks(spark):
    df = spark.range(200_000).select(F.lit("doc").alias("k"), F.col("id").alias("p"), F.lit(1).cast("long").alias("v"))
    out = scanned(df, F.floor(F.col("p") / 10_000)).withColumn("task", F.spark_partition_id())
    assert out.agg(F.max("s"), F.max("w")).first()[:] == (200_000, 200_000)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in out.groupBy("task").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert len(sizes) > 1 and max(sizes) < 150_000
