import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import crops
from quire.operators.preview import wrap
from quire.operators.render import wrapped_lines
from quire.sources import cache

BOX = "struct<x0:int,y0:int,x1:int,y1:int>"


@pytest.mark.parametrize("depth", [1, 3])
def test_crops_equal_slices(spark, depth):
    rng = np.random.default_rng(2)
    pages, boxes = [], []
    for doc, (h, w) in enumerate(((700, 50), (1, 1), (256, 300), (257, 3))):
        pages.append((doc, 1, w, h, rng.integers(0, 256, (h, w, depth), dtype=np.uint8)))
        for k in range(12):
            x, y = int(rng.integers(-5, w + 5)), int(rng.integers(-5, h + 5))
            boxes.append((doc, 1, f"b{k}", (x, y, x + int(rng.integers(0, w + 9)), y + int(rng.integers(0, h + 9)))))
        boxes.append((doc, 1, "all", (0, 0, w, h)))
    odd = [(0, 2, "no page", (0, 0, 1, 1)), (9, 1, "no document", (0, 0, 1, 1)), (None, 1, "null", (0, 0, 1, 1)), (0, 1, "no box", None), boxes[0], boxes[0]]
    p = spark.createDataFrame([(*r[:4], bytearray(r[4].tobytes())) for r in pages] + [(7, 1, 4, 4, None)], "doc_id int, page_no int, width int, height int, pixels binary")
    b = spark.createDataFrame(boxes + odd, f"doc_id int, page_no int, block_id string, bbox {BOX}").repartition(4)
    got = {(r["doc_id"], r["block_id"]): (r["width"], r["height"], bytes(r["pixels"])) for r in crops.crop(p, b, depth).collect()}
    want = {}
    for doc, _, name, (x0, y0, x1, y1) in boxes:
        page = pages[doc][4]
        part = page[max(0, y0) : max(0, min(y1, page.shape[0])), max(0, x0) : max(0, min(x1, page.shape[1]))]
        if part.size:
            want[doc, name] = (part.shape[1], part.shape[0], part.tobytes())
    assert got == want
    assert crops.crop(p.limit(0), b, depth).count() == crops.crop(p, b.limit(0), depth).count() == 0
    on = crops.refined(crops.crop(p, b, depth), enabled=True).first()
    assert on["refinement_mode"] == crops.PENDING and on["uncertain"]


def test_lines_break_as_the_preview_does(spark):
    texts = ["", "a", "a" * 60, "a" * 61, "가" * 30, "가" * 31, "a가" * 41, "x\n\ny", "\n", "a" * 59 + "가", "é" * 200, "line\n" * 5000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", wrapped_lines(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == {t: len(wrap(t)) for t in texts}


def asked(spark, path):
    """How many requests were answered in all runs, visible or not."""
    return spark.read.schema("digest string, raw string, run string").parquet(f"{path}/answers").count()


def test_cache_asks_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = [("a", bytearray(b"1")), ("b", bytearray(b"22")), ("a", bytearray(b"1")), (None, bytearray(b"x"))]
    requests = spark.createDataFrame(rows, "digest string, content binary").withColumn("raw_no", F.lit(1))
    reply = lambda content: f"{len(content)} bytes"
    want = [("a", "1 bytes"), ("a", "1 bytes"), ("b", "2 bytes"), (None, None)]
    assert sorted(map(tuple, cache.ask(requests, path, reply).select("digest", "raw").collect()), key=repr) == want
    assert asked(spark, path) == 2

    def refuse(content):
        raise AssertionError("asked again")

    assert sorted(map(tuple, cache.ask(requests, path, refuse).select("digest", "raw").collect()), key=repr) == want
    more = requests.unionByName(spark.createDataFrame([("c", bytearray(b"333"), 1)], "digest string, content binary, raw_no int"))
    assert {r["digest"]: r["raw"] for r in cache.ask(more, path, reply).collect()} == {"a": "1 bytes", "b": "2 bytes", "c": "3 bytes", None: None}
    assert asked(spark, path) == 3
    assert cache.ask(requests.limit(0), path, refuse).count() == 0


def test_cache_of_killed_and_rival_runs(spark, tmp_path):
    path = str(tmp_path / "cache")
    requests = spark.createDataFrame([("a", bytearray(b"1")), ("bad", bytearray(b""))], "digest string, content binary")

    def dies(content):
        if not content:
            raise OSError("gone")
        return "half"

    with pytest.raises(Exception, match="gone"):
        cache.ask(requests, path, dies)
    # A run that wrote its answers and died before its record.
    spark.createDataFrame([("a", "unseen")], cache.ANSWERS).write.parquet(f"{path}/answers/run=zzz")
    assert cache.cached(spark, path).count() == 0
    assert {r["digest"]: r["raw"] for r in cache.ask(requests, path, lambda c: f"<{len(c)}>").collect()} == {"a": "<1>", "bad": "<0>"}
    # A rival that answered the same: one answer counts, the same on every reading.
    spark.createDataFrame([("a", "rival")], cache.ANSWERS).write.parquet(f"{path}/answers/run=000")
    spark.createDataFrame([("000",)], "run string").write.parquet(f"{path}/commits/000")
    assert {r["digest"]: r["raw"] for r in cache.cached(spark, path).collect()} == {"a": "rival", "bad": "<0>"}
