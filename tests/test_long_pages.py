"""Joins over the grid, sweeps, scans and tree walks held against plain versions, and on long pages."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quire.functions.geometry import box, contains, intersects
from quire.operators import blocks as B
from quire.operators import notes as A
from quire.operators import scan as scans
from quire.operators import windows as W
from quire.operators.spatial import PAGE, join_meeting
from quire.sources.layout import walk_tree

BOX = "struct<x0:int,y0:int,x1:int,y1:int>"


def boxes(rng, n, side, far=40_000):
    out = []
    for i in range(n):
        x, y = rng.randrange(-far, far), rng.randrange(-far, far * 3)
        w, h = rng.choice([(0, 0), (side, 5), (5, side), (side * 40, side * 30), (side * 4000, 3)])
        out.append((rng.choice(["a", "b"]), rng.randrange(2), i, (x, y, x + rng.randrange(w + 1), y + rng.randrange(h + 1))))
    return out


def test_grid_joins_equal_all_pairs(spark):
    rng = random.Random(1)
    items, ranges = boxes(rng, 600, 60), boxes(rng, 200, 300)
    i = spark.createDataFrame(items, f"doc_id string, page_no int, k int, bbox {BOX}").repartition(4)
    r = spark.createDataFrame(ranges, f"doc_id string, page_no int, question_no int, range {BOX}").repartition(4)
    pairs = i.join(r.withColumnsRenamed({"doc_id": "d", "page_no": "p"}), (F.col("doc_id") == F.col("d")) & (F.col("page_no") == F.col("p"))).select("k", "question_no", "bbox", "range")
    inside = pairs.where(contains(F.col("range"), F.col("bbox"), 8)).select("k", "question_no")
    assert sorted(B.in_ranges(i, r, 8).select("k", "question_no").collect()) == sorted(inside.collect()) != []
    right = r.select(*PAGE, F.col("range").alias("box"), "question_no")
    meeting = pairs.where(intersects(F.col("bbox"), F.col("range"))).select("k", "question_no")
    got = join_meeting(i, right, "box", intersects(F.col("bbox"), F.col("box")), "inner")
    assert sorted(got.select("k", "question_no").collect()) == sorted(meeting.collect()) != []
    met = {p["k"] for p in meeting.collect()}
    assert sorted(x["k"] for x in B.outside_boxes(i, right).collect()) == sorted(x[2] for x in items if x[2] not in met)
    labels = i.withColumn("text", F.lit("label 1"))
    near = {p["k"] for p in pairs.where((F.col("bbox.x0") - 140 < F.col("range.x1")) & (F.col("range.x0") < F.col("bbox.x1") + 140) & (F.col("bbox.y0") - 140 < F.col("range.y1")) & (F.col("range.y0") < F.col("bbox.y1") + 140)).collect()}
    assert sorted(x["k"] for x in B.near_images(labels, right).collect()) == sorted(near)


def test_grid_of_nothing_and_nulls(spark):
    i = spark.createDataFrame([("a", 1, 1, None), (None, 1, 2, (0, 0, 5, 5)), ("a", None, 3, (0, 0, 5, 5))], f"doc_id string, page_no int, k int, bbox {BOX}")
    r = spark.createDataFrame([("a", 1, 1, (0, 0, 9, 9)), (None, 1, 2, (0, 0, 9, 9)), ("a", 1, 3, None)], f"doc_id string, page_no int, question_no int, range {BOX}")
    assert B.in_ranges(i, r, 8).count() == 0
    assert B.outside_boxes(i, r.select(*PAGE, F.col("range").alias("box"))).count() == 3
    assert B.in_ranges(i.limit(0), r, 8).count() == B.in_ranges(i, r.limit(0), 8).count() == 0


def plain_nms(rows):
    kept = []
    for x0, y0, x1, y1 in sorted(rows, key=lambda b: (b[1], b[0], b[2], b[3])):
        if not any(max(x0, k[0]) < min(x1, k[2]) and max(y0, k[1]) < min(y1, k[3]) for k in kept):
            kept.append((x0, y0, x1, y1))
    return kept


@pytest.mark.parametrize("most", [1, 10**9])
def test_sweep_equals_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(scans, "MOST_ROWS", most)
    rng = random.Random(7)
    rows = []
    for doc in ("a", "b", None):
        for _ in range(250):
            x, y = rng.randrange(400), rng.randrange(30_000) if doc == "b" else rng.randrange(500)
            rows.append((doc, (x, y, x + rng.randrange(-3, 60), y + rng.randrange(-3, 40))))
        rows += rows[-60:]
    df = spark.createDataFrame(rows, f"doc_id string, bbox {BOX}").repartition(5)
    got = sorted(((r["doc_id"], *r["bbox"]) for r in W.greedy_boxes(df, ["doc_id"]).collect()), key=repr)
    want = sorted(((d, *b) for d in ("a", "b", None) for b in plain_nms([b for e, b in rows if e == d])), key=repr)
    assert got == want
    assert W.greedy_boxes(df.limit(0), ["doc_id"]).count() == 0


def test_sweep_of_a_hundred_thousand_boxes(spark):
    i = F.col("id")
    df = spark.range(100_000).select(F.lit(1).alias("doc_id"), box((i * 7919) % 2000, (i * 104_729) % 200_000, (i * 7919) % 2000 + 30, (i * 104_729) % 200_000 + 20).alias("bbox"))
    began = time.time()
    kept = W.greedy_boxes(df, ["doc_id"]).count()
    assert 10_000 < kept < 100_000 and time.time() - began < 60


def test_rows_and_segments_over_bands(spark, monkeypatch):
    """Bands of any height give the rows and segments of one window over the page."""
    rng = random.Random(5)
    rows = []
    for doc in ("a", None):
        for n in range(400):
            x, y = rng.randrange(30_000), rng.randrange(60_000)
            rows.append((doc, 1, n, 0, "w", (x, y, x + rng.randrange(1, 300), y + rng.randrange(1, 40))))
    df = spark.createDataFrame(rows + rows[::7], f"doc_id string, page_no int, line_no int, word_no int, text string, bbox {BOX}").repartition(3)
    seen = []
    for most, page, row in ((10**9, 13, 16), (1, 4, 5), (1, 30, 30)):
        monkeypatch.setattr(scans, "MOST_ROWS", most)
        monkeypatch.setattr(W, "PAGE_BAND", page)
        monkeypatch.setattr(W, "ROW_BAND", row)
        seen.append(sorted(W.split_segments(W.cluster_rows(df)).select("doc_id", "line_no", "row_no", "segment_no").collect(), key=repr))
    assert seen[0] == seen[1] == seen[2] and max(r["row_no"] for r in seen[0]) > 50


def test_notes_over_bands(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(d, k, rng.choice([f"{rng.randrange(1, 30)}. x", f"({rng.randrange(1, 30)}) y", "plain", f"{rng.randrange(1, 9)})"])) for d in ("a", "b") for k in range(200)]
    blocks = spark.createDataFrame(rows, "doc_id string, ord int, text string").repartition(3)
    expected = spark.range(1, 25).select(F.lit("a").alias("doc_id"), F.col("id").cast("int").alias("question_no"))
    seen = []
    for most, bits in ((10**9, 14), (1, 2), (1, 20)):
        monkeypatch.setattr(scans, "MOST_ROWS", most)
        monkeypatch.setattr(A, "BAND_BITS", bits)
        seen.append((sorted(A.note_anchors(blocks).collect()), sorted(A.build_notes(blocks, expected).collect())))
    assert seen[0] == seen[1] == seen[2]


NODE = "doc_id int, node_id string, parent_id string, ord int, type string, page_no int, bbox_pdf struct<left:double,bottom:double,right:double,top:double>, content string"

DEEP = 5000


def test_deep_trees_rings_and_orphans(spark):
    b = (0.0, 0.0, 1.0, 1.0)
    rows = [(1, f"n{i}", f"n{i - 1}" if i else None, i % 3, "paragraph", 1, b, f" t{i} ") for i in range(DEEP)]
    rows += [(2, "r", None, 0, "document", None, None, None), (2, "h", "r", 0, "header", 1, b, "head"), (2, "in", "h", 0, "paragraph", 1, b, "in head"), (2, "p", "r", 1, "paragraph", 1, b, "body"), (2, "o", "gone", 0, "paragraph", 1, b, "orphan")]
    rows += [(3, "x", "y", 0, "paragraph", 1, b, "ring"), (3, "y", "x", 0, "paragraph", 1, b, "ring"), (3, "z", "x", 0, "paragraph", 1, b, "below")]
    out = walk_tree(spark.createDataFrame(rows, NODE).repartition(4))
    deep = out.where("doc_id = 1").select("node_id", F.size("path").alias("n"), F.element_at("path", -1).alias("last"), "content").collect()
    assert {r["node_id"]: (r["n"], r["last"], r["content"]) for r in deep} == {f"n{i}": (i + 1, i % 3, f"t{i}") for i in range(DEEP)}
    assert [(r["node_id"], list(r["path"])) for r in out.where("doc_id <> 1").collect()] == [("p", [0, 1])]
    assert walk_tree(spark.createDataFrame([], NODE)).count() == 0
