"""What queries cost as their tables grow: tasks, plans and bounds, with the same results."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions.geometry import box
from quire.operators import crops, images, notes, preview, scan, templates
from quire.plans import files, output, sequences
from quire.sources import views


def test_thumbnails_are_exact_means():
    rng = np.random.default_rng(3)
    for shape in ((481, 10), (1300, 977), (2001, 2001)):
        gray = rng.integers(0, 256, shape).astype(np.uint8)
        step = max(1, -(-max(shape) // preview.THUMBNAIL))
        high, wide = (s // step * step for s in shape)
        assert (preview.thumbnail(gray) == gray[:high, :wide].reshape(high // step, step, wide // step, step).mean(axis=(1, 3)).round()).all()


def part(spark, path, n):
    """A table of parts in one file."""
    spark.range(n).selectExpr("id as p_partkey", "cast(id % 50 + 1 as int) as p_size").coalesce(1).write.parquet(f"{path}/part.parquet")
    return str(path)


def test_pictures_of_one_small_file_are_drawn_in_many_tasks(spark, tmp_path):
    """A file of part rows is one task to read, but its pictures are many."""
    d = part(spark, tmp_path, 3000)
    assert files.sink_thumbnail(spark, d).rdd.getNumPartitions() == max(3, spark.sparkContext.defaultParallelism)
    rows = views.spread(views.table(spark, d, "part"), 100)
    assert rows.rdd.getNumPartitions() == 30 and max(rows.rdd.glom().map(len).collect()) <= 130 and rows.count() == 3000
    assert views.spread(rows.limit(0)).count() == 0


def test_pages_of_grays_are_cut_once_for_both_modes(spark, tmp_path):
    d = part(spark, tmp_path, 60)
    got = {(r["doc_id"], r["k"]): (r["refinement_mode"], r["uncertain"]) for r in output.exe_image_refine(spark, d).collect()}
    assert got == {(i, k): ((crops.PASSED, crops.PENDING)[k - 1], k == 2) for i in range(60) for k in (1, 2)}
    plan = output.exe_image_refine(spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("array_join(transform(sequence(0, 299") <= 2  # 24,000 hex digits a page before
    one = spark.range(2).select(F.col("id"), box(F.lit(0), F.lit(0), F.lit(1), F.lit(1)).alias("bbox"))
    assert [r["uncertain"] for r in crops.refined(one, F.col("id") == 1).orderBy("id").collect()] == [False, True]


def test_closing_and_runs_on_any_shape():
    rng = np.random.default_rng(5)
    for shape in ((1, 1), (3, 40), (40, 3), (50, 60)):
        mask = rng.random(shape) < 0.2
        for size in (1, 2, 5, 9):
            r = size // 2
            framed = np.pad(mask, r + size)
            want = np.array([[framed[y + size : y + 2 * size, x + size : x + 2 * size].any() for x in range(shape[1])] for y in range(shape[0])])
            assert (images._spread(mask, size) == want).all()


def test_headers_never_pass_through_the_driver(spark):
    """A header of one make packs to next to nothing on disk, so by sizes of files its table would be broadcast."""
    documents = spark.range(50).withColumnRenamed("id", "doc_id")
    header = '<hh:head><hh:refList><hh:fontfaces><hh:fontface lang="LATIN" fontCnt="0"/></hh:fontfaces><hh:styles itemCnt="0"/></hh:refList></hh:head>'
    parts = documents.where("doc_id % 2 = 0").select("doc_id", F.lit(templates.HEADER).alias("name"), F.lit(header).alias("content"))
    sections = documents.select("doc_id", F.lit('<hp:p paraPrIDRef="7" styleIDRef="3"/>').alias("section"))
    plans = []

    def keep(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.cache()

    done = templates.resolve_headers(documents, parts, sections, keep)
    assert {(r["doc_id"], r["given"]) for r in done.collect()} == {(i, i % 2 == 0) for i in range(50)}
    assert templates.dangling(done, sections).count() == 0
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans)
    given = done.where("given").first()["header"]
    assert given.count('<hh:font ') == 1 and 'fontCnt="1"' in given and '<hh:style id="3"' in given


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_texts_are_dealt_out_before_they_are_split_into_words(spark):
    plan = sequences.win_segment_split(spark, SF)._jdf.queryExecution().executedPlan().toString()
    words = plan[: plan.index("posexplode")]  # a plan is printed from its end: what stands before comes after the split
    assert "Window" in words and "Exchange" not in words
    assert views.words(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_notes_count_their_blocks_once(spark, monkeypatch):
    counted, plain = [], scan.largest_group
    for module in (scan, notes):
        monkeypatch.setattr(module, "largest_group", lambda rows, keys: counted.append(keys) or plain(rows, keys))
    blocks = spark.createDataFrame([("a", 1, "1. x"), ("a", 2, "y"), ("a", 3, "2. z"), ("b", 1, "no")], "doc_id string, ord int, text string")
    expected = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "doc_id string, question_no long")
    got = {tuple(r)[:4] for r in notes.build_notes(blocks, expected).collect()}
    assert got == {("a", 1, True, "x\ny"), ("a", 2, True, "z"), ("a", 3, False, ""), ("b", 1, False, "")}
    assert counted == [["doc_id"]]


def test_documents_alike_in_template_and_references_are_one_case(spark):
    text = '<hh:head><hh:refList><hh:charProperties itemCnt="0"/></hh:refList></hh:head>'
    ids = spark.range(200).select(F.col("id").alias("doc_id"))
    given = F.when(F.col("doc_id") % 2 == 0, F.lit(text)).otherwise(F.lit("<broken"))
    parts = ids.where("doc_id < 150").select("doc_id", F.lit(templates.HEADER).alias("name"), given.alias("content"))
    twice = parts.unionByName(parts.where("doc_id = 1").withColumn("content", F.lit(text)))  # of two texts the larger counts
    sections = ids.where("doc_id % 50 = 0").select("doc_id", F.lit('<p charPrIDRef="7" styleIDRef="4"/><p charPrIDRef="7"/>').alias("section"))
    mine, cases = templates.header_cases(ids, twice, sections)
    assert mine.count() == 200 and cases.count() == 4  # fixed or given, with the section's references or none
    got = {r["doc_id"]: r for r in templates.resolve_headers(ids, twice, sections).collect()}
    assert len(got) == 200 and all(got[i]["given"] == (i < 150 and i % 2 == 0) for i in got if i != 1)
    assert got[1]["given"] == (max(text, "<broken") == text)
    assert all(('<hh:charPr' in r["header"]) and (('id="7"' in r["header"]) == (i % 50 == 0)) for i, r in got.items())


def test_strips_of_pages_are_not_sent_through_the_driver(spark):
    plan = output._crops(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "strip" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_manifests_and_preview_pictures_need_no_markup_and_no_notes(spark):
    from quire.operators import markup
    from quire.plans import packages

    rows = spark.createDataFrame([(1, 1, "image"), (1, 2, "text"), (1, 3, "image"), (2, 1, "note")], "doc_id long, para_seq int, kind string").selectExpr("*", "1 AS question_no", "'t' AS text", "false AS column_break", "false AS page_break")
    media = lambda df: {r["doc_id"]: r["media"] for r in df.collect()}
    assert media(markup.pictures(rows)) == media(markup.sections(markup.paragraphs(rows))) == {1: ["image1", "image2"], 2: []}
    for query in (packages.hwpx_preview_image, packages.hwpx_package_manifest):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "Window" not in plan
    plan = files.sink_hwpx(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") <= 3  # one pass over the section's rows


def test_text_sink_gives_back_what_its_files_hold(spark, tmp_path):
    from quire.operators import sinks

    texts = {1: "a\r\nb\n\nc", 2: "", 3: None, 4: "\u001e\n다음\u001e", 5: '{"doc_id":9}\n'}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, preview string")
    got = {r["doc_id"]: r["preview"] for r in sinks.write_texts(rows, "preview", str(tmp_path / "t")).collect()}
    assert got == {k: v or "" for k, v in texts.items()}
    files_of = lambda: {p for p in os.listdir(root) if p.startswith("texts-")}
    root = os.path.dirname(files.work_dir(spark))
    os.makedirs(root, exist_ok=True)
    before = files_of()
    chars = {r["doc_id"]: r["chars"] for r in files.sink_text(spark, SF).collect()}
    assert len(files_of() - before) == 1
    assert chars == {r["doc_id"]: len(r["preview"]) for r in output.agg_preview_text(spark, SF).collect()}


def test_sizes_of_pages_are_not_held_by_every_executor(spark):
    plan = files.exe_detect_images(spark, SF)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "Inner" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
