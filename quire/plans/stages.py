"""The stages of a document's analysis (quire.document) over the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from .. import document as DOC
from ..operators import windows as W
from ..sources import views as V
from . import decide, sequences
from .registry import plan

STARTED = datetime(2024, 1, 2, 3, 4, 5)


def _csv(column):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


def _files(spark, d):
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("stem"), "p_size")


@plan("stage_intake", "SELECT p_partkey AS doc_id, p_name || '_20240102_030405' AS run_id, '/work/' || p_name || '_20240102_030405/ocr' AS ocr_dir, '/out' AS output_dir FROM part")
def stage_intake(spark, d):
    return DOC.intake(_files(spark, d), STARTED, "/work", "/out").select("doc_id", "run_id", "ocr_dir", "output_dir")


@plan("stage_layout", """SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS order_index, 'item ' || l_linenumber AS content, (100 * l_linenumber)::INTEGER AS y0, (100 * l_linenumber + 80)::INTEGER AS y1
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""")  # fmt: skip
def stage_layout(spark, d):
    """Paragraphs under a root, in PDF points from the bottom; a point is two pixels here."""
    n = F.col("l_linenumber")
    rows = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber").distinct()
    box = F.struct(F.lit(50.0).alias("left"), (1000.0 - 50 * n - 40).alias("bottom"), F.lit(250.0).alias("right"), (1000.0 - 50 * n).alias("top"))
    leaves = rows.select("doc_id", n.cast("long").alias("node_id"), F.lit(0).cast("long").alias("parent_id"), n.alias("ord"), F.lit("paragraph").alias("type"), F.lit(1).alias("page_no"), box.alias("bbox_pdf"), F.concat(F.lit("item "), n).alias("content"))
    roots = rows.select("doc_id").distinct().select("doc_id", F.lit(0).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).alias("ord"), F.lit("document").alias("type"), F.lit(0).alias("page_no"), F.lit(None).cast(leaves.schema["bbox_pdf"].dataType).alias("bbox_pdf"), F.lit("").alias("content"))
    pages = rows.select("doc_id").distinct().select("doc_id", F.lit(1).alias("page_no"), F.lit(1000).alias("width"), F.lit(2000).alias("height"), F.lit(500.0).alias("pdf_width"), F.lit(1000.0).alias("pdf_height"))
    return DOC.layout_elements(leaves.unionByName(roots), pages, True).select("doc_id", "order_index", "content", "bbox.y0", "bbox.y1")


@plan("stage_ocr", "SELECT doc_id, page_no, ord, text FROM v_turns")
def stage_ocr(spark, d):
    return DOC.page_lines(None, V.turns(spark, d), False).select("doc_id", "page_no", "ord", "text")


@plan("stage_template", "SELECT p_partkey AS doc_id, contains(p_name, 'a') AS should_apply, CASE WHEN contains(p_name, 'a') THEN 2 END AS page_no, CASE WHEN contains(p_name, 'a') THEN p_name END AS school FROM part")
def stage_template(spark, d):
    files = _files(spark, d)
    pages = files.select("doc_id", F.explode(F.array(F.lit(3), F.lit(2))).alias("page_no"))
    fields = files.select("doc_id", F.create_map(F.lit("school"), "stem").alias("template"))
    used = DOC.template_use(files, pages, DOC.Settings(use_template=True, template_keywords=("a",)), fields)
    return used.select("doc_id", "should_apply", "page_no", F.col("template")["school"].alias("school"))


@plan("stage_page_evidence", "SELECT doc_id, page_no, numbered::INTEGER AS question_anchors, answers::INTEGER AS answer_anchors FROM v_style", decide.PAGES)
def stage_page_evidence(spark, d):
    return DOC.D.page_evidence(decide._marked(spark, d)).select("doc_id", "page_no", "question_anchors", "answer_anchors")


@plan("stage_meta", """SELECT conv_id AS doc_id, CASE WHEN conv_id % 4 = 0 THEN '2024' WHEN conv_id % 5 = 0 THEN '2023' END AS year, CASE WHEN conv_id % 3 = 0 THEN '세종과학고등학교' WHEN conv_id % 7 = 0 THEN 'of the form' END AS school, conv_id % 3 + 1 || '학년' AS grade,
  CASE WHEN conv_id % 5 = 0 THEN '1학기' END AS semester, CASE WHEN conv_id % 2 = 0 THEN '기말' END AS exam_type FROM (SELECT DISTINCT conv_id FROM conversations)""")  # fmt: skip
def stage_meta(spark, d):
    """File names hold some fields, first lines others, a template the rest."""
    k = F.col("doc_id")
    ids = V.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    stem = F.concat_ws("-", F.when(k % 4 == 0, "2024").otherwise("x"), F.when(k % 3 == 0, "세종과고").otherwise("y"), F.concat(k % 3 + 1, F.lit("학년_"), F.when(k % 2 == 0, "기말").otherwise("z")))
    lines = ids.select("doc_id", F.lit(2).alias("page_no"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("ord")).withColumn("text", F.when((k % 5 == 0) & (F.col("ord") == 8), "2023 1학기").when(F.col("ord") > 8, "2022 2학기").otherwise("line"))
    use = ids.where("doc_id % 7 = 0").select("doc_id", F.create_map(F.lit("school"), F.lit("of the form")).alias("template"))
    return DOC.exam_meta(ids.withColumn("stem", stem), lines, use).select("doc_id", "year", "school", "grade", "semester", "exam_type")


@plan("stage_section", "SELECT doc_id, split_page, question_pages, answer_pages FROM v_split", decide.PAGES)
def stage_section(spark, d):
    s = DOC.sections(decide._marked(spark, d))
    return s.select("doc_id", "split_page", _csv("question_pages").alias("question_pages"), _csv("answer_pages").alias("answer_pages"))


def _split(spark, d):
    """Orders of even key have one question page, others two."""
    k = F.col("o_orderkey")
    return V.table(spark, d, "orders").select(k.alias("doc_id"), F.when(k % 2 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))).alias("question_pages"), (k % 2 == 0).alias("has_answer_section"))


@plan("stage_anchors", r"""SELECT doc_id, question_no, page_no, x0, y0, row_number() OVER (PARTITION BY doc_id, question_no ORDER BY page_no, y0, x0, text) AS occurrence FROM
  (SELECT *, regexp_extract(text, '^([0-9]+)', 1)::BIGINT AS question_no FROM v_anchor) WHERE question_no > 0 AND (doc_id % 2 <> 0 OR page_no = 1)""")  # fmt: skip
def stage_anchors(spark, d):
    return DOC.anchors(V.anchor_candidates(spark, d), _split(spark, d)).select("doc_id", "question_no", "page_no", "bbox.x0", "bbox.y0", "occurrence")


@plan("stage_refine")
def stage_refine(spark, d):
    """Blocks typed and rendered: every order line is a block of its question."""
    rows = V.question_items(spark, d).withColumns({"block_id": F.concat_ws("_", "question_no", "ord"), "text": F.col("content"), "confidence": F.lit(0.95), "table_id": F.lit(None).cast("string"), "page_no": F.lit(1)})
    kind = F.when(F.col("type").isin("table", "image"), F.col("type")).otherwise("text")
    blocks = DOC.refined_blocks(rows.withColumn("type", kind).drop("content", "target"), None)
    return DOC.render_items(blocks, None).select("doc_id", "question_no", "ord", "item_id", "type", "content", "target", "uncertain")


@plan("stage_layout_plan", sequences._SLOTS.replace("(1 + (row_number()", "(3 + (row_number()"))
def stage_layout_plan(spark, d):
    return W.layout_slots(V.question_items(spark, d).select("doc_id", "question_no").distinct(), 3)


@plan("stage_write", """SELECT o_orderkey AS doc_id, coalesce(q.n, 0) AS questions, o_orderkey % 2 = 0 AS has_answer_section, coalesce(i.n, 0) AS issues, CASE WHEN coalesce(q.n, 0) > 0 THEN 'best_effort_ready' ELSE 'failed' END AS document_status FROM orders
  LEFT JOIN (SELECT doc_id, count(DISTINCT question_no) AS n FROM v_items GROUP BY 1) q ON q.doc_id = o_orderkey LEFT JOIN (SELECT doc_id, count(*) AS n FROM v_issues GROUP BY 1) i ON i.doc_id = o_orderkey""")  # fmt: skip
def stage_write(spark, d):
    """What a run returns for each document; files are written by quire.document.write."""
    files = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    questions = V.question_items(spark, d).select("doc_id", "question_no").distinct()
    return DOC.results(files, questions, _split(spark, d), V.issues(spark, d))
