"""The whole analysis of a small document: a page with a meta line and two questions, and a page of answers."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quire import document as DOC

PAGE_1 = ["2024 세종과학고등학교 3학년 1학기 기말", "1. Calculate x^2 + y^2 = r^2", "2. Balance 2H2 + O2 -> 2H2O"]
PAGE_2 = ["정답 및 풀이", "1. 정답: r^2 해설: 피타고라스", "2. 정답: 2H2O 해설: 반응식"]
BOX = "struct<x0:int,y0:int,x1:int,y1:int>"
STEM = "2024-3-1-세종과고-AP일반화학1-②기말"


@pytest.fixture(scope="module")
def demo(spark):
    lines, words = [], []
    for doc in ("d1", "d2"):  # two documents alike: nothing may cross
        for page, texts in enumerate([PAGE_1, PAGE_2], 1):
            for i, text in enumerate(texts, 1):
                y, x = 170 + 160 * i, 208
                lines.append((doc, page, i, text, (x, y, x + 14 * len(text), y + 58), 0.99))
                for k, w in enumerate(text.split()):
                    words.append((doc, page, i, k, w, (x, y, x + 28 * len(w), y + 58), 0.99))
                    x += 28 * len(w) + 14
    frame = spark.createDataFrame
    return DOC.Inputs(
        files=frame([("d1", STEM), ("d2", STEM)], "doc_id string, stem string"),
        pages=frame([(d, p, 2480, 3508) for d in ("d1", "d2") for p in (1, 2)], "doc_id string, page_no int, width int, height int"),
        lines=frame(lines, f"doc_id string, page_no int, ord int, text string, bbox {BOX}, confidence double").coalesce(1),
        words=frame(words, f"doc_id string, page_no int, line_no int, word_no int, text string, bbox {BOX}, confidence double").coalesce(1),
    )


def rows(df, *columns):
    return sorted(tuple(r) for r in df.where("doc_id = 'd1'").select(*columns).collect())


def test_demo_document(spark, demo, tmp_path):
    out = DOC.analyse(demo, {"layout": {"first_page_no": 3}})
    assert rows(out["meta"], "year", "school", "grade", "semester", "exam_type", "subject") == [("2024", "세종과학고등학교", "3학년", "1학기", "기말", "AP 일반 화학Ⅰ")]
    assert rows(out["sections"], "split_page", "question_pages", "answer_pages") == [(2, [1], [2])]
    assert rows(out["anchor_summary"], "numbers", "missing", "sequence_ok") == [([1, 2], [], True)]
    assert rows(out["packages"], "question_no", "page_no", "rough_text") == [(1, 1, PAGE_1[1]), (2, 1, PAGE_1[2])]
    assert rows(out["blocks"], "block_id", "type") == [("q1_b1", "text"), ("q2_b1", "text")]
    assert [r[1] for r in rows(out["blocks"], "block_id", "final_type")][1] == "chem_equation"
    assert [r[:2] for r in rows(out["notes"], "question_no", "exists", "raw_text")] == [(1, True), (2, True)]
    assert rows(out["layout_plan"], "question_no", "start_page", "start_column") == [(1, 3, "left"), (2, 3, "right")]
    result = DOC.write(demo.files, out, f"file://{tmp_path}/run").collect()
    assert len(result) == 2 and all(r["valid"] and r["questions"] == 2 and r["has_answer_section"] and r["document_status"] == "best_effort_ready" for r in result)
    assert {r["package"] for r in result} == {STEM + ".hwpx"}
    for name in DOC.DECISIONS:
        assert spark.read.text(f"file://{tmp_path}/run/decisions/{name}").count() > 0 or name == "triage"
    pdf = spark.read.parquet(f"file://{tmp_path}/run/previews").first()
    assert bytes(pdf["content"]).startswith(b"%PDF") and pdf["name"] == STEM + ".pdf"


def test_overrides_and_gates(spark, demo):
    over = {"section_split": spark.createDataFrame([("d1", None, False, [1, 2], [])], "doc_id string, split_page int, has_answer_section boolean, question_pages array<int>, answer_pages array<int>")}
    data = DOC.Inputs(demo.files, demo.pages, demo.lines, demo.words, overrides=over)
    on = DOC.analyse(data)
    assert rows(on["sections"], "question_pages") == [([1, 2],)] and on["sections"].where("doc_id = 'd2'").first()["question_pages"] == [1]
    assert rows(on["anchor_summary"], "uncertain") == [([1, 2],)]
    assert DOC.overrides_of(DOC.wire({"agents": {"section_split": {"enabled": False}}}), "section_split", over) is None
    assert DOC.overrides_of(DOC.wire({"agents": {"section_split": True}}), "section_split", over) is over["section_split"]


def test_settings_and_intake(spark, demo):
    config = {"ocr": {"precise_block_confidence_threshold": 0.8, "clova": {"invoke_url": "u", "secret_key": "s", "template": {"enabled": True, "match_keywords": ["세종"]}}}, "analysis": {"opendataloader": {"enabled": True}}}
    s = DOC.wire(config)
    assert (s.refine_below, s.use_ocr, s.use_template, s.use_layout, s.first_page) == (0.8, True, True, True, 1) and not DOC.wire({}).use_ocr
    used = DOC.template_use(demo.files, demo.pages, s, spark.createDataFrame([("d1", {"school": "x"})], "doc_id string, template map<string,string>"))
    assert {(r["doc_id"], r["should_apply"], r["page_no"]) for r in used.collect()} == {("d1", True, 1), ("d2", True, 1)}
    row = DOC.intake(demo.files, datetime(2024, 5, 6, 7, 8, 9), "/work/", "/out").first()
    assert row["run_id"] == STEM + "_20240506_070809" and row["ocr_dir"] == f"/work/{row['run_id']}/ocr" and row["output_dir"] == "/out"


def test_nothing_is_found(spark, demo):
    empty = DOC.Inputs(demo.files, demo.pages, demo.lines.limit(0), demo.words.limit(0))
    out = DOC.analyse(empty)
    assert [r["document_status"] for r in out["result"].collect()] == ["failed", "failed"]
    assert rows(out["issues"], "category", "severity") == [("question_anchors", "high")]


def test_tables_and_pictures(spark, demo):
    """A full table takes its text out of the lines; one that is not reliable becomes a picture."""
    box = lambda *b: F.struct(*[F.lit(v).cast("int").alias(n) for v, n in zip(b, ("x0", "y0", "x1", "y1"), strict=True)])
    tables = spark.createDataFrame([("d1", 1, 1, "t1")], "doc_id string, page_no int, ord int, table_id string").withColumn("bbox", box(300, 400, 900, 460))
    cells = spark.createDataFrame([("d1", "t1", 2, 2, r, c, f"v{r}{c}") for r in (0, 1) for c in (0, 1)], "doc_id string, table_id string, n_rows int, n_cols int, row int, col int, text string")
    images = spark.createDataFrame([("d1", 2, 1)], "doc_id string, question_no int, page_no int").withColumn("bbox", box(208, 800, 900, 1400))
    low = tables.withColumn("bbox", box(208, 485, 900, 550))
    data = DOC.Inputs(demo.files, demo.pages, demo.lines, demo.words, low, cells, images=images)
    profile, split = DOC.noise(data.lines, data.pages), DOC.sections(data.lines)
    ranges = DOC.packages(DOC.anchors(DOC.anchor_candidates(data.words, data.lines), split), data.pages, profile, split)
    blocks = DOC.refined_blocks(DOC.build_blocks(ranges, data, data.pages, profile), None)
    assert rows(blocks, "question_no", "final_type") == [(1, "table"), (2, "chem_equation"), (2, "image")]
    given = spark.createDataFrame([("d1", 1, 1, "b", None, "", "table", False, 0.95)], "doc_id string, question_no int, ord int, block_id string, table_id string, text string, final_type string, needs_review boolean, confidence double")
    full, none = given.withColumn("table_id", F.lit("t1")), given
    assert rows(DOC.render_items(full, cells), "type", "tag") == [("table", None)]
    assert rows(DOC.render_items(none, cells), "type", "tag", "uncertain") == [("image", "table_preserved_as_image", True)]
