"""Decisions, blocks, notes and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import blocks as B
from ..operators import decisions as D
from ..operators import notes as A
from ..operators import windows as W
from ..sources import views as V
from ..staging import stage
from . import sequences as S
from .registry import plan
from .scalars import TEXTS

CLASSES = TEXTS | {
    "v_class": r"""SELECT *, CASE WHEN t = '' THEN 'unknown:0.0' WHEN prose THEN 'text:0.94,equation:0.06' WHEN regexp_matches(t, '->|→|⇌|<=>') AND regexp_matches(t, '\p{Lu}') THEN 'chem_equation:0.82,equation:0.45,text:0.18'
      WHEN equation AND length(trim(text)) < 160 THEN 'equation:0.74,text:0.3' ELSE 'text:0.9,equation:0.1' END AS candidates FROM v_kinds""",
    "v_typed": r"""SELECT *, CASE WHEN regexp_matches(t, '->|→|⇌|<=>') AND regexp_matches(t, '\p{Lu}') THEN 'chem_equation' WHEN prose THEN 'text' WHEN equation AND length(trim(text)) < 180 THEN 'equation' WHEN t = '' THEN 'unknown' ELSE 'text' END AS final_type,
      CASE WHEN regexp_matches(t, '->|→|⇌|<=>') AND regexp_matches(t, '\p{Lu}') THEN CASE WHEN p_partkey % 2 = 0 THEN 0.9 ELSE 0.84 END WHEN prose THEN 0.9 WHEN equation AND length(trim(text)) < 180 THEN 0.82 WHEN t = '' THEN 0.2 ELSE 0.9 END::DOUBLE AS confidence, t = '' AND NOT prose AS needs_review FROM (SELECT c.*, f.p_partkey FROM v_class c JOIN v_formulas f USING (block_id))""",
}


def _candidates(c):
    return F.array_join(F.transform(c, lambda x: F.concat(x["type"], F.lit(":"), x["score"].cast("string"))), ",")


@plan("dec_classify_block", "SELECT block_id, candidates FROM v_class", CLASSES)
def dec_classify_block(spark, d):
    return V.formulas(spark, d).select("block_id", _candidates(D.classify_text(F.col("text"))).alias("candidates"))


@plan("dec_block_type", "SELECT block_id, final_type, confidence, needs_review FROM v_typed", CLASSES)
def dec_block_type(spark, d):
    around = F.when(F.col("p_partkey") % 2 == 0, "다음 식").otherwise("")
    r = D.block_type(F.col("text"), D.classify_text(F.col("text")), around)
    return V.formulas(spark, d).select("block_id", r["type"].alias("final_type"), r["confidence"].alias("confidence"), r["needs_review"].alias("needs_review"))


@plan("topk_best_type", "SELECT block_id, string_split(string_split(candidates, ',')[1], ':')[1] AS type, string_split(string_split(candidates, ',')[1], ':')[2]::DOUBLE AS score FROM v_class", CLASSES)
def topk_best_type(spark, d):
    r = D.best_candidate(D.classify_text(F.col("text")))
    return V.formulas(spark, d).select("block_id", r["type"].alias("type"), r["score"].alias("score"))


@plan("dec_formula_repair", r"""SELECT block_id, block_type AS kind, CASE WHEN block_type = 'chem_equation' THEN trim(replace(regexp_replace(c, '([A-Z][a-z]?)([0-9]+)', '\1_{\2}', 'g'), '->', ' rightarrow ')) ELSE f END AS target,
  CASE WHEN block_type = 'chem_equation' THEN CASE WHEN regexp_matches(c, '->|<=>') AND regexp_matches(c, '[A-Z]') THEN 0.83 ELSE 0.4 END ELSE CASE WHEN regexp_matches(f, '=|\^|/|√|→|->|⇌|\+|-') THEN 0.84 ELSE 0.42 END END::DOUBLE AS confidence
  FROM (SELECT *, regexp_replace(trim(text), '\s+', ' ', 'g') AS c, regexp_replace(replace(replace(trim(text), '**', '^'), 'sqrt', '√'), '\s+', ' ', 'g') AS f FROM v_formulas)""")  # fmt: skip
def dec_formula_repair(spark, d):
    r = D.formula_repair(F.col("block_type"), F.col("text"))
    return V.formulas(spark, d).select("block_id", r["kind"].alias("kind"), r["target"].alias("target"), r["confidence"].alias("confidence"))


@plan("exe_formula_item", r"""SELECT block_id || '_i1' AS item_id, block_id AS source_block_id, block_type AS type, text AS content, CASE WHEN block_type = 'chem_equation' THEN NOT regexp_matches(text, '->') ELSE NOT regexp_matches(replace(replace(text, '**', '^'), 'sqrt', '√'), '=|\^|/|√|→|->|⇌|\+|-') END AS uncertain FROM v_formulas""")
def exe_formula_item(spark, d):
    r = D.formula_repair(F.col("block_type"), F.col("text"))
    return V.formulas(spark, d).select(F.concat("block_id", F.lit("_i1")).alias("item_id"), F.col("block_id").alias("source_block_id"), r["kind"].alias("type"), F.col("text").alias("content"), r["needs_review"].alias("uncertain"))


# --- pages -----------------------------------------------------------------------------------------

PAGES = {
    "v_pages": """SELECT doc_id, page_no, array_to_string(list(text ORDER BY ord)[1:5], chr(10)) AS top, list_sort(list_filter(['정답', '정답 및 풀이', '해설', '풀이', '- 끝 -'], lambda k: contains(string_agg(text, chr(10) ORDER BY ord), k))) AS hits,
      count(*) FILTER (WHERE regexp_matches(trim(text), '^[0-9]+\\.')) AS numbered, count(*) FILTER (WHERE regexp_matches(text, '정답|해설|풀이|- 끝 -')) AS answers FROM v_marked GROUP BY 1, 2""".replace("\\\\", "\\"),
    "v_marked": "SELECT doc_id, page_no, ord, CASE WHEN ord % 7 = 1 AND page_no % 3 = 2 THEN '정답 및 풀이' WHEN ord = 2 AND page_no % 4 = 3 THEN ord || '. ' || text || ' 해설' ELSE text END AS text FROM v_turns",
    "v_style": "SELECT *, CASE WHEN numbered > 0 THEN 0.9 ELSE 0.1 END::DOUBLE AS question_style, CASE WHEN answers > 0 THEN 0.95 ELSE 0.05 END::DOUBLE AS answer_style FROM v_pages",
    "v_cut": r"""SELECT *, CASE WHEN page_no > 1 AND (list_contains(th, '정답') OR len(th) >= 2 OR answer_style >= 0.9 AND regexp_matches(top, '(?m)^\s*[0-9]+[.)]')) THEN page_no END AS cut FROM (SELECT *, list_filter(hits, lambda k: contains(top, k)) AS th FROM v_style)""",
    "v_split": """SELECT doc_id, CASE WHEN ok THEN s END AS split_page, ok AS has_answer_section, array_to_string(CASE WHEN ok THEN before ELSE pages END, ',') AS question_pages, CASE WHEN ok THEN array_to_string(list_filter(pages, lambda p: p >= s), ',') ELSE '' END AS answer_pages,
      CASE WHEN ok THEN 0.97 ELSE 0.62 END::DOUBLE AS confidence FROM (SELECT *, s IS NOT NULL AND len(before) > 0 AS ok FROM (SELECT *, list_filter(pages, lambda p: p < s) AS before FROM (SELECT doc_id, min(cut) AS s, list_sort(list(page_no)) AS pages FROM v_cut GROUP BY 1)))""",
}


def _marked(spark, d):
    """Conversation lines with answer headers and numbered answers put in, as the corpus has none."""
    t, o, p = F.col("text"), F.col("ord"), F.col("page_no")
    text = F.when((o % 7 == 1) & (p % 3 == 2), "정답 및 풀이").when((o == 2) & (p % 4 == 3), F.concat(o, F.lit(". "), t, F.lit(" 해설"))).otherwise(t)
    return V.turns(spark, d).withColumn("text", text)


def _csv(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@plan("dec_page_evidence", "SELECT doc_id, page_no, top, array_to_string(hits, '|') AS hits, numbered::INTEGER AS question_anchors, answers::INTEGER AS answer_anchors FROM v_style", PAGES)
def dec_page_evidence(spark, d):
    return D.page_evidence(_marked(spark, d)).select("doc_id", "page_no", F.array_join("top_lines", "\n").alias("top"), F.array_join("keyword_hits", "|").alias("hits"), "question_anchors", "answer_anchors")


@plan("dec_section_features", "SELECT doc_id, page_no, question_style, answer_style FROM v_style", PAGES)
def dec_section_features(spark, d):
    return D.page_evidence(_marked(spark, d)).select("doc_id", "page_no", "question_style", "answer_style")


@plan("agg_keyword_hits", "SELECT doc_id, page_no, array_to_string(hits, '|') AS hits FROM v_pages", PAGES)
def agg_keyword_hits(spark, d):
    return D.page_evidence(_marked(spark, d)).select("doc_id", "page_no", F.array_join("keyword_hits", "|").alias("hits"))


@plan("agg_top_lines", "SELECT doc_id, page_no, array_to_string(list(text ORDER BY ord)[1:5], '|') AS top FROM v_lines GROUP BY 1, 2")
def agg_top_lines(spark, d):
    return D.page_evidence(V.lines(spark, d)).select("doc_id", "page_no", F.array_join("top_lines", "|").alias("top"))


@plan("dec_section_split", "SELECT * FROM v_split", PAGES)
def dec_section_split(spark, d):
    s = D.section_split(D.page_evidence(_marked(spark, d)))
    return s.select("doc_id", "split_page", "has_answer_section", _csv("question_pages").alias("question_pages"), _csv("answer_pages").alias("answer_pages"), "confidence")


@plan("topk_first_lines", "SELECT doc_id, ord, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM v_turns WHERE page_no = 1) WHERE k <= 8")
def topk_first_lines(spark, d):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    return V.turns(spark, d).where("page_no = 1").withColumn("k", k).where("k <= 8").select("doc_id", "ord", "text")


@plan("dec_anchor_candidates", r"""WITH w AS (SELECT doc_id, page_no, ord, text, regexp_matches(text, '^[0-9]+\.($|[^0-9])') AS strong, regexp_matches(text, '^[0-9]+\.') AS weak FROM (SELECT doc_id, page_no, ord, CASE WHEN ord % 5 = 2 THEN ord || '. ' || text WHEN ord % 5 = 3 THEN ord || '.5 ' || text ELSE text END AS text FROM v_turns))
  SELECT doc_id, page_no, ord, text FROM (SELECT *, bool_or(strong) OVER (PARTITION BY doc_id, page_no) AS any_strong FROM w) WHERE strong OR NOT any_strong AND weak""")  # fmt: skip
def dec_anchor_candidates(spark, d):
    from pyspark.sql import Window

    o, t = F.col("ord"), F.col("text")
    rows = V.turns(spark, d).withColumn("text", F.when(o % 5 == 2, F.concat(o, F.lit(". "), t)).when(o % 5 == 3, F.concat(o, F.lit(".5 "), t)).otherwise(t))
    rows = rows.withColumns({"strong": F.col("text").rlike(r"^\d+\.(?!\d)"), "weak": F.col("text").rlike(r"^\d+\.")})
    some = F.max("strong").over(Window.partitionBy("doc_id", "page_no"))
    return rows.withColumn("some", some).where("strong or (not some and weak)").select("doc_id", "page_no", "ord", "text")


@plan("dec_layout_anchors", r"SELECT doc_id, page_no, text, x0, y0, 0.92::DOUBLE AS score FROM v_anchor WHERE regexp_matches(trim(text), '^[0-9]+\.\s+\S')")
def dec_layout_anchors(spark, d):
    rows = V.anchor_candidates(spark, d).where(T.strip(F.col("text")).rlike(r"^(\d+)\.\s+\S"))
    return rows.select("doc_id", "page_no", "text", "bbox.x0", "bbox.y0", F.lit(0.92).alias("score"))


# --- metadata --------------------------------------------------------------------------------------

_META = {
    "v_meta_in": """SELECT conv_id AS doc_id, [CASE WHEN conv_id % 4 = 0 THEN '2024' ELSE 'x' END, CASE WHEN conv_id % 3 = 0 THEN '세종과고' ELSE 'y' END, conv_id % 3 + 1 || '학년', CASE WHEN conv_id % 2 = 0 THEN '기말' ELSE 'z' END] AS tokens,
      CASE WHEN conv_id % 5 = 0 THEN '2023 세종과학고등학교 1학기 중간 AP 일반 화학Ⅰ' ELSE '2학기' END AS page FROM (SELECT DISTINCT conv_id FROM conversations)""",
    "v_meta": """SELECT doc_id, page, CASE WHEN doc_id % 4 = 0 THEN '2024' WHEN doc_id % 5 = 0 THEN '2023' END AS year, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN '세종과학고등학교' END AS school, tokens[3] AS grade,
      CASE WHEN doc_id % 5 = 0 THEN '1학기' ELSE '2학기' END AS semester, CASE WHEN doc_id % 2 = 0 THEN '기말' WHEN doc_id % 5 = 0 THEN '중간' END AS exam_type, CASE WHEN doc_id % 5 = 0 THEN 'AP 일반 화학Ⅰ' END AS subject FROM v_meta_in""",
    "v_meta_out": """SELECT *, round_even(least(0.98, ((year IS NOT NULL)::INT + (school IS NOT NULL)::INT + 2 + (exam_type IS NOT NULL)::INT + (subject IS NOT NULL)::INT) / 6.0::DOUBLE + CASE WHEN tagline IS NOT NULL THEN 0.15 ELSE 0 END), 2)::DOUBLE AS confidence
      FROM (SELECT *, '(' || year || '년 ' || school || ' ' || grade || ' ' || semester || ' ' || exam_type || ')' AS tagline FROM v_meta)""",
}


def _meta(spark, d):
    k = F.col("doc_id")
    ids = V.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    tokens = F.array(F.when(k % 4 == 0, "2024").otherwise("x"), F.when(k % 3 == 0, "세종과고").otherwise("y"), F.concat(k % 3 + 1, F.lit("학년")), F.when(k % 2 == 0, "기말").otherwise("z"))
    page = F.when(k % 5 == 0, F.array(F.lit("2023 세종과학고등학교"), F.lit("1학기 중간 AP 일반 화학Ⅰ"))).otherwise(F.array(F.lit("2학기")))
    return D.exam_meta(ids.select("doc_id", tokens.alias("tokens"), page.alias("first_lines")))


def _meta_plan(key, column):
    @plan(key, f"SELECT doc_id, {column} FROM v_meta_out", _META)
    def query(spark, d):
        return _meta(spark, d).select("doc_id", *column.split(", "))

    return query


for _key, _column in (("dec_meta_year", "year"), ("dec_meta_school", "school"), ("dec_meta_subject", "subject"), ("dec_meta_pattern", "grade, semester"), ("dec_meta_exam_type", "exam_type"), ("agg_meta_confidence", "confidence"), ("dec_exam_meta", "year, school, grade, semester, exam_type, subject, tagline, confidence")):
    _meta_plan(_key, _column)


# --- answers ---------------------------------------------------------------------------------------

NOTES = {
    "v_heads": r"SELECT doc_id, try_cast(nullif(regexp_extract(text, '^\s*\(?([0-9]+)\)?[.)]?\s*(.*)$', 1), '') AS BIGINT) AS question_no, ord, text, max(ord) OVER (PARTITION BY doc_id) AS last FROM v_answers",
    "v_spans_all": "SELECT doc_id, question_no, ord AS start_ord, coalesce(lead(ord) OVER (PARTITION BY doc_id ORDER BY ord) - 1, last) AS end_ord FROM v_heads WHERE question_no IS NOT NULL",
    "v_spans": "SELECT doc_id, question_no, start_ord, end_ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, question_no ORDER BY start_ord) AS k FROM v_spans_all SEMI JOIN v_expected USING (doc_id, question_no)) WHERE k = 1",
    "v_note_sum": """SELECT doc_id, coalesce(missing, []) AS missing, coalesce(extra, []) AS extra FROM (SELECT DISTINCT doc_id FROM v_expected) LEFT JOIN (SELECT doc_id, list_sort(list(DISTINCT question_no)) AS missing FROM v_expected ANTI JOIN v_spans USING (doc_id, question_no) GROUP BY 1) USING (doc_id)
      LEFT JOIN (SELECT doc_id, list_sort(list(DISTINCT question_no)) AS extra FROM v_spans_all ANTI JOIN v_expected USING (doc_id, question_no) GROUP BY 1) USING (doc_id)""",
    "v_inside": """SELECT a.doc_id, a.ord, a.text, s.question_no, s.start_ord FROM (SELECT *, max(CASE WHEN question_no IS NOT NULL THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord) AS at FROM v_heads) a
      JOIN v_spans s ON a.doc_id = s.doc_id AND a.at = s.start_ord""",
    "v_note_lines": r"""SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id, question_no ORDER BY ord) AS now FROM (SELECT *, try_cast(nullif(regexp_extract(text, '^\s*([0-9]+)[.)]', 1), '') AS BIGINT) AS own FROM v_inside)""",
    "v_note_text": r"""SELECT doc_id, question_no, string_agg(said, chr(10) ORDER BY ord) AS raw_text FROM (SELECT *, CASE WHEN own IS NULL THEN text ELSE trim(regexp_extract(text, '^\s*[0-9]+[.)]\s*(.*)', 1)) END AS said FROM v_note_lines WHERE now = question_no) WHERE said <> '' GROUP BY 1, 2""",
    "v_notes": "SELECT e.doc_id, e.question_no::BIGINT AS question_no, t.raw_text IS NOT NULL AS exists, coalesce(t.raw_text, '') AS raw_text, s.start_ord IS NULL AS missing_note FROM v_expected e LEFT JOIN v_note_text t USING (doc_id, question_no) LEFT JOIN v_spans s USING (doc_id, question_no)",
}


@plan("win_note_spans", "SELECT doc_id, question_no, start_ord, end_ord FROM v_spans", NOTES)
def win_note_spans(spark, d):
    return A.note_spans(V.answer_blocks(spark, d), V.expected_questions(spark, d))


@plan("dec_answer_alignment", "SELECT doc_id, array_to_string(missing, ',') AS missing, array_to_string(extra, ',') AS extra, CASE WHEN len(missing) = 0 THEN 0.91 ELSE 0.76 END::DOUBLE AS confidence, len(missing) + len(extra) > 0 AS needs_review FROM v_note_sum", NOTES)
def dec_answer_alignment(spark, d):
    s = A.note_summary(V.answer_blocks(spark, d), V.expected_questions(spark, d))
    return s.select("doc_id", _csv("missing").alias("missing"), _csv("extra").alias("extra"), "confidence", "needs_review")


@plan("join_block_spans", "SELECT doc_id, question_no, ord FROM v_inside", NOTES)
def join_block_spans(spark, d):
    blocks = V.answer_blocks(spark, d)
    return A.span_blocks(blocks, A.note_spans(blocks, V.expected_questions(spark, d))).select("doc_id", "question_no", "ord")


@plan("join_block_id_lookup", "SELECT s.doc_id, s.question_no, 'a1_b' || s.start_ord AS block_id, a.ord FROM v_spans s JOIN v_answers a ON a.doc_id = s.doc_id AND a.ord = s.start_ord", NOTES)
def join_block_id_lookup(spark, d):
    blocks = V.answer_blocks(spark, d)
    named = A.note_spans(blocks, V.expected_questions(spark, d)).withColumn("block_id", F.concat(F.lit("a1_b"), "start_ord"))
    return named.join(blocks, ["doc_id", "block_id"]).select("doc_id", "question_no", "block_id", "ord")


@plan("win_note_current", r"SELECT doc_id, ord, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord) AS current_no FROM (SELECT *, try_cast(nullif(regexp_extract(text, '^\s*([0-9]+)[.)]', 1), '') AS BIGINT) AS own FROM v_answers)")
def win_note_current(spark, d):
    return D.last_question_lines(V.answer_blocks(spark, d)).select("doc_id", "ord", "current_no")


def _notes(spark, d):
    return A.build_notes(stage(V.answer_blocks(spark, d), "answers"), V.expected_questions(spark, d))


@plan("agg_notes", "SELECT * FROM v_notes", NOTES)
def agg_notes(spark, d):
    return _notes(spark, d)


@plan("exe_notes", "SELECT doc_id, question_no, raw_text FROM v_notes WHERE exists", NOTES)
def exe_notes(spark, d):
    return _notes(spark, d).where("exists").select("doc_id", "question_no", "raw_text")


@plan("exe_build_notes", "SELECT doc_id, question_no, 'medium' AS severity, 'missing_note' AS message FROM v_notes WHERE missing_note", NOTES)
def exe_build_notes(spark, d):
    return _notes(spark, d).where("missing_note").select("doc_id", "question_no", F.lit("medium").alias("severity"), F.lit("missing_note").alias("message"))


@plan("exe_to_notes", "SELECT doc_id, question_no, exists, raw_text FROM v_notes", NOTES)
def exe_to_notes(spark, d):
    return _notes(spark, d).select("doc_id", "question_no", "exists", "raw_text")


@plan("exe_answer_blocks", "SELECT doc_id, page_no, ord, 'a' || page_no || '_b' || ord AS block_id, text FROM v_turns WHERE page_no % 2 = 0")
def exe_answer_blocks(spark, d):
    return V.turns(spark, d).where("page_no % 2 = 0").select("doc_id", "page_no", "ord", F.concat(F.lit("a"), "page_no", F.lit("_b"), "ord").alias("block_id"), "text")


# --- spatial joins ---------------------------------------------------------------------------------

_SPACE = S.ANCHORS | {
    "v_items_box": "SELECT doc_id, page_no, text, x0 + 10 AS x0, y0 + 60 AS y0, x0 + 50 AS x1, y0 + 90 AS y1 FROM v_anchor WHERE doc_id % 2 = 0",
    "v_in": "SELECT i.doc_id, i.page_no, i.text, i.x0, i.y0, i.x1, i.y1, r.question_no FROM v_items_box i JOIN v_ranges r ON i.doc_id = r.doc_id AND i.page_no = r.page_no WHERE i.x0 >= rx0 - 8 AND i.y0 >= ry0 - 8 AND i.x1 <= rx1 + 8 AND i.y1 <= ry1 + 8",
    "v_excluded": "SELECT doc_id, page_no, x0 - 24 AS bx0, y0 - 24 AS by0, x1 + 24 AS bx1, y1 + 24 AS by1 FROM v_anchor WHERE doc_id % 4 = 0",
}
_IN = "doc_id, page_no, text, x0, y0, question_no"


def _item_boxes(spark, d):
    b = F.col("bbox")
    rows = V.anchor_candidates(spark, d).where("doc_id % 2 = 0")
    return rows.select("doc_id", "page_no", "text", G.box(b["x0"] + 10, b["y0"] + 60, b["x0"] + 50, b["y0"] + 90).alias("bbox"))


def _inside(spark, d):
    return B.in_ranges(_item_boxes(spark, d), S.ranges(spark, d), B.WORD_MARGIN)


def _flat(df):
    return df.select("doc_id", "page_no", "text", "bbox.x0", "bbox.y0", "question_no")


@plan("join_words_in_range", f"SELECT {_IN} FROM v_in", _SPACE)
def join_words_in_range(spark, d):
    return _flat(_inside(spark, d))


@plan("join_exclude_boxes", f"SELECT {_IN} FROM v_in i WHERE NOT EXISTS (SELECT 1 FROM v_excluded e WHERE e.doc_id = i.doc_id AND e.page_no = i.page_no AND i.x0 < bx1 AND bx0 < i.x1 AND i.y0 < by1 AND by0 < i.y1)", _SPACE)
def join_exclude_boxes(spark, d):
    boxes = V.anchor_candidates(spark, d).where("doc_id % 4 = 0").select("doc_id", "page_no", G.expand(F.col("bbox"), B.IMAGE_MARGIN).alias("box"))
    return _flat(B.outside_boxes(_inside(spark, d), boxes))


@plan("join_lines_in_range", f"WITH busy AS (SELECT DISTINCT doc_id, question_no FROM v_in WHERE doc_id % 4 = 0) SELECT {_IN} FROM v_in i WHERE NOT EXISTS (SELECT 1 FROM busy b WHERE b.doc_id = i.doc_id AND b.question_no = i.question_no)", _SPACE)
def join_lines_in_range(spark, d):
    items = _item_boxes(spark, d)
    return _flat(B.lines_without_words(items, items.where("doc_id % 4 = 0"), S.ranges(spark, d)))


@plan("join_tables_in_range", "SELECT i.doc_id, i.page_no, i.text, i.x0, i.y0, r.question_no FROM v_items_box i JOIN v_ranges r ON i.doc_id = r.doc_id AND i.page_no = r.page_no WHERE i.x0 >= rx0 - 16 AND i.y0 >= ry0 - 16 AND i.x1 <= rx1 + 16 AND i.y1 <= ry1 + 16", _SPACE)
def join_tables_in_range(spark, d):
    return _flat(B.in_ranges(_item_boxes(spark, d), S.ranges(spark, d), B.TABLE_MARGIN))


@plan("join_layout_text", """SELECT doc_id, question_no, string_agg(trim(text), chr(10) ORDER BY page_no, k) AS text FROM (SELECT i.*, r.question_no, row_number() OVER (PARTITION BY i.doc_id, r.question_no ORDER BY i.page_no, i.y0, i.x0, i.text) AS k FROM v_items_box i JOIN v_ranges r ON i.doc_id = r.doc_id AND i.page_no = r.page_no
  WHERE (i.x0 >= rx0 - 6 AND i.y0 >= ry0 - 6 AND i.x1 <= rx1 + 6 AND i.y1 <= ry1 + 6) OR (i.x0 < rx1 AND rx0 < i.x1 AND i.y0 < ry1 AND ry0 < i.y1)) GROUP BY 1, 2""", _SPACE)  # fmt: skip
def join_layout_text(spark, d):
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("bbox.y0", "bbox.x0", "text"))
    return B.layout_text(_item_boxes(spark, d).withColumn("order_index", order).withColumnRenamed("text", "content"), S.ranges(spark, d))


@plan("agg_question_text", "SELECT doc_id, question_no, string_agg(text, chr(10) ORDER BY page_no, y0, x0, text) AS text FROM v_in GROUP BY 1, 2", _SPACE)
def agg_question_text(spark, d):
    rows = _inside(spark, d).groupBy("doc_id", "question_no").agg(F.array_sort(F.collect_list(F.struct("page_no", "bbox.y0", "bbox.x0", "text"))).alias("i"))
    return rows.select("doc_id", "question_no", F.array_join(F.transform("i", lambda x: x["text"]), "\n").alias("text"))


@plan("agg_bbox_union", "SELECT doc_id, question_no, min(x0) AS r_x0, min(y0) AS r_y0, max(x1) AS r_x1, max(y1) AS r_y1 FROM v_in GROUP BY 1, 2", _SPACE)
def agg_bbox_union(spark, d):
    return _inside(spark, d).groupBy("doc_id", "question_no").agg(G.union_box("bbox").alias("r")).select("doc_id", "question_no", *[F.col("r")[s].alias("r_" + s) for s in G.SIDES])


@plan("join_anchor_merge", "SELECT doc_id, page_no, text, x0, y0, score FROM v_anchor WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, page_no, text, x0, y0, max(0.92::DOUBLE) FROM v_anchor WHERE doc_id % 3 = 0 GROUP BY 1, 2, 3, 4, 5")
def join_anchor_merge(spark, d):
    rows = V.anchor_candidates(spark, d)
    out = B.merge_candidates(rows.where("doc_id % 3 <> 0"), rows.withColumn("score", F.lit(0.92)))
    return out.select("doc_id", "page_no", "text", "bbox.x0", "bbox.y0", "score")


@plan("join_page_lookup", "SELECT l.doc_id, l.page_no, l.ord, l.text, p.n FROM v_turns l JOIN (SELECT doc_id, page_no, count(*) AS n FROM v_turns GROUP BY 1, 2) p USING (doc_id, page_no)")
def join_page_lookup(spark, d):
    rows = V.turns(spark, d)
    return rows.join(rows.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("n")), ["doc_id", "page_no"]).select("doc_id", "page_no", "ord", "text", "n")


@plan("flt_chart_label_near_image", r"""SELECT doc_id, page_no, text, x0, y0 FROM (SELECT doc_id, page_no, 'label ' || doc_id % 10 AS text, x0, y0, x1, y1 FROM v_anchor) a WHERE EXISTS (SELECT 1 FROM v_excluded e WHERE e.doc_id = a.doc_id AND e.page_no = a.page_no AND a.x0 - 140 < bx1 AND bx0 < a.x1 + 140 AND a.y0 - 140 < by1 AND by0 < a.y1 + 140)""", _SPACE)
def flt_chart_label_near_image(spark, d):
    rows = V.anchor_candidates(spark, d)
    boxes = rows.where("doc_id % 4 = 0").select("doc_id", "page_no", G.expand(F.col("bbox"), B.IMAGE_MARGIN).alias("box"))
    labels = rows.withColumn("text", F.concat(F.lit("label "), F.col("doc_id") % 10))
    return B.near_images(labels, boxes).select("doc_id", "page_no", "text", "bbox.x0", "bbox.y0")


# --- blocks ----------------------------------------------------------------------------------------

_REFINE = "NOT (type = 'table') AND NOT (type = 'image') AND (confidence < 0.9 OR type IN ('equation', 'chem_equation') AND confidence < 0.98)"
_CONF = {"v_conf": "SELECT *, 1 - (ord * 7 + question_no) % 30 / 100.0::DOUBLE AS confidence FROM v_items"}


def _confident(spark, d):
    return V.question_items(spark, d).withColumn("confidence", 1 - (F.col("ord") * 7 + F.col("question_no")) % 30 / F.lit(100.0))


@plan("flt_should_refine_block", f"SELECT doc_id, question_no, ord, {_REFINE} AS refine FROM v_conf", _CONF)
def flt_should_refine_block(spark, d):
    image = F.when(F.col("type") == "image", 0.95).otherwise(0.0)
    return _confident(spark, d).select("doc_id", "question_no", "ord", B.should_refine(F.col("type"), F.col("confidence"), F.col("type") == "table", image).alias("refine"))


@plan("flt_uncertain_text", "SELECT doc_id, question_no, ord, confidence < 0.78 OR ord % 5 = 0 AS uncertain FROM v_conf", _CONF)
def flt_uncertain_text(spark, d):
    from ..operators.render import uncertain

    return _confident(spark, d).select("doc_id", "question_no", "ord", uncertain(F.col("confidence"), F.col("ord") % 5 == 0).alias("uncertain"))


@plan("exe_refine_ocr", f"SELECT doc_id, question_no, ord, CASE WHEN {_REFINE} THEN upper(content) ELSE content END AS text, CASE WHEN {_REFINE} THEN 0.99 ELSE confidence END::DOUBLE AS confidence, CASE WHEN {_REFINE} THEN content END AS coarse_text, CASE WHEN {_REFINE} THEN 'block_ocr' ELSE 'page_ocr' END AS ocr_engine FROM v_conf", _CONF)
def exe_refine_ocr(spark, d):
    image = F.when(F.col("type") == "image", 0.95).otherwise(0.0)
    blocks = _confident(spark, d).withColumn("block_id", F.concat_ws("_", "question_no", "ord")).withColumnRenamed("content", "text")
    second = blocks.where(B.should_refine(F.col("type"), F.col("confidence"), F.col("type") == "table", image)).select("doc_id", "block_id", F.upper("text").alias("text"), F.lit(0.99).alias("confidence"))
    return B.refine(blocks, second).select("doc_id", "question_no", "ord", "text", "confidence", "coarse_text", "ocr_engine")


@plan("exe_build_blocks", r"""SELECT doc_id, question_no, ord, 'q' || question_no || '_b' || row_number() OVER (PARTITION BY doc_id, question_no ORDER BY CASE type WHEN 'table' THEN 1 WHEN 'image' THEN 2 ELSE 0 END, ord) AS block_id, CASE WHEN type IN ('table', 'image') THEN type || ':0.95,text:0.05' ELSE 'text:0.9,equation:0.1' END AS candidates FROM v_items""")
def exe_build_blocks(spark, d):
    rows = B.number_blocks(V.question_items(spark, d).withColumn("content", F.concat(F.lit("item"), F.col("ord") % 10)))
    shown = F.when(F.col("type").isin("table", "image"), F.concat("type", F.lit(":0.95,text:0.05"))).otherwise(_candidates(D.classify_text(F.col("content"))))
    return rows.select("doc_id", "question_no", "ord", "block_id", shown.alias("candidates"))


@plan("set_union_blocks", "SELECT doc_id, question_no, ord, 'text' AS kind FROM v_items WHERE type NOT IN ('table', 'image') UNION ALL SELECT doc_id, question_no, ord, type FROM v_items WHERE type IN ('table', 'image')")
def set_union_blocks(spark, d):
    items = V.question_items(spark, d)
    part = lambda test, kind: items.where(test).select("doc_id", "question_no", "ord", F.lit(kind).alias("kind"))
    return part("type not in ('table', 'image')", "text").unionByName(part("type = 'table'", "table")).unionByName(part("type = 'image'", "image"))


@plan("exe_package", "SELECT r.doc_id, r.question_no, r.page_no, r.rx0, r.ry0, r.rx1, r.ry1, coalesce(t.text, '') AS rough_text FROM v_ranges r LEFT JOIN (SELECT doc_id, question_no, string_agg(text, chr(10) ORDER BY page_no, y0, x0, text) AS text FROM v_in GROUP BY 1, 2) t USING (doc_id, question_no)", _SPACE)
def exe_package(spark, d):
    r = F.col("range")
    ranges = S.ranges(spark, d)
    packages = ranges.join(agg_question_text(spark, d).withColumnRenamed("text", "rough_text"), ["doc_id", "question_no"], "left")
    return packages.select("doc_id", "question_no", "page_no", *[r[s].alias("r" + s) for s in G.SIDES], F.coalesce("rough_text", F.lit("")).alias("rough_text"))


# --- overrides -------------------------------------------------------------------------------------

@plan("dec_llm_override", "SELECT block_id, CASE WHEN p_partkey % 5 = 0 THEN 'image' ELSE final_type END AS final_type, CASE WHEN p_partkey % 10 = 0 THEN 0.5 ELSE confidence END::DOUBLE AS confidence FROM v_typed", CLASSES)
def dec_llm_override(spark, d):
    rules = dec_block_type(spark, d).select("block_id", "final_type", "confidence")
    given = V.formulas(spark, d).where("p_partkey % 5 = 0").select("block_id", F.lit("image").alias("final_type"), F.when(F.col("p_partkey") % 10 == 0, 0.5).alias("confidence"))
    return D.apply_overrides(rules, given, ["block_id"], ["final_type", "confidence"])


@plan("dec_llm_span_coerce", "SELECT event_id AS doc_id, (event_id % 9)::BIGINT AS question_no, 'a' || event_id AS start_block_id, 'b' AS end_block_id FROM events WHERE event_id % 3 <> 0")
def dec_llm_span_coerce(spark, d):
    tail = F.when(F.col("event_id") % 3 != 0, ',"end_block_id":"b"').otherwise("")
    raw = F.concat(F.lit('[{"question_no":'), F.col("event_id") % 9, F.lit(',"start_block_id":"a'), "event_id", F.lit('"'), tail, F.lit("}]"))
    return D.parse_spans(V.table(spark, d, "events").select(F.col("event_id").alias("doc_id"), raw.alias("raw")), "raw")


@plan("dec_llm_nonempty_guard", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '7' ELSE numbers END AS numbers FROM v_summary", S.ANCHORS | S._SUMMARY)
def dec_llm_nonempty_guard(spark, d):
    s = W.anchor_summary(S.deduped(spark, d))
    given = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(7).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return s.select("doc_id", D.nonempty_or(given, F.col("numbers")).alias("numbers")).select("doc_id", _csv("numbers").alias("numbers"))

