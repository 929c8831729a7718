"""Windows over anchors, words and blocks; noise; section split."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import noise as N
from ..operators import windows as W
from ..sources import views as V
from .registry import plan
from .scalars import LINE_TEXTS

ANCHORS = {
    "v_num": r"SELECT *, try_cast(regexp_extract(trim(text), '^([0-9]+)\.', 1) AS BIGINT) AS question_no FROM v_anchor",
    "v_first": "SELECT *, row_number() OVER (PARTITION BY doc_id, question_no ORDER BY page_no, y0, x0, question_no, text) AS occurrence, rank() OVER (PARTITION BY doc_id ORDER BY page_no, y0, x0, question_no, text) AS position FROM v_num WHERE question_no > 0",
    "v_kept": "SELECT * FROM v_first WHERE occurrence = 1",
    "v_cols": """SELECT *, n < 2 OR spread < 496 AS single, CASE WHEN center > 1240 THEN 1 ELSE 0 END AS col FROM (SELECT *, count(*) OVER p AS n, max(center) OVER p - min(center) OVER p AS spread FROM
      (SELECT *, (x0 + x1) / 2.0::DOUBLE AS center FROM v_kept) WINDOW p AS (PARTITION BY doc_id, page_no))""",
    "v_bounds": "SELECT *, CASE WHEN single OR col = 0 THEN 0 ELSE 1248 END AS left_edge, CASE WHEN single OR col = 1 THEN 2480 ELSE 1232 END AS right_edge FROM v_cols",
    "v_next": "SELECT *, min(y0) OVER (PARTITION BY doc_id, page_no, CASE WHEN single THEN -1 ELSE col END ORDER BY y0 RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_y0 FROM v_bounds",
    "v_ranges": "SELECT *, left_edge AS rx0, y0 AS ry0, right_edge AS rx1, CASE WHEN next_y0 IS NULL THEN 3505 ELSE greatest(y0 + 10, next_y0 - 4) END AS ry1 FROM v_next",
}


def deduped(spark, d):
    return W.dedup_anchors(W.numbered(V.anchor_candidates(spark, d)))


def kept(spark, d):
    return deduped(spark, d).where("occurrence = 1")


def ranges(spark, d):
    return W.page_ranges(W.next_in_column(W.column_bounds(kept(spark, d), V.PAGE_WIDTH)), V.PAGE_HEIGHT)


@plan("win_anchor_dedup", "SELECT doc_id, question_no, page_no, x0, y0, text, position FROM v_kept", ANCHORS)
def win_anchor_dedup(spark, d):
    return kept(spark, d).select("doc_id", "question_no", "page_no", "bbox.x0", "bbox.y0", "text", "position")


@plan("win_column_bounds", "SELECT doc_id, question_no, page_no, left_edge, right_edge FROM v_bounds", ANCHORS)
def win_column_bounds(spark, d):
    return W.column_bounds(kept(spark, d), V.PAGE_WIDTH).select("doc_id", "question_no", "page_no", "left_edge", "right_edge")


@plan("win_next_same_column", "SELECT doc_id, question_no, page_no, next_y0 FROM v_next", ANCHORS)
def win_next_same_column(spark, d):
    return W.next_in_column(W.column_bounds(kept(spark, d), V.PAGE_WIDTH)).select("doc_id", "question_no", "page_no", "next_y0")


@plan("win_page_range", "SELECT doc_id, question_no, page_no, rx0, ry0, rx1, ry1 FROM v_ranges", ANCHORS)
def win_page_range(spark, d):
    r = F.col("range")
    return ranges(spark, d).select("doc_id", "question_no", "page_no", *[r[s].alias("r" + s) for s in G.SIDES])


_ROWS = {
    "v_step": "SELECT *, CASE WHEN abs(y0 - lag(y0) OVER w) <= 28 THEN 0 ELSE 1 END AS fresh FROM v_words WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY y0, x0, line_no, word_no)",
    "v_rows": "SELECT * EXCLUDE (fresh), sum(fresh) OVER (PARTITION BY doc_id, page_no ORDER BY y0, x0, line_no, word_no) AS row_no FROM v_step",
    "v_gap": """SELECT *, CASE WHEN x0 - lag(x1) OVER w < greatest(64, trunc(avg(greatest(1, y1 - y0)) OVER r * 1.6::DOUBLE)) THEN 0 ELSE 1 END AS fresh FROM v_rows
      WINDOW w AS (PARTITION BY doc_id, page_no, row_no ORDER BY x0, y0, line_no, word_no), r AS (PARTITION BY doc_id, page_no, row_no)""",
    "v_segments": "SELECT * EXCLUDE (fresh), sum(fresh) OVER (PARTITION BY doc_id, page_no, row_no ORDER BY x0, y0, line_no, word_no) AS segment_no FROM v_gap",
    "v_synthetic": """SELECT doc_id, page_no, row_no, segment_no, 'p' || page_no || '_qb' || row_no || '_' || segment_no AS line_id, string_agg(trim(text), ' ' ORDER BY x0, y0, line_no, word_no) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
      avg(confidence) AS confidence, max(height) AS height FROM v_segments GROUP BY doc_id, page_no, row_no, segment_no""",
}


def segments(spark, d):
    return W.split_segments(W.cluster_rows(V.words(spark, d)))


@plan("win_row_cluster", "SELECT doc_id, page_no, line_no, word_no, row_no::INTEGER AS row_no FROM v_rows", _ROWS)
def win_row_cluster(spark, d):
    return W.cluster_rows(V.words(spark, d)).select("doc_id", "page_no", "line_no", "word_no", "row_no")


@plan("win_segment_split", "SELECT doc_id, page_no, line_no, word_no, row_no::INTEGER AS row_no, segment_no::INTEGER AS segment_no FROM v_segments", _ROWS)
def win_segment_split(spark, d):
    return segments(spark, d).select("doc_id", "page_no", "line_no", "word_no", "row_no", "segment_no")


@plan("win_synthetic_lines", "SELECT doc_id, page_no, line_id, text, x0, y0, x1, y1, round(confidence, 10) AS confidence FROM v_synthetic", _ROWS)
def win_synthetic_lines(spark, d):
    b = F.col("bbox")
    return W.synthetic_lines(segments(spark, d)).select("doc_id", "page_no", "line_id", "text", *[b[s].alias(s) for s in G.SIDES], F.round("confidence", 10).alias("confidence"))


@plan("win_anchor_snippet", """WITH n AS (SELECT h.doc_id, h.page_no, h.line_no, h.word_no, w.text, w.x0, w.x1, w.line_no AS wl, w.word_no AS ww FROM v_words h JOIN v_words w USING (doc_id, page_no)
  WHERE h.word_no % 9 = 0 AND h.line_no % 5 = 0 AND abs(w.y0 - h.y0) <= 28 AND abs(w.y1 - h.y1) <= 28 AND w.x0 BETWEEN h.x0 AND h.x0 + 900),
 f AS (SELECT *, CASE WHEN x0 - lag(x1) OVER o > 180 THEN 1 ELSE 0 END AS far, row_number() OVER o AS k, sum(length(text) + 1) OVER o - 1 AS len FROM n WINDOW o AS (PARTITION BY doc_id, page_no, line_no, word_no ORDER BY x0, wl, ww)),
 g AS (SELECT *, max(far) OVER o AS cut, coalesce(max(CASE WHEN k >= 10 OR len >= 80 THEN 1 ELSE 0 END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM f WINDOW o AS (PARTITION BY doc_id, page_no, line_no, word_no ORDER BY x0, wl, ww))
 SELECT doc_id, page_no, line_no, word_no, string_agg(text, ' ' ORDER BY k) AS text FROM g WHERE cut = 0 AND done = 0 GROUP BY 1, 2, 3, 4""")  # fmt: skip
def win_anchor_snippet(spark, d):
    # These pages have no numbered words, so every ninth word of every fifth line stands in for an anchor.
    words = V.words(spark, d).withColumn("text", F.when((F.col("word_no") % 9 == 0) & (F.col("line_no") % 5 == 0), F.concat(F.lit("1.\u0003"), "text")).otherwise(F.col("text")))
    out = W.anchor_snippets(words, pattern="^1\\.\u0003")
    return out.select("doc_id", "page_no", "anchor.line_no", "anchor.word_no", F.replace("text", F.lit("1.\u0003"), F.lit("")).alias("text"))


@plan("win_surrounding_text", "SELECT doc_id, question_no, ord, concat_ws(' ', nullif(trim(lag(content) OVER w), ''), nullif(trim(lead(content) OVER w), '')) AS around FROM v_items WINDOW w AS (PARTITION BY doc_id, question_no ORDER BY ord)")
def win_surrounding_text(spark, d):
    return W.surrounding_text(V.question_items(spark, d).withColumnRenamed("content", "text")).select("doc_id", "question_no", "ord", "around")


_SLOTS = "SELECT doc_id, question_no, (1 + (row_number() OVER (PARTITION BY doc_id ORDER BY question_no) - 1) // 2)::INTEGER AS start_page, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY question_no) % 2 = 1 THEN 'left' ELSE 'right' END AS start_column FROM (SELECT DISTINCT doc_id, question_no FROM v_items)"


@plan("win_layout_slots", _SLOTS)
def win_layout_slots(spark, d):
    return W.layout_slots(V.question_items(spark, d).select("doc_id", "question_no").distinct())


@plan("helper_layout_plan", _SLOTS)
def helper_layout_plan(spark, d):
    return win_layout_slots(spark, d)


_NMS = """WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0, x0, x1, y1) AS k FROM v_anchor),
s AS (SELECT doc_id, page_no, 1::BIGINT AS k, [{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}] AS kept FROM b WHERE k = 1
  UNION ALL SELECT s.doc_id, s.page_no, s.k + 1, CASE WHEN len(list_filter(s.kept, lambda q: greatest(q.x0, b.x0) < least(q.x1, b.x1) AND greatest(q.y0, b.y0) < least(q.y1, b.y1))) > 0 THEN s.kept
    ELSE list_append(s.kept, {'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1}) END FROM s JOIN b ON b.doc_id = s.doc_id AND b.page_no = s.page_no AND b.k = s.k + 1)
SELECT doc_id, page_no, q.x0 AS x0, q.y0 AS y0, q.x1 AS x1, q.y1 AS y1 FROM (SELECT doc_id, page_no, unnest(kept) AS q FROM (SELECT *, max(k) OVER (PARTITION BY doc_id, page_no) AS top FROM s) WHERE k = top)"""


@plan("win_greedy_nms", _NMS)
def win_greedy_nms(spark, d):
    out = W.greedy_boxes(V.anchor_candidates(spark, d), ["doc_id", "page_no"])
    return out.select("doc_id", "page_no", *[F.col("bbox")[s].alias(s) for s in G.SIDES])


@plan("win_duplicate_numbers", "SELECT doc_id, question_no, occurrence FROM v_first WHERE occurrence > 1", ANCHORS)
def win_duplicate_numbers(spark, d):
    return deduped(spark, d).where("occurrence > 1").select("doc_id", "question_no", "occurrence")


@plan("win_first_text", "SELECT doc_id, question_no, ord, question_no > min(question_no) OVER (PARTITION BY doc_id) AS column_break FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, question_no ORDER BY ord) AS k FROM v_items WHERE type = 'text') WHERE k = 1")
def win_first_text(spark, d):
    from ..operators.render import first_text_items

    return first_text_items(V.question_items(spark, d)).select("doc_id", "question_no", "ord", "column_break")


@plan("win_block_index", "SELECT doc_id, question_no, ord, type, 'q' || question_no || '_b' || row_number() OVER (PARTITION BY doc_id, question_no ORDER BY CASE type WHEN 'table' THEN 1 WHEN 'image' THEN 2 ELSE 0 END, ord) AS block_id FROM v_items")
def win_block_index(spark, d):
    from ..operators.blocks import number_blocks

    return number_blocks(V.question_items(spark, d)).select("doc_id", "question_no", "ord", "type", "block_id")


# --- anchors as decisions --------------------------------------------------------------------------

_SUMMARY = {
    "v_sum": """SELECT doc_id, list(question_no ORDER BY position) FILTER (WHERE occurrence = 1) AS numbers, coalesce(list_sort(list(DISTINCT question_no) FILTER (WHERE occurrence > 1)), []) AS uncertain FROM v_first GROUP BY 1""",
    "v_missing": "SELECT *, list_sort(list_filter(range(numbers[1], numbers[-1] + 1), lambda x: NOT list_contains(numbers, x))) AS missing FROM v_sum",
    "v_summary": "SELECT doc_id, array_to_string(numbers, ',') AS numbers, array_to_string(missing, ',') AS missing, array_to_string(uncertain, ',') AS uncertain, len(missing) = 0 AS sequence_ok, CASE WHEN len(missing) = 0 THEN 0.89 ELSE 0.66 END::DOUBLE AS confidence FROM v_missing",
}
_joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


@plan("agg_anchor_summary", "SELECT * FROM v_summary", ANCHORS | _SUMMARY)
def agg_anchor_summary(spark, d):
    s = W.anchor_summary(deduped(spark, d))
    return s.select("doc_id", _joined("numbers"), _joined("missing"), _joined("uncertain"), "sequence_ok", "confidence")


@plan("dec_question_anchors", "SELECT k.doc_id, k.question_no, k.page_no, k.text, s.sequence_ok, s.confidence FROM v_kept k JOIN v_summary s USING (doc_id)", ANCHORS | _SUMMARY)
def dec_question_anchors(spark, d):
    rows = deduped(spark, d)
    return rows.where("occurrence = 1").join(W.anchor_summary(rows), "doc_id").select("doc_id", "question_no", "page_no", "text", "sequence_ok", "confidence")


@plan("dec_question_split", "SELECT doc_id, question_no, page_no, text, position FROM v_first WHERE question_no > 0 AND page_no IN (1)", ANCHORS)
def dec_question_split(spark, d):
    return deduped(spark, d).where("question_no > 0 and page_no in (1)").select("doc_id", "question_no", "page_no", "text", "position")


@plan("dec_anchor_score", "SELECT doc_id, text, x0, y0, page_no, least(0.99, greatest(0.1, (CASE WHEN doc_id % 2 = 0 THEN 0.9 ELSE 0.4 END + score) / 2))::DOUBLE AS anchor_score FROM v_anchor")
def dec_anchor_score(spark, d):
    from ..operators.decisions import anchor_score

    text = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("no "), "text"))
    return V.anchor_candidates(spark, d).select("doc_id", "text", "bbox.x0", "bbox.y0", "page_no", anchor_score(text, F.col("score")).alias("anchor_score"))


@plan("join_missing_numbers", "SELECT doc_id, unnest(missing) AS question_no FROM v_missing", ANCHORS | _SUMMARY)
def join_missing_numbers(spark, d):
    return W.anchor_summary(deduped(spark, d)).select("doc_id", F.explode("missing").alias("question_no"))


@plan("set_except_numbers", "SELECT doc_id, array_to_string(missing, ',') AS missing FROM v_missing", ANCHORS | _SUMMARY)
def set_except_numbers(spark, d):
    return W.anchor_summary(deduped(spark, d)).select("doc_id", _joined("missing"))


@plan("gen_range", "SELECT doc_id, unnest(range(min(question_no), max(question_no) + 1)) AS question_no FROM v_kept GROUP BY doc_id", ANCHORS)
def gen_range(spark, d):
    return kept(spark, d).groupBy("doc_id").agg(F.min("question_no").alias("a"), F.max("question_no").alias("b")).select("doc_id", F.explode(F.sequence("a", "b")).alias("question_no"))


@plan("sort_packages", "SELECT doc_id, question_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, question_no) AS place FROM v_kept", ANCHORS)
def sort_packages(spark, d):
    from ..operators.blocks import sort_packages as in_order

    pages = kept(spark, d).withColumn("question_pages", F.array(F.lit(1), F.lit(2)))
    return in_order(pages).select("doc_id", "question_no", "place")


# --- noise -----------------------------------------------------------------------------------------

_KW = "'저작권|다음 면|세종과학고등학교|- 끝'"
NOISE = LINE_TEXTS | {
    "v_region": rf"""SELECT doc_id, page_no, ord, text, y0, y1, height, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[0-9]+', '#', 'g') AS canonical,
      CASE WHEN y0 >= trunc(height * 0.8::DOUBLE) OR regexp_matches(text, {_KW}) THEN 'footer' WHEN y1 <= trunc(height * 0.18::DOUBLE) THEN 'header' END AS region FROM v_lines""",
    "v_patterns": f"""SELECT doc_id, region, canonical, pages, CASE WHEN region = 'header' THEN bottom ELSE top END AS edge FROM (SELECT doc_id, region, canonical, count(DISTINCT page_no) AS pages, arg_min(text, (page_no, ord)) AS sample, max(y1) AS bottom, min(y0) AS top
      FROM v_region WHERE region IS NOT NULL GROUP BY 1, 2, 3) WHERE (pages >= 2 OR regexp_matches(sample, {_KW})) AND (region = 'footer' OR pages >= 3 AND length(trim(sample)) >= 12 AND NOT starts_with(canonical, '#. '))""",
    "v_profile": """SELECT doc_id, max(edge) FILTER (WHERE region = 'header') AS header_bottom, min(edge) FILTER (WHERE region = 'footer') AS footer_top, coalesce(list_sort(list(DISTINCT canonical) FILTER (WHERE region = 'header')), []) AS header_patterns,
      coalesce(list_sort(list(DISTINCT canonical) FILTER (WHERE region = 'footer')), []) AS footer_patterns FROM v_patterns GROUP BY 1""",
    "v_noise": f"""SELECT r.doc_id, r.page_no, r.ord, r.text, p.doc_id IS NOT NULL AND (coalesce(r.y0 >= p.footer_top - 6 AND (list_contains(p.footer_patterns, canonical) OR regexp_matches(text, {_KW})), false)
      OR coalesce(r.y1 <= p.header_bottom + 6 AND list_contains(p.header_patterns, canonical), false) OR r.y0 >= trunc(r.height * 0.92::DOUBLE) AND regexp_matches(text, {_KW})) AS noise FROM v_region r LEFT JOIN v_profile p USING (doc_id)""",
}


def profile(spark, d):
    return N.noise_profile(N.noise_patterns(N.noise_buckets(V.lines(spark, d))))


@plan("agg_noise_buckets", "SELECT doc_id, page_no, ord, region, canonical FROM v_region WHERE region IS NOT NULL", NOISE)
def agg_noise_buckets(spark, d):
    return N.noise_buckets(V.lines(spark, d)).select("doc_id", "page_no", "ord", "region", "canonical")


@plan("agg_noise_profile", "SELECT doc_id, header_bottom, footer_top, array_to_string(header_patterns, '|') AS header_patterns, array_to_string(footer_patterns, '|') AS footer_patterns FROM v_profile", NOISE)
def agg_noise_profile(spark, d):
    return profile(spark, d).select("doc_id", "header_bottom", "footer_top", F.array_join("header_patterns", "|").alias("header_patterns"), F.array_join("footer_patterns", "|").alias("footer_patterns"))


@plan("set_distinct_patterns", "SELECT DISTINCT doc_id, region, canonical FROM v_patterns", NOISE)
def set_distinct_patterns(spark, d):
    return N.noise_patterns(N.noise_buckets(V.lines(spark, d))).select("doc_id", "region", "canonical").distinct()


@plan("flt_noise_line", "SELECT * FROM v_noise", NOISE)
def flt_noise_line(spark, d):
    return N.flag_noise(V.lines(spark, d), profile(spark, d)).select("doc_id", "page_no", "ord", "text", "noise")


@plan("stage_noise", "SELECT doc_id, region, canonical, pages, edge FROM v_patterns", NOISE)
def stage_noise(spark, d):
    return N.noise_patterns(N.noise_buckets(V.lines(spark, d)))
