"""Sources, tables, validation, triage and output rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import crops
from ..operators import decisions as D
from ..operators import render as R
from ..operators import tables as X
from ..operators import validate as C
from ..sources import layout, ocr, template
from ..sources import views as V
from ..sources.config import prompt_sections
from . import decide
from . import sequences as S
from .registry import plan

# --- sources ---------------------------------------------------------------------------------------


@plan("src_file_hash", "SELECT page_id, sha1(html) AS digest FROM pages")
def src_file_hash(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"))


@plan("src_ocr_cache", "SELECT page_id, sha1(concat_ws('|', hex(encode(url)), 'V2', 'ko', 'true', 'u', '')) AS digest, page_id % 3 = 0 AS hit FROM pages")
def src_ocr_cache(spark, d):
    digest = ocr.cache_digest(F.col("url").cast("binary"), "V2", "ko", True, "u")
    requests = V.table(spark, d, "pages").select("page_id", digest.alias("digest"))
    cache = requests.where("page_id % 3 = 0").select("digest").distinct()
    hits, misses = ocr.cache_hits(requests, cache), ocr.cache_misses(requests, cache)
    return hits.select("page_id", "digest", F.lit(True).alias("hit")).unionByName(misses.select("page_id", "digest", F.lit(False).alias("hit")))


@plan("src_ocr_url_norm", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://x.ncloud.com/' || page_id ELSE 'http://other.org/' || page_id END AS url FROM pages")
def src_ocr_url_norm(spark, d):
    host = F.when(F.col("page_id") % 2 == 0, "http://x.ncloud.com/").otherwise("http://other.org/")
    return V.table(spark, d, "pages").select("page_id", ocr.normalize_url(F.concat(host, "page_id")).alias("url"))


@plan("src_ocr_page", "SELECT doc_id, page_no, ord, text FROM v_turns")
def src_ocr_page(spark, d):
    return ocr.ocr_pages(None, V.turns(spark, d)).select("doc_id", "page_no", "ord", "text")


@plan("src_ocr_crop", "SELECT doc_id, 'q' || question_no || '_b' || ord AS block_id, content AS text, 1.0::DOUBLE AS confidence FROM v_items")
def src_ocr_crop(spark, d):
    crops = V.question_items(spark, d).select("doc_id", F.concat(F.lit("q"), "question_no", F.lit("_b"), "ord").alias("block_id"), F.col("content").alias("text"))
    return ocr.crop_lines(crops)


_TREE = {
    "v_nodes": """SELECT l_orderkey AS doc_id, l_linenumber AS node_id, CASE WHEN l_linenumber > 1 THEN l_linenumber // 2 END AS parent_id, l_linenumber % 2 AS ord, CASE WHEN l_linenumber = 3 AND l_orderkey % 2 = 0 THEN 'header' ELSE 'paragraph' END AS type, l_quantity
      FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)""",
}


def _nodes(spark, d):
    n = F.col("l_linenumber")
    rows = V.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    box = F.struct(F.lit(0.0).alias("left"), F.lit(0.0).alias("bottom"), F.col("q").alias("right"), F.col("q").alias("top"))
    return rows.select(F.col("l_orderkey").alias("doc_id"), n.cast("long").alias("node_id"), F.when(n > 1, F.floor(n / 2)).cast("long").alias("parent_id"), (n % 2).alias("ord"), F.when((n == 3) & (F.col("l_orderkey") % 2 == 0), "header").otherwise("paragraph").alias("type"), F.lit(1).alias("page_no"), box.alias("bbox_pdf"), F.concat(F.lit("node "), n).alias("content"))


_WALK = """WITH RECURSIVE t AS (SELECT doc_id, node_id, [ord] AS path, CASE WHEN type = 'header' THEN 1 ELSE 0 END AS hidden FROM v_nodes WHERE parent_id IS NULL
  UNION ALL SELECT n.doc_id, n.node_id, list_append(t.path, n.ord), greatest(t.hidden, CASE WHEN n.type = 'header' THEN 1 ELSE 0 END) FROM v_nodes n JOIN t ON n.doc_id = t.doc_id AND n.parent_id = t.node_id)
  SELECT doc_id, node_id, 'node ' || node_id AS content, array_to_string(path, '.') AS path FROM t WHERE hidden = 0"""


def _with_tree(sql):
    return sql.replace("WITH RECURSIVE t", f"WITH RECURSIVE v_nodes AS ({_TREE['v_nodes']}), t", 1)


@plan("src_layout_tree_walk", _with_tree(_WALK))
def src_layout_tree_walk(spark, d):
    return layout.walk_tree(_nodes(spark, d)).select("doc_id", "node_id", "content", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"))


@plan("sort_reading_order", _with_tree(_WALK.replace("SELECT doc_id, node_id, 'node ' || node_id AS content, array_to_string(path, '.') AS path FROM t", "SELECT doc_id, node_id, row_number() OVER (PARTITION BY doc_id ORDER BY path, node_id) AS place FROM t")))
def sort_reading_order(spark, d):
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("path", "node_id"))
    return layout.walk_tree(_nodes(spark, d)).select("doc_id", "node_id", place.alias("place"))


@plan("flt_layout_regions", "SELECT doc_id, node_id FROM v_nodes WHERE type NOT IN ('header', 'footer')", _TREE)
def flt_layout_regions(spark, d):
    return layout.drop_regions(_nodes(spark, d).withColumnRenamed("type", "kind")).select("doc_id", "node_id")


@plan("src_template_plan", "SELECT p_partkey, contains(p_name, 'a') OR contains(p_name, 'red') AS should_apply FROM part")
def src_template_plan(spark, d):
    return V.table(spark, d, "part").select("p_partkey", template.should_apply(True, ["a", "red"], F.col("p_name"), F.lit(8)).alias("should_apply"))


def _template(spark, d):
    names = ("name", "label", "key", "inferFieldName", "inferText", "value", "text", "inferFieldValue")
    entry = lambda **k: F.struct(*[(k[n] if n in k else F.lit(None).cast("string")).alias(n) for n in names])
    brand, size = F.col("p_brand"), F.col("p_size").cast("string")
    title = F.array(entry(name=F.lit("school"), value=F.lit("title school")))
    fields = F.array(entry(name=F.lit(" "), label=F.lit("school"), inferText=brand), entry(key=F.lit("과목"), text=size), entry(key=F.lit("과목"), inferFieldValue=F.when(F.col("p_size") % 2 == 0, F.col("p_type"))))
    return template.read_fields(V.table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), title.alias("title"), fields.alias("fields")))


@plan("src_template_extract", "SELECT p_partkey AS doc_id, p_brand AS school, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_size::VARCHAR END AS subject FROM part")
def src_template_extract(spark, d):
    return _template(spark, d).select("doc_id", F.col("template")["school"].alias("school"), F.col("template")["과목"].alias("subject"))


@plan("src_template_merge", "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 'own' ELSE p_brand END AS school, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_size::VARCHAR END AS subject, CASE WHEN p_partkey % 2 = 0 THEN 'filename' ELSE 'template' END AS school_source, 'template' AS subject_source FROM part")
def src_template_merge(spark, d):
    own = F.col("doc_id") % 2 == 0
    none = F.lit(None).cast("string")
    fields = _template(spark, d)
    meta = fields.select("doc_id", F.when(own, "own").alias("school"), none.alias("subject"), none.alias("exam_type"), F.when(own, "filename").alias("school_source"), none.alias("subject_source"), none.alias("exam_type_source"))
    return template.merge_meta(meta, fields).select("doc_id", "school", "subject", "school_source", "subject_source")


@plan("src_prompts", """WITH l AS (SELECT doc_id, page_no, ord, CASE WHEN ord % 4 = 2 THEN '## part ' || ord ELSE text END AS text, ord % 4 = 2 AS h FROM v_turns), s AS (SELECT doc_id || '/' || page_no AS doc_id, ord, text, h, sum(h::INT) OVER (PARTITION BY doc_id, page_no ORDER BY ord) AS s FROM l)
  SELECT doc_id, max(text[9:]) FILTER (WHERE h) AS part, trim(coalesce(string_agg(text, chr(10) ORDER BY ord) FILTER (WHERE NOT h), '')) AS body FROM s WHERE s > 0 GROUP BY doc_id, s""")  # fmt: skip
def src_prompts(spark, d):
    o = F.col("ord")
    rows = V.turns(spark, d).select(F.concat("doc_id", F.lit("/"), "page_no").alias("doc_id"), "ord", F.when(o % 4 == 2, F.concat(F.lit("## part "), o)).otherwise(F.col("text")).alias("text"))
    return prompt_sections(rows).select("doc_id", F.regexp_replace("name", "^part ", "").alias("part"), "body")


# --- normalisation ---------------------------------------------------------------------------------


@plan("norm_lines_from_text", "SELECT doc_id, page_no, 'p' || page_no || '_l' || ord AS line_id, text, x0, y0, x1, y1, confidence FROM v_lines")
def norm_lines_from_text(spark, d):
    b = F.col("bbox")
    return V.lines(spark, d).select("doc_id", "page_no", "line_id", "text", *[b[s].alias(s) for s in G.SIDES], "confidence")


def _text_arrays(spark, d):
    return V.document_pages(spark, d).select("doc_id", "page_no", F.split("text", "\n", -1).alias("items"))


@plan("norm_page", "SELECT doc_id, page_no, ord, 'p' || page_no || '_l' || ord AS id, text FROM v_lines")
def norm_page(spark, d):
    return ocr.number_items(_text_arrays(spark, d), "items", "l")


@plan("norm_words", "SELECT doc_id, page_no, ord, 'p' || page_no || '_w' || ord AS id, text FROM v_lines")
def norm_words(spark, d):
    return ocr.number_items(_text_arrays(spark, d), "items", "w")


# Means are compared to ten digits: at fewer, long lines of round values fall on halves.
@plan("norm_lines_from_words", """SELECT doc_id, page_no, ord, 'p' || page_no || '_l' || ord AS line_id, text, x0, x1, round(confidence, 10) AS confidence FROM (SELECT doc_id, page_no, line_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS ord, string_agg(trim(text), ' ' ORDER BY word_no) AS text, min(x0) AS x0, max(x1) AS x1, avg(confidence) AS confidence FROM v_words GROUP BY 1, 2, 3)""")
def norm_lines_from_words(spark, d):
    out = ocr.lines_from_words(V.words(spark, d).withColumn("block_no", F.lit(None).cast("int")))
    return out.select("doc_id", "page_no", "ord", "line_id", "text", "bbox.x0", "bbox.x1", F.round("confidence", 10).alias("confidence"))


@plan("norm_pdf_words", "SELECT doc_id, page_no, line_no, word_no, trim(text) AS text, x0, confidence, 'pdf_text_stub' AS backend FROM v_words")
def norm_pdf_words(spark, d):
    return V.words(spark, d).select("doc_id", "page_no", "line_no", "word_no", F.trim("text").alias("text"), "bbox.x0", "confidence", F.lit("pdf_text_stub").alias("backend"))


@plan("norm_fields_to_lines", """WITH f AS (SELECT doc_id, page_no, line_no::BIGINT * 1000000 + word_no AS ord, text, x0, y0, x1, y1, confidence, word_no % 5 = 4 AS brk FROM v_words WHERE word_no % 11 <> 10),
  g AS (SELECT *, sum(b) OVER (PARTITION BY doc_id, page_no ORDER BY ord) AS line FROM (SELECT *, coalesce(lag(brk::INT) OVER (PARTITION BY doc_id, page_no ORDER BY ord), 0) AS b FROM f))
  SELECT doc_id, page_no, line::INTEGER AS line_no, string_agg(text, ' ' ORDER BY ord) AS text, min(x0) AS x0, max(y1) AS y1, round(avg(confidence), 10) AS confidence FROM g GROUP BY 1, 2, 3""")  # fmt: skip
def norm_fields_to_lines(spark, d):
    b, w = F.col("bbox"), F.col("word_no")
    point = lambda x, y: F.struct(b[x].cast("double").alias("x"), b[y].cast("double").alias("y"))
    corners = F.array(point("x0", "y0"), point("x1", "y0"), point("x1", "y1"), point("x0", "y1"))
    fields = V.words(spark, d).select("doc_id", "page_no", (F.col("line_no").cast("long") * 1_000_000 + w).alias("ord"), "text", (w % 5 == 4).alias("lineBreak"), "confidence", F.when(w % 11 == 10, F.slice(corners, 1, 3)).otherwise(corners).alias("vertices"))
    return ocr.fields_to_lines(fields).select("doc_id", "page_no", "line_no", "text", "bbox.x0", "bbox.y1", F.round("confidence", 10).alias("confidence"))


_RAW = "SELECT doc_id, 'clova_table_' || doc_id AS table_id, max(row + 1) AS n_rows, max(col + 1) AS n_cols, string_agg(text, '|' ORDER BY row, col) AS texts FROM v_cells GROUP BY 1"


def _raw_tables(spark, d):
    none = F.filter(F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))), lambda _: F.lit(False))
    cell = F.struct(F.col("row").alias("rowIndex"), F.col("col").alias("columnIndex"), F.lit(None).cast("int").alias("rowSpan"), F.lit(1).alias("columnSpan"), F.array(F.array("text")).alias("lines"), F.lit(0.9).alias("confidence"), none.alias("vertices"))
    tables = V.cells(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row", "col", cell.alias("cell")))).alias("c"))
    return ocr.raw_tables(tables.select("doc_id", F.lit(1).alias("page_no"), F.col("doc_id").alias("ord"), none.alias("vertices"), F.transform("c", lambda x: x["cell"]).alias("cells")))


@plan("norm_raw_tables", _RAW)
def norm_raw_tables(spark, d):
    return _raw_tables(spark, d).select("doc_id", "table_id", "n_rows", "n_cols", F.array_join(F.transform("cells", lambda c: c["text"]), "|").alias("texts"))


@plan("norm_tables", "SELECT doc_id, row, col, 1 AS rowspan, 1 AS colspan, text FROM v_cells")
def norm_tables(spark, d):
    return _raw_tables(spark, d).select("doc_id", F.explode("cells").alias("c")).select("doc_id", "c.row", "c.col", "c.rowspan", "c.colspan", "c.text")


@plan("helper_ocr_normalize", "SELECT doc_id, page_no, count(*) AS lines, 'pdf_text_stub' AS backend FROM v_lines GROUP BY 1, 2")
def helper_ocr_normalize(spark, d):
    return V.lines(spark, d).groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("lines"), F.lit("pdf_text_stub").alias("backend"))


@plan("helper_llm_payload", "SELECT block_id, '{\"block_id\":\"' || block_id || '\",\"p_size\":' || p_size || '}' AS payload FROM v_formulas")
def helper_llm_payload(spark, d):
    return V.formulas(spark, d).select("block_id", F.to_json(F.struct("block_id", "p_size")).alias("payload"))


# --- tables ----------------------------------------------------------------------------------------

TABLES = {
    "v_stats": r"""SELECT doc_id, table_id, n_rows, n_cols, count(*) AS cells, count(*) FILTER (WHERE t <> '') AS filled, count(DISTINCT row) FILTER (WHERE t <> '') AS full_rows, count(DISTINCT col) FILTER (WHERE t <> '') AS full_cols,
      count(*) FILTER (WHERE t <> '' AND length(t) >= 40) AS long, count(*) FILTER (WHERE t <> '' AND length(t) <= 8) AS short, count(*) FILTER (WHERE t <> '' AND regexp_full_match(t, '[0-9]+')) AS numeric, count(*) FILTER (WHERE t <> '' AND regexp_matches(t, '\p{L}')) AS alpha,
      array_to_string(list(t ORDER BY row, col) FILTER (WHERE t <> '')[1:6], ' ') AS text FROM (SELECT *, trim(text) AS t FROM v_shaped) GROUP BY 1, 2, 3, 4""",
    # Two shapes beside the plain one: a lookup grid of digits and letters, and label and value columns.
    "v_shaped": """SELECT doc_id, table_id, n_rows, CASE WHEN doc_id % 3 = 1 THEN 2 ELSE n_cols END AS n_cols, row, col, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN row = 0 THEN 'a' || col ELSE row || col::VARCHAR END ELSE text END AS text FROM v_cells WHERE doc_id % 3 <> 1 OR col < 2""",
    "v_grid": "SELECT *, n_rows >= 2 AND n_cols >= 3 AND filled = cells AND short >= filled - 1 AND numeric >= 1 AND alpha >= 2 AS grid FROM v_stats",
    "v_kv": """SELECT g.*, g.n_cols = 2 AND g.n_rows >= 2 AND coalesce(k.n, 0) >= greatest(2, g.n_rows - 1) AND coalesce(k.a, 0) >= greatest(2, coalesce(k.n, 0) - 1) AND coalesce(k.b, 0) >= greatest(2, coalesce(k.n, 0) - 1) AS kv FROM v_grid g LEFT JOIN
      (SELECT l.doc_id, count(*) AS n, count(*) FILTER (WHERE length(trim(l.text)) <= 40) AS a, count(*) FILTER (WHERE length(trim(r.text)) <= 20) AS b FROM v_shaped l JOIN v_shaped r ON l.doc_id = r.doc_id AND l.row = r.row AND l.col = 0 AND r.col = 1 AND trim(l.text) <> '' AND trim(r.text) <> '' GROUP BY 1) k USING (doc_id)""",
    "v_structured": r"""SELECT *, n_rows > 1 AND n_cols > 1 AND filled >= 4 AND (grid OR kv OR filled / cells::DOUBLE >= 0.5 AND full_cols >= 2 AND long <= filled // 2 AND NOT (n_rows <= 3 AND NOT regexp_matches(text, '[=^√∫Σ/±]|->|→|⇌|<=>')
      AND length(text) - length(replace(text, ' ', '')) >= 2 AND length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) >= greatest(10, trunc(length(text) * 0.35::DOUBLE)))) AS structured FROM v_kv""",
    "v_reliable": """SELECT *, NOT (n_rows = 1 AND n_cols = 1) AND filled > 0 AND cells >= greatest(2, least(4, n_rows * n_cols)) AND filled / cells::DOUBLE >= 0.6 AND full_rows / n_rows::DOUBLE >= 0.75 AND (n_cols <= 1 OR full_cols / n_cols::DOUBLE >= 0.75) AS reliable FROM v_structured""",
}


def _shaped(spark, d):
    k, row, col = F.col("doc_id") % 3, F.col("row"), F.col("col")
    text = F.when(k == 0, F.when(row == 0, F.concat(F.lit("a"), col)).otherwise(F.concat(row, col))).otherwise(F.col("text"))
    return V.cells(spark, d).where((k != 1) | (col < 2)).withColumn("text", text).withColumn("n_cols", F.when(k == 1, 2).otherwise(F.col("n_cols")))


def _table_plan(key, column, test):
    @plan(key, f"SELECT doc_id, table_id, {column} AS accepted FROM v_reliable", TABLES)
    def query(spark, d):
        return X.table_stats(_shaped(spark, d)).select("doc_id", "table_id", test().alias("accepted"))

    return query


for _key, _column, _test in (("flt_lookup_grid", "grid", X.lookup_grid), ("flt_key_value_table", "kv", X.key_value), ("flt_structured_table", "structured", X.structured), ("flt_reliable_table", "reliable", X.reliable)):
    _table_plan(_key, _column, _test)


@plan("agg_table_fill", "SELECT doc_id, cells, filled, full_rows, full_cols, round(filled / cells::DOUBLE, 6) AS fill FROM v_stats", TABLES)
def agg_table_fill(spark, d):
    return X.table_stats(_shaped(spark, d)).select("doc_id", "cells", "filled", "full_rows", "full_cols", F.round(F.col("filled") / F.col("cells"), 6).alias("fill"))


_BEST = {
    "v_tb": "SELECT doc_id, page_no, text AS table_id, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0, x0, text) AS o, x0, y0, x1 + 100 AS x1, y1 + 60 AS y1 FROM v_anchor",
    "v_bb": "SELECT doc_id, page_no, text AS name, x0 + 30 AS x0, y0 + 10 AS y0, x0 + 130 AS x1, y0 + 70 AS y1 FROM v_anchor WHERE doc_id % 2 = 0",
    "v_scored": "SELECT b.doc_id, b.page_no, b.name, t.table_id, t.o, abs((t.x1 - t.x0) * (t.y1 - t.y0) - 6000) AS delta, greatest(0, least(t.x1, b.x1) - greatest(t.x0, b.x0)) * greatest(0, least(t.y1, b.y1) - greatest(t.y0, b.y0)) / 6000.0::DOUBLE AS score FROM v_bb b JOIN v_tb t USING (doc_id, page_no)",
    "v_best": "SELECT doc_id, page_no, name, arg_max(table_id, (score, -delta, -o)) AS table_id, max(score) AS score FROM (SELECT DISTINCT * FROM v_scored) GROUP BY 1, 2, 3 HAVING max(score) >= 0.45",
}


def _best_tables(spark, d):
    rows, b = V.anchor_candidates(spark, d), F.col("bbox")
    order = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("bbox.y0", "bbox.x0", "text"))
    tables = rows.select("doc_id", "page_no", F.col("text").alias("table_id"), order.alias("ord"), G.box(b["x0"], b["y0"], b["x1"] + 100, b["y1"] + 60).alias("bbox"))
    boxes = rows.where("doc_id % 2 = 0").select("doc_id", "page_no", F.col("text").alias("name"), G.box(b["x0"] + 30, b["y0"] + 10, b["x0"] + 130, b["y0"] + 70).alias("bbox"))
    return X.best_table(boxes, tables, ["doc_id", "page_no", "name"])


@plan("join_best_table", "SELECT doc_id, page_no, name, table_id, round(score, 6) AS score FROM v_best", _BEST)
def join_best_table(spark, d):
    return _best_tables(spark, d).select("doc_id", "page_no", "name", "table_id", F.round("score", 6).alias("score"))


@plan("exe_table", "SELECT b.doc_id, b.page_no, b.name, coalesce(r.reliable, false) AS built FROM v_best b LEFT JOIN v_reliable r USING (doc_id)", TABLES | _BEST)
def exe_table(spark, d):
    good = X.table_stats(_shaped(spark, d)).select("doc_id", X.reliable().alias("reliable"))
    return _best_tables(spark, d).join(good, "doc_id", "left").select("doc_id", "page_no", "name", F.coalesce("reliable", F.lit(False)).alias("built"))


@plan("gen_simple_table", "SELECT p_partkey AS doc_id, 2 AS n_rows, 3 AS n_cols, unnest([0, 0, 1, 1, 1]) AS row, unnest([0, 1, 0, 1, 2]) AS col, unnest([p_brand, p_type, p_name, p_size::VARCHAR, 'x']) AS text FROM part")
def gen_simple_table(spark, d):
    rows = F.array(F.array("p_brand", "p_type"), F.array(F.col("p_name"), F.col("p_size").cast("string"), F.lit("x")))
    return X.simple_table(V.table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), rows.alias("rows"))).select("doc_id", "n_rows", "n_cols", "row", "col", "text")


# --- validation ------------------------------------------------------------------------------------

_Q = "'question_' || lpad(question_no::VARCHAR, 3, '0')"
_FIND = "doc_id, question_no, category, severity, message, asset"
FINDINGS = TABLES | {
    "v_schema_f": f"SELECT doc_id, question_no::BIGINT AS question_no, 'schema' AS category, 'high' AS severity, 'unsupported_item_type:' || type AS message, {_Q} || '_item_' || ord AS asset FROM v_items WHERE type NOT IN ('text', 'table', 'equation', 'chem_equation', 'image')",
    "v_qs": "SELECT doc_id, question_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, y0, x0, text) AS ord, CASE WHEN y0 % 400 = 0 THEN 0 ELSE 1 END AS n_items FROM (SELECT *, regexp_extract(text, '^([0-9]+)', 1)::BIGINT AS question_no FROM v_anchor)",
    "v_number_f": f"""SELECT doc_id, question_no, 'numbering' AS category, 'high' AS severity, 'duplicate_question_number' AS message, {_Q} AS asset FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, question_no ORDER BY ord) AS k FROM v_qs) WHERE k > 1
      UNION ALL SELECT doc_id, question_no, 'numbering', 'medium', 'missing_question_number', {_Q} FROM (SELECT doc_id, unnest(range(min(question_no), max(question_no) + 1)) AS question_no FROM v_qs GROUP BY 1) g ANTI JOIN v_qs USING (doc_id, question_no)""",
    "v_formula_f": f"""SELECT doc_id, question_no::BIGINT AS question_no, 'formula' AS category, CASE WHEN m = 'empty_formula_target' THEN 'high' ELSE 'medium' END AS severity, m AS message, {_Q} || '_item_' || ord AS asset FROM (SELECT *, CASE WHEN trim(target) = '' THEN 'empty_formula_target'
      WHEN type = 'chem_equation' AND NOT regexp_matches(target, '->|rightarrow|⇌|<=>') THEN 'chem_equation_missing_arrow' WHEN type = 'equation' AND NOT regexp_matches(target, '[=^√/+-]') THEN 'equation_missing_operator' END AS m FROM v_items WHERE type IN ('equation', 'chem_equation')) WHERE m IS NOT NULL""",
    "v_table_in": "SELECT i.doc_id, i.question_no, i.ord, CASE WHEN i.doc_id % 5 <> 0 THEN s.cells END AS cells, CASE WHEN i.doc_id % 7 = 0 THEN 0 ELSE s.n_rows END AS n_rows, s.n_cols, s.filled, s.full_cols, b.r, b.c FROM v_items i JOIN v_stats s USING (doc_id) JOIN (SELECT doc_id, max(row) AS r, max(col) AS c FROM v_shaped GROUP BY 1) b USING (doc_id) WHERE i.type = 'table'",
    "v_table_f": f"""SELECT doc_id, question_no::BIGINT AS question_no, 'table' AS category, severity, message, {_Q} || '_item_' || ord AS asset FROM (SELECT *, 'high' AS severity, 'missing_table_object' AS message FROM v_table_in WHERE cells IS NULL
      UNION ALL SELECT *, 'high', 'invalid_table_dimensions' FROM v_table_in WHERE cells IS NOT NULL AND (n_rows <= 0 OR n_cols <= 0) UNION ALL SELECT *, 'medium', 'table_cell_out_of_bounds' FROM v_table_in WHERE cells IS NOT NULL AND (r >= n_rows OR c >= n_cols)
      UNION ALL SELECT *, 'medium', 'sparse_table_structure' FROM v_table_in WHERE filled / cells::DOUBLE < 0.6 UNION ALL SELECT *, 'medium', 'table_missing_content_columns' FROM v_table_in WHERE filled / cells::DOUBLE >= 0.6 AND n_cols > 1 AND full_cols / n_cols::DOUBLE < 0.75)""",
    "v_consistency_f": f"""SELECT doc_id, NULL::BIGINT AS question_no, 'final_consistency' AS category, 'high' AS severity, 'duplicate_question_numbers' AS message, 'document' AS asset FROM v_qs GROUP BY doc_id HAVING count(*) <> count(DISTINCT question_no)
      UNION ALL SELECT doc_id, question_no, 'final_consistency', 'high', 'empty_question_items:' || question_no, {_Q} FROM v_qs WHERE n_items = 0""",
}


def _questions(spark, d):
    rows = V.anchor_candidates(spark, d)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "bbox.y0", "bbox.x0", "text"))
    return rows.select("doc_id", F.regexp_extract("text", r"^(\d+)", 1).cast("long").alias("question_no"), order.alias("ord"), F.when(F.col("bbox.y0") % 400 == 0, 0).otherwise(1).alias("n_items"))


def _table_stats(spark, d):
    stats = X.table_stats(_shaped(spark, d)).withColumn("n_rows", F.when(F.col("doc_id") % 7 == 0, 0).otherwise(F.col("n_rows"))).withColumn("cells", F.when(F.col("doc_id") % 5 != 0, F.col("cells")))
    return V.question_items(spark, d).where("type = 'table'").select("doc_id", "question_no", "ord").join(stats, "doc_id")


@plan("val_schema", "SELECT * FROM v_schema_f", FINDINGS)
def val_schema(spark, d):
    return C.schema_findings(V.question_items(spark, d))


@plan("val_numbering", "SELECT * FROM v_number_f", FINDINGS)
def val_numbering(spark, d):
    return C.numbering_findings(_questions(spark, d))


@plan("val_formula", "SELECT * FROM v_formula_f", FINDINGS)
def val_formula(spark, d):
    return C.formula_findings(V.question_items(spark, d))


@plan("val_table", "SELECT * FROM v_table_f", FINDINGS)
def val_table(spark, d):
    return C.table_findings(_table_stats(spark, d))


@plan("val_consistency", "SELECT * FROM v_consistency_f", FINDINGS)
def val_consistency(spark, d):
    return C.consistency_findings(_questions(spark, d))


@plan("set_union_findings", " UNION ALL ".join(f"SELECT {_FIND} FROM {v}" for v in ("v_schema_f", "v_number_f", "v_formula_f", "v_table_f", "v_consistency_f")), FINDINGS)
def set_union_findings(spark, d):
    out = val_schema(spark, d)
    for more in (val_numbering, val_formula, val_table, val_consistency):
        out = out.unionByName(more(spark, d))
    return out


_ARCHIVE = "SELECT p_partkey AS doc_id, array_to_string(CASE WHEN p_partkey % 2 = 0 THEN ['mimetype'] ELSE [] END, ',') AS missing, p_partkey % 2 <> 0 AS valid FROM part"


def _archives(spark, d):
    every = F.array(*[F.lit(p) for p in C.REQUIRED_PARTS])
    names = F.when(F.col("p_partkey") % 2 == 0, F.filter(every, lambda p: p != "mimetype")).otherwise(F.concat(every, F.array(F.lit("BinData/image1.png"))))
    return C.missing_parts(V.table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), names.alias("names")))


@plan("val_hwpx", _ARCHIVE)
def val_hwpx(spark, d):
    return _archives(spark, d).select("doc_id", F.array_join("missing", ",").alias("missing"), "valid")


@plan("join_required_parts", "SELECT p_partkey AS doc_id, 'mimetype' AS part FROM part WHERE p_partkey % 2 = 0")
def join_required_parts(spark, d):
    return _archives(spark, d).select("doc_id", F.explode("missing").alias("part"))


# --- triage and checklist --------------------------------------------------------------------------


@plan("dec_qa_triage", "SELECT doc_id, ord, question_no, severity, severity IN ('high', 'medium') AS insert_marker FROM v_issues")
def dec_qa_triage(spark, d):
    return D.triage(V.issues(spark, d)).select("doc_id", "ord", "question_no", "severity", "insert_marker")


_MARKED = """SELECT i.doc_id, i.question_no, i.ord, CASE WHEN h.doc_id IS NOT NULL AND type = 'text' AND k = 1 THEN '[불확실] ' || content ELSE content END AS content FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, question_no, type ORDER BY ord) AS k FROM v_items) i
  LEFT JOIN (SELECT DISTINCT doc_id, question_no FROM v_issues WHERE severity IN ('high', 'medium') AND question_no IS NOT NULL) h ON h.doc_id = i.doc_id AND h.question_no = i.question_no"""


@plan("exe_triage_marker", _MARKED)
def exe_triage_marker(spark, d):
    return R.mark_triaged(V.question_items(spark, d), V.issues(spark, d)).select("doc_id", "question_no", "ord", "content")


@plan("join_triage_questions", "SELECT DISTINCT i.doc_id, i.question_no::BIGINT AS question_no FROM v_items i SEMI JOIN (SELECT * FROM v_issues WHERE question_no IS NOT NULL) s ON s.doc_id = i.doc_id AND s.question_no = i.question_no")
def join_triage_questions(spark, d):
    hit = V.issues(spark, d).where("question_no is not null").select("doc_id", "question_no")
    return V.question_items(spark, d).select("doc_id", F.col("question_no").cast("long").alias("question_no")).distinct().join(hit, ["doc_id", "question_no"], "left_semi")


@plan("exe_checklist_rows", "SELECT doc_id, ord, 'out.hwpx' AS file_name, question_no, question_no AS page, category, severity, message, asset FROM v_issues WHERE question_no IS NOT NULL")
def exe_checklist_rows(spark, d):
    return R.checklist_rows(V.issues(spark, d), "out.hwpx")


@plan("sink_checklist", """SELECT doc_id, '파일명: out.hwpx' || chr(10) || chr(10) || string_agg('[Q' || question_no || '][' || category || '][' || severity || ']' || chr(10) || message || chr(10) || 'page: ' || question_no || chr(10) || 'asset: ' || asset, chr(10) || chr(10) ORDER BY ord) || chr(10) AS checklist FROM v_issues WHERE question_no IS NOT NULL GROUP BY 1""")
def sink_checklist(spark, d):
    return R.checklist_text(R.checklist_rows(V.issues(spark, d), "out.hwpx"))


@plan("exe_anchor_issues", "SELECT doc_id, unnest(missing) AS question_no, 'high' AS severity, 'missing_question_anchor' AS message FROM v_missing UNION ALL SELECT doc_id, unnest(uncertain), 'medium', 'uncertain_question_anchor' FROM v_missing", S.ANCHORS | S._SUMMARY)
def exe_anchor_issues(spark, d):
    from ..operators.windows import anchor_summary

    s = anchor_summary(S.deduped(spark, d))
    part = lambda c, severity: s.select("doc_id", F.explode(c).alias("question_no"), F.lit(severity).alias("severity"), F.lit(f"{c}_question_anchor").alias("message"))
    return part("missing", "high").unionByName(part("uncertain", "medium"))


@plan("agg_uncertainties", "SELECT doc_id, question_no, array_to_string(list_sort(list(DISTINCT severity)), ',') AS tags FROM v_issues WHERE question_no IS NOT NULL GROUP BY 1, 2")
def agg_uncertainties(spark, d):
    tags = F.array_join(F.sort_array(F.collect_set("severity")), ",")
    return V.issues(spark, d).where("question_no is not null").groupBy("doc_id", "question_no").agg(tags.alias("tags"))


@plan("agg_doc_status", "SELECT o_orderkey AS doc_id, count(q.doc_id) AS questions, CASE WHEN count(q.doc_id) > 0 THEN 'best_effort_ready' ELSE 'failed' END AS document_status FROM orders LEFT JOIN (SELECT DISTINCT doc_id, question_no FROM v_items) q ON q.doc_id = o_orderkey GROUP BY 1")
def agg_doc_status(spark, d):
    questions = V.question_items(spark, d).select("doc_id", "question_no").distinct()
    docs = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return D.document_status(docs.join(questions, "doc_id", "left").groupBy("doc_id").agg(F.count("question_no").alias("questions")))


@plan("agg_run_result", "SELECT q.doc_id, q.questions, coalesce(n.answers, 0) > 0 AS has_answer_section, coalesce(i.issues, 0) AS issues FROM (SELECT doc_id, count(DISTINCT question_no) AS questions FROM v_items GROUP BY 1) q LEFT JOIN (SELECT doc_id, count(*) AS answers FROM v_answers GROUP BY 1) n USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS issues FROM v_issues GROUP BY 1) i USING (doc_id)")
def agg_run_result(spark, d):
    count = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    questions = V.question_items(spark, d).groupBy("doc_id").agg(F.count_distinct("question_no").alias("questions"))
    out = questions.join(count(V.answer_blocks(spark, d), "answers"), "doc_id", "left").join(count(V.issues(spark, d), "issues"), "doc_id", "left")
    return out.select("doc_id", "questions", (F.coalesce("answers", F.lit(0)) > 0).alias("has_answer_section"), F.coalesce("issues", F.lit(0)).alias("issues"))


# --- render ----------------------------------------------------------------------------------------

_RENDER = "SELECT doc_id, question_no, ord, 'q' || question_no || '_i' || ord AS item_id, CASE WHEN type = 'table' THEN 'image' WHEN type = 'drawing' THEN 'text' ELSE type END AS type, CASE WHEN trim(content) = '' THEN '[불확실]' ELSE content END AS content, CASE WHEN type IN ('equation', 'chem_equation') THEN target ELSE content END AS target FROM v_items"


def _render_items(spark, d):
    kind = F.when(F.col("type") == "table", "image").when(F.col("type") == "drawing", "text").otherwise(F.col("type"))
    target = F.when(F.col("type").isin("equation", "chem_equation"), F.col("target")).otherwise(F.col("content"))
    text = F.when(F.trim("content") == "", R.UNCERTAIN).otherwise(F.col("content"))
    return V.question_items(spark, d).select("doc_id", "question_no", "ord", F.concat(F.lit("q"), "question_no", F.lit("_i"), "ord").alias("item_id"), kind.alias("type"), text.alias("content"), target.alias("target"))


@plan("exe_render_items", _RENDER)
def exe_render_items(spark, d):
    return _render_items(spark, d)


_TO_Q = "SELECT q.doc_id, q.question_no, q.items, coalesce(n.exists, false) AS has_note, CASE WHEN n.exists THEN q.question_no END AS note_ref_no FROM (SELECT doc_id, question_no::BIGINT AS question_no, count(*) AS items FROM v_items GROUP BY 1, 2) q LEFT JOIN v_notes n USING (doc_id, question_no)"


def _questions_with_notes(spark, d):
    items = V.question_items(spark, d).groupBy("doc_id", F.col("question_no").cast("long").alias("question_no")).agg(F.count(F.lit(1)).alias("items"))
    out = items.join(decide._notes(spark, d).select("doc_id", "question_no", "exists"), ["doc_id", "question_no"], "left")
    return out.select("doc_id", "question_no", "items", F.coalesce("exists", F.lit(False)).alias("has_note"), F.when(F.col("exists"), F.col("question_no")).alias("note_ref_no"))


@plan("exe_to_questions", _TO_Q, decide.NOTES)
def exe_to_questions(spark, d):
    return _questions_with_notes(spark, d)


@plan("join_questions_notes", _TO_Q, decide.NOTES)
def join_questions_notes(spark, d):
    return _questions_with_notes(spark, d)


# Pages of 80 x 300 grays drawn from part keys, and two boxes of each, one across strips and one over the page's edge.
_GRAYS = {
    "v_gray": "SELECT p_partkey AS doc_id, p_size, unnest([1, 2]) AS k FROM part",
    "v_box": "SELECT doc_id, k, CASE WHEN k = 1 THEN 5 + p_size ELSE 60 END AS x0, CASE WHEN k = 1 THEN 250 ELSE 10 + p_size END AS y0, CASE WHEN k = 1 THEN 15 + p_size ELSE 80 END AS x1, CASE WHEN k = 1 THEN 262 ELSE 14 + p_size END AS y1 FROM v_gray",
    "v_cut": "SELECT *, md5(unhex(array_to_string(list_transform(range(0, (y1 - y0) * (x1 - x0)), lambda i: lpad(to_hex((doc_id + (y0 + i // (x1 - x0)) * 7 + x0 + i % (x1 - x0)) % 256), 2, '0')), ''))) AS pixels FROM v_box",
}


def _crops(spark, d):
    part = V.spread(V.table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page_no"), "p_size"))
    # A line of 80 grays is a piece of one slope that runs through all grays and on: 300 pieces a page, not 24,000 pixels.
    slope = F.lit(bytes(i % 256 for i in range(256 + 80)))
    line = lambda y: F.substring(slope, ((F.col("doc_id") + y * 7) % 256 + 1).cast("int"), F.lit(80))
    drawn = crops.joined(F.transform(F.sequence(F.lit(0), F.lit(299)), line))
    pages = part.select("doc_id", "page_no", F.lit(80).alias("width"), F.lit(300).alias("height"), drawn.alias("pixels"))
    size = F.col("p_size")
    two = F.array(F.struct(F.lit(1).alias("k"), G.box(5 + size, 250, 15 + size, 262).alias("bbox")), F.struct(F.lit(2).alias("k"), G.box(F.lit(60), 10 + size, F.lit(95), 14 + size).alias("bbox")))
    return crops.crop(pages, part.select("doc_id", "page_no", F.explode(two).alias("b")).select("doc_id", "page_no", "b.k", "b.bbox"))


@plan("exe_image_refine", "SELECT doc_id, k, pixels, array_to_string([x0, y0, x1, y1], ',') AS crop_bbox, 'nanobanana_passthrough' AS refinement_mode, false AS uncertain FROM v_cut WHERE k = 1 UNION ALL SELECT doc_id, k, pixels, array_to_string([x0, y0, x1, y1], ','), 'nanobanana_pending', true FROM v_cut WHERE k = 2", _GRAYS)
def exe_image_refine(spark, d):
    """Crops as pictures: the first of each page with the service off, the second with it on."""
    both = crops.refined(_crops(spark, d), F.col("k") == 2)
    return both.select("doc_id", "k", F.md5("pixels").alias("pixels"), F.array_join(F.transform("crop_bbox", lambda x: x.cast("string")), ",").alias("crop_bbox"), "refinement_mode", "uncertain")


_MEDIA = {"v_media": "SELECT doc_id, question_no, ord, 'image' || n AS media_id, 'BinData/image' || n || '.png' AS href, 'image/png' AS media_type FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY question_no, ord) AS n FROM v_items WHERE type = 'image')"}


@plan("hwpx_media", "SELECT * FROM v_media", _MEDIA)
def hwpx_media(spark, d):
    return R.media_entries(V.question_items(spark, d))


@plan("join_media_entries", "SELECT i.doc_id, i.question_no, i.ord, i.type, m.href FROM v_items i LEFT JOIN v_media m USING (doc_id, question_no, ord)", _MEDIA)
def join_media_entries(spark, d):
    items = V.question_items(spark, d)
    return items.join(R.media_entries(items), ["doc_id", "question_no", "ord"], "left").select("doc_id", "question_no", "ord", "type", "href")


_SECTION = {
    "v_section": """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, question_no, ord) AS para_seq, kind, question_no, text, column_break, part = 1 AND row_number() OVER (PARTITION BY doc_id, part ORDER BY question_no, ord) = 1 AS page_break FROM (
      SELECT doc_id, 0 AS part, question_no, ord, type AS kind, coalesce(nullif(target, ''), content) AS text, row_number() OVER (PARTITION BY doc_id, question_no ORDER BY ord) = 1 AND question_no > min(question_no) OVER (PARTITION BY doc_id) AS column_break FROM v_items
      UNION ALL SELECT doc_id, 1, question_no::INTEGER, 0, 'note', question_no || '. ' || raw_text, false FROM v_notes WHERE exists)""",
}


def _section(spark, d):
    return R.section_rows(V.question_items(spark, d, True), decide._notes(spark, d))


@plan("hwpx_section_rows", "SELECT * FROM v_section", decide.NOTES | _SECTION)
def hwpx_section_rows(spark, d):
    return _section(spark, d)


@plan("agg_preview_text", "SELECT doc_id, string_agg(text, chr(13) || chr(10) ORDER BY para_seq) AS preview FROM v_section GROUP BY 1", decide.NOTES | _SECTION)
def agg_preview_text(spark, d):
    return R.preview_text(_section(spark, d))


@plan("hwpx_text_segments", "SELECT block_id, least(9000, greatest(1000, 380 * length(text))) AS width FROM v_formulas")
def hwpx_text_segments(spark, d):
    return V.formulas(spark, d).select("block_id", R.text_width(F.col("text"), True).alias("width"))


@plan("hwpx_equation", "SELECT block_id, least(20500, greatest(1800, 420 * length(text))) AS width FROM v_formulas")
def hwpx_equation(spark, d):
    return V.formulas(spark, d).select("block_id", R.text_width(F.col("text"), False).alias("width"))


@plan("hwpx_table", "SELECT doc_id, table_id, (25230 // n_cols)::INTEGER AS column_width, greatest(282, n_rows * 800)::INTEGER AS height FROM v_stats", TABLES)
def hwpx_table(spark, d):
    return R.table_geometry(X.table_stats(_shaped(spark, d)))


@plan("hwpx_picture", "SELECT p_partkey, 24247 AS width, greatest(1000, trunc(24247 * (p_size * 3) / (p_size + 40)::DOUBLE))::INTEGER AS height, ((p_size + 40) * 75)::INTEGER AS original_width, (p_size * 3 * 75)::INTEGER AS original_height FROM part")
def hwpx_picture(spark, d):
    r = R.picture_geometry(F.col("p_size") + 40, F.col("p_size") * 3)
    return V.table(spark, d, "part").select("p_partkey", *[r[c].alias(c) for c in ("width", "height", "original_width", "original_height")])


@plan("hwpx_units", "SELECT p_partkey, round_even(p_size * 283.465::DOUBLE, 0)::INTEGER AS units FROM part")
def hwpx_units(spark, d):
    return V.table(spark, d, "part").select("p_partkey", F.bround(F.col("p_size") * 283.465).cast("int").alias("units"))


@plan("pdf_question_blocks", "SELECT doc_id, question_no, string_agg(CASE WHEN type = 'image' THEN 'image:' || content ELSE coalesce(nullif(target, ''), content) END, chr(10) ORDER BY ord) AS blocks FROM v_items GROUP BY 1, 2")
def pdf_question_blocks(spark, d):
    text = F.when(F.col("type") == "image", F.concat(F.lit("image:"), "content")).otherwise(F.coalesce(F.nullif("target", F.lit("")), "content"))
    rows = V.question_items(spark, d).groupBy("doc_id", "question_no").agg(F.array_sort(F.collect_list(F.struct("ord", text.alias("t")))).alias("i"))
    return rows.select("doc_id", "question_no", F.array_join(F.transform("i", lambda x: x["t"]), "\n").alias("blocks"))
