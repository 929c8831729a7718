"""Rule cores of the decisions, as columns and small plans; an override table may take precedence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .scan import scan_groups

#: Blocks of a document that are scanned as one band, as a power of two.
SCAN_BAND = 14
# Fixed values.
ANSWER_KEYWORDS = ("정답", "정답 및 풀이", "해설", "풀이", "- 끝 -")
CHEMISTRY_CONTEXT = ("반응식", "화학식", "화학 반응", "다음 식")
SCHOOLS = (("세종과고", "세종과학고등학교"), ("세종과학고", "세종과학고등학교"), ("세종과학고등학교", "세종과학고등학교"))
SUBJECTS = (("AP일반화학1", "AP 일반 화학Ⅰ"), ("AP일반화학Ⅰ", "AP 일반 화학Ⅰ"), ("AP 일반 화학1", "AP 일반 화학Ⅰ"), ("AP 일반 화학Ⅰ", "AP 일반 화학Ⅰ"))
META_FIELDS = ("year", "school", "grade", "semester", "exam_type", "subject")


def _typed(*pairs: tuple[str, float]) -> Column:
    return F.array(*[F.struct(F.lit(t).alias("type"), F.lit(float(s)).alias("score")) for t, s in pairs])


def classify_text(s: Column) -> Column:
    """array<struct<type,score>>, best first."""
    return T.let(T.strip(s), _classified)


def _classified(t: Column) -> Column:
    chem = T.any_in(t, T.REACTION) & T.has_upper(t)
    return (
        F.when(t == "", _typed(("unknown", 0.0)))
        .when(T.is_prose(t), _typed(("text", 0.94), ("equation", 0.06)))
        .when(chem, _typed(("chem_equation", 0.82), ("equation", 0.45), ("text", 0.18)))
        .when(T.is_equation(t) & (F.length(t) < 160), _typed(("equation", 0.74), ("text", 0.3)))
        .otherwise(_typed(("text", 0.9), ("equation", 0.1)))
    )


def best_candidate(candidates: Column) -> Column:
    """The candidate with the highest score, the first of equals; text at 0.5 for none."""
    ranked = F.transform(candidates, lambda c, i: F.struct(c["score"].alias("score"), (-i).alias("first"), c["type"].alias("type")))
    top = F.array_max(ranked)
    return F.struct(F.coalesce(top["type"], F.lit("text")).alias("type"), F.coalesce(top["score"], F.lit(0.5)).alias("score"))


def score_of(candidates: Column, kind: str) -> Column:
    """The last score given for a type, 0 for none."""
    return F.coalesce(F.try_element_at(F.filter(candidates, lambda c: c["type"] == kind), F.lit(-1))["score"], F.lit(0.0))


def block_type(s: Column, candidates: Column, around: Column, table_lines: Column | None = None, texture: Column | None = None) -> Column:
    """struct<type,confidence,needs_review>: the first rule that applies."""
    t = T.strip(s)
    table_lines, texture = (F.lit(False) if c is None else c for c in (table_lines, texture))
    chem, best = T.any_in(t, T.REACTION) & T.has_upper(t), best_candidate(candidates)

    def decided(kind, confidence, review) -> Column:
        wrap = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(wrap(kind).alias("type"), wrap(confidence).cast("double").alias("confidence"), wrap(review).alias("needs_review"))

    return (
        F.when(table_lines | (score_of(candidates, "table") >= 0.9), decided("table", 0.96, False))
        .when(score_of(candidates, "image") >= 0.9, decided("image", 0.92, False))
        .when(chem, decided("chem_equation", F.when(T.any_in(around, CHEMISTRY_CONTEXT), 0.9).otherwise(0.84), False))
        .when(T.is_prose(t), decided("text", 0.9, False))
        .when(T.is_equation(t) & (F.length(t) < 180), decided("equation", 0.82, False))
        .when(texture, decided("image", 0.75, True))
        .when(t == "", decided("unknown", 0.2, True))
        .otherwise(decided(best["type"], F.greatest(F.lit(0.55), best["score"]), best["score"] < 0.7))
    )


def formula_repair(kind: Column, s: Column) -> Column:
    """struct<kind,normalized,target,confidence,flags,needs_review>"""
    return T.let(F.struct(T.norm_chem_equation(s).alias("chem"), T.norm_formula(s).alias("math")), lambda n: _repaired(kind, n["chem"], n["math"]))


def _repaired(kind: Column, chem: Column, math: Column) -> Column:
    is_chem = kind == "chem_equation"
    target = F.replace(F.regexp_replace(chem["text"], rf"({T.ELEMENT})(\d+)", r"$1_{$2}"), F.lit("->"), F.lit(" rightarrow "))
    flags = F.when(is_chem & (target != chem["text"]), F.array(F.lit("subscript_inferred"))).otherwise(F.array().cast("array<string>"))
    pick = lambda a, b: F.when(is_chem, a).otherwise(b)
    return F.struct(
        pick(F.lit("chem_equation"), F.lit("equation")).alias("kind"), pick(chem["text"], math["text"]).alias("normalized"), pick(T.strip(target), math["text"]).alias("target"),
        pick(F.when(chem["valid"], 0.83).otherwise(0.4), F.when(math["valid"], 0.84).otherwise(0.42)).alias("confidence"), flags.alias("flags"), pick(~chem["valid"], ~math["valid"]).alias("needs_review"),
    )


def anchor_score(s: Column, confidence: Column) -> Column:
    base = F.when(T.strip(s).rlike(r"^\d+\."), 0.9).otherwise(0.4)
    return F.least(F.lit(0.99), F.greatest(F.lit(0.1), (base + confidence) / 2))


# --- pages and sections ----------------------------------------------------------------------------


def page_evidence(lines: DataFrame, keywords=ANSWER_KEYWORDS) -> DataFrame:
    """doc_id, page_no, top_lines (first five), keyword_hits (sorted), question_anchors, answer_anchors (counts), question_style, answer_style."""
    t = F.col("text")
    k = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("ord"))
    # Texts of the first five lines alone are gathered; of the others flags and counts.
    pages = lines.withColumn("_k", k).groupBy("doc_id", "page_no").agg(
        F.array_sort(F.collect_list(F.when(F.col("_k") <= 5, F.struct("ord", "text")))).alias("_top"),
        F.array(*[F.when(F.bool_or(F.contains(t, F.lit(w))), F.lit(w)) for w in keywords]).alias("_hits"),
        F.count_if(T.strip(t).rlike(r"^\d+\.")).alias("_numbered"), F.count_if(T.any_in(t, keywords)).alias("_answers"),
    )
    return pages.select(
        "doc_id", "page_no", F.transform("_top", lambda i: i["text"]).alias("top_lines"), F.sort_array(F.filter("_hits", lambda w: w.isNotNull())).alias("keyword_hits"),
        F.col("_numbered").cast("int").alias("question_anchors"), F.col("_answers").cast("int").alias("answer_anchors"),
        F.when(F.col("_numbered") > 0, 0.9).otherwise(0.1).alias("question_style"), F.when(F.col("_answers") > 0, 0.95).otherwise(0.05).alias("answer_style"),
    )


def section_split(pages: DataFrame) -> DataFrame:
    """doc_id, split_page, has_answer_section, question_pages, answer_pages, confidence.

    The first page after page 1 with an answer header on top, or in answer style with numbered top lines.
    """
    blob = F.array_join("top_lines", "\n")
    top = F.array_distinct(F.filter("keyword_hits", lambda k: F.contains(blob, k)))
    header = F.array_contains(top, "정답") | (F.size(top) >= 2)
    numbered = (F.col("answer_style") >= 0.9) & blob.rlike(r"(?m)^\s*\d+[.)]")
    marked = pages.withColumn("_split", F.when((F.col("page_no") > 1) & (header | numbered), F.col("page_no")))
    found = marked.groupBy("doc_id").agg(F.min("_split").alias("s"), F.sort_array(F.collect_list("page_no")).alias("pages"))
    before = F.filter("pages", lambda p: p < F.col("s"))
    usable = F.col("s").isNotNull() & (F.size(before) > 0)
    none = F.filter("pages", lambda _: F.lit(False))
    return found.select(
        "doc_id", F.when(usable, F.col("s")).alias("split_page"), usable.alias("has_answer_section"), F.when(usable, before).otherwise(F.col("pages")).alias("question_pages"),
        F.when(usable, F.filter("pages", lambda p: p >= F.col("s"))).otherwise(none).alias("answer_pages"), F.when(usable, 0.97).otherwise(0.62).alias("confidence"),
    )


# --- exam metadata ---------------------------------------------------------------------------------


def _first(values: Column) -> Column:
    return F.try_element_at(F.filter(values, lambda v: v.isNotNull() & (v != "")), F.lit(1))


def exam_meta(rows: DataFrame) -> DataFrame:
    """rows (doc_id, tokens, first_lines) -> the meta fields, where each was found, tagline, confidence, needs_review.

    File-name tokens come before the page; within a token the first entry of a dictionary wins.
    """
    page = F.array_join("first_lines", " ")
    places = F.concat(F.col("tokens"), F.array(page))

    def by_pattern(pattern: str) -> Column:
        return _first(F.transform(places, lambda p: F.regexp_extract(p, f"({pattern})", 1)))

    def by_table(table) -> Column:
        pick = lambda p: reduce(lambda w, kv: w.when(F.contains(p, F.lit(kv[0])), kv[1]), table[1:], F.when(F.contains(p, F.lit(table[0][0])), table[0][1]))
        return _first(F.transform(places, pick))

    found = rows.select(
        "doc_id", page.alias("_page"), by_pattern(r"20\d{2}").alias("year"), by_table(SCHOOLS).alias("school"), by_pattern("[123]학년").alias("grade"), by_pattern("[12]학기").alias("semester"),
        by_table((("기말", "기말"), ("중간", "중간"))).alias("exam_type"), by_table(SUBJECTS).alias("subject"),
    )
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in META_FIELDS[:5]])
    tagline = F.when(full, F.concat(F.lit("("), "year", F.lit("년 "), F.concat_ws(" ", "school", "grade", "semester", "exam_type"), F.lit(")")))
    source = lambda c: F.when(F.col(c).isNotNull(), F.when(F.contains(F.col("_page"), F.col(c)), "first_page").otherwise("filename"))
    out = found.withColumn("tagline", tagline).withColumns({f"{c}_source": source(c) for c in META_FIELDS})
    out = out.withColumn("confidence", meta_confidence())
    return out.withColumn("needs_review", F.col("confidence") < 0.7).drop("_page")


def meta_confidence() -> Column:
    filled = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in META_FIELDS])
    return F.bround(F.least(F.lit(0.98), filled / 6 + F.when(F.col("tagline").isNotNull(), 0.15).otherwise(0.0)), 2)


# --- triage and overrides --------------------------------------------------------------------------


def triage(issues: DataFrame) -> DataFrame:
    return issues.withColumn("insert_marker", F.col("severity").isin("high", "medium"))


def document_status(question_counts: DataFrame) -> DataFrame:
    return question_counts.withColumn("document_status", F.when(F.col("questions") > 0, "best_effort_ready").otherwise("failed"))


def apply_overrides(rules: DataFrame, overrides: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Field by field, an override where it is not null, else the rule's value."""
    given = overrides.select(*key, *[F.col(f).alias(f"_o_{f}") for f in fields])
    joined = rules.join(given, key, "left")
    return joined.select(*[c for c in rules.columns if c not in fields], *[F.coalesce(f"_o_{f}", f).alias(f) for f in fields])


def parse_spans(raw: DataFrame, column: str) -> DataFrame:
    """A JSON list of note spans, tolerant of a JSON string inside; incomplete spans are dropped."""
    schema = "array<struct<question_no:bigint,start_block_id:string,end_block_id:string>>"
    inner = F.coalesce(F.from_json(column, schema), F.from_json(F.get_json_object(column, "$"), schema))
    spans = raw.withColumn("_s", F.explode(inner)).select(*[c for c in raw.columns if c != column], F.col("_s.*"))
    return spans.where("question_no is not null and start_block_id is not null and end_block_id is not null")


def nonempty_or(overridden: Column, rule: Column) -> Column:
    """An override list only if it has entries."""
    return F.when(F.size(overridden) > 0, overridden).otherwise(rule)


def last_question_lines(blocks: DataFrame) -> DataFrame:
    """blocks with current_no: the number of the last note header at or before each block of its document."""
    number = F.expr(r"try_cast(nullif(regexp_extract(text, '^\\s*([0-9]+)[.)]', 1), '') as bigint)")
    return scan_groups(blocks.withColumn("own_no", number), ["doc_id"], F.shiftright(F.col("ord").cast("long"), SCAN_BAND), [(["ord"], {"current_no": ("last", F.col("own_no"))}, {}, {}, {})])
