"""From pages to packages: the stages of a document's analysis, each one plan over all documents at once.

A stage takes DataFrames keyed by doc_id and returns DataFrames; nothing is worked out until an output
is read. analyse() wires them in order; write() stores what they give.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions.geometry import pdf_to_pixels, union_box
from .operators import blocks as B
from .operators import decisions as D
from .operators import noise as N
from .operators import notes as A
from .operators import preview, sinks
from .operators import render as R
from .operators import tables as TB
from .operators import validate as VA
from .operators import windows as W
from .sources import config as C
from .sources import layout, ocr, template
from .staging import staged, work_dir

PAGE = ["doc_id", "page_no"]
FOLDERS = ("pages", "thumbs", "ocr", "evidence", "decisions", "questions", "crops", "layout")
#: Regions narrower than this share of a page give their text by words (fixed value).
WORD_SHARE = 0.85


# --- settings --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """What a configuration says, with defaults."""

    keywords: tuple[str, ...] = D.ANSWER_KEYWORDS
    refine_below: float = 0.9
    first_page: int = 1
    use_layout: bool = False
    use_ocr: bool = False
    use_template: bool = False
    template_keywords: tuple[str, ...] = ()
    agents: dict = field(default_factory=dict)


def wire(config: dict) -> Settings:
    """Settings of a nested configuration; the template's keys stand over those of its service."""
    # Names of the configuration's keys, and defaults (fixed values).
    analysis, service, agents = config.get("analysis", {}), config.get("ocr", {}).get("clova", {}), config.get("agents", {})
    form = {k: v for k, v in service.items() if k != "template"} | service.get("template", {})
    return Settings(
        tuple(analysis.get("answer_section_keywords") or D.ANSWER_KEYWORDS), float(config.get("ocr", {}).get("precise_block_confidence_threshold", 0.9)), int(config.get("layout", {}).get("first_page_no", 1)),
        bool(analysis.get("opendataloader", {}).get("enabled", False)), C.ocr_enabled(service), bool(form.get("enabled", False)) and C.ocr_enabled(form), tuple(form.get("match_keywords", ())), agents,
    )


def overrides_of(settings: Settings, agent: str, overrides: dict[str, DataFrame]) -> DataFrame | None:
    """The overrides of an agent, none if it is switched off."""
    given = settings.agents.get(agent, {})
    return overrides.get(agent) if not isinstance(given, dict) or given.get("enabled", True) else None


# --- inputs ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Inputs:
    files: DataFrame  # doc_id, stem
    pages: DataFrame  # doc_id, page_no, width, height; for layout also pdf_width, pdf_height
    lines: DataFrame  # doc_id, page_no, ord, text, bbox, confidence
    words: DataFrame  # doc_id, page_no, line_no, word_no, text, bbox, confidence
    tables: DataFrame | None = None  # doc_id, page_no, ord, table_id, bbox
    cells: DataFrame | None = None  # doc_id, table_id, n_rows, n_cols, row, col, text
    elements: DataFrame | None = None  # doc_id, page_no, order_index, content, bbox
    images: DataFrame | None = None  # doc_id, question_no, page_no, bbox
    fields: DataFrame | None = None  # doc_id, template (map)
    second: DataFrame | None = None  # doc_id, block_id, text, confidence
    overrides: dict[str, DataFrame] = field(default_factory=dict)


def intake(files: DataFrame, started: datetime, work_dir: str, output_dir: str) -> DataFrame:
    """files with run_id (stem and time) and a path for each folder of the run."""
    rows = files.withColumn("run_id", F.concat("stem", F.lit(started.strftime("_%Y%m%d_%H%M%S"))))
    run_dir = F.concat(F.lit(work_dir.rstrip("/") + "/"), "run_id")
    return rows.withColumns({"run_dir": run_dir, **{f"{f}_dir": F.concat(run_dir, F.lit(f"/{f}")) for f in FOLDERS}, "output_dir": F.lit(output_dir.rstrip("/"))})


def layout_elements(nodes: DataFrame | None, pages: DataFrame, enabled: bool) -> DataFrame | None:
    """A layout parser's nodes as elements in pixels and reading order; None while it is off."""
    if nodes is None or not enabled:
        return None
    walked = layout.walk_tree(nodes).join(pages, PAGE)
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("path", "node_id"))
    return walked.select(*PAGE, order.alias("order_index"), "content", pdf_to_pixels(F.col("bbox_pdf"), F.col("width"), F.col("height"), F.col("pdf_width"), F.col("pdf_height")).alias("bbox"))


def page_lines(service: DataFrame | None, from_pdf: DataFrame, enabled: bool) -> DataFrame:
    """Lines of all pages: the service's where it is on, else the PDF's own."""
    return ocr.ocr_pages(service if enabled else None, from_pdf)


def template_use(files: DataFrame, pages: DataFrame, settings: Settings, fields: DataFrame | None = None) -> DataFrame:
    """doc_id, should_apply, page_no (the lowest, that fields are read from), template (map, null where it does not apply)."""
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.min("page_no").alias("page_no"))
    rows = files.join(counts, "doc_id", "left").withColumn("should_apply", template.should_apply(settings.use_template, list(settings.template_keywords), F.col("stem"), F.coalesce("_n", F.lit(0))))
    rows = rows.join(fields, "doc_id", "left") if fields is not None else rows.withColumn("template", F.lit(None).cast("map<string,string>"))
    return rows.select("doc_id", "should_apply", F.when(F.col("should_apply"), F.col("page_no")).alias("page_no"), F.when(F.col("should_apply"), F.col("template")).alias("template"))


# --- decisions about documents ---------------------------------------------------------------------


def noise(lines: DataFrame, pages: DataFrame) -> DataFrame:
    return N.noise_profile(N.noise_patterns(N.noise_buckets(with_height(lines, pages))))


def with_height(rows: DataFrame, pages: DataFrame) -> DataFrame:
    return rows.drop("height").join(pages.select(*PAGE, "height"), PAGE)


def exam_meta(files: DataFrame, lines: DataFrame, use: DataFrame) -> DataFrame:
    """Metadata from file names and the first eight lines of the lowest page, what is empty filled from a template."""
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "ord"))
    first = lines.withColumn("_p", F.min("page_no").over(Window.partitionBy("doc_id"))).where("page_no = _p").withColumn("_k", k).where("_k <= 8")
    tops = first.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("_k", "text"))).alias("_i"))
    rows = files.join(tops, "doc_id", "left").select("doc_id", T.filename_tokens(F.col("stem")).alias("tokens"), F.coalesce(F.transform("_i", lambda i: i["text"]), F.array().cast("array<string>")).alias("first_lines"))
    found = D.exam_meta(rows)
    merged = template.merge_meta(found, use.select("doc_id", "template"))
    names = [c for c in merged.columns if c != "doc_id"]
    return found.drop(*names).join(merged, "doc_id").select(*found.columns)


def sections(lines: DataFrame, keywords: tuple[str, ...] = D.ANSWER_KEYWORDS) -> DataFrame:
    return D.section_split(D.page_evidence(lines, keywords))


def anchor_candidates(words: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, page_no, text, bbox, score: words that begin a number with what follows, on pages without any the lines that do."""
    by_word = W.anchor_snippets(words).select(*PAGE, "text", "bbox", "confidence")
    by_line = lines.where(T.strip(F.col("text")).rlike(r"^\d+\.")).select(*PAGE, "text", "bbox", "confidence").join(by_word.select(*PAGE).distinct(), PAGE, "left_anti")
    return by_word.unionByName(by_line).withColumn("score", D.anchor_score(F.col("text"), F.col("confidence"))).drop("confidence")


def layout_candidates(elements: DataFrame) -> DataFrame:
    rows = elements.where(T.strip(F.col("content")).rlike(r"^(\d+)\.\s+\S"))
    return rows.select(*PAGE, T.strip(F.col("content")).alias("text"), "bbox", F.lit(0.92).alias("score"))


def anchors(candidates: DataFrame, split: DataFrame) -> DataFrame:
    """Numbered candidates on question pages, each number's first in reading order with occurrence 1."""
    pages = split.select("doc_id", F.explode("question_pages").alias("page_no"))
    return W.dedup_anchors(W.numbered(candidates.join(pages, PAGE, "left_semi")))


def _issue(rows: DataFrame, severity: str, category: str, message, asset) -> DataFrame:
    wrap = lambda v: v if not isinstance(v, str) else F.lit(v)
    number = F.col("question_no").cast("long") if "question_no" in rows.columns else F.lit(None).cast("long")
    return rows.select("doc_id", number.alias("question_no"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), wrap(message).alias("message"), wrap(asset).alias("asset"))


def anchor_issues(files: DataFrame, summary: DataFrame) -> DataFrame:
    """Documents without anchors, with missing and with uncertain numbers (messages are fixed values)."""
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]"))
    none = files.join(summary.where(F.size("numbers") > 0), "doc_id", "left_anti")
    rows = summary.where(F.size("numbers") > 0)
    where = "question_anchors.json"
    parts = [
        _issue(none.select("doc_id"), "high", "question_anchors", "문항 anchor를 확정하지 못했습니다.", where),
        _issue(rows.where(F.size("missing") > 0), "high", "question_anchors", F.concat(F.lit("문항 번호가 누락되었습니다: "), listed("missing")), where),
        _issue(rows.where(F.size("uncertain") > 0), "medium", "question_anchors", F.concat(F.lit("문항 anchor가 불확실합니다: "), listed("uncertain")), where),
    ]
    return reduce(DataFrame.unionByName, parts)


# --- questions -------------------------------------------------------------------------------------


def packages(found: DataFrame, pages: DataFrame, profile: DataFrame, split: DataFrame) -> DataFrame:
    """doc_id, question_no, page_no, range (the question's region), place (its order)."""
    kept = found.where("occurrence = 1").join(pages.select(*PAGE, "width", "height"), PAGE)
    ranged = W.page_ranges(W.next_in_column(W.column_bounds(kept, F.col("width"))), F.col("height"), profile)
    rows = ranged.select("doc_id", "question_no", "page_no", "width", "height", "range").join(split.select("doc_id", "question_pages"), "doc_id")
    return B.sort_packages(rows).drop("question_pages")


def _by_question(rows: DataFrame) -> DataFrame:
    """Rows of one question under a document key of its own, so that operators on documents work on questions."""
    return rows.withColumn("doc_id", F.struct("doc_id", "question_no")).drop("question_no")


def _back(rows: DataFrame) -> DataFrame:
    return rows.withColumn("question_no", F.col("doc_id.question_no")).withColumn("doc_id", F.col("doc_id.doc_id"))


def question_lines(ranges: DataFrame, words: DataFrame, lines: DataFrame, pages: DataFrame, profile: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """doc_id, question_no, page_no, text, bbox, confidence: rows of words inside each region, of lines where it has no words.

    `taken` are boxes (tables, images) whose text is left out; headers and footers are as well.
    """
    free_words, free_lines = (words, lines) if taken is None else (B.outside_boxes(words, taken), B.outside_boxes(lines, taken))
    inside = _by_question(with_height(B.in_ranges(free_words, ranges, B.WORD_MARGIN).drop("range"), pages))
    by_word = _back(W.synthetic_lines(W.split_segments(W.cluster_rows(inside)))).select("doc_id", "question_no", "page_no", "text", "bbox", "confidence", "height")
    by_line = with_height(B.lines_without_words(free_lines, free_words, ranges).drop("range"), pages).select("doc_id", "question_no", "page_no", "text", "bbox", "confidence", "height")
    return N.flag_noise(by_word.unionByName(by_line), profile).where("not noise").drop("noise", "height")


def rough_texts(ranges: DataFrame, words: DataFrame, lines: DataFrame, pages: DataFrame, profile: DataFrame, elements: DataFrame | None = None) -> DataFrame:
    """doc_id, question_no, rough_text: of layout elements where there are any, in columns of word rows, else of lines."""
    narrow = ranges.where(F.col("range.x1") - F.col("range.x0") < F.greatest(F.lit(1), (F.col("width") * WORD_SHARE).cast("int")))
    wide = ranges.join(narrow.select("doc_id", "question_no"), ["doc_id", "question_no"], "left_anti")
    rows = _by_question(with_height(B.in_ranges(words, narrow, B.WORD_MARGIN).drop("range"), pages))
    item = F.struct(F.col("bbox.x0").alias("x"), F.col("bbox.y0").alias("y"), "line_no", "word_no", F.trim("text").alias("t"))
    joined = W.cluster_rows(rows).groupBy(*PAGE, "row_no").agg(F.array_sort(F.collect_list(item)).alias("_i"), union_box("bbox").alias("bbox"), F.max("height").alias("height"))
    text = F.array_join(F.filter(F.transform("_i", lambda i: i["t"]), lambda t: t != ""), " ")
    by_word = _back(joined.withColumn("text", text).where("text <> ''")).select("doc_id", "question_no", "page_no", F.col("row_no").cast("long").alias("ord"), "text", "bbox", "height")
    by_line = with_height(B.in_ranges(lines, wide, B.WORD_MARGIN), pages).select("doc_id", "question_no", "page_no", F.col("ord").cast("long").alias("ord"), "text", "bbox", "height")
    clean = N.flag_noise(by_word.unionByName(by_line), profile).where("not noise")
    texts = clean.groupBy("doc_id", "question_no").agg(F.array_sort(F.collect_list(F.struct("page_no", "ord", "text"))).alias("_i"))
    texts = texts.select("doc_id", "question_no", F.array_join(F.transform("_i", lambda i: i["text"]), "\n").alias("rough_text"))
    out = ranges.select("doc_id", "question_no").join(texts, ["doc_id", "question_no"], "left")
    if elements is None:
        return out.withColumn("rough_text", F.coalesce("rough_text", F.lit("")))
    layouts = B.layout_text(elements, ranges).withColumn("_l", F.trim("text")).select("doc_id", "question_no", "_l")
    return out.join(layouts, ["doc_id", "question_no"], "left").select("doc_id", "question_no", F.coalesce(F.nullif("_l", F.lit("")), "rough_text", F.lit("")).alias("rough_text"))


def build_blocks(ranges: DataFrame, data: Inputs, pages: DataFrame, profile: DataFrame) -> DataFrame:
    """doc_id, question_no, ord, block_id, page_no, type (text, table, image), table_id, text, bbox, confidence."""
    boxes, tables, images = [], None, None
    if data.tables is not None and data.cells is not None:
        stats = TB.table_stats(data.cells).where(TB.structured()).select("doc_id", "table_id")
        tables = B.in_ranges(data.tables.join(stats, ["doc_id", "table_id"], "left_semi"), ranges, B.TABLE_MARGIN)
        boxes.append(tables.select(*PAGE, F.col("bbox").alias("box")))
    if data.images is not None:
        images = data.images.join(ranges.select("doc_id", "question_no"), ["doc_id", "question_no"], "left_semi")
        boxes.append(images.select(*PAGE, F.col("bbox").alias("box")))
    taken = reduce(DataFrame.unionByName, boxes) if boxes else None
    shape = lambda rows, kind, table, text, confidence: rows.select("doc_id", "question_no", "page_no", F.lit(kind).alias("type"), table.alias("table_id"), text.alias("text"), "bbox", confidence.cast("double").alias("confidence"))
    none = F.lit(None).cast("string")
    parts = [shape(question_lines(ranges, data.words, data.lines, pages, profile, taken), "text", none, F.col("text"), F.col("confidence"))]
    if images is not None:  # labels of a chart belong to its picture
        labels = parts[0].where(T.is_chart_label(F.col("text")))
        near = B.near_images(labels, images.select(*PAGE, F.col("bbox").alias("box"))).select("doc_id", "question_no", "text", "bbox")
        parts[0] = parts[0].join(near, ["doc_id", "question_no", "text", "bbox"], "left_anti").select(parts[0].columns)
        parts.append(shape(images, "image", none, F.lit(""), F.lit(0.95)))
    if tables is not None:
        parts.append(shape(tables, "table", F.col("table_id"), F.lit(""), F.lit(0.95)))
    rows = reduce(DataFrame.unionByName, parts)
    order = F.row_number().over(Window.partitionBy("doc_id", "question_no").orderBy("page_no", "bbox.y0", "bbox.x0", "type", "text"))
    return B.number_blocks(rows.withColumn("ord", order))


def refined_blocks(blocks: DataFrame, second: DataFrame | None, below: float = 0.9) -> DataFrame:
    """blocks with a second reading where one is worth it, and their decided types; tables and images keep theirs."""
    top = D.best_candidate(D.classify_text(F.col("text")))["type"]
    worth = B.should_refine(top, F.when(F.col("confidence") < below, F.lit(0.0)).otherwise(F.col("confidence")), F.col("type") == "table", F.when(F.col("type") == "image", 0.95).otherwise(0.0))
    asked = blocks.where(worth).select("doc_id", "block_id")
    read = second.join(asked, ["doc_id", "block_id"], "left_semi") if second is not None else blocks.select("doc_id", "block_id", F.lit("").alias("text"), F.lit(0.0).alias("confidence")).limit(0)
    typed = B.type_blocks(W.surrounding_text(B.refine(blocks, read)))
    fixed = F.col("type").isin("table", "image")
    return typed.withColumns({"final_type": F.when(fixed, F.col("type")).otherwise(F.col("final_type")), "needs_review": ~fixed & F.col("needs_review")}).drop("candidates")


def render_items(blocks: DataFrame, cells: DataFrame | None) -> DataFrame:
    """doc_id, question_no, ord, item_id, type, content, target, table_id, uncertain, tag: an item for each block.

    A table that is not reliable is kept as a picture; a short reaction inside prose stays text; other formulas are repaired.
    """
    kind, s = F.col("final_type"), F.col("text")
    rows = blocks.withColumn("_f", D.formula_repair(kind, s))
    if cells is not None:
        rows = rows.join(TB.table_stats(cells).where(TB.reliable()).select("doc_id", "table_id", F.lit(True).alias("_ok")), ["doc_id", "table_id"], "left")
    else:
        rows = rows.withColumn("_ok", F.lit(None).cast("boolean"))
    lost = (kind == "table") & F.col("_ok").isNull()
    inline = (kind == "chem_equation") & T.inlines_equation(s)
    formula = kind.isin("equation", "chem_equation") & ~inline
    item = F.when(lost | (kind == "image"), "image").when(kind == "table", "table").when(formula, kind).otherwise("text")
    content = F.when(formula, s).when(kind.isin("table", "image"), "").otherwise(T.repair_scientific(s))
    content = F.when((item == "text") & (F.trim(content) == ""), R.UNCERTAIN).otherwise(content)
    doubt = F.when(lost, True).when(formula, F.col("_f.needs_review") | F.col("needs_review")).when(item == "text", R.uncertain(F.col("confidence"), F.col("needs_review"))).otherwise(F.col("needs_review"))
    tag = F.when(lost, "table_preserved_as_image").when((formula | inline) & doubt, "equation_conversion_low_confidence").when((item == "text") & doubt, "uncertain_text")
    return rows.select(
        "doc_id", F.col("question_no").cast("int").alias("question_no"), F.row_number().over(Window.partitionBy("doc_id", "question_no").orderBy("ord")).alias("ord"), "block_id", item.alias("type"), content.alias("content"),
        F.when(formula, F.col("_f.target")).otherwise(F.lit("")).alias("target"), "table_id", F.coalesce(doubt, F.lit(False)).alias("uncertain"), tag.alias("tag"),
    ).withColumn("item_id", F.concat(F.lit("q"), "question_no", F.lit("_i"), "ord"))


# --- notes -----------------------------------------------------------------------------------------


def answer_blocks(lines: DataFrame, split: DataFrame) -> DataFrame:
    """doc_id, ord, block_id, page_no, text of the lines on answer pages."""
    pages = split.select("doc_id", F.explode("answer_pages").alias("page_no"))
    rows = lines.join(pages, PAGE, "left_semi")
    k = F.row_number().over(Window.partitionBy(*PAGE).orderBy("ord"))
    every = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "ord"))
    return rows.select("doc_id", every.alias("ord"), F.concat(F.lit("a"), "page_no", F.lit("_b"), k).alias("block_id"), "page_no", "text")


# --- the whole -------------------------------------------------------------------------------------


def analyse(data: Inputs, config: dict | None = None, keep=None) -> dict[str, DataFrame]:
    """Every stage's output by name. What several stages read goes through `keep` and is worked out once; other frames are lazy.

    Without `keep`, stages are written to a folder of their own in the shared one.
    """
    keep = keep or staged(work_dir(data.files.sparkSession))
    settings = wire(config or {})
    given = lambda agent: overrides_of(settings, agent, data.overrides)
    out: dict[str, DataFrame] = {}

    def decide(name: str, rules: DataFrame, agent: str, fields: list[str]) -> DataFrame:
        over = given(agent)
        out[name] = keep(rules if over is None else D.apply_overrides(rules, over, ["doc_id"], fields), name)
        return out[name]

    pages, lines, words = data.pages, data.lines, data.words
    out["template"] = template_use(data.files, pages, settings, data.fields)
    profile = out["noise"] = keep(noise(lines, pages), "noise")
    out["evidence"] = D.page_evidence(lines, settings.keywords)
    decide("meta", exam_meta(data.files, lines, out["template"]), "exam_meta", list(D.META_FIELDS))
    split = decide("sections", D.section_split(out["evidence"]), "section_split", ["split_page", "has_answer_section", "question_pages", "answer_pages"])
    elements = data.elements if settings.use_layout else None
    candidates = anchor_candidates(words, lines)
    if elements is not None:
        candidates = B.merge_candidates(candidates, layout_candidates(elements))
    found = out["anchors"] = keep(anchors(candidates, split), "anchors")
    out["anchor_summary"] = W.anchor_summary(found)
    ranges = keep(packages(found, pages, profile, split), "ranges")
    out["packages"] = ranges.join(rough_texts(ranges, words, lines, pages, profile, elements), ["doc_id", "question_no"])
    built = build_blocks(ranges, data, pages, profile)
    typed = refined_blocks(built, data.second, settings.refine_below)
    if given("block_typing") is not None:
        typed = D.apply_overrides(typed, given("block_typing"), ["doc_id", "block_id"], ["final_type", "final_confidence"])
    typed = out["blocks"] = keep(typed, "blocks")
    expected = ranges.join(split.where("has_answer_section"), "doc_id", "left_semi").select("doc_id", "question_no")
    answers = keep(answer_blocks(lines, split), "answers")
    out["alignment"] = A.note_summary(answers, expected)
    notes = out["notes"] = keep(A.build_notes(answers, expected), "notes")
    questions = ranges.select("doc_id", "question_no", F.col("place").alias("ord"))
    out["layout_plan"] = W.layout_slots(questions.select("doc_id", "question_no"), settings.first_page)
    # Category and message: fixed values.
    missed = _issue(out["alignment"].select("doc_id", F.explode("missing").alias("question_no")), "medium", "answer_alignment", "해설 매핑이 누락되었습니다.", F.concat(F.lit("question_"), F.lpad(F.col("question_no").cast("string"), 3, "0")))
    early = keep(anchor_issues(data.files, out["anchor_summary"]).unionByName(missed), "early_issues")
    out["items"] = keep(R.mark_triaged(render_items(typed, data.cells), D.triage(early)), "items")
    out["issues"] = keep(early.unionByName(findings(questions, out["items"], data.cells)), "issues")
    out["triage"] = D.triage(out["issues"])
    out["section_rows"] = R.section_rows(out["items"], notes)
    out["result"] = results(data.files, questions, split, out["issues"])
    return out


def findings(questions: DataFrame, items: DataFrame, cells: DataFrame | None) -> DataFrame:
    """What the validators find in questions and their items."""
    counts = questions.select("doc_id", "question_no").join(items.groupBy("doc_id", F.col("question_no").cast("long").alias("question_no")).agg(F.count(F.lit(1)).alias("n_items")), ["doc_id", "question_no"], "left")
    parts = [VA.schema_findings(items), VA.numbering_findings(questions), VA.formula_findings(items), VA.consistency_findings(counts.fillna(0, ["n_items"]))]
    if cells is not None:
        shown = items.where("type = 'table'").select("doc_id", "question_no", "ord", "table_id")
        parts.append(VA.table_findings(shown.join(TB.table_stats(cells), ["doc_id", "table_id"], "left")))
    return reduce(DataFrame.unionByName, parts)


def results(files: DataFrame, questions: DataFrame, split: DataFrame, issues: DataFrame) -> DataFrame:
    """doc_id, questions, has_answer_section, issues, document_status for every file."""
    count = lambda rows, name: rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    rows = files.select("doc_id").join(count(questions, "questions"), "doc_id", "left").join(split.select("doc_id", "has_answer_section"), "doc_id", "left").join(count(issues, "issues"), "doc_id", "left")
    rows = rows.select("doc_id", F.coalesce("questions", F.lit(0)).alias("questions"), F.coalesce("has_answer_section", F.lit(False)).alias("has_answer_section"), F.coalesce("issues", F.lit(0)).alias("issues"))
    return D.document_status(rows)


DECISIONS = ("template", "noise", "evidence", "meta", "sections", "anchors", "packages", "blocks", "alignment", "notes", "layout_plan", "triage")


def write(files: DataFrame, out: dict[str, DataFrame], path: str, media: DataFrame | None = None) -> DataFrame:
    """Store what analyse() gave under `path`, and return a row for each document: paths, verification, counts.

    Decisions are JSON lines; packages and previews are tables of files (doc_id, name, content), written
    in parallel, with the pictures in `media` (doc_id, media_id, content); a checklist is there for a
    document with findings about questions only.
    """
    for name in DECISIONS:
        sinks.write_json(out[name], f"{path}/decisions/{name}")
    stems = files.select("doc_id", "stem")
    named = lambda rows, suffix: rows.join(stems, "doc_id").withColumn("name", F.concat("stem", F.lit(suffix))).drop("stem")
    named(sinks.hwpx_packages(out["section_rows"], media), ".hwpx").write.mode("overwrite").parquet(f"{path}/packages")
    named(preview.pdf_previews(out["section_rows"]), ".pdf").write.mode("overwrite").parquet(f"{path}/previews")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("question_no", "category", "message", "asset"))
    rows = out["issues"].where("question_no is not null").withColumn("ord", order)
    lists = R.checklist_text(R.checklist_rows(rows, "").drop("file_name").join(stems, "doc_id").withColumn("file_name", F.concat("stem", F.lit(".hwpx"))).drop("stem"))
    named(lists, "_checklist.txt").write.mode("overwrite").parquet(f"{path}/checklists")
    spark = files.sparkSession
    made = spark.read.parquet(f"{path}/packages").select("doc_id", "names", F.col("name").alias("package"))
    checked = VA.missing_parts(made)
    told = spark.read.parquet(f"{path}/checklists").select("doc_id", F.col("name").alias("checklist"))
    return out["result"].join(made.drop("names"), "doc_id", "left").join(checked, "doc_id", "left").join(told, "doc_id", "left")
