"""Geometry and text functions, applied to the adapter views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..sources import views as V
from .registry import plan

_KEYS = ("doc_id", "page_no", "text", "x0", "y0")


def _boxes(spark, d):
    """Anchor boxes a with a second box b made from the same row."""
    rows = V.anchor_candidates(spark, d)
    b = F.col("bbox")
    other = G.box(b["x0"] + F.col("doc_id") % 90 - 45, b["y0"] + F.col("doc_id") % 70 - 35, b["x1"] + F.col("doc_id") % 90 - 30, b["y1"] + F.col("doc_id") % 70 - 30)
    return rows.select("doc_id", "page_no", "text", b["x0"].alias("x0"), b["y0"].alias("y0"), b.alias("a"), other.alias("b"))


_PAIRS = {
    "v_pairs": """SELECT doc_id, page_no, text, x0, y0, x0 AS ax0, y0 AS ay0, x1 AS ax1, y1 AS ay1, x0 + doc_id % 90 - 45 AS bx0, y0 + doc_id % 70 - 35 AS by0, x1 + doc_id % 90 - 30 AS bx1, y1 + doc_id % 70 - 30 AS by1 FROM v_anchor""",
    "v_meet": """SELECT *, (ax0 < bx1 AND bx0 < ax1 AND ay0 < by1 AND by0 < ay1) AS meet, greatest(0, ax1 - ax0) * greatest(0, ay1 - ay0) AS area_a, greatest(0, bx1 - bx0) * greatest(0, by1 - by0) AS area_b,
      greatest(0, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0, least(ay1, by1) - greatest(ay0, by0)) AS area_both FROM v_pairs""",
}
_K = "doc_id, page_no, text, x0, y0"


def _box_columns(c, prefix="r_"):
    return [c[s].alias(prefix + s) for s in G.SIDES]


@plan("geo_union_boxes", "SELECT doc_id, page_no, min(x0) AS r_x0, min(y0) AS r_y0, max(x1) AS r_x1, max(y1) AS r_y1 FROM v_anchor GROUP BY 1, 2")
def geo_union_boxes(spark, d):
    out = V.anchor_candidates(spark, d).groupBy("doc_id", "page_no").agg(G.union_box("bbox").alias("r"))
    return out.select("doc_id", "page_no", *_box_columns(F.col("r")))


@plan("geo_box_area", f"SELECT {_K}, area_b::BIGINT AS area FROM v_meet", _PAIRS)
def geo_box_area(spark, d):
    return _boxes(spark, d).select(*_KEYS, G.area(F.col("b")).alias("area"))


@plan("geo_intersects", f"SELECT {_K}, meet FROM v_meet", _PAIRS)
def geo_intersects(spark, d):
    return _boxes(spark, d).select(*_KEYS, G.intersects(F.col("a"), F.col("b")).alias("meet"))


@plan("geo_intersection", f"""SELECT {_K}, CASE WHEN meet THEN greatest(ax0, bx0) ELSE 0 END AS r_x0, CASE WHEN meet THEN greatest(ay0, by0) ELSE 0 END AS r_y0,
  CASE WHEN meet THEN least(ax1, bx1) ELSE 0 END AS r_x1, CASE WHEN meet THEN least(ay1, by1) ELSE 0 END AS r_y1 FROM v_meet""", _PAIRS)  # fmt: skip
def geo_intersection(spark, d):
    return _boxes(spark, d).select(*_KEYS, *_box_columns(G.intersection(F.col("a"), F.col("b"))))


@plan("geo_contains", f"SELECT {_K}, (bx0 >= ax0 - 20 AND by0 >= ay0 - 20 AND bx1 <= ax1 + 20 AND by1 <= ay1 + 20) AS inside FROM v_meet", _PAIRS)
def geo_contains(spark, d):
    return _boxes(spark, d).select(*_KEYS, G.contains(F.col("a"), F.col("b"), 20).alias("inside"))


@plan("geo_expand_box", f"SELECT {_K}, x0 - 24 AS r_x0, y0 - 24 AS r_y0, ax1 + 24 AS r_x1, ay1 + 24 AS r_y1 FROM v_pairs", _PAIRS)
def geo_expand_box(spark, d):
    return _boxes(spark, d).select(*_KEYS, *_box_columns(G.expand(F.col("a"), 24)))


@plan("geo_overlap_ratio", f"SELECT {_K}, CASE WHEN meet THEN area_both / greatest(1, least(area_a, area_b))::DOUBLE ELSE 0 END AS ratio FROM v_meet", _PAIRS)
def geo_overlap_ratio(spark, d):
    return _boxes(spark, d).select(*_KEYS, G.overlap_ratio(F.col("a"), F.col("b")).alias("ratio"))


@plan("geo_pdf_to_pixel", f"""SELECT {_K}, greatest(0, round_even(x0 * 0.3::DOUBLE * (2480 / 595.0::DOUBLE), 0))::INTEGER AS r_x0, greatest(0, round_even(3505 - y1 * 0.4::DOUBLE * (3505 / 842.0::DOUBLE), 0))::INTEGER AS r_y0,
  least(2480, round_even(x1 * 0.3::DOUBLE * (2480 / 595.0::DOUBLE), 0))::INTEGER AS r_x1, least(3505, round_even(3505 - y0 * 0.4::DOUBLE * (3505 / 842.0::DOUBLE), 0))::INTEGER AS r_y1 FROM v_anchor""")  # fmt: skip
def geo_pdf_to_pixel(spark, d):
    b = F.col("bbox")
    pdf = F.struct((b["x0"] * 0.3).alias("left"), (b["y0"] * 0.4).alias("bottom"), (b["x1"] * 0.3).alias("right"), (b["y1"] * 0.4).alias("top"))
    rows = V.anchor_candidates(spark, d)
    return rows.select("doc_id", "page_no", "text", b["x0"].alias("x0"), b["y0"].alias("y0"), *_box_columns(G.pdf_to_pixels(pdf, F.lit(V.PAGE_WIDTH), F.lit(V.PAGE_HEIGHT), F.lit(595.0), F.lit(842.0))))


@plan("geo_clamp_crop", f"SELECT {_K}, greatest(0, bx0) AS r_x0, greatest(0, by0) AS r_y0, least(1300, bx1) AS r_x1, least(1900, by1) AS r_y1 FROM v_pairs", _PAIRS)
def geo_clamp_crop(spark, d):
    return _boxes(spark, d).select(*_KEYS, *_box_columns(G.clamp(F.col("b"), F.lit(1300), F.lit(1900))))


@plan("src_word_scale", f"""SELECT {_K}, trunc(x0 * 2.0833::DOUBLE)::INTEGER AS r_x0, trunc(y0 * 2.0833::DOUBLE)::INTEGER AS r_y0, trunc(ax1 * 2.0833::DOUBLE)::INTEGER AS r_x1, trunc(ay1 * 2.0833::DOUBLE)::INTEGER AS r_y1 FROM v_pairs""", _PAIRS)
def src_word_scale(spark, d):
    return _boxes(spark, d).select(*_KEYS, *_box_columns(G.scale_word(F.col("a"), 2.0833, 2.0833)))


@plan("norm_poly_to_bbox", f"SELECT {_K}, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE least(ax0, bx1, 0) END AS r_x0, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE least(ay0, by1, ay1) END AS r_y0, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE greatest(ax0, bx1, 0) END AS r_x1, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE greatest(ay0, by1, ay1) END AS r_y1 FROM v_pairs", _PAIRS)
def norm_poly_to_bbox(spark, d):
    a, b = F.col("a"), F.col("b")
    point = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    corners = F.array(point(a["x0"], a["y0"]), point(b["x1"], b["y1"]), point(F.lit(None), a["y1"]))
    polygon = F.when(F.col("doc_id") % 9 == 0, F.filter(corners, lambda _: F.lit(False))).otherwise(corners)
    return _boxes(spark, d).select(*_KEYS, *_box_columns(G.polygon_box(polygon)))


# --- text ------------------------------------------------------------------------------------------

_L = "doc_id, page_no, ord"


def _on_lines(spark, d, *columns):
    return V.lines(spark, d).select("doc_id", "page_no", "ord", *columns)


def _on_formulas(spark, d, *columns):
    return V.formulas(spark, d).select("block_id", *columns)


_COLLAPSED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_FOOT = {
    "v_flags": rf"""SELECT *, t <> '' AND NOT regexp_matches(t, '->|→|⇌|<=>') AND NOT regexp_matches(t, '[=^√∫Σ/±]') AND (spaces >= 2 AND letters >= greatest(10, trunc(length(t) * 0.35::DOUBLE)::INTEGER)
      OR regexp_matches(t, '다음|서술|설명|물음|이유|자료|그림|조건|과정|답|쓰시오|표시|계산|경향성|존재') AND spaces >= 1) AS prose FROM
      (SELECT *, length(t) - length(replace(t, ' ', '')) AS spaces, length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')) AS letters, length(t) - length(regexp_replace(t, '[=^√∫Σ/±]', '', 'g')) AS operators,
       length(t) - length(regexp_replace(t, '[=^√∫Σ/±()\[\]{{}}]', '', 'g')) AS symbols, length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS digits, length(t) - length(regexp_replace(t, '[+-]', '', 'g')) AS signs FROM v_texts)""",
    "v_kinds": r"""SELECT *, CASE WHEN t = '' OR prose THEN false WHEN regexp_matches(t, '->|→|⇌|<=>') THEN regexp_matches(t, '\p{Lu}') ELSE (operators >= 1 AND length(t) < 180 AND symbols + digits >= greatest(3, letters // 2))
      OR (regexp_full_match(t, '[A-Za-z0-9\[\]()+\-.\s]+') AND digits >= 2 AND signs >= 2) END AS equation FROM v_flags""",
}
TEXTS = {"v_texts": rf"SELECT block_id, p_size, block_type, text, {_COLLAPSED} AS t FROM v_formulas"} | _FOOT
LINE_TEXTS = {"v_texts": rf"SELECT doc_id, page_no, ord, text, {_COLLAPSED} AS t FROM v_lines"} | _FOOT


@plan("txt_canonicalize", rf"SELECT {_L}, regexp_replace({_COLLAPSED}, '[0-9]+', '#', 'g') AS canonical FROM v_lines")
def txt_canonicalize(spark, d):
    return _on_lines(spark, d, T.canonicalize(F.col("text")).alias("canonical"))


@plan("txt_is_prose", f"SELECT {_L}, prose FROM v_flags", LINE_TEXTS)
def txt_is_prose(spark, d):
    return _on_lines(spark, d, T.is_prose(F.col("text")).alias("prose"))


@plan("txt_is_equation", "SELECT block_id, equation FROM v_kinds", TEXTS)
def txt_is_equation(spark, d):
    return _on_formulas(spark, d, T.is_equation(F.col("text")).alias("equation"))


@plan("txt_repair_sci")
def txt_repair_sci(spark, d):
    return _on_formulas(spark, d, T.repair_scientific(F.col("text")).alias("repaired"))


@plan("txt_repair_ionic", "SELECT block_id, CASE WHEN p_size % 2 = 0 THEN 'the Ionic bond' ELSE 'colonic tract' END AS repaired FROM v_formulas")
def txt_repair_ionic(spark, d):
    s = F.when(F.col("p_size") % 2 == 0, "the lonic bond").otherwise("colonic tract")
    return _on_formulas(spark, d, T.repair_ionic(s).alias("repaired"))


@plan("txt_repair_alpha")
def txt_repair_alpha(spark, d):
    return _on_formulas(spark, d, T.repair_alpha(F.concat(F.lit("a particles and Ba particles "), "text")).alias("repaired"))


@plan("txt_repair_angstrom")
def txt_repair_angstrom(spark, d):
    return _on_formulas(spark, d, T.repair_angstrom(F.concat("p_size", F.lit(".5 8일 때 2.27 A "), "text")).alias("repaired"))


@plan("txt_repair_isotope")
def txt_repair_isotope(spark, d):
    return _on_formulas(spark, d, T.repair_isotope(F.concat("p_size", F.lit(" Au 79 + (He2+) "), "text")).alias("repaired"))


@plan("txt_repair_ions")
def txt_repair_ions(spark, d):
    return _on_formulas(spark, d, T.repair_ions(F.concat(F.lit("A +B (g) X + (g) "), "text")).alias("repaired"))


@plan("txt_repair_chem_tokens", r"""SELECT block_id, CASE p_size % 6 WHEN 4 THEN '[Fe(H2O)4Br2]+ 6H.0(l) Na' || p_size || '+(aq)' ELSE text END AS repaired FROM v_formulas WHERE p_size % 6 IN (0, 2, 4)""")
def txt_repair_chem_tokens(spark, d):
    return V.formulas(spark, d).where("p_size % 6 in (0, 2, 4)").select("block_id", T.repair_chem_tokens(F.col("text")).alias("repaired"))


@plan("txt_is_chem_like", r"SELECT block_id, (contains(t, '[') OR regexp_matches(t, '[0-9]')) AND regexp_matches(t, '\p{Lu}') AS chem FROM v_texts", TEXTS)
def txt_is_chem_like(spark, d):
    return _on_formulas(spark, d, T.is_chem_like(F.col("text")).alias("chem"))


@plan("txt_norm_chem_token")
def txt_norm_chem_token(spark, d):
    return _on_formulas(spark, d, T.norm_chem_token(F.concat(F.lit("6H,0(1)|*"), "text")).alias("token"))


@plan("txt_superscript", "SELECT block_id, translate(p_size || '+-', '0123456789+-', '⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻') AS raised FROM v_formulas")
def txt_superscript(spark, d):
    return _on_formulas(spark, d, T.superscript(F.concat("p_size", F.lit("+-"))).alias("raised"))


@plan("txt_chem_segments")
def txt_chem_segments(spark, d):
    parts = T.chem_segments(F.col("text"))
    return _on_formulas(spark, d, F.array_join(F.transform(parts, lambda p: F.concat(p["type"], F.lit(":"), F.coalesce(p["script"], p["text"]))), "|").alias("segments"))


_TOKEN = "(CASE p_size % 3 WHEN 0 THEN 'Fe' || p_size || 'O' || p_size || '3+(aq)' WHEN 1 THEN 'HCN' ELSE 'A⁺(g)' END)"
_ASCII = {
    "v_tok": f"SELECT block_id, {_TOKEN} AS tok FROM v_formulas",
    "v_state": r"SELECT block_id, tok, regexp_extract(tok, '(\((?:aq|s|l|g)\))$', 1) AS state, regexp_replace(tok, '\((?:aq|s|l|g)\)$', '') AS rest FROM v_tok",
    "v_charge": r"SELECT block_id, tok, state, regexp_extract(rest, '([0-9]*[+-])$', 1) AS charge, regexp_replace(rest, '[0-9]*[+-]$', '') AS core FROM v_state",
    "v_ascii": r"SELECT block_id, tok, CASE WHEN regexp_matches(core, '[A-Z]') AND NOT regexp_full_match(core, '[A-Z]{2,}') THEN regexp_replace(core, '([0-9]+)', '_{\1}', 'g') || CASE WHEN charge = '' THEN '' ELSE '^{' || charge || '}' END || state END AS script FROM v_charge",
}


def _tokens():
    k = F.col("p_size").cast("string")
    return F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Fe"), k, F.lit("O"), k, F.lit("3+(aq)"))).when(F.col("p_size") % 3 == 1, "HCN").otherwise("A⁺(g)")


@plan("txt_chem_to_script", "SELECT block_id, CASE WHEN tok = 'A⁺(g)' THEN 'A^{+}(g)' ELSE script END AS script FROM v_ascii", _ASCII)
def txt_chem_to_script(spark, d):
    return _on_formulas(spark, d, T.chem_script(_tokens()).alias("script"))


@plan("txt_unicode_chem", "SELECT block_id, CASE p_size % 2 WHEN 0 THEN ' ^{' || p_size || '}_{2}He^{2+} ' ELSE 'Na^{' || p_size || '+}(g)' END AS script FROM v_formulas")
def txt_unicode_chem(spark, d):
    k = T.superscript(F.col("p_size").cast("string"))
    token = F.when(F.col("p_size") % 2 == 0, F.concat(k, F.lit("₂He²⁺"))).otherwise(F.concat(F.lit("Na"), k, F.lit("⁺(g)")))
    return _on_formulas(spark, d, T.unicode_chem(token).alias("script"))


@plan("txt_ascii_chem", "SELECT block_id, script FROM v_ascii WHERE tok <> 'A⁺(g)'", _ASCII)
def txt_ascii_chem(spark, d):
    return V.formulas(spark, d).where("p_size % 3 <> 2").select("block_id", T.ascii_chem(_tokens()).alias("script"))


@plan("txt_inline_equation", "SELECT block_id, p_size % 3 = 0 AS inlined FROM v_formulas")
def txt_inline_equation(spark, d):
    s = F.when(F.col("p_size") % 3 == 0, "다음 반응 A -> B 이다").when(F.col("p_size") % 3 == 1, "다음 A -> B").otherwise("다음 반응 이다 이다")
    return _on_formulas(spark, d, T.inlines_equation(s).alias("inlined"))


@plan("txt_norm_formula", r"""SELECT block_id, f AS formula, f <> '' AND regexp_matches(f, '=|\^|/|√|→|->|⇌|\+|-') AS valid FROM (SELECT block_id, regexp_replace(replace(replace(trim(text), '**', '^'), 'sqrt', '√'), '\s+', ' ', 'g') AS f FROM v_formulas)""")
def txt_norm_formula(spark, d):
    r = T.norm_formula(F.col("text"))
    return _on_formulas(spark, d, r["text"].alias("formula"), r["valid"].alias("valid"))


@plan("txt_norm_chem_eq", r"""SELECT block_id, f AS formula, regexp_matches(f, '->|<=>') AND regexp_matches(f, '[A-Z]') AS valid FROM (SELECT block_id, regexp_replace(replace(replace(trim(text), '→', '->'), '⇌', '<=>'), '\s+', ' ', 'g') AS f FROM v_formulas)""")
def txt_norm_chem_eq(spark, d):
    r = T.norm_chem_equation(F.col("text"))
    return _on_formulas(spark, d, r["text"].alias("formula"), r["valid"].alias("valid"))


@plan("txt_chart_label", r"""SELECT doc_id, page_no, ord, t <> '' AND (length(t) <= 14 AND regexp_full_match(t, '[0-9A-Za-z가-힣+\-().,/→§ ]+') AND len(string_split(t, ' ')) <= 3
  OR regexp_full_match(t, '[+\-]?[0-9]+(?:\.[0-9]+)?(?:\s+[+\-]?[0-9]+(?:\.[0-9]+)?)*') OR t IN ('(가)', '(나)', '(다)', '(라)', 'Contour plots', 'Line scan', 'x', 'y', 'z', 'A→', 'B→', '>')) AS label FROM v_texts""", LINE_TEXTS)  # fmt: skip
def txt_chart_label(spark, d):
    return _on_lines(spark, d, T.is_chart_label(F.col("text")).alias("label"))


@plan("txt_strip_note_lead", "SELECT doc_id, ord, trim(CASE WHEN starts_with(text, '1. ') THEN substr(text, 4) WHEN starts_with(text, '1.') THEN substr(text, 3) ELSE text END) AS note FROM v_answers")
def txt_strip_note_lead(spark, d):
    return V.answer_blocks(spark, d).select("doc_id", "ord", T.strip_note_lead(F.col("text"), F.lit(1)).alias("note"))


@plan("txt_filename_tokens", "SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array('2024-3-' || p_brand || '_' || p_name || '--x', '[-_]'), lambda x: x <> ''), '|') AS tokens FROM part")
def txt_filename_tokens(spark, d):
    stem = F.concat(F.lit("2024-3-"), "p_brand", F.lit("_"), "p_name", F.lit("--x"))
    return V.table(spark, d, "part").select("p_partkey", F.array_join(T.filename_tokens(stem), "|").alias("tokens"))
