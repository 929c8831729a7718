"""Markup of packages, template parts and header references, with DuckDB SQL that builds the same text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import markup as M
from ..operators import templates as T
from ..operators.sinks import SPACES, definition, fixed_parts, section_properties
from ..sources import views as V
from . import decide, output
from .registry import plan


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _esc(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_NS = " ".join(f'xmlns:{s}="{SPACES[s]}"' for s in ("hs", "hp", "hc"))
_SZ = """'<hp:sz width="' || {w} || '" widthRelTo="ABSOLUTE" height="' || {h} || '" heightRelTo="ABSOLUTE" protect="0"/>'"""
_EQUATION = f"""'<hp:equation id="' || seq || '" version="Equation Version 60" baseUnit="1000" font="HancomEQN">' || {_SZ.format(w="least(20500, greatest(1800, 420 * length(t)))", h="1050")} || '<hp:pos treatAsChar="1"/><hp:script>' || {_esc("t")} || '</hp:script></hp:equation>'"""
_CELL = f"""'<hp:tc><hp:subList><hp:p id="0" paraPrIDRef="0" styleIDRef="0"><hp:run charPrIDRef="0"><hp:t>' || {_esc("c")} || '</hp:t></hp:run></hp:p></hp:subList><hp:cellAddr colAddr="' || (j - 1) || '" rowAddr="' || (i - 1) || '"/><hp:cellSpan colSpan="1" rowSpan="1"/><hp:cellSz width="' || (25230 // wide) || '" height="800"/></hp:tc>'"""
_TABLE = f"""'<hp:tbl id="' || seq || '" rowCnt="' || len(grid) || '" colCnt="' || wide || '" borderFillIDRef="2">' || {_SZ.format(w="25230", h="greatest(282, 800 * len(grid))")} ||
  array_to_string(list_transform(grid, lambda r, i: '<hp:tr>' || array_to_string(list_transform(r, lambda c, j: {_CELL}), '') || '</hp:tr>'), '') || '</hp:tbl>'"""
_PICTURE = f"""'<hp:pic id="' || seq || '">' || {_SZ.format(w="24247", h="12123")} || '<hc:img binaryItemIDRef="image' || pic || '"/></hp:pic>'"""
_NOTE = """'<hp:ctrl><hp:endNote number="' || question_no || '" instId="' || (seq + 9000) || '"><hp:subList><hp:p id="0" paraPrIDRef="2" styleIDRef="1"><hp:run charPrIDRef="1"><hp:ctrl><hp:autoNum num="' || question_no || '" numType="ENDNOTE"/></hp:ctrl><hp:t> </hp:t></hp:run></hp:p></hp:subList></hp:endNote></hp:ctrl>'"""
VIEWS = decide.NOTES | output._SECTION | {
    "v_placed": """SELECT *, row_number() OVER d AS seq, sum(CASE WHEN kind = 'image' THEN 1 ELSE 0 END) OVER d AS pic, coalesce(text, '') AS t, list_transform(string_split(coalesce(text, ''), chr(10)), lambda r: string_split(r, chr(9))) AS grid,
      kind <> 'note' AND min(CASE WHEN kind <> 'note' THEN para_seq END) OVER q = para_seq AS head, max(CASE WHEN kind = 'note' THEN 1 ELSE 0 END) OVER q = 1 AS noted
      FROM v_section WINDOW d AS (PARTITION BY doc_id ORDER BY para_seq), q AS (PARTITION BY doc_id, question_no)""",
    "v_lead": f"""SELECT *, list_max(list_transform(grid, lambda r: len(r))) AS wide, CASE WHEN head THEN '<hp:t>' || question_no || '. </hp:t>' || CASE WHEN noted THEN {_NOTE} ELSE '' END ELSE '' END AS lead FROM v_placed""",
    "v_para": f"""SELECT doc_id, para_seq, kind, question_no, pic, lead, '<hp:p id="' || seq || '" paraPrIDRef="0" styleIDRef="0" pageBreak="' || page_break::INTEGER || '" columnBreak="' || column_break::INTEGER || '" merged="0"><hp:run charPrIDRef="0">' || lead ||
      CASE WHEN kind IN ('equation', 'chem_equation') THEN {_EQUATION} WHEN kind = 'table' THEN {_TABLE} WHEN kind = 'image' THEN {_PICTURE} ELSE '<hp:t>' || {_esc("t")} || '</hp:t>' END || '</hp:run></hp:p>' AS paragraph FROM v_lead""",
    "v_body": f"""SELECT doc_id, {_q(M.DECLARATION + f"<hs:sec {_NS}>" + section_properties())} || string_agg(paragraph, '' ORDER BY para_seq) || '</hs:sec>' AS section, coalesce(list('image' || pic ORDER BY para_seq) FILTER (WHERE kind = 'image'), []) AS media FROM v_para GROUP BY 1""",
}


def _paragraphs(spark, d):
    return M.paragraphs(output._section(spark, d))


def _sections(spark, d):
    return M.sections(_paragraphs(spark, d))


def _pictures(spark, d):
    """Pictures of each document. Notes are text and made from lines of orders that have items, so they add neither pictures nor documents."""
    return M.pictures(V.question_items(spark, d).select("doc_id", F.col("type").alias("kind")))


@plan("hwpx_section", "SELECT doc_id, md5(section) AS section, length(section)::INTEGER AS chars FROM v_body", VIEWS)
def hwpx_section(spark, d):
    return _sections(spark, d).select("doc_id", F.md5(F.col("section").cast("binary")).alias("section"), F.length("section").alias("chars"))


_PAGE, _COLUMNS, _ALL = r'<hp:pagePr [^>]*width="(\d+)"', r'<hp:colPr [^>]*colCount="(\d+)"', "(?s)<hp:secPr .*?</hp:secPr>"


@plan("hwpx_section_props", f"SELECT doc_id, regexp_extract(section, '{_PAGE}', 1) AS width, regexp_extract(section, '{_COLUMNS}', 1) AS columns, md5(regexp_extract(section, '{_ALL}')) AS properties FROM v_body", VIEWS)
def hwpx_section_props(spark, d):
    """Page and columns as each document's section states them."""
    found = lambda p, g=1: F.regexp_extract("section", p, g)
    return _sections(spark, d).select("doc_id", found(_PAGE).alias("width"), found(_COLUMNS).alias("columns"), F.md5(found(_ALL, 0).cast("binary")).alias("properties"))


@plan("hwpx_text_paragraph", "SELECT doc_id, para_seq, paragraph FROM v_para WHERE kind NOT IN ('equation', 'chem_equation', 'table', 'image')", VIEWS)
def hwpx_text_paragraph(spark, d):
    return _paragraphs(spark, d).where(~F.col("kind").isin("equation", "chem_equation", "table", "image")).select("doc_id", "para_seq", "paragraph")


@plan("hwpx_question_paragraph", "SELECT doc_id, para_seq, question_no, paragraph FROM v_para WHERE lead <> ''", VIEWS)
def hwpx_question_paragraph(spark, d):
    return _paragraphs(spark, d).where("lead <> ''").select("doc_id", "para_seq", "question_no", "paragraph")


@plan("hwpx_endnote", "SELECT doc_id, question_no, para_seq, lead FROM v_para WHERE contains(lead, '<hp:endNote ')", VIEWS)
def hwpx_endnote(spark, d):
    return _paragraphs(spark, d).where(F.col("lead").contains("<hp:endNote ")).select("doc_id", "question_no", "para_seq", "lead")


_ITEM = """'<opf:item id="' || {i} || '" href="' || {h} || '" media-type="' || {t} || '"/>'"""
_MANIFEST = f"""SELECT doc_id, {_q(M.DECLARATION + f'<opf:package version="1.0" xmlns:opf="{SPACES["opf"]}">')} AS head, '<opf:metadata><opf:title>' || doc_id || '</opf:title><opf:language>ko</opf:language></opf:metadata><opf:manifest>' || {_ITEM.format(i="'header'", h="'Contents/header.xml'", t="'application/xml'")} ||
  {_ITEM.format(i="'section0'", h="'Contents/section0.xml'", t="'application/xml'")} || array_to_string(list_transform(media, lambda m: {_ITEM.format(i="m", h="'BinData/' || m || '.png'", t="'image/png'")}), '') || '</opf:manifest><opf:spine><opf:itemref idref="header"/><opf:itemref idref="section0"/></opf:spine></opf:package>' AS body FROM v_body"""


@plan("hwpx_package_manifest", f"SELECT doc_id, body AS manifest FROM ({_MANIFEST})", VIEWS)
def hwpx_package_manifest(spark, d):
    """What follows the package's own tag, whose attributes have no fixed order in XML."""
    return M.manifests(_pictures(spark, d)).select("doc_id", F.regexp_extract("manifest", "(?s)<opf:metadata>.*$", 0).alias("manifest"))


@plan("hwpx_preview_image", "SELECT doc_id, coalesce(list_extract(media, 1), '') AS media_id FROM v_body", VIEWS)
def hwpx_preview_image(spark, d):
    """The picture that stands for each document, its first; none where there is none."""
    return _pictures(spark, d).select("doc_id", F.coalesce(F.get("media", F.lit(0)), F.lit("")).alias("media_id"))


# --- templates -------------------------------------------------------------------------------------

_LISTS = ('<hh:fontfaces itemCnt="2"><hh:fontface lang="HANGUL" fontCnt="9"><hh:font id="3" face="', '"/><hh:font id="4" face="x"/></hh:fontface><hh:fontface lang="LATIN" fontCnt="0"/></hh:fontfaces><hh:charProperties itemCnt="0"><hh:charPr id="5" height="900" borderFillIDRef="', '"><hh:fontRef hangul="3" latin="4"/><hh:ratio hangul="80"/></hh:charPr></hh:charProperties>')
_REST = ('<hh:tabProperties itemCnt="7"/><hh:paraProperties itemCnt="9"><hh:paraPr id="1" tabPrIDRef="', '"/></hh:paraProperties><hh:styles itemCnt="1"><hh:style id="1" paraPrIDRef="8" charPrIDRef="9" nextStyleIDRef="2"/></hh:styles>')
_HEAD, _TAIL = '<hh:head version="1.4"><hh:refList>', "</hh:refList></hh:head>"
_FIRST = "(?s)^(.*?<hh:fontface\\b[^>]*>.*?<hh:font [^>]*?{a}=\")[^\"]*"
_P2 = f"regexp_replace(regexp_replace(p, '{_FIRST.format(a='face')}', '\\1{T.FACE}'), '{_FIRST.format(a='id')}', '\\10')"
_P3 = f"CASE WHEN contains({_P2}, '<hh:font ') THEN {_P2} ELSE {_P2} || {_q(T._FONT)} END"
_P4 = f"regexp_replace({_P3}, '(<hh:fontface\\b[^>]*?fontCnt=\")[^\"]*', '\\1' || len(regexp_extract_all({_P3}, '<hh:font ')), 'g')"
_PROFILE = f"array_to_string(list_transform(pieces, lambda p, i: CASE WHEN i < len(pieces) THEN {_P4} ELSE p END), '</hh:fontface>')"
_PROFILE = f"regexp_replace(regexp_replace({_PROFILE}, '(<hh:charPr\\b[^>]*?)\\sheight=\"[^\"]*\"', '\\1', 'g'), '<hh:charPr\\b', '<hh:charPr height=\"1000\"', 'g')"
for _tag, _all in T._EVERY.items():
    _PROFILE = f"regexp_replace({_PROFILE}, '<hh:{_tag}\\b[^>]*/>', {_q(_all)}, 'g')"
for _tag in T.KINDS.values():
    _PROFILE = f"regexp_replace({_PROFILE}, '<hh:{_tag}\\b([^>]*)/>', '<hh:{_tag}\\1></hh:{_tag}>', 'g')"


def _completion() -> dict[str, str]:
    """A view for each kind: its missing definitions go into the header, and its list is counted."""
    out, before = {}, "v_profile"
    for k, tag in T.KINDS.items():
        new = f"array_to_string(list_transform(ids, lambda i: replace(CASE WHEN i = 99 THEN {_q(definition(k, '@id@', center=True))} ELSE {_q(definition(k, '@id@'))} END, '@id@', i::VARCHAR)), '')"
        put = f"CASE WHEN ids IS NULL THEN header WHEN contains(header, '</hh:{tag}>') THEN replace(header, '</hh:{tag}>', {new} || '</hh:{tag}>') ELSE replace(header, '</hh:refList>', '<hh:{tag} itemCnt=\"0\">' || {new} || '</hh:{tag}></hh:refList>') END"
        out[f"v_with_{k}"] = f"SELECT doc_id, given, regexp_replace(h, '(<hh:{tag}\\b[^>]*?itemCnt=\")[^\"]*', '\\1' || len(regexp_extract_all(h, '<hh:{k}\\b')), 'g') AS header FROM (SELECT b.doc_id, given, {put} AS h FROM {before} b LEFT JOIN (SELECT * FROM v_missing WHERE kind = '{k}') m USING (doc_id))"
        before = f"v_with_{k}"
    return out | {"v_resolved": f"SELECT * FROM {before}"}


TEMPLATES = VIEWS | {
    "v_header_in": f"""SELECT o_orderkey AS doc_id, {_q(T.HEADER)} AS name, {_q(_HEAD + _LISTS[0])} || o_orderpriority || {_q(_LISTS[1])} || (o_orderkey % 7) || {_q(_LISTS[2])} || CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE {_q(_REST[0])} || (o_orderkey % 3) || {_q(_REST[1])} END || CASE WHEN o_orderkey % 4 = 2 THEN '</hh:ref' ELSE {_q(_TAIL)} END AS content FROM orders WHERE o_orderkey % 4 <> 1""",
    "v_parts_in": """SELECT * FROM v_header_in UNION ALL SELECT o_orderkey, 'version.xml', '<v n="' || o_orderkey || '"/>' FROM orders WHERE o_orderkey % 3 = 0
      UNION ALL SELECT o_orderkey, 'other.bin', 'x' FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'settings.xml', NULL FROM orders WHERE o_orderkey % 6 = 0""",
    "v_parts": f"SELECT doc_id, name, max(content) AS content FROM v_parts_in WHERE name IN ({', '.join(map(_q, T.TEMPLATE_NAMES))}) AND content IS NOT NULL GROUP BY 1, 2",
    "v_chosen": f"""SELECT doc_id, contains(coalesce(content, ''), '</hh:refList></hh:head>') AS given, CASE WHEN given THEN content ELSE {_q(fixed_parts()[T.HEADER].decode())} END AS h0
      FROM (SELECT DISTINCT o_orderkey AS doc_id FROM orders) LEFT JOIN (SELECT doc_id, content FROM v_parts WHERE name = {_q(T.HEADER)}) USING (doc_id)""",
    "v_profile": f"SELECT doc_id, given, {_PROFILE} AS header FROM (SELECT *, string_split(regexp_replace(h0, '<hh:fontface\\b([^>]*)/>', '<hh:fontface\\1></hh:fontface>', 'g'), '</hh:fontface>') AS pieces FROM v_chosen)",
    "v_uses": " UNION ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(t, '{'[sS]tyle' if k == 'style' else k}IDRef=\"(\\d+)\"', 1)) AS id FROM v_said" for k in T.KINDS),
    "v_said": "SELECT doc_id, header AS t FROM v_profile UNION ALL SELECT doc_id, section FROM v_body WHERE doc_id IN (SELECT doc_id FROM v_profile)",
    "v_defined": " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(header, '<hh:{k}\\b[^>]*?\\sid=\"(\\d+)\"', 1)) AS id FROM v_profile" for k in T.KINDS),
    "v_need": f"SELECT * FROM v_uses WHERE id <> '{T.NO_ID}' UNION SELECT doc_id, a.k, a.i FROM v_profile, (VALUES {', '.join(map(str, T.ALWAYS))}) a(k, i)",
    "v_missing": "SELECT doc_id, kind, list_sort(list(id::BIGINT)) AS ids FROM v_need ANTI JOIN v_defined USING (doc_id, kind, id) GROUP BY 1, 2",
    **_completion(),
}


def _parts(spark, d):
    """Parts of given packages, by order: headers that are good, absent, broken, or without some lists; others, allowed and not."""
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    some = F.when(F.col("k") % 4 == 3, "").otherwise(F.concat(F.lit(_REST[0]), F.col("k") % 3, F.lit(_REST[1])))
    whole = F.concat(F.lit(_HEAD + _LISTS[0]), "o_orderpriority", F.lit(_LISTS[1]), F.col("k") % 7, F.lit(_LISTS[2]), some, F.when(F.col("k") % 4 == 2, "</hh:ref").otherwise(_TAIL))
    part = lambda name, content: F.struct(F.lit(name).alias("name"), content.alias("content"))
    given = [F.when(F.col("k") % 4 != 1, part(T.HEADER, whole)), F.when(F.col("k") % 3 == 0, part("version.xml", F.concat(F.lit('<v n="'), "k", F.lit('"/>')))), F.when(F.col("k") % 5 == 0, part("other.bin", F.lit("x"))), F.when(F.col("k") % 6 == 0, part("settings.xml", F.lit(None).cast("string")))]
    return o.select(F.col("k").alias("doc_id"), F.explode(F.array(*given)).alias("p")).where("p is not null").select("doc_id", "p.*")


def _documents(spark, d):
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))


def _header_cases(spark, d):
    return T.header_cases(_documents(spark, d), _parts(spark, d), _sections(spark, d))


def _told(spark, d, *shown):
    """doc_id and what is shown of its header, worked out once for each case."""
    mine, cases = _header_cases(spark, d)
    return mine.join(cases.select("case", "given", *shown), "case")


@plan("hwpx_template_parts", "SELECT * FROM v_parts", TEMPLATES)
def hwpx_template_parts(spark, d):
    return T.template_parts(_parts(spark, d))


@plan("hwpx_font_profile", "SELECT doc_id, md5(header) AS header FROM v_profile WHERE given", TEMPLATES)
def hwpx_font_profile(spark, d):
    """Given headers that parse, with the profile applied."""
    return T.chosen_headers(_documents(spark, d), T.template_parts(_parts(spark, d))).where("given").select("doc_id", F.md5(F.col("header").cast("binary")).alias("header"))


@plan("hwpx_header_resolve", "SELECT doc_id, given, md5(header) AS header FROM v_resolved", TEMPLATES)
def hwpx_header_resolve(spark, d):
    return _told(spark, d, F.md5(F.col("header").cast("binary")).alias("header")).select("doc_id", "given", "header")


@plan("hwpx_header", "SELECT doc_id, length(header)::INTEGER AS chars, md5(header) AS header FROM v_resolved WHERE NOT given", TEMPLATES)
def hwpx_header(spark, d):
    """Headers of documents without a usable template."""
    return _told(spark, d, F.length("header").alias("chars"), F.md5(F.col("header").cast("binary")).alias("header")).where("not given").select("doc_id", "chars", "header")


_COUNTED = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, len(regexp_extract_all(header, '<hh:{k}\\b'))::BIGINT AS defined, 0::BIGINT AS dangling FROM v_resolved" for k in T.KINDS)


@plan("hwpx_header_parts", _COUNTED, TEMPLATES)
def hwpx_header_parts(spark, d):
    """Definitions of each kind in each header, and references that have none: never any."""
    mine, cases = _header_cases(spark, d)
    headers = cases.select(F.col("case").alias("doc_id"), "header", F.col("said").alias("section"))
    none = T.dangling(headers, headers).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("dangling"))
    counts = T.definitions(headers).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("defined")).join(T.merged(none), ["doc_id", "kind"], "left")
    return mine.join(counts.withColumnRenamed("doc_id", "case"), "case").select("doc_id", "kind", "defined", F.coalesce("dangling", F.lit(0)).cast("long").alias("dangling"))


_FIXED = {n: c for n, c in fixed_parts().items() if n != T.HEADER}
_STATIC = f"SELECT o.doc_id, f.name, p.content IS NOT NULL AS given, coalesce(strlen(p.content), f.bytes)::BIGINT AS bytes FROM (SELECT o_orderkey AS doc_id FROM orders) o CROSS JOIN (VALUES {', '.join(f'({_q(n)}, {len(c)})' for n, c in _FIXED.items())}) f(name, bytes) LEFT JOIN v_parts p ON p.doc_id = o.doc_id AND p.name = f.name"


@plan("hwpx_static_parts", _STATIC, TEMPLATES)
def hwpx_static_parts(spark, d):
    """Parts that are alike in every package, or as the document's template gives them, with their sizes."""
    fixed = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(len(c)).cast("long").alias("size")) for n, c in _FIXED.items()])).alias("f")
    parts = T.template_parts(_parts(spark, d))
    rows = _documents(spark, d).select("doc_id", fixed).select("doc_id", "f.*").join(parts, ["doc_id", "name"], "left")
    return rows.select("doc_id", "name", F.col("content").isNotNull().alias("given"), F.coalesce(F.octet_length("content").cast("long"), "size").alias("bytes"))
