"""Files from rows: JSON, text, and HWPX packages (one per document, built in parallel by mapInPandas)."""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from functools import lru_cache
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .validate import REQUIRED_PARTS

# Namespaces and measures of the format (fixed values).
SPACES = {
    "ha": "http://www.hancom.co.kr/hwpml/2011/app", "hp": "http://www.hancom.co.kr/hwpml/2011/paragraph", "hs": "http://www.hancom.co.kr/hwpml/2011/section", "hc": "http://www.hancom.co.kr/hwpml/2011/core",
    "hh": "http://www.hancom.co.kr/hwpml/2011/head", "opf": "http://www.idpf.org/2007/opf/", "hv": "http://www.hancom.co.kr/hwpml/2011/version", "ocf": "urn:oasis:names:tc:opendocument:xmlns:container",
    "odf": "urn:oasis:names:tc:opendocument:xmlns:manifest:1.0", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "pkg": "http://www.hancom.co.kr/hwpml/2016/meta/pkg#",
}
UNITS_PER_MM = 283.465
COLUMN_WIDTH, PICTURE_WIDTH = 25230, 24247
FONT_LANGUAGES = ("HANGUL", "LATIN", "HANJA", "JAPANESE", "OTHER", "SYMBOL", "USER")


def mm(value: float) -> int:
    return round(value * UNITS_PER_MM)


def element(tag: str, /, *inside: str, **attributes) -> str:
    """An XML element as text; inside is markup, and __ in an attribute's name a colon."""
    head = tag + "".join(f" {k.replace('__', ':')}={quoteattr(str(v))}" for k, v in attributes.items())
    return f"<{head}>{''.join(inside)}</{tag}>" if inside else f"<{head}/>"


def part(root: str, /, *inside: str, spaces: tuple[str, ...], **attributes) -> bytes:
    declared = {f"xmlns__{s}": SPACES[s] for s in spaces}
    return ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + element(root, *inside, **declared, **attributes)).encode()


@lru_cache(maxsize=1)
def fixed_parts() -> dict[str, bytes]:
    """The parts that are alike in every package."""
    holds = lambda about, prop, to: element("rdf:Description", element(prop, rdf__resource=to), rdf__about=about)
    pkg = SPACES["pkg"]
    files = [("Contents/content.hpf", "application/hwpml-package+xml"), ("Preview/PrvText.txt", "text/plain"), ("META-INF/container.rdf", "application/rdf+xml")]
    roots = "".join(f"<ocf:rootfile full-path={quoteattr(p)} media-type={quoteattr(m)}/>" for p, m in files)
    return {
        "version.xml": part("hv:HCFVersion", spaces=("hv",), tagetApplication="WORDPROCESSOR", major=5, minor=1, micro=1, buildNumber=0, os=10, xmlVersion="1.5", application="quire", appVersion="1.0"),
        "settings.xml": part("ha:HWPApplicationSetting", element("ha:CaretPosition", listIDRef=0, paraIDRef=1, pos=0), spaces=("ha",)),
        "META-INF/manifest.xml": part("odf:manifest", spaces=("odf",)),
        "META-INF/container.xml": part("ocf:container", element("ocf:rootfiles", roots), spaces=("ocf",)),
        "META-INF/container.rdf": part(
            "rdf:RDF", holds("", "pkg:hasPart", "Contents/header.xml"), holds("Contents/header.xml", "rdf:type", pkg + "HeaderFile"), holds("", "pkg:hasPart", "Contents/section0.xml"),
            holds("Contents/section0.xml", "rdf:type", pkg + "SectionFile"), holds("", "rdf:type", pkg + "Document"), spaces=("rdf", "pkg"),
        ),
        "Contents/header.xml": header(),
    }


def definition(kind: str, number: int | str, center: bool = False) -> str:
    """A plain definition of a header, by kind and id; the second fill draws lines."""
    per_language = lambda tag, value: element(f"hh:{tag}", **{lang.lower(): value for lang in FONT_LANGUAGES})
    if kind == "borderFill":
        sides = "".join(element(f"hh:{s}Border", type="SOLID" if number == 2 else "NONE", width="0.12 mm", color="#000000") for s in ("left", "right", "top", "bottom"))
        return element("hh:borderFill", sides, id=number, threeD=0, shadow=0)
    if kind == "charPr":
        return element("hh:charPr", per_language("fontRef", 0), per_language("ratio", 95), per_language("spacing", -5), height=1000, id=number, textColor="#000000")
    if kind == "numbering":
        return element("hh:numbering", element("hh:paraHead", "^1.", start=1, level=1, align="LEFT", numFormat="DIGIT"), id=number, start=0)
    if kind == "paraPr":
        return element("hh:paraPr", element("hh:align", horizontal="CENTER" if center else "JUSTIFY", vertical="BASELINE"), id=number, tabPrIDRef=0)
    if kind == "style":
        return element("hh:style", id=number, type="PARA", name=f"style {number}", paraPrIDRef=0, charPrIDRef=0)
    return element("hh:tabPr", id=number)


def header(font: str = "나눔명조") -> bytes:
    """Fonts, border fills, characters, paragraphs and styles that the body refers to."""
    faces = [element("hh:fontface", element("hh:font", id=0, face=font, type="TTF", isEmbedded=0), lang=lang, fontCnt=1) for lang in FONT_LANGUAGES]
    fills = [definition("borderFill", 1), definition("borderFill", 2)]
    characters = [definition("charPr", i) for i in range(3)]
    paragraphs = [definition("paraPr", 0), element("hh:paraPr", element("hh:align", horizontal="LEFT", vertical="BASELINE"), id=1, tabPrIDRef=0), definition("paraPr", 2), definition("paraPr", 99, center=True)]
    styles = [element("hh:style", id=i, type="PARA", name=n, paraPrIDRef=p, charPrIDRef=0) for i, n, p in ((0, "바탕글", 0), (1, "미주", 2), (2, "문항", 1), (99, "가운데", 99))]
    numberings = [definition("numbering", 1)]
    listed = lambda tag, items: element(f"hh:{tag}", *items, itemCnt=len(items))
    refs = element("hh:refList", listed("fontfaces", faces), listed("borderFills", fills), listed("charProperties", characters), listed("tabProperties", [definition("tabPr", 0)]), listed("numberings", numberings), listed("paraProperties", paragraphs), listed("styles", styles))
    return part("hh:head", element("hh:beginNum", page=1, footnote=1, endnote=1, pic=1, tbl=1, equation=1), refs, spaces=("hh", "hc"), version="1.4", secCnt=1)


def section_properties() -> str:
    """Page, notes and columns: the first paragraph of every section."""
    margin = element("hp:margin", header=mm(25), footer=mm(15), gutter=0, left=mm(10), right=mm(10), top=0, bottom=mm(15))
    page = element("hp:pagePr", margin, landscape="WIDELY", width=59528, height=84186, gutterType="LEFT_ONLY")
    number = element("hp:autoNumFormat", type="DIGIT", suffixChar=")", supscript=0)
    notes = [element(f"hp:{n}", number, element("hp:noteLine", length=length, type="SOLID", width="0.12 mm", color="#000000"), element("hp:placement", place=place, beneathText=0)) for n, length, place in (("footNotePr", -1, "EACH_COLUMN"), ("endNotePr", 14692344, "END_OF_DOCUMENT"))]
    section = element("hp:secPr", page, *notes, id="", textDirection="HORIZONTAL", spaceColumns=1134, tabStop=8000)
    columns = element("hp:ctrl", element("hp:colPr", element("hp:colLine", type="SOLID", width="0.12 mm", color="#000000"), id="", type="NEWSPAPER", layout="LEFT", colCount=2, sameSz=1, sameGap=2268))
    return element("hp:p", element("hp:run", section, columns, charPrIDRef=0), id=0, paraPrIDRef=0, styleIDRef=0)


@lru_cache(maxsize=8)
def png(width: int, height: int, gray: int = 255) -> bytes:
    """A plain gray picture."""
    block = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    pixels = (b"\0" + bytes([gray]) * width) * height
    return b"\x89PNG\r\n\x1a\n" + block(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + block(b"IDAT", zlib.compress(pixels)) + block(b"IEND", b"")


def zipped(parts: dict[str, bytes], media: dict[str, bytes]) -> bytes:
    """An HWPX file: mimetype first and stored, then the parts in order, then pictures, stored."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as archive:
        archive.writestr(zipfile.ZipInfo("mimetype"), "application/hwp+zip", zipfile.ZIP_STORED)
        for name in [*REQUIRED_PARTS[1:], *(n for n in parts if n not in REQUIRED_PARTS)]:
            archive.writestr(name, parts[name])
        for media_id, content in media.items():
            archive.writestr(zipfile.ZipInfo(f"BinData/{media_id}.png"), content, zipfile.ZIP_STORED)
    return out.getvalue()


def hwpx_packages(rows: DataFrame, media: DataFrame | None = None, templates: DataFrame | None = None) -> DataFrame:
    """Section rows -> doc_id, names (array of part names), content (the file).

    media (doc_id, media_id, content: PNG bytes) are the pictures, numbered as render.media_entries()
    does; one that is not given is a blank, and the first stands for the document. templates (doc_id, name, content) are
    parts of given packages: they take the place of the fixed ones, the header as templates.resolve_headers() completes it. Markup is made
    by Spark expressions; only the archive is written in Python.
    """
    from . import markup, templates as given_parts

    made = markup.sections(markup.paragraphs(rows), preview=True).withColumn("manifest", markup.manifest())
    if media is None:
        made = made.withColumn("pictures", F.lit(None).cast("map<string,binary>"))
    else:
        pictures = media.dropDuplicates(["doc_id", "media_id"]).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("media_id", "content"))).alias("pictures"))
        made = made.join(pictures, "doc_id", "left")
    if templates is None:
        made = made.withColumn("given", F.lit(None).cast("map<string,string>"))
    else:
        chosen = given_parts.with_headers(given_parts.template_parts(templates), made.select("doc_id"), made.select("doc_id", "section"))
        made = made.join(chosen.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "content"))).alias("given")), "doc_id", "left")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, files = [], []
            for section, manifest, preview, ids, pictures, given in zip(*(batch[c] for c in ("section", "manifest", "preview", "media", "pictures", "given")), strict=True):
                found = {k: bytes(v) for k, v in dict(pictures or {}).items()}
                shown = {i: found.get(i) or png(8, 8) for i in ids}
                parts = fixed_parts() | {k: v.encode() for k, v in dict(given or {}).items()} | {"Contents/content.hpf": manifest.encode(), "Contents/section0.xml": section.encode(), "Preview/PrvText.txt": (preview or "").encode()}
                parts["Preview/PrvImage.png"] = next(iter(shown.values()), None) or png(320, 240)
                names.append(["mimetype", *REQUIRED_PARTS[1:], *(n for n in parts if n not in REQUIRED_PARTS), *(f"BinData/{i}.png" for i in shown)])
                files.append(zipped(parts, shown))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "names": names, "content": files})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return made.select("doc_id", "section", "manifest", "preview", "media", "pictures", "given").mapInPandas(build, f"doc_id {kind}, names array<string>, content binary")


def by_document(rows: DataFrame) -> DataFrame:
    """doc_id, rows: a document's section rows in order, as one value: its file is one."""
    fields = ("para_seq", "kind", "question_no", "text", "column_break", "page_break")
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))


def as_json(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.select(*key, F.to_json(F.struct(*rows.columns)).alias("json"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_text(rows: DataFrame, column: str, path: str, separator: str = "\n") -> None:
    """Replaces what an earlier run left, so no stale file stays where nothing is written now."""
    rows.select(F.col(column).alias("value")).write.mode("overwrite").option("lineSep", separator).text(path)


def write_texts(rows: DataFrame, column: str, path: str, key: str = "doc_id") -> DataFrame:
    """Texts of many documents as UTF-8 text files, and (key, column) as these files give them back.

    A record is a line of JSON with the key, then the text as it is (null: empty); records end with a mark that no text can hold, as it is drawn for each call.
    """
    mark = f"\u001e{uuid.uuid4().hex}\u001e\n"
    head = F.struct(F.col(key))
    write_text(rows.select(F.concat(F.to_json(head), F.lit("\n"), F.coalesce(F.col(column), F.lit(""))).alias("value")), "value", path, mark)
    read = rows.sparkSession.read.option("lineSep", mark).text(path)
    said = F.from_json(F.substring_index("value", "\n", 1), rows.select(head.alias("h")).schema["h"].dataType)
    return read.select(said[key].alias(key), F.substring("value", F.locate("\n", "value") + 1, F.length("value")).alias(column))
