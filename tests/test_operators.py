"""Operators on small inline tables."""

import io
import zipfile

import numpy as np
from pyspark.sql import functions as F

from quire.operators import blocks, decisions, images, noise, notes, sinks, tables, validate, windows
from quire.sources import config, layout, ocr, template

BOX = "struct<x0:int,y0:int,x1:int,y1:int>"


def words(spark, rows, width=40):
    data = [(1, 1, i, j, t, (x, y, x + width, y + 20), 1.0, 3000) for i, line in enumerate(rows) for j, (t, x, y) in enumerate(line)]
    return spark.createDataFrame(data, f"doc_id long, page_no int, line_no int, word_no int, text string, bbox {BOX}, confidence double, height int")


def test_rows_and_lanes(spark):
    w = words(spark, [[("left", 100, 120), ("one", 150, 121), ("right", 1400, 122), ("two", 1450, 120)], [("left", 100, 220), ("three", 150, 220), ("right", 1400, 221), ("four", 1450, 220)]])
    lines = windows.synthetic_lines(windows.split_segments(windows.cluster_rows(w))).orderBy("row_no", "segment_no").collect()
    assert [r["text"] for r in lines] == ["left one", "right two", "left three", "right four"]


def test_snippets(spark):
    w = words(spark, [[("9.", 100, 120), ("left", 150, 120), ("question", 200, 120), ("11.", 1400, 120), ("right", 1450, 120), ("question", 1500, 120), ("2.27", 1600, 300)]])
    assert sorted(r["text"] for r in windows.anchor_snippets(w).collect()) == ["11. right question", "9. left question"]


def candidates(spark, rows):
    data = [(1, p, t, (x, y, x + 60, y + 40), 0.9) for p, t, x, y in rows]
    return spark.createDataFrame(data, f"doc_id long, page_no int, text string, bbox {BOX}, score double")


def test_anchors_in_reading_order(spark):
    c = candidates(spark, [(1, "2. b", 100, 500), (1, "1. a", 100, 100), (2, "0. zero", 100, 50), (2, "3. c", 100, 100), (2, "3. again", 100, 900)])
    d = windows.dedup_anchors(windows.numbered(c))
    kept = d.where("occurrence = 1").orderBy("position").collect()
    assert [(r["question_no"], r["page_no"]) for r in kept] == [(1, 1), (2, 1), (3, 2)]
    s = windows.anchor_summary(d).first()
    assert (s["missing"], s["uncertain"], s["sequence_ok"], s["confidence"]) == ([], [3], True, 0.89)


def test_reversed_page_has_no_missing(spark):
    s = windows.anchor_summary(windows.dedup_anchors(windows.numbered(candidates(spark, [(1, "5. a", 0, 0), (1, "2. b", 0, 90)])))).first()
    assert s["missing"] == []


def test_noise_footer(spark):
    rows = [("d", p, 1, f"다음 면에 계속 {p}/8", (100, y, 900, y + 30), 3505) for p, y in ((1, 3342), (2, 3399))] + [("d", 1, 2, "1. question", (100, 300, 900, 340), 3505)]
    lines = spark.createDataFrame(rows, f"doc_id string, page_no int, ord int, text string, bbox {BOX}, height int")
    profile = noise.noise_profile(noise.noise_patterns(noise.noise_buckets(lines)))
    assert profile.first()["footer_top"] == 3342
    flagged = {r["text"]: r["noise"] for r in noise.flag_noise(lines, profile).collect()}
    assert flagged == {"다음 면에 계속 1/8": True, "다음 면에 계속 2/8": True, "1. question": False}


def test_section_split(spark):
    rows = [("d", 1, ["1. question"], [], 0.05), ("d", 8, ["정답 및 풀이", "1. answer"], ["정답", "풀이"], 0.95)]
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, top_lines array<string>, keyword_hits array<string>, answer_style double")
    s = decisions.section_split(pages).first()
    assert (s["split_page"], s["question_pages"], s["answer_pages"], s["confidence"]) == (8, [1], [8], 0.97)


def test_notes(spark):
    texts = ["1. first", "more", "2. second", "9. other", "tail"]
    b = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "doc_id long, ord int, text string")
    e = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "doc_id long, question_no int")
    spans = {r["question_no"]: (r["start_ord"], r["end_ord"]) for r in notes.note_spans(b, e).collect()}
    assert spans == {1: (1, 2), 2: (3, 3)}
    s = notes.note_summary(b, e).first()
    assert (s["missing"], s["extra"], s["confidence"]) == ([3], [9], 0.76)
    n = {r["question_no"]: (r["exists"], r["raw_text"], r["missing_note"]) for r in notes.build_notes(b, e).collect()}
    assert n == {1: (True, "first\nmore", False), 2: (True, "second", False), 3: (False, "", True)}


def cells(spark, n_rows, n_cols, texts):
    data = [(1, "t", n_rows, n_cols, r, c, t) for (r, c), t in texts.items()]
    return tables.table_stats(spark.createDataFrame(data, "doc_id long, table_id string, n_rows int, n_cols int, row int, col int, text string"))


def test_table_acceptance(spark):
    kv = cells(spark, 3, 2, {(r, c): f"{'label' if c == 0 else 'v'}{r}" for r in range(3) for c in range(2)})
    assert kv.select(tables.key_value().alias("a"), tables.structured().alias("b")).first() == (True, True)
    grid = cells(spark, 2, 4, {(0, 0): "a", (0, 1): "b", (0, 2): "c", (0, 3): "d", (1, 0): "1", (1, 1): "2", (1, 2): "3", (1, 3): "4"})
    assert grid.select(tables.lookup_grid().alias("a")).first()["a"]
    sparse = cells(spark, 4, 2, {(0, 0): "x", (1, 0): "y", (2, 0): "z", (3, 0): ""})
    assert sparse.select(tables.structured().alias("a"), tables.reliable().alias("b")).first() == (False, False)


def test_block_types(spark):
    rows = [("다음 A -> B 는 반응이다",), ("",), ("x^2 = 25 + y",), ("ordinary words in a long enough line",)]
    b = spark.createDataFrame(rows, "text string").withColumn("around", F.lit(""))
    assert [r["final_type"] for r in blocks.type_blocks(b).collect()] == ["chem_equation", "unknown", "equation", "text"]


def test_findings(spark):
    items = spark.createDataFrame([(1, 1, 1, "equation", "ab"), (1, 1, 2, "chem_equation", "H2O"), (1, 1, 3, "drawing", ""), (1, 1, 4, "equation", "")], "doc_id long, question_no int, ord int, type string, target string")
    found = {r["message"] for r in validate.formula_findings(items).union(validate.schema_findings(items)).collect()}
    assert found == {"equation_missing_operator", "chem_equation_missing_arrow", "unsupported_item_type:drawing", "empty_formula_target"}
    q = spark.createDataFrame([(1, 1, 1, 1), (1, 1, 2, 0), (1, 3, 3, 1)], "doc_id long, question_no int, ord int, n_items int")
    assert {r["message"] for r in validate.numbering_findings(q).collect()} == {"duplicate_question_number", "missing_question_number"}
    assert {r["message"] for r in validate.consistency_findings(q).collect()} == {"duplicate_question_numbers", "empty_question_items:1"}


SECTION = "doc_id string, para_seq int, kind string, question_no int, text string, column_break boolean, page_break boolean"


def test_package_has_its_parts(spark):
    rows = spark.createDataFrame([("t", 1, "text", 1, "a < b", False, False), ("t", 2, "image", 1, None, False, False), ("t", 3, "note", 1, "1. why", False, True), ("<&\">", 1, "table", 7, "x\ty\nz", True, False)], SECTION)
    files = {r["doc_id"]: r for r in sinks.hwpx_packages(rows).collect()}
    import xml.etree.ElementTree as ET

    for r in files.values():
        archive = zipfile.ZipFile(io.BytesIO(r["content"]))
        names = archive.namelist()
        assert names == list(r["names"]) and names[0] == "mimetype" and not set(validate.REQUIRED_PARTS) - set(names)
        for name in names:
            if name.endswith((".xml", ".hpf", ".rdf")):
                ET.fromstring(archive.read(name))
    archive = zipfile.ZipFile(io.BytesIO(files["t"]["content"]))
    body = archive.read("Contents/section0.xml").decode()
    assert "BinData/image1.png" in archive.namelist()
    assert "a &lt; b" in body and "endNote" in body and 'pageBreak="1"' in body


def test_markup_of_odd_rows(spark):
    """Nulls, markup in texts, uneven tables, repeated rows and an empty table."""
    from quire.operators import markup

    rows = [("d", 1, "text", 1, 'a & "b" <c>', False, False), ("d", 2, "table", 1, "x\ty\n<z>", False, False), ("d", 3, "equation", 2, None, True, False), ("d", 4, "image", 2, "", False, False), ("d", 4, "image", 2, "", False, False), ("d", 5, "note", 2, "2. why", False, True), (None, 1, "text", None, "t", False, False)]
    df = spark.createDataFrame(rows, SECTION)
    made = {(r["doc_id"], r["para_seq"], r["picture_no"]): r for r in markup.paragraphs(df).collect()}
    assert "<hp:t>1. </hp:t><hp:t>a &amp; \"b\" &lt;c&gt;</hp:t>" in made["d", 1, None]["paragraph"]
    table = made["d", 2, None]["paragraph"]
    assert 'rowCnt="2" colCnt="2"' in table and 'colAddr="0" rowAddr="1"' in table and "&lt;z&gt;" in table and 'width="12615"' in table
    assert "endNote number=\"2\"" in made["d", 3, None]["lead"] and "<hp:script></hp:script>" in made["d", 3, None]["paragraph"]
    parts = {r["doc_id"]: r for r in markup.sections(markup.paragraphs(df)).collect()}
    assert list(parts["d"]["media"]) == ["image1", "image2"] and parts["d"]["section"].count("<hp:p ") == 1 + 6 + 3 + 1
    assert markup.manifests(markup.sections(markup.paragraphs(df.limit(0)))).count() == 0


def test_headers_of_given_packages(spark):
    """Good, absent, broken and bare headers: each parses, keeps what it had, and defines all that it and its section refer to."""
    import re
    import xml.etree.ElementTree as ET

    from quire.operators import markup, templates

    good = '<hh:head xmlns:hh="u"><hh:refList><hh:fontfaces itemCnt="1"><hh:fontface lang="LATIN" fontCnt="7"><hh:font face="Old" id="3"/><hh:font id="4" face="Other"/></hh:fontface><hh:fontface lang="HANJA" fontCnt="0"/></hh:fontfaces><hh:charProperties itemCnt="9"><hh:charPr id="7" height="900" borderFillIDRef="5"><hh:fontRef latin="3"/></hh:charPr></hh:charProperties><hh:styles itemCnt="0"/></hh:refList><hh:mine/></hh:head>'
    parts = spark.createDataFrame([("good", templates.HEADER, good), ("broken", templates.HEADER, good[:-20]), ("bare", templates.HEADER, "<hh:head/>"), ("good", "evil.exe", "x"), ("good", "version.xml", "<v/>"), ("good", "settings.xml", None), ("broken", "settings.xml", "<v>"), ("other", "version.xml", "<w/>")], "doc_id string, name string, content string")
    rows = spark.createDataFrame([(d, k, "table" if k == 2 else "text", 1, "t", False, False) for d in ("good", "broken", "bare", "none") for k in (1, 2)], SECTION)
    chosen = templates.template_parts(parts)
    assert {(r["doc_id"], r["name"]) for r in chosen.collect()} == {("good", templates.HEADER), ("broken", templates.HEADER), ("bare", templates.HEADER), ("good", "version.xml"), ("broken", "settings.xml"), ("other", "version.xml")}
    sections = markup.sections(markup.paragraphs(rows))
    headers = templates.resolve_headers(rows.select("doc_id"), chosen, sections)
    found = {r["doc_id"]: r for r in headers.collect()}
    assert {d: r["given"] for d, r in found.items()} == {"good": True, "broken": False, "bare": False, "none": False}
    assert templates.dangling(headers, sections).count() == 0
    assert found["none"]["header"] == found["broken"]["header"] == sinks.fixed_parts()[templates.HEADER].decode()
    h = found["good"]["header"]
    ET.fromstring(h)
    assert "<hh:mine/>" in h and f'<hh:font face="{templates.FACE}" id="0"/><hh:font id="4" face="Other"/>' in h and 'lang="LATIN" fontCnt="2"' in h and 'lang="HANJA" fontCnt="1"' in h
    for kind, tag in templates.KINDS.items():
        ids = re.findall(rf'<hh:{kind}\b[^>]*?\sid="(\d+)"', h)
        assert len(ids) == len(set(ids)) == int(re.search(rf'<hh:{tag}\b[^>]*?itemCnt="(\d+)"', h).group(1))
        assert set(re.findall(rf'{"[sS]tyle" if kind == "style" else kind}IDRef="(\d+)"', h)) <= set(ids)
    files = {r["doc_id"]: zipfile.ZipFile(io.BytesIO(r["content"])) for r in sinks.hwpx_packages(rows, templates=parts).collect()}
    assert files["good"].read(templates.HEADER).decode() == h and files["good"].read("version.xml") == b"<v/>" and files["none"].read("version.xml") != b"<v/>"
    assert files["broken"].read("settings.xml") == sinks.fixed_parts()["settings.xml"]


def plain_detect(page: np.ndarray, region: tuple[int, int, int, int], text_boxes: list, table_boxes: list) -> list[tuple[int, int, int, int]]:
    """Boxes of dark regions of a gray page that are large enough and no text or table, without overlaps."""
    x0, y0, x1, y1 = region
    mask = page[y0:y1, x0:x1] <= images.DARK
    if not mask.size:
        return []
    for b in [*text_boxes, *table_boxes]:
        if b[0] >= x0 - 8 and b[1] >= y0 - 8 and b[2] <= x1 + 8 and b[3] <= y1 + 8:
            mask[max(0, b[1] - y0 - images.PAD) : max(0, b[3] - y0 + images.PAD) + 1, max(0, b[0] - x0 - images.PAD) : max(0, b[2] - x0 + images.PAD) + 1] = False
    least = max(images.LEAST_AREA, int(max(1, (x1 - x0) * (y1 - y0)) * images.LEAST_SHARE))
    meets = lambda a, b: a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]
    kept: list = []
    for a, b, c, e in sorted(images.regions(images.close(mask))[0], key=lambda r: (r[1], r[0])):
        found = (x0 + a, y0 + b, x0 + c, y0 + e)
        if c - a < images.LEAST_SIDE or e - b < images.LEAST_SIDE or (c - a) * (e - b) < least:
            continue
        if not any(meets(found, t) for t in table_boxes) and not any(meets(found, k) for k in kept):
            kept.append(found)
    return kept


def drawn(rng, height, width):
    """A page with pictures, lines of text, specks, and shapes that wind from strip to strip."""
    page = np.full((height, width), 255, np.uint8)
    for _ in range(int(rng.integers(1, 9))):
        y, x, h, w = int(rng.integers(0, height)), int(rng.integers(0, width)), int(rng.integers(1, 400)), int(rng.integers(1, 300))
        page[y : y + h, x : x + w] = 30
    page[rng.random(page.shape) < 0.001] = 0
    for x in range(20, min(width - 20, 400), 40):  # teeth that only meet far below
        page[30 : height - 60, x : x + 15] = 0
    page[height - 70 : height - 60, 20 : min(width - 20, 395)] = 0
    return page


def test_image_detection(spark):
    page = np.full((700, 700), 255, np.uint8)
    page[100:300, 100:400] = 30
    page[400:420, 100:600] = 0
    assert plain_detect(page, (0, 0, 700, 700), [(100, 400, 600, 420)], []) == [(100, 100, 400, 300)]
    rng = np.random.default_rng(6)
    rows, want = [("d", 1, 700, 700, bytearray(page.tobytes()), [(100, 400, 600, 420)], None)], {("d", 1, 100, 100, 400, 300)}
    for k in range(6):
        p = drawn(rng, int(rng.integers(90, 1400)), int(rng.integers(90, 700)))
        h, w = p.shape
        texts, tables = [(5, 5, min(w, 90), 25), (-50, 0, w, 30)], [(0, 0, 40, 40)] if k % 2 else []
        rows.append(("e", k, w, h, bytearray(p.tobytes()), texts, tables))
        want |= {("e", k, *b) for b in plain_detect(p, (0, 0, w, h), texts, tables)}
    box = "array<struct<x0:int,y0:int,x1:int,y1:int>>"
    df = spark.createDataFrame([*rows, ("f", 1, 5, 5, None, None, None)], f"doc_id string, page_no int, width int, height int, pixels binary, texts {box}, tables {box}")
    assert {tuple(r) for r in images.detect_images(df).collect()} == want
    assert images.detect_images(df.limit(0)).count() == 0


def test_layout_tree(spark):
    box = (0.0, 0.0, 9.0, 9.0)
    rows = [(1, 1, None, 0, "doc", 0, None, ""), (1, 2, 1, 0, "paragraph", 1, box, "1. a"), (1, 3, 1, 1, "footer", 1, box, "foot"), (1, 4, 3, 0, "paragraph", 1, box, "in foot"), (1, 5, 1, 2, "paragraph", 1, box, "2.27Å")]
    nodes = spark.createDataFrame(rows, "doc_id long, node_id long, parent_id long, ord int, type string, page_no int, bbox_pdf struct<left:double,bottom:double,right:double,top:double>, content string")
    assert [r["content"] for r in layout.walk_tree(nodes).orderBy("path").collect()] == ["1. a", "2.27Å"]


def test_template_last_value_wins(spark):
    f = dict.fromkeys(("name", "label", "key", "inferFieldName", "inferText", "value", "text", "inferFieldValue"))
    kind = "array<struct<" + ",".join(f"{k}:string" for k in f) + ">>"
    entry = lambda **k: tuple((f | k).values())
    rows = spark.createDataFrame([(1, [entry(name="school", value="t")], [entry(label="school", inferText="f"), entry(name=" ", key="subject", text="s")])], f"doc_id long, title {kind}, fields {kind}")
    assert template.read_fields(rows).first()["template"] == {"school": "f", "subject": "s"}


def test_url_and_prompts(spark, tmp_path):
    urls = spark.createDataFrame([("http://a.ncloud.com/x",), ("http://b.org/ncloud.com",)], "u string").select(ocr.normalize_url(F.col("u")).alias("u")).collect()
    assert [r["u"] for r in urls] == ["https://a.ncloud.com/x", "http://b.org/ncloud.com"]
    (tmp_path / "p.md").write_text("intro\n## one\ntext\n## two\nmore\n", encoding="utf-8")
    assert config.load_prompts(str(tmp_path / "p.md")) == {"one": "text", "two": "more"}


def test_override_wins_field_by_field(spark):
    rules = spark.createDataFrame([(1, "text", 0.9), (2, "text", 0.8)], "id int, kind string, confidence double")
    given = spark.createDataFrame([(1, "image", None)], "id int, kind string, confidence double")
    assert [tuple(r) for r in decisions.apply_overrides(rules, given, ["id"], ["kind", "confidence"]).orderBy("id").collect()] == [(1, "image", 0.9), (2, "text", 0.8)]


def test_preview_pdf_is_well_formed():
    from quire.operators import preview

    questions = [[("text", "다음 자료를 보고 " * 40), ("image", "")] for _ in range(12)]
    data = preview.pdf(questions)
    assert data.startswith(b"%PDF") and data.rstrip().endswith(b"%%EOF") and data.count(b"/Type /Page ") > 2
    start = int(data.rsplit(b"startxref\n", 1)[1].split()[0])
    table = data[start:].split(b"trailer")[0].split(b"\n")[3:-1]
    for i, line in enumerate(table, start=1):
        assert data[int(line[:10]) :].startswith(f"{i} 0 obj".encode())
    assert preview.picture_size(5000, 100) == (511, 10) and preview.wrap("ab\ncd", 60) == ["ab", "cd"]
    assert preview.thumbnail(np.zeros((3505, 2480), np.uint8)).shape == (438, 310)


def test_layout_json(spark):
    from quire.sources import services

    text = '{"kids": [{"type": "header", "kids": [{"type": "p", "page number": 1, "bounding box": [0, 0, 1, 1], "content": "head"}]}, {"type": "p", "page number": 1, "bounding box": [0, 0, 1, 1], "content": " 1. a "}, 5]}'
    nodes = services.layout_nodes(spark.createDataFrame([(1, text)], "doc_id long, json string"))
    assert [r["content"] for r in layout.walk_tree(nodes).collect()] == ["1. a"]


def test_model_replies(spark):
    from quire.sources import services

    def send(prompt):
        if prompt == "bad":
            raise ValueError
        return '```json\n{"a": 1}\n```' if prompt == "fenced" else '{"a": 2}'

    rows = spark.createDataFrame([(1, "fenced"), (2, "plain"), (3, "bad")], "doc_id long, prompt string")
    got = {r["doc_id"]: r["answer"] and r["answer"]["a"] for r in services.complete_json(rows, send, "a int").collect()}
    assert got == {1: 1, 2: 2, 3: None}
