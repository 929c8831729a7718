"""PDF previews and thumbnails without libraries: text in a predefined Korean font, gray pictures."""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .sinks import by_document

WIDTH, HEIGHT, MARGIN, LINE, PICTURE, LEAST_ROOM = 595, 842, 42, 14, 180, 42
CHARS = 60  # of a line; wide characters count twice
THUMBNAIL = 480


def wrap(text: str, width: int = CHARS) -> list[str]:
    out, line, used = [], "", 0
    for c in text:
        size = 2 if ord(c) > 0x2E7F else 1
        if c == "\n" or used + size > width:
            out.append(line)
            line, used = "", 0
        if c != "\n":
            line, used = line + c, used + size
    return [*out, line]


def estimate_height(blocks: list[tuple[str, str]]) -> int:
    """24 points above and below, a picture's room or a line's height each."""
    return 48 + sum(PICTURE if kind == "image" else LINE * len(wrap(text)) for kind, text in blocks)


def picture_size(width: int, height: int) -> tuple[int, int]:
    scale = min((WIDTH - 2 * MARGIN) / max(1, width), PICTURE / max(1, height), 1)
    return int(width * scale), int(height * scale)


def pdf(questions: list[list[tuple[str, str]]], picture: np.ndarray | None = None) -> bytes:
    """A4 pages: the blocks (kind, text) of each question in turn; a question that does not fit starts a page."""
    picture = np.full((60, 90), 230, np.uint8) if picture is None else picture
    wide, high = picture_size(picture.shape[1], picture.shape[0])
    pages, now, y = [], [], HEIGHT - MARGIN

    def turn() -> None:
        nonlocal now, y
        pages.append("\n".join(now))
        now, y = [], HEIGHT - MARGIN

    for blocks in questions:
        if now and y - estimate_height(blocks) < MARGIN:
            turn()
        for kind, text in blocks:
            if kind == "image":
                if y - high < LEAST_ROOM:
                    turn()
                y -= high
                now.append(f"q {wide} 0 0 {high} {MARGIN} {y} cm /P Do Q")
                continue
            for line in wrap(text):
                if y - LINE < MARGIN:
                    turn()
                y -= LINE
                now.append(f"BT /F 10 Tf {MARGIN} {y} Td <{line.encode('utf-16-be').hex()}> Tj ET")
        y -= LINE
    turn()
    kids = " ".join(f"{7 + 2 * i} 0 R" for i in range(len(pages)))
    gray = zlib.compress(picture.tobytes())
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode(), b"<< /Type /Font /Subtype /Type0 /BaseFont /HYSMyeongJo-Medium /Encoding /UniKS-UCS2-H /DescendantFonts [4 0 R] >>",
        b"<< /Type /Font /Subtype /CIDFontType0 /BaseFont /HYSMyeongJo-Medium /CIDSystemInfo << /Registry (Adobe) /Ordering (Korea1) /Supplement 1 >> /FontDescriptor 5 0 R >>",
        b"<< /Type /FontDescriptor /FontName /HYSMyeongJo-Medium /Flags 6 /FontBBox [0 -148 1001 880] /ItalicAngle 0 /Ascent 752 /Descent -271 /CapHeight 737 /StemV 58 >>",
        f"<< /Type /XObject /Subtype /Image /Width {picture.shape[1]} /Height {picture.shape[0]} /ColorSpace /DeviceGray /BitsPerComponent 8 /Filter /FlateDecode /Length {len(gray)} >>\nstream\n".encode() + gray + b"\nendstream",
    ]
    for i, content in enumerate(pages):
        packed = zlib.compress(content.encode())
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {WIDTH} {HEIGHT}] /Resources << /Font << /F 3 0 R >> /XObject << /P 6 0 R >> >> /Contents {8 + 2 * i} 0 R >>".encode())
        objects.append(f"<< /Filter /FlateDecode /Length {len(packed)} >>\nstream\n".encode() + packed + b"\nendstream")
    out, places = io.BytesIO(), []
    out.write(b"%PDF-1.5\n")
    for i, body in enumerate(objects, start=1):
        places.append(out.tell())
        out.write(f"{i} 0 obj\n".encode() + body + b"\nendobj\n")
    start = out.tell()
    out.write(f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places))
    out.write(f"trailer << /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode())
    return out.getvalue()


def thumbnail(gray: np.ndarray, most: int = THUMBNAIL) -> np.ndarray:
    """A picture no larger than most x most: means of the pixels that fall together."""
    step = max(1, -(-max(gray.shape) // most))
    whole = np.pad(gray, [(0, max(0, step - s)) for s in gray.shape], mode="edge")  # a side narrower than a step becomes one
    high, wide = (s // step * step for s in whole.shape)
    # Whole lines are added first, in integers: exact, and along memory.
    lines = whole[:high, :wide].reshape(high // step, step, wide).sum(axis=1, dtype=np.int64)
    return (lines.reshape(high // step, wide // step, step).sum(axis=2) / step**2).round().astype(np.uint8)


def pdf_previews(rows: DataFrame) -> DataFrame:
    """Section rows -> doc_id, pages, content (the PDF)."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            files = []
            for group in batch["rows"]:
                questions: dict = {}
                for r in group:
                    questions.setdefault((r["kind"] == "note", r["question_no"]), []).append((r["kind"], r["text"] or ""))
                files.append(pdf(list(questions.values())))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "pages": [f.count(b"/Type /Page ") for f in files], "content": files})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return by_document(rows).mapInPandas(build, f"doc_id {kind}, pages int, content binary")
