"""External services behind send functions, and the replies they give."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "struct<node_id:bigint,parent_id:bigint,ord:int,type:string,page_no:int,bbox_pdf:struct<left:double,bottom:double,right:double,top:double>,content:string>"
CHILDREN = ("kids", "list items", "rows", "cells")  # fixed values


def flatten_layout(text: str) -> list[dict]:
    """Nodes of a layout parser's JSON, numbered in pre-order; anything malformed is passed over."""
    import json

    out: list[dict] = []
    todo = [(node, None, i) for i, node in reversed(list(enumerate(json.loads(text).get("kids", []))))]
    while todo:
        node, parent, place = todo.pop()
        if not isinstance(node, dict):
            continue
        box = node.get("bounding box")
        good = isinstance(box, list) and len(box) == 4
        own = len(out)
        out.append({
            "node_id": own, "parent_id": parent, "ord": place, "type": str(node.get("type", "")), "page_no": int(node.get("page number") or 0),
            "bbox_pdf": dict(zip(("left", "bottom", "right", "top"), map(float, box), strict=True)) if good else None, "content": str(node.get("content") or "").strip(),
        })
        below = [c for key in CHILDREN if isinstance(node.get(key), list) for c in node[key]]
        todo += [(c, own, i) for i, c in reversed(list(enumerate(below)))]
    return out


def layout_nodes(documents: DataFrame) -> DataFrame:
    """doc_id, json -> the node table that layout.walk_tree() reads."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "nodes": [flatten_layout(t) for t in batch["json"]]})

    return documents.mapInPandas(run, f"doc_id {kind}, nodes array<{NODE}>").select("doc_id", F.explode("nodes").alias("n")).select("doc_id", "n.*")


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """Layout JSON files, a document each, as nodes keyed by file."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("json"))
    return layout_nodes(files)


def without_fences(reply: Column) -> Column:
    """A model's reply without a code fence around it."""
    return F.trim(F.regexp_replace(reply, r"(?s)^\s*```[A-Za-z]*\s*(.*?)\s*```\s*$", "$1"))


def complete_json(requests: DataFrame, send: Callable[[str], str], schema: str, strict: bool = False) -> DataFrame:
    """requests (doc_id, prompt) with answer, the parsed reply of `send`; what fails is null, or fails the job if strict."""
    kind = requests.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies = []
            for prompt in batch["prompt"]:
                try:
                    replies.append(send(prompt))
                except Exception:
                    if strict:
                        raise
                    replies.append(None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "reply": replies})

    return requests.mapInPandas(run, f"doc_id {kind}, reply string").select("doc_id", F.from_json(without_fences(F.col("reply")), schema).alias("answer"))


def template_page(pages: DataFrame, enabled: bool, fields: DataFrame | None = None) -> DataFrame:
    """doc_id, applied and the template's fields of the first page; nothing is applied while the service is off."""
    if not enabled or fields is None:
        return pages.select("doc_id", F.lit(False).alias("applied"))
    return pages.join(fields, "doc_id", "left").select("doc_id", F.col("template").isNotNull().alias("applied"), "template")


def render_pages(spark: SparkSession, path: str, dpi: int = 300) -> DataFrame:
    """PDF files as page rasters, where a PDF library is installed; here none is, and the call says so."""
    try:
        import fitz  # noqa: F401
    except ImportError as e:
        raise NotImplementedError("rendering PDF pages needs PyMuPDF on the executors") from e

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                for i, page in enumerate(fitz.open(stream=content, filetype="pdf"), start=1):
                    image = page.get_pixmap(dpi=dpi, colorspace=fitz.csGRAY)
                    rows.append((name, i, image.width, image.height, bytes(image.samples), page.get_text()))
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "width", "height", "pixels", "text"])

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInPandas(run, "doc_id string, page_no int, width int, height int, pixels binary, text string")
