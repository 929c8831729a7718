"""Elements of a layout parser's tree in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged, work_dir


def walk_tree(nodes: DataFrame, keep=None) -> DataFrame:
    """doc_id, node_id, parent_id, ord, type, page_no, bbox_pdf, content -> elements in pre-order (path: the ordinals from the root).

    Elements have a page and a box and lie in no header or footer. Each node knows a stretch of the way up from itself
    and the node where it ends; joined with that node's own stretch it grows to twice its length, so a tree of any depth takes as many
    rounds as its depth has binary digits. Nodes that reach no root (a parent missing, or a ring) are left out; node_id is unique in its document. Only
    ids, ordinals and regions go through the rounds; `keep` stages them (by default in the shared folder).
    """
    keep = keep or staged(work_dir(nodes.sparkSession, "layout-tree"))
    region = F.when(F.col("type").isin("header", "footer"), F.col("type"))
    way = keep(nodes.select("doc_id", "node_id", F.col("parent_id").alias("up"), F.array("ord").alias("path"), region.alias("region")), "way-0")
    done, going, n, i = way.where("up is null"), way.where("up is not null"), way.count(), 0
    # After i rounds every node within 2**i levels of a root is done; what then goes on beyond the number of nodes is a ring.
    while 1 << i <= n and not going.isEmpty():
        above = done.unionByName(going).select("doc_id", F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("region").alias("_region"))
        longer = going.join(above, ["doc_id", "up"])  # the region nearest to the node counts
        i += 1
        way = keep(longer.select("doc_id", "node_id", F.col("_up").alias("up"), F.concat("_path", "path").alias("path"), F.coalesce("region", "_region").alias("region")), f"way-{i}")
        done, going = done.unionByName(way.where("up is null")), way.where("up is not null")
    rest = nodes.drop("region", "path")
    out = done.where("region is null").select("doc_id", "node_id", "path").join(rest, ["doc_id", "node_id"]).where("page_no > 0 and bbox_pdf is not null")
    return out.select("doc_id", "node_id", "page_no", F.col("type").alias("kind"), "bbox_pdf", F.trim("content").alias("content"), "path")


def drop_regions(elements: DataFrame) -> DataFrame:
    return elements.where(~F.col("kind").isin("header", "footer"))
