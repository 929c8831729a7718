"""Reading order: rows, segments, columns, anchors and their page regions, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box, union_box
from ..functions.text import strip
from .scan import scan_groups
from .spatial import join_corners

ROW_GAP, SNIPPET_WIDTH, SNIPPET_GAP, SNIPPET_WORDS, SNIPPET_CHARS = 28, 900, 180, 10, 80
COLUMN_SPREAD, GUTTER = 0.2, 8


#: Heights and widths, as powers of two, of the bands that rows of a page and words of a row are scanned in.
PAGE_BAND, ROW_BAND = 13, 16


def cluster_rows(words: DataFrame) -> DataFrame:
    """words with row_no: in (y0, x0) order a new row begins where y0 moves by more than ROW_GAP from the word before.

    Within a band the word before is a lag; only the first word of a band has to know the last y0 of the bands above, and rows are
    counted on from there, so a page of any height is many tasks.
    """
    order = ["bbox.y0", "bbox.x0", "line_no", "word_no"]
    step = F.abs(F.col("bbox.y0") - F.col("_last")) > ROW_GAP
    steps = [
        (order, {}, {"_last": ("last", F.col("bbox.y0"))}, {}, {"_new": F.coalesce(step, F.lit(True)).cast("int")}),
        ([*order, -F.col("_new")], {"row_no": ("sum", F.col("_new"))}, {}, {}, {}),  # of rows alike the new one stays first
    ]
    rows = scan_groups(words, ["doc_id", "page_no"], F.shiftright("bbox.y0", PAGE_BAND), steps)
    return rows.withColumn("row_no", F.col("row_no").cast("int")).drop("_new", "_last")


def split_segments(rows: DataFrame) -> DataFrame:
    """Words of rows with segment_no: a new one where the gap to the word on the left reaches a threshold of the row."""
    key, order = ["doc_id", "page_no", "row_no"], ["bbox.x0", "bbox.y0", "line_no", "word_no"]
    tall = F.greatest(F.lit(1), F.col("bbox.y1") - F.col("bbox.y0")).cast("long")
    limit = F.greatest(F.lit(64), (F.col("_tall") / F.col("_many") * 1.6).cast("int"))
    fresh = F.coalesce(F.col("bbox.x0") - F.col("_left") >= limit, F.lit(True)).cast("int")
    steps = [
        (order, {}, {"_left": ("last", F.col("bbox.x1"))}, {"_tall": ("sum", tall), "_many": ("sum", F.lit(1).cast("long"))}, {"_new": fresh}),
        ([*order, -F.col("_new")], {"segment_no": ("sum", F.col("_new"))}, {}, {}, {}),
    ]
    out = scan_groups(rows, key, F.shiftright("bbox.x0", ROW_BAND), steps, rows.withColumn("row_no", F.lit(0)))  # a page has no fewer words than its rows
    return out.withColumn("segment_no", F.col("segment_no").cast("int")).drop("_new", "_left", "_tall", "_many")


def synthetic_lines(segments: DataFrame) -> DataFrame:
    """A line for each segment: its words from left to right, the box around them and their mean confidence."""
    item = F.struct(F.col("bbox.x0").alias("x"), F.col("bbox.y0").alias("y"), "line_no", "word_no", F.trim("text").alias("t"))
    lines = segments.groupBy("doc_id", "page_no", "row_no", "segment_no").agg(
        F.array_sort(F.collect_list(item)).alias("items"), union_box("bbox").alias("bbox"), F.avg("confidence").alias("confidence"), F.max("height").alias("height")
    )
    text = F.array_join(F.filter(F.transform("items", lambda i: i["t"]), lambda t: t != ""), " ")
    named = F.concat(F.lit("p"), "page_no", F.lit("_qb"), "row_no", F.lit("_"), "segment_no")
    return lines.withColumn("text", text).where("text <> ''").select("doc_id", "page_no", "row_no", "segment_no", named.alias("line_id"), "text", "bbox", "confidence", "height")


def anchor_snippets(words: DataFrame, pattern: str = r"^\d+\.($|\D)") -> DataFrame:
    """Words that match `pattern`, each with the text that follows on its row up to a gap or a length."""
    key = F.struct("line_no", "word_no")
    heads = words.where(strip(F.col("text")).rlike(pattern)).select("doc_id", "page_no", key.alias("anchor"), F.col("bbox").alias("head"), F.col("confidence").alias("head_confidence"))
    reach = box(F.col("head.x0"), F.col("head.y0") - ROW_GAP, F.col("head.x0") + SNIPPET_WIDTH, F.col("head.y0") + ROW_GAP)
    level = (F.abs(F.col("bbox.y0") - F.col("head.y0")) <= ROW_GAP) & (F.abs(F.col("bbox.y1") - F.col("head.y1")) <= ROW_GAP)
    near = join_corners(words, heads.withColumn("_reach", reach), "_reach", level & F.col("bbox.x0").between(F.col("head.x0"), F.col("head.x0") + SNIPPET_WIDTH)).drop("_reach")
    w = Window.partitionBy("doc_id", "page_no", "anchor").orderBy("bbox.x0", "line_no", "word_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    far = F.coalesce(F.col("bbox.x0") - F.lag("bbox.x1").over(w) > SNIPPET_GAP, F.lit(False))
    near = near.withColumns({"_far": far.cast("int"), "_n": F.row_number().over(w), "_len": F.sum(F.length(F.trim("text")) + 1).over(upto) - 1})
    near = near.withColumn("_full", ((F.col("_n") >= SNIPPET_WORDS) | (F.col("_len") >= SNIPPET_CHARS)).cast("int"))
    near = near.withColumns({"_cut": F.max("_far").over(upto), "_done": F.coalesce(F.max("_full").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    kept = near.where("_cut = 0 and _done = 0")
    text = kept.groupBy("doc_id", "page_no", "anchor", "head", "head_confidence").agg(F.array_sort(F.collect_list(F.struct("_n", F.trim("text").alias("t")))).alias("items"))
    return text.select("doc_id", "page_no", "anchor", F.col("head").alias("bbox"), F.array_join(F.filter(F.transform("items", lambda i: i["t"]), lambda t: t != ""), " ").alias("text"), F.col("head_confidence").alias("confidence"))


def numbered(candidates: DataFrame) -> DataFrame:
    """Candidates whose text begins with a positive number and a dot, with question_no."""
    number = F.expr(r"try_cast(regexp_extract(trim(text), '^([0-9]+)\\.', 1) as bigint)")
    return candidates.withColumn("question_no", number).where("question_no > 0")


_READING = ("page_no", "bbox.y0", "bbox.x0", "question_no", "text")


def dedup_anchors(anchors: DataFrame) -> DataFrame:
    """Anchors with occurrence (1 for the first of its number in reading order) and position (place among all; anchors alike in everything share one)."""
    first = Window.partitionBy("doc_id", "question_no").orderBy(*_READING)
    every = Window.partitionBy("doc_id").orderBy(*_READING)
    return anchors.withColumns({"occurrence": F.row_number().over(first), "position": F.rank().over(every)})


def anchor_summary(deduped: DataFrame) -> DataFrame:
    """doc_id, numbers, missing, uncertain, sequence_ok, confidence. Missing runs from the first to the last kept anchor."""
    kept = F.col("occurrence") == 1
    grouped = deduped.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(kept, F.struct("position", "question_no")))).alias("kept"), F.sort_array(F.collect_set(F.when(~kept, F.col("question_no")))).alias("uncertain")
    )
    numbers = F.transform("kept", lambda a: a["question_no"])
    first, last = F.element_at(numbers, 1), F.element_at(numbers, -1)
    span = F.when(first <= last, F.sequence(first, last)).otherwise(F.filter(numbers, lambda _: F.lit(False)))
    missing = F.sort_array(F.array_except(span, numbers))
    ok = F.size(missing) == 0
    return grouped.select("doc_id", numbers.alias("numbers"), missing.alias("missing"), "uncertain", ok.alias("sequence_ok"), F.when(ok, 0.89).otherwise(0.66).alias("confidence"))


def column_bounds(anchors: DataFrame, page_width: int | Column) -> DataFrame:
    """Anchors with column (0 left, 1 right) and its left and right edge on the page."""
    page_width = F.lit(page_width)
    page = Window.partitionBy("doc_id", "page_no")
    center = (F.col("bbox.x0") + F.col("bbox.x1")) / 2
    spread = F.max(center).over(page) - F.min(center).over(page)
    single = (F.count(F.lit(1)).over(page) < 2) | (spread < page_width * COLUMN_SPREAD)
    half = F.floor(page_width / 2).cast("int")
    right = center > half
    rows = anchors.withColumns({"single": single, "column": F.when(right, 1).otherwise(0)})
    left_edge = F.when(F.col("single"), 0).when(F.col("column") == 1, half + GUTTER).otherwise(0)
    right_edge = F.when(F.col("single"), page_width).when(F.col("column") == 1, page_width).otherwise(half - GUTTER)
    return rows.withColumns({"left_edge": left_edge, "right_edge": right_edge})


def next_in_column(bounded: DataFrame) -> DataFrame:
    """Anchors with next_y0: the least y0 strictly below in the same column of the page."""
    w = Window.partitionBy("doc_id", "page_no", F.when(F.col("single"), -1).otherwise(F.col("column"))).orderBy(F.col("bbox.y0").cast("long")).rangeBetween(1, Window.unboundedFollowing)
    return bounded.withColumn("next_y0", F.min("bbox.y0").over(w))


def page_ranges(with_next: DataFrame, page_height: int | Column, profile: DataFrame | None = None) -> DataFrame:
    """Each anchor's region of its page, down to the next anchor in its column or the page's end, clear of the footer."""
    top = F.col("bbox.y0")
    bottom = F.when(F.col("next_y0").isNull(), page_height).otherwise(F.greatest(F.col("bbox.y0") + 10, F.col("next_y0") - 4))
    rows = with_next
    if profile is not None:
        rows = rows.join(profile.select("doc_id", "footer_top"), "doc_id", "left")
        free = F.greatest(F.col("bbox.y1") + 8, F.col("footer_top") - 12)
        bottom = F.when(bottom > F.col("footer_top"), free).otherwise(bottom)
    return rows.withColumn("range", box(F.col("left_edge"), top, F.col("right_edge"), bottom))


def surrounding_text(blocks: DataFrame, order: Column | str = "ord") -> DataFrame:
    """Blocks with around: the text before and after in the same question, blanks left out."""
    w = Window.partitionBy("doc_id", "question_no").orderBy(order)
    side = lambda f: F.nullif(F.trim(f("text").over(w)), F.lit(""))
    return blocks.withColumn("around", F.concat_ws(" ", side(F.lag), side(F.lead)))


def layout_slots(questions: DataFrame, first_page: int = 1) -> DataFrame:
    """Two questions a page: start_page and start_column in question order."""
    i = F.row_number().over(Window.partitionBy("doc_id").orderBy("question_no")) - 1
    return questions.withColumn("_i", i).select("*", (first_page + F.floor(F.col("_i") / 2)).cast("int").alias("start_page"), F.when(F.col("_i") % 2 == 0, "left").otherwise("right").alias("start_column")).drop("_i")


def box_clusters(boxes: DataFrame, key: list[str]) -> DataFrame:
    """The key, bbox and cluster of boxes: in y0 order a new one begins where no box before reaches further down, so boxes of two clusters never meet."""
    order = ["bbox.y0", "bbox.x0", "bbox.x1", "bbox.y1"]
    new = F.coalesce(F.col("bbox.y0") >= F.col("_reach"), F.lit(True)).cast("long")
    steps = [(order, {}, {"_reach": ("max", F.col("bbox.y1"))}, {}, {"_new": new}), ([*order, -F.col("_new")], {"cluster": ("sum", F.col("_new"))}, {}, {}, {})]
    return scan_groups(boxes.select(*key, "bbox"), key, F.shiftright("bbox.y0", PAGE_BAND), steps).drop("_new", "_reach")


def _swept(names: list[str]):
    """Rows sorted by key, cluster and (y0, x0, x1, y1) -> the boxes that greedy suppression keeps.

    Kept boxes that the sweep line crosses lie side by side, so they stand in a list ordered by x: a new box is held against its
    two neighbours there, and boxes that ended above leave by a heap.
    """
    import heapq
    from bisect import bisect_left

    import pyarrow as pa

    def run(batches):
        key, xs, active, ends = None, [], {}, []
        for batch in batches:
            keep = []
            columns = [batch.column(c).to_pylist() for c in names]
            x0s, y0s, x1s, y1s = (batch.column(c).to_pylist() for c in ("_x0", "_y0", "_x1", "_y1"))
            for i, now in enumerate(zip(*columns, strict=True)):
                x0, y0, x1, y1 = x0s[i], y0s[i], x1s[i], y1s[i]
                if now != key:
                    key, xs, active, ends = now, [], {}, []
                while ends and ends[0][0] <= y0:
                    gone = heapq.heappop(ends)[1]
                    xs.pop(bisect_left(xs, gone))
                    del active[gone]
                if None in (x0, y0, x1, y1) or x0 >= x1 or y0 >= y1:  # meets nothing
                    keep.append(i)
                    continue
                at = bisect_left(xs, x1)  # the last that begins before x1 is the only one that can end after x0
                if at and active[xs[at - 1]] > x0:
                    continue
                keep.append(i)
                xs.insert(at, x0)
                active[x0] = x1
                heapq.heappush(ends, (y1, x0))
            yield batch.take(pa.array(keep, pa.int64())).select([*names, "_x0", "_y0", "_x1", "_y1"])

    return run


def greedy_boxes(boxes: DataFrame, key: list[str]) -> DataFrame:
    """Of each key's boxes in (y0, x0, x1, y1) order those that overlap none kept before.

    Clusters apart in y are swept apart; a sweep holds only the kept boxes that it crosses, so a page of any size is
    linear but for a logarithm. Boxes without area overlap nothing and are all kept. Null boxes likewise.
    """
    names = [f"_k{i}" for i in range(len(key))]
    sides = {f"_{s}": F.col("bbox")[s] for s in ("x0", "y0", "x1", "y1")}
    rows = box_clusters(boxes, key).select(*[F.col(k).alias(n) for k, n in zip(key, names, strict=True)], "cluster", *[c.alias(n) for n, c in sides.items()])
    group = [*names, "cluster"]
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in [*group, *sides])
    kept = rows.repartition(*group).sortWithinPartitions(*group, "_y0", "_x0", "_x1", "_y1").mapInArrow(_swept(group), kinds)
    return kept.select(*[F.col(n).alias(k) for k, n in zip(key, names, strict=True)], box(*[F.col(n) for n in sides]).alias("bbox"))
