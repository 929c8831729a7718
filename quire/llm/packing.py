"""Mixture-controlled packing of token sequences by deficit round-robin over source queues.

One pass encodes every document and stages its ids with the place in its source's queue; a small
table of counts per partition and source gives each queue's start in each partition; a second pass
over the staged ids asks the closed-form schedule (mixture.py) where each run of tokens goes and
cuts it there. Token ids stay where they are while the planner finds that table small enough to broadcast;
beyond that each partition's rows move once, by partition and queue.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, materialise, null_safe, partition_id, slices, text_of
from .mixture import LEAST_TOKENS, Schedule, sequence_of
from .tokens import END_ID, default_path, encoder

WIDTH = 4096


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, queue, part, local_start, n_tokens, ids (little-endian unsigned 32-bit, end id included).

    Null text is empty, so it has the end id alone. local_start counts the tokens before the row in
    its partition and queue.
    """
    path = tokenizer_path or default_path()
    queue = null_safe(docs[source_col]) if source_col else F.lit("0")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), queue.alias("queue"), text_of(docs, text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(path).encode, partition_id(), defaultdict(int)
        for batch in slices(batches, "text"):
            ids = [x.astype("<u4").tobytes() for x in encode(batch.column("text").to_pylist(), end_id)]
            n = [len(x) // 4 for x in ids]
            starts = []
            for q, k in zip(batch.column("queue").to_pylist(), n, strict=True):
                starts.append(at[q])
                at[q] += k
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("queue"), pa.array([part] * len(n), pa.int32()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "queue", "part", "local_start", "n_tokens", "ids"],
            )

    return rows.mapInArrow(frugal(run), "doc_id long, queue string, part int, local_start long, n_tokens long, ids binary")


def queue_starts(encoded: DataFrame, lanes: DataFrame) -> DataFrame:
    """(part, queue, lane, lane_start): tokens of the lane before this queue's first token in this partition.

    Sums over partitions run on one row for each partition and lane; queues that share the pool are
    ordered inside their partition apart from that.
    """
    sums = encoded.groupBy("part", "queue").agg(F.sum("n_tokens").alias("n")).join(lanes, "queue", "left")
    sums = sums.withColumn("lane", F.coalesce("lane", F.lit(-1)))
    by_part = sums.groupBy("lane", "part").agg(F.sum("n").alias("part_n"))
    before = by_part.select("lane", "part", (F.sum("part_n").over(Window.partitionBy("lane").orderBy("part")) - F.col("part_n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part", "lane").orderBy("queue")) - F.col("n")
    return sums.withColumn("inside", inside).join(before, ["lane", "part"]).select("part", "queue", "lane", (F.col("before") + F.col("inside")).alias("lane_start"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", width: int = WIDTH, weights: dict[str | None, float] | None = None, tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset, source_lane.

    Every token lies in exactly one piece. Each full window holds the sources in proportion to
    `weights` (by default to their tokens, so that all last to the end), to within a token, rounding
    carried from window to window. A source with a weight has a lane of its own until its queue runs dry, from where the
    others share by their weights; sources without one follow at the end. Without weights, sources with less than
    LEAST_TOKENS of a window share one lane as a queue. The rest of the tape after the last full window is cut into powers of two.
    Null text is empty; a null source is a source; rows alike are packed as often as they occur;
    an empty table gives no rows.
    """
    encoded = materialise(encode_documents(docs, id_col, text_col, source_col, tokenizer_path, end_id), "encoded")
    totals = encoded.groupBy("queue").agg(F.sum("n_tokens").alias("n"))
    total = totals.agg(F.sum("n")).first()[0] or 0
    weight_of = {("0" if k is None else f"1{k}"): Fraction(v) for k, v in (weights or {}).items()}
    # A source with a weight has a lane of its own, however small it is. Of the others at most width / LEAST_TOKENS can hold
    # such a share, so what the driver collects is bounded by that and the weights given.
    own = F.col("n") * width >= F.lit(LEAST_TOKENS * total)
    weighted = sorted(q for q, w in weight_of.items() if w > 0)
    large = {r[0]: r[1] for r in totals.where(own | F.col("queue").isin(weighted) if weighted else own).collect()}
    names = sorted(large)
    lanes = docs.sparkSession.createDataFrame([(q, i) for i, q in enumerate(names)], "queue string, lane int")
    pooled = total - sum(large.values())
    sizes = [*(large[q] for q in names), pooled]
    if weights is None:
        schedule = Schedule.make(sizes, None, width)
    else:
        schedule = Schedule.make(sizes, [*(weight_of.get(q, Fraction(0)) for q in names), Fraction(0)], width)
    # Written first, so that the planner knows its size and leaves the ids where they are while it is small.
    starts = materialise(queue_starts(encoded, lanes), "queue-starts")
    placed = encoded.join(starts, ["part", "queue"]).select("doc_id", "n_tokens", "ids", "lane", (F.col("lane_start") + F.col("local_start")).alias("position"))
    pool_lane = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            out: list[list] = [[] for _ in range(8)]
            for doc, n, ids, lane, position in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids", "lane", "position")), strict=True):
                lane = pool_lane if lane < 0 else lane
                for at, length, tape in schedule.pieces(lane, position, n):
                    start = at - position
                    while length:
                        sequence, offset, room = sequence_of(tape, total, width)
                        k = min(length, room)
                        for column, value in zip(out, (doc, start, k, ids[4 * start : 4 * (start + k)], n, sequence, offset, lane), strict=True):
                            column.append(value)
                        start, tape, length = start + k, tape + k, length - k
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "source_lane")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=list(names))

    return placed.mapInArrow(frugal(run), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, source_lane int")


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences from pieces: sequence_id, n_tokens, ids, and the pieces' documents in order."""
    item = F.struct("offset", "ids", "doc_id", "length")
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(item)).alias("items"))  # at most `width` pieces
    ids = F.aggregate("items", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"), ids.alias("ids"), F.transform("items", lambda x: x["doc_id"]).alias("doc_ids"))
