"""Prefix trie of conversations by partition refinement.

All conversations start as one class. Each round takes the active classes some turns further: at every turn a
class splits by what is said, and a class is named by a chained hash of all turns so far, so members know their class without
being told. A class left with one conversation retires: the rest of that conversation is a
unary chain, which is written down without grouping anything. Rounds double in length, so conversations
that agree for long take few of them.

Then the classes fold back. Each node hands what it adds (a leaf, tokens saved, a child) to its least
member, and running sums along that conversation from its end carry it up to every node above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import scan
from .common import BLANK, discard, frugal, join_counted, materialise, new_path

#: Turns of a conversation that one task walks at a time, as a power of two.
BAND_BITS = 12
FIRST_ROUND = 4
NODE = ["depth", "a", "b"]


def count_words(text: Column) -> Column:
    """Runs of `[^\\x20\\x09-\\x0D]`, without making them."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(marks, BLANK, "")).cast("long")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest of role and text, words. Rows without a conv_id belong to no conversation.

    Turns are ordered by turn, null first; of one turn by role, then by digest.
    """
    c = conversations
    role, text = (F.coalesce(c[x].cast("string"), F.lit("")) for x in ("role", "text"))
    rows = c.where(c["conv_id"].isNotNull()).select(
        c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), role.alias("role"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"), count_words(text).alias("words")
    )
    rows = materialise(rows, "turns")
    band = F.shiftright(F.coalesce("turn", F.lit(-(1 << 63))), BAND_BITS)
    out = materialise(scan(rows, ["conv_id"], band, ["turn", "role", "digest"], {"pos": ("sum", F.lit(1).cast("long"))}).select("conv_id", "pos", "digest", "words"), "numbered-turns")
    discard(rows)
    return out


def rebuilt(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, words) and (conv_id, n_turns): each conversation with the head of its group's first.

    The first h turns of conversation c - c % group (all if fewer, none if absent), then its own after its first h; h = crc32(c) % most.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    bases = sizes.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = sizes.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % group}).join(bases, "base", "left")
    convs = convs.withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0)).cast("long")))
    convs = materialise(convs.select("conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")), "conversations")
    # A conversation is the base of fewer than twice `group`, and gives fewer than `most` turns to each.
    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < most)).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "digest", "words")
    first = convs.where("head > 0").join(heads, "base").where(F.col("depth") <= F.col("head")).select("conv_id", "depth", "digest", "words")
    gaps = convs.where("head < h").select("conv_id", (F.col("h") - F.col("head")).alias("gap"))
    own = turns.where(F.col("pos") > h).join(gaps, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("gap", F.lit(0))).alias("depth"), "digest", "words")
    return first.unionByName(own), convs.select("conv_id", "n_turns")


def named_classes(turns: DataFrame) -> DataFrame:
    """turns with n_turns and the names (a, b) of the class at each depth and (pa, pb) of the one above: hashes of all turns so far."""
    item = lambda seed: F.xxhash64("depth", "digest", F.lit(seed))
    band = F.shiftright("depth", BAND_BITS)
    out = scan(turns, ["conv_id"], band, ["depth"], {"a": ("xor", item(1)), "b": ("xor", item(2))}, whole={"n_turns": ("sum", F.lit(1).cast("long"))})
    return out.select("conv_id", "depth", "words", "n_turns", "a", "b", F.col("a").bitwiseXOR(item(1)).alias("pa"), F.col("b").bitwiseXOR(item(2)).alias("pb"))


def refine(named: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, retired): rows of conversations at depths where their class has others, the root included; and where each lone conversation left.

    retired: conv_id, start (the depth of its first lone turn), n_turns, pa, pb (the class above).
    """
    spark = named.sparkSession
    members, lone = new_path(spark, "trie-members"), new_path(spark, "trie-retired")
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("words"), "n_turns", zero.alias("a"), zero.alias("b"), zero.alias("pa"), zero.alias("pb"))
    materialise(root, "trie-root", f"{members}/round=0")
    lo, length, active, i = 1, FIRST_ROUND, None, 1
    while True:
        rows = named.where(F.col("depth").between(lo, lo + length - 1))
        if active is not None:
            rows = rows.join(active, "conv_id", "left_semi")
        alone = rows.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.min("n_turns").alias("n_turns"), F.min("pa").alias("pa"), F.min("pb").alias("pb")).where("n = 1")
        left = alone.groupBy("conv_id").agg(F.min(F.struct(F.col("depth").alias("start"), "n_turns", "pa", "pb")).alias("s")).select("conv_id", "s.*")
        gone = materialise(left, "trie-retired", f"{lone}/round={i}")
        stay = rows.join(gone.select("conv_id", "start"), "conv_id", "left").where("start is null or depth < start").drop("start")
        kept = materialise(stay.select(*root.columns), "trie-members", f"{members}/round={i}")
        active = kept.where((F.col("depth") == lo + length - 1) & (F.col("n_turns") > F.col("depth"))).select("conv_id")
        if active.isEmpty():
            break
        lo, length, i = lo + length, length * 2, i + 1
    read = lambda like, path: spark.read.schema(like.schema).parquet(*[f"{path}/round={r}" for r in range(0 if path == members else 1, i + 1)])
    return read(root, members), read(gone, lone)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and id -> comma-joined ids of a bounded length, with the first of them."""
    node, first, ids, size = None, None, [], 0
    done: list[tuple] = []
    schema = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    for batch in batches:
        for *key, c in zip(*(batch.column(x).to_pylist() for x in (*NODE, "conv_id")), strict=True):
            if key != node or size > 1 << 16:
                if ids:
                    done.append((*node, first, ",".join(ids)))
                node, first, ids, size = key, c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if len(done) >= 64:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d, strict=True)) for d in done], schema)
            done = []
    if ids:
        done.append((*node, first, ",".join(ids)))
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d, strict=True)) for d in done], schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by node and first id -> SHA-256 of the joined ids, a chunk in memory at a time."""
    node, state = None, None
    schema = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("sha", pa.string())])
    out: list[dict] = []
    close = lambda: out.append(dict(zip(schema.names, (*node, state.hexdigest()), strict=True)))
    for batch in batches:
        for *key, ids in zip(*(batch.column(x).to_pylist() for x in (*NODE, "ids")), strict=True):
            if key != node:
                if node is not None:
                    close()
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(out) > 4096:
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
    if node is not None:
        close()
    yield pa.RecordBatch.from_pylist(out, schema)


def ends_of(members: DataFrame) -> DataFrame:
    """(depth, a, b, sha) of nodes at which conversations end: SHA-256 of their ids, ascending.

    Ids are sorted by ranges of (node, id), so a node where a third of all end is joined in many tasks;
    one task then hashes its chunks one after the other, as the hash demands.
    """
    ended = members.where("n_turns = depth").select(*NODE, "conv_id")
    chunks = ended.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(frugal(_chunks), "depth long, a long, b long, first long, ids string")
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(frugal(_hashed), "depth long, a long, b long, sha string")


def trie(conversations: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """A row per distinct sequence of first turns, the textless root included: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Columns conv_id, turn, role, text are read, others not. Rows without conv_id are left out; a null turn comes first,
    null role or text is empty; turns that tie are ordered by role and content; repeated rows are turns of their own; a text of any
    length is read once, as a digest and a word count. An empty table gives no rows.
    """
    numbered = numbered_turns(conversations)
    turns, convs = rebuilt(numbered, group, most)
    named = materialise(named_classes(turns), "trie-turns")
    discard(numbered)
    members, retired = refine(named, convs)
    discard(named)
    nodes = members.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"), F.max("n_turns").alias("deepest"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    nodes = materialise(nodes, "trie-nodes")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    gives = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saves"), (F.col("deepest") == F.col("depth")).cast("long").alias("leaves"), zero.alias("children"))
    gives = gives.unionByName(nodes.where("depth > 0").select("conv_id", (F.col("depth") - 1).alias("depth"), zero.alias("saves"), zero.alias("leaves"), one.alias("children")))
    gives = gives.unionByName(retired.select("conv_id", (F.col("start") - 1).alias("depth"), zero.alias("saves"), one.alias("leaves"), one.alias("children")))
    gives = gives.groupBy("conv_id", "depth").agg(*[F.sum(c).alias(c) for c in ("saves", "leaves", "children")])
    given = members.select("conv_id", *NODE).join(gives, ["conv_id", "depth"], "left")
    back = scan(given, ["conv_id"], -F.shiftright("depth", BAND_BITS), [F.col("depth").desc()], {"saved": ("sum", F.col("saves")), "below": ("sum", F.col("leaves"))})
    folded = back.groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"), F.sum("below").alias("n_leaves"), F.sum("children").alias("n_children"))
    shared = nodes.join(folded, NODE).join(ends_of(members), NODE, "left")
    above = nodes.select(F.struct("depth", "a", "b").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_convs")
    up = F.struct((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).alias("parent")
    nothing = hashlib.sha256(b"").hexdigest()
    some = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    facts = shared.select("conv_id", "depth", F.col("n_convs").alias("members"), *some, F.coalesce("sha", F.lit(nothing)).alias("ends_sha256"), up)
    inner = facts.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).unionByName(join_counted(facts.where("depth > 0"), above, "parent", "n_convs"), allowMissingColumns=True)
    inner = inner.withColumnRenamed("members", "n_convs").select(*columns)
    chains = join_counted(retired.withColumn("depth", F.col("start")).select("conv_id", "start", "n_turns", up), above, "parent", "n_convs")
    step = 1 << BAND_BITS
    chains = chains.withColumn("_from", F.explode(F.sequence("start", "n_turns", F.lit(step).cast("long")))).withColumn("depth", F.explode(F.sequence("_from", F.least(F.col("_from") + step - 1, "n_turns"))))
    last = F.col("depth") == F.col("n_turns")
    tails = chains.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("start"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"), (~last).cast("long").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(nothing)).alias("ends_sha256"),
    )
    return inner.unionByName(tails)
