"""Adapter views that turn general tables into page-structured ones: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import box
from ..operators.scan import scan

PAGE_WIDTH, PAGE_HEIGHT = 2480, 3505
#: Ids of a source that are numbered as one band, as a power of two.
ID_BAND = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Pages that are drawn in one task.
PAGES_A_TASK = 1000


def spread(rows: DataFrame, most: int = PAGES_A_TASK, keys: tuple[str, ...] = (), counted: DataFrame | None = None) -> DataFrame:
    """rows dealt out evenly, or by keys, at most about `most` a task: for small rows, of which a file holds many, that grow large later.

    They are counted in `counted`, if it is given.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-(rows if counted is None else counted).count() // most)), *keys)


def lines_of(texts: DataFrame) -> DataFrame:
    """doc_id, page_no, text -> a row per non-blank line; ordinals count blank lines, heights all of them."""
    split = texts.select("doc_id", "page_no", F.split("text", "\n", -1).alias("parts"))
    rows = split.select("doc_id", "page_no", (40 * (F.size("parts") + 1)).alias("height"), F.posexplode("parts").alias("pos", "text")).where(F.trim("text") != "")
    i = F.col("pos") + 1
    return rows.select("doc_id", "page_no", i.alias("ord"), F.concat(F.lit("p"), "page_no", F.lit("_l"), i).alias("line_id"), F.trim("text").alias("text"), box(F.lit(0), 40 * i, F.lit(1000), 40 * i + 24).alias("bbox"), F.lit(1.0).alias("confidence"), "height")


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's documents are the pages of one document, in id order.

    Ids are numbered apart from the texts, in bands of ids, so no task gets all of a source and no text is sorted; repeated
    rows of an id share a number.
    """
    docs = table(spark, sf_dir, "documents").select(F.struct("source", "doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("_id", "_id.source", "_id.doc_id").distinct()
    pages = scan(ids, ["source"], F.shiftright("doc_id", ID_BAND), ["doc_id"], {"page_no": ("sum", F.lit(1))})
    return docs.join(pages, "_id").select(F.col("source").alias("doc_id"), F.col("page_no").cast("int").alias("page_no"), "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(document_pages(spark, sf_dir))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return lines_of(t.select(F.col("conv_id").cast("string").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_no"), F.coalesce("text", F.lit("")).alias("text")))


def anchor_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered words on two-column pages: doc_id, page_no, text, bbox, score."""
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    both = items.join(parts, items.l_partkey == parts.p_partkey)
    x0, y0 = (100 + 1240 * (F.col("l_partkey") % 2)), (40 * F.col("l_quantity"))
    return both.select(
        F.col("l_orderkey").alias("doc_id"), (1 + F.col("l_suppkey") % 2).cast("int").alias("page_no"),
        F.concat("l_linenumber", F.lit(". "), "p_name").alias("text"), box(x0, y0, x0 + 60, y0 + 40).alias("bbox"), (1 - F.col("l_discount")).alias("score"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of lines; every seventh word starts a wider gap.

    Texts are dealt out by page before they are split, so windows over lines, rows and pages need no words dealt out again.
    """
    rows = lines_of(spread(document_pages(spark, sf_dir), PAGES_A_TASK, ("doc_id", "page_no"), table(spark, sf_dir, "documents"))).select("doc_id", "page_no", F.col("ord").alias("line_no"), "height", F.posexplode(F.split("text", " ", -1)).alias("word_no", "text"))
    before = F.sum(F.length("text") + 1).over(Window.partitionBy("doc_id", "page_no", "line_no").orderBy("word_no")) - F.length("text") - 1
    x0 = 20 * before + 80 * F.floor(F.col("word_no") / 7)
    placed = rows.withColumn("x0", x0.cast("int"))
    return placed.where(F.col("text") != "").select(
        "doc_id", "page_no", "line_no", "word_no", "text", box(F.col("x0"), 40 * F.col("line_no"), F.col("x0") + 20 * F.length("text"), 40 * F.col("line_no") + 24).alias("bbox"),
        (1 - F.length("text") % 10 / 20.0).alias("confidence"), "height",
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table per order: doc_id, table_id, n_rows, n_cols, row, col, text (last of a place wins)."""
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    both = items.join(parts, items.l_partkey == parts.p_partkey)
    rows = both.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("row"), (F.col("l_suppkey") % 3).cast("int").alias("col"), F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("p_name")).alias("text"), F.struct("l_partkey", "l_suppkey", "l_shipdate").alias("_o"))
    one = rows.groupBy("doc_id", "row", "col").agg(F.max_by("text", "_o").alias("text"))
    n_rows = F.max(F.col("row") + 1).over(Window.partitionBy("doc_id"))
    return one.select("doc_id", F.concat(F.lit("t"), "doc_id").alias("table_id"), n_rows.alias("n_rows"), F.lit(3).alias("n_cols"), "row", "col", "text")


def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block_id, block_type and text by part, in six patterns."""
    k = F.col("p_size").cast("string")
    text = (
        F.when(F.col("p_size") % 6 == 0, F.concat(k, F.lit(" H2 + O2 -> "), k, F.lit(" H2O"))).when(F.col("p_size") % 6 == 1, F.concat(F.lit("x**2 +  y^2 = "), k, F.lit("^2")))
        .when(F.col("p_size") % 6 == 2, F.lit("  ")).when(F.col("p_size") % 6 == 3, F.concat(F.lit("다음 자료 "), "p_name"))
        .when(F.col("p_size") % 6 == 4, F.concat(F.lit("[Fe(H2O)4Br2]* 6H,0(1) Na"), k, F.lit("+(aq)"))).otherwise(F.concat(F.lit("sqrt("), k, F.lit(") plain "), "p_name"))
    )
    kind = F.when(F.col("p_size") % 6 == 0, "chem_equation").otherwise("equation")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("b"), "p_partkey").alias("block_id"), "p_partkey", "p_size", kind.alias("block_type"), text.alias("text"))


def answer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, block_id, text: numbered headers and lines that follow them; some numbers are left out."""
    a = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).where("l_partkey % 4 <> 0")
    head = F.when(F.col("l_partkey") % 3 == 0, F.concat("l_linenumber", F.lit("."))).otherwise(F.concat("l_linenumber", F.lit(". "), "p_brand"))
    two = F.array(F.struct(F.lit(0).alias("k"), head.alias("text")), F.struct(F.lit(1).alias("k"), F.col("p_name").alias("text")))
    # Dealt out by document before each line becomes two.
    rows = a.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", two.alias("t")).repartition("doc_id").withColumn("t", F.explode("t"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "t.k"))
    return rows.select("doc_id", order.alias("ord"), F.concat(F.lit("a1_b"), order).alias("block_id"), F.col("t.text").alias("text"))


def expected_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, question_no: every line number of an order, and one more."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("question_no"))
    more = items.groupBy("doc_id").agg((F.max("question_no") + 1).alias("question_no"))
    return items.distinct().unionByName(more)


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    number = F.when(F.col("event_id") % 7 != 0, F.col("user_id") % 20)
    severity = F.when(F.col("event_type") == "purchase", "high").when(F.col("event_type") == "click", "medium").otherwise("low")
    k = F.get_json_object("props", "$.k")
    return e.select((F.col("event_id") % 50).alias("doc_id"), F.col("event_id").alias("ord"), number.alias("question_no"), severity.alias("severity"), F.col("event_type").alias("category"), F.concat(F.lit("message "), k).alias("message"), F.concat(F.lit("asset_"), k).alias("asset"))


def question_items(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """doc_id, question_no, ord, type, content, target: an item for each order line; `whole` documents are dealt out once, for windows over questions and over documents."""
    a = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("text", "equation", "chem_equation", "image", "table", "drawing")]), (F.col("p_size") % 6 + 1).cast("int"))
    target = F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 5 == 1, "2 H2 -> H4").when(F.col("p_size") % 5 == 2, "a = b").otherwise(F.col("p_brand"))
    number = (1 + F.col("l_linenumber") % 4 + F.when(F.col("l_linenumber") % 4 == 3, 1).otherwise(0)).cast("int")
    rows = a.select(F.col("l_orderkey").alias("doc_id"), number.alias("question_no"), kind.alias("type"), F.col("p_name").alias("content"), target.alias("target"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = rows.repartition("doc_id") if whole else rows
    order = F.row_number().over(Window.partitionBy("doc_id", "question_no").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return rows.select("doc_id", "question_no", order.alias("ord"), "type", "content", "target")
