from quire.operators.blocks import type_blocks
from quire.streaming import per_document


def test_micro_batches_give_the_batch_result(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "A -> B"), (2, "plain words"), (3, "")], "doc_id long, text string").withColumn("around", F.lit(""))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    per_document(stream, type_blocks, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("doc_id", "final_type").collect()
    assert sorted(map(tuple, got)) == sorted((r["doc_id"], r["final_type"]) for r in type_blocks(rows).collect())
