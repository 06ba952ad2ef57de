from pyspark.sql import functions as F

from loomwright.llm.toxicity import op2_toxicity


def test_recall_and_precision_on_documents_that_training_never_saw(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    rows = op2_toxicity(spark, sf_dir).where("held_out").join(labels, "doc_id").select("toxic", "predicted", (F.col("score") >= 0.7).cast("int").alias("by_score")).collect()
    hit = sum(r.toxic and r.predicted for r in rows)
    assert len(rows) > 1000 and all(r.predicted == r.by_score for r in rows)
    assert hit >= 0.9 * sum(r.toxic for r in rows) and hit >= 0.9 * sum(r.predicted for r in rows)
