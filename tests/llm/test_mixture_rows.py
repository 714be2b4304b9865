"""The rows of the pipeline's result follow the decision of its last stage."""

from pyspark.sql import functions as F

import corpus_pipeline
from tallybook.llm.mixing import repeat_documents

DATA = "/root/testdata/sf0.01"


def test_rows_follow_copies(spark):
    mixed = spark.createDataFrame([(1, 0), (2, 1), (3, 4)], "doc_id long, copies long")
    assert sorted(tuple(r) for r in repeat_documents(mixed).select("doc_id", "copy").collect()) == [(2, 1), (3, 1), (3, 2), (3, 3), (3, 4)]


def test_run_has_the_target_shares(spark):
    rows = corpus_pipeline.run(spark, DATA).cache()
    assert rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copies").alias("copies")).filter("n != copies").isEmpty()
    spent = dict(rows.groupBy("domain").agg(F.sum("tokens")).collect())
    print("shares", {d: round(n / sum(spent.values()), 3) for d, n in spent.items()}, rows.count(), rows.select("doc_id").distinct().count())
    once = dict(rows.filter("copy = 1").groupBy("domain").agg(F.sum("tokens")).collect())
    print("once", {d: round(n / sum(once.values()), 3) for d, n in once.items()})
    assert len(spent) == 4 and all(abs(n / sum(spent.values()) - 0.25) < 0.05 for n in spent.values())
