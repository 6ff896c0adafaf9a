"""Joins that meet what was summed, not every row."""

from pyspark.sql import functions as F

from gleanery.llm import pii


def test_terms_are_summed_before_they_are_joined(spark):
    """A term in many documents is one row of the join; shares are still of all documents."""
    rows = [(i, f"call maria{i % 2}@x.example today w{i} reach") for i in range(8)] + [(100 + i, "reach today") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = docs.select(F.col("doc_id").alias("row_id"), "text").withColumn("base", pii.base_spans(F.col("text"))).where(F.size("base") > 0)
    found = pii.disclosing_terms(marked, docs, "text", -10.0, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and plan.index("Join Inner, (term") < plan.index("Generate explode")
    share = {x.term: x.disclosure for x in found.where("value = 'maria0@x.example'").collect()}
    assert set(share) == {"call", "today", "reach"}
    assert share["call"] > share["today"] == share["reach"]  # in 8 documents, and in all 38
