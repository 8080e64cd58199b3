"""Held-out quality of the classifiers on supplied tables; no row that is judged here was learned from."""

from pyspark.sql import functions as F

from gleanery.llm import registry


def test_languages_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    out = registry.QUERIES["op7_language"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    n, right = out.where("held_out and lang is not null").agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()
    assert n > 200 and right >= 0.98


def test_toxicity_of_held_out_documents(spark):
    """On 97 toxic held-out documents of 825; measured: recall 0.76, false positives 0.09."""
    folder = "/root/testdata/sf0.1"
    out = registry.QUERIES["op5_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    rates = {r.toxic: (r.n, r.rate) for r in out.where("held_out").groupBy("toxic").agg(F.count("*").alias("n"), F.avg("predicted").alias("rate")).collect()}
    assert rates[1][0] > 90 and rates[1][1] >= 0.65 and rates[0][1] <= 0.15
