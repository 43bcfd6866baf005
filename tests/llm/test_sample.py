"""The sample that the model is trained on."""

from pyspark.sql import functions as F

from rillstone.llm import spam as S


def test_large_pages_are_passed_over(spark, monkeypatch):
    ids = spark.range(60).withColumnRenamed("id", "doc_id")
    first = {r["doc_id"] for r in ids.orderBy(F.xxhash64("doc_id")).limit(3).collect()}
    df = ids.withColumn("text", F.when(F.col("doc_id").isin(first), F.repeat(F.lit("word "), 40_000)).otherwise(F.concat(F.lit("page "), "doc_id")))
    seen = []
    monkeypatch.setattr(S, "train", lambda texts: seen.extend(texts))
    S.fit(df, sample_bytes=100_000)
    assert sorted(seen) == sorted(f"page {i}" for i in range(60) if i not in first)
