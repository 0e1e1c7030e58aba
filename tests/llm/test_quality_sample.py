from pyspark.sql import functions as F

from seqloom.llm import quality_classifier
from tests.llm.helpers import frame, prose


def test_a_long_text_does_not_empty_its_class(spark):
    ids = spark.range(60).select("id", F.xxhash64(F.lit("sample"), "id").alias("u")).orderBy("u")
    first = {i % 2: i for i in reversed([r["id"] for r in ids.collect()])}  # the first of either class
    texts = [" ".join(prose(k, 60, 300) if k % 2 else [f"v{w}" for w in prose(k, 60, 300)]) for k in range(60)]
    texts[first[1]] = " ".join(prose(99, 9000, 300))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    docs = frame(spark, texts)
    model = quality_classifier.fit_quality(docs, labels, F.lit(True), sample_bytes=40_000)
    scores = {r["doc_id"]: r["score"] for r in quality_classifier.score_quality(docs, model).collect()}
    assert len(set(scores.values())) > 30
    assert sum((s > 0.5) == (i % 2 == 1) for i, s in scores.items()) >= 54
