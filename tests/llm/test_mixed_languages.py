"""Texts in several languages in the pipeline."""

from pyspark.sql import functions as F

import corpus_pipeline
from tastemark.llm import language


def test_texts_in_several_languages_stay_in_the_pipeline(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = docs.filter("lang is not null and n_chars between 1000 and 4000").groupBy("lang").agg(F.max_by("text", "n_chars").alias("t")).orderBy("lang").collect()
    words = [r["t"].split()[:60] for r in known][:3]
    mixed = [words[0] + words[1], [w for k in range(0, 60, 12) for ws in words[:2] for w in ws[k : k + 12]], sum(words, [])]
    rows = [(-1 - i, " ".join(ws), None, "test", 0) for i, ws in enumerate(mixed)] + [(-9, "... 123 --", None, "test", 0)]
    more = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    model = language.train(more)
    told = {r["doc_id"]: r["r"] for r in more.filter("doc_id < 0").select("doc_id", language.identify(model, "text").alias("r")).collect()}
    assert told[-3]["score"] < 0.5
    stay = {r["doc_id"] for r in corpus_pipeline.language_id(spark, more, sf).filter("doc_id < 0").collect()}
    assert stay == {-1, -2, -3}
