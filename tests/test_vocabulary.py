"""Vocabularies filled from the most frequent terms are those of all counts; rare terms are not counted by text."""

import random

from pyspark.sql import functions as F

from tastemark.operators import vectors


def _docs(spark):
    rng = random.Random(8)
    rows = [(i, ["all", "most"] + [f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(12))]) for i in range(60)]
    rows += [(3, ["again", "w1"]), (None, ["w2", "w2"]), (None, ["w1"]), (99, [])]
    return spark.createDataFrame(rows, "doc long, words array<string>")


def _rows(df):
    return sorted(((r.doc if r.doc is not None else -1, r.term_id, r.term, r.tf, round(r.value, 9)) for r in df.collect()))


def test_same_vocabulary_as_from_all_counts(spark, monkeypatch):
    docs, words = _docs(spark), F.col("words")
    for more in (1000, 1):  # 1: the two words of every text fill the first places, so more terms are taken
        monkeypatch.setattr(vectors, "MORE_TERMS", more)
        for high in (1, 3):
            counts = vectors.term_counts(docs, words, ["doc"], 1, high)
            want = vectors.tfidf(counts, vectors.vocabulary(counts, "doc", docs.select("doc").distinct(), 0.5, 7), "doc")
            assert _rows(vectors.fit_tfidf(docs, words, "doc", 0.5, 7, 1, high)) == _rows(want)


def test_rare_terms_are_not_counted_by_text(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(vectors, "MORE_TERMS", 3)
    monkeypatch.setattr(vectors, "vocabulary", lambda counts, *a, _old=vectors.vocabulary: (seen.append(counts.select("term").distinct().count()), _old(counts, *a))[1])
    vectors.fit_tfidf(_docs(spark), F.col("words"), "doc", 1.0, 7)
    assert seen == [10]
