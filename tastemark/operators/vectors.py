"""Term counts, vocabularies, TF-IDF and keyword rankings in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemark.functions.textual import ngram_range
from tastemark.operators.ranking import group_rank, top_per_group, top_rows
from tastemark.operators.similarity import normalise
from tastemark.session import cut

PART_REVIEWS = 1000
#: Terms looked at beyond those wanted, as some of the most frequent are in too many texts; more are taken if these do not do.
MORE_TERMS = 1000


def term_counts(docs: DataFrame, words: Column, keys: Sequence[str], low: int = 1, high: int = 1) -> DataFrame:
    """``(keys..., term, tf)``. Repeats inside a text are summed before the shuffle."""
    grams = words if (low, high) == (1, 1) else ngram_range(words, low, high)
    return (
        docs.select(*keys, F.explode(grams).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    )


def corpus_counts(docs: DataFrame, words: Column, n: int = 1) -> DataFrame:
    """Corpus count of every n-gram."""
    return term_counts(docs, words, [], n, n).withColumnRenamed("tf", "count")


def top_terms(docs: DataFrame, words: Column, n: int = 1, k: int = 20, max_features: int | None = None) -> DataFrame:
    """The ``k`` most frequent n-grams (among the first ``max_features`` when given)."""
    k = k if max_features is None else min(k, max_features)
    return top_rows(corpus_counts(docs, words, n), [F.col("count").desc(), F.col("term")], k, "rank")


def common_and_rare(docs: DataFrame, words: Column, k: int = 20) -> DataFrame:
    """Most common and rarest words, ``kind`` in common, rare."""
    counts = corpus_counts(docs, words)
    common = top_rows(counts, [F.col("count").desc(), F.col("term")], k, "rank").withColumn("kind", F.lit("common"))
    rare = top_rows(counts, [F.col("count").asc(), F.col("term")], k, "rank").withColumn("kind", F.lit("rare"))
    return common.unionByName(rare)


def vocabulary(counts: DataFrame, doc: str, n_docs: int | DataFrame, max_df: float = 0.9, max_features: int = 5000) -> DataFrame:
    """``(term_id, term, df, total, n_docs)``: terms in at most ``max_df`` of the texts, best by corpus count.

    ``n_docs`` is the number of texts, or a table of them to count.
    """
    n = n_docs if isinstance(n_docs, int) else n_docs.count()
    stats = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    kept = stats.where(F.col("df") <= F.lit(float(max_df)) * F.lit(n))
    ranked = top_rows(kept, [F.col("total").desc(), F.col("term")], max_features, "term_id")
    return ranked.withColumn("term_id", F.col("term_id") - 1).withColumn("n_docs", F.lit(n).cast("long"))


def smooth_idf(vocab: DataFrame) -> Column:
    """``ln((1 + n) / (1 + df)) + 1``."""
    return F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)


def tfidf(counts: DataFrame, vocab: DataFrame, doc: str) -> DataFrame:
    """``(doc, term_id, term, tf, value)``: counts times smooth idf, each text at L2 length 1.

    Apply a train vocabulary to new texts by passing their counts.
    """
    weights = vocab.select("term", "term_id", smooth_idf(vocab).alias("_idf"))  # small by its statistics where the vocabulary is
    raw = counts.join(weights, "term").withColumn("value", F.col("tf") * F.col("_idf")).drop("_idf")
    return normalise(raw, [doc]).select(doc, "term_id", "term", "tf", "value")


def fit_tfidf(docs: DataFrame, words: Column, doc: str, max_df: float = 0.9, max_features: int = 5000, low: int = 1, high: int = 1) -> DataFrame:
    """Counts, vocabulary and TF-IDF of one corpus.

    Only terms frequent enough for the vocabulary are counted by text; of all others the corpus count alone is shuffled.
    The vocabulary is the same: it is filled from the first terms in its own order.
    """
    n_docs = docs.select(doc).distinct().count()
    grams = docs.select(doc, F.explode(words if (low, high) == (1, 1) else ngram_range(words, low, high)).alias("term"))
    totals = grams.groupBy("term").agg(F.count(F.lit(1)).alias("total"))
    looked_at, enough = max_features + MORE_TERMS, False
    while not enough:
        first = cut(top_rows(totals, [F.col("total").desc(), F.col("term")], looked_at).select(F.col("term").alias("_first")))
        met = grams.join(F.broadcast(first), F.col("term").eqNullSafe(F.col("_first")), "left_semi")
        counts = cut(met.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf")))
        vocab = cut(vocabulary(counts, doc, n_docs, max_df, max_features))
        enough = vocab.count() >= max_features or first.count() < looked_at
        looked_at *= 4
    return tfidf(counts, vocab, doc)


def keywords(vectors: DataFrame, doc: str, k: int = 10) -> DataFrame:
    """Best ``k`` keywords of each text: weight, then column, both descending; weight to 3 decimals."""
    best = top_per_group(vectors, [doc], [F.col("value").desc(), F.col("term_id").desc()], k)
    return best.select(doc, "rank", "term", F.round("value", 3).alias("weight"))


def similar_texts(queries: DataFrame, vectors: DataFrame, doc: str, k: int = 5) -> DataFrame:
    """Best ``k`` texts for each query text by the dot product of their unit vectors."""
    left = queries.select(F.col(doc).alias("query"), "term_id", F.col("value").alias("w"))
    dots = (
        left.join(vectors.select(F.col(doc).alias("match"), "term_id", "value"), "term_id")
        .groupBy("query", "match")
        .agg(F.round(F.sum(F.col("w") * F.col("value")), 9).alias("sim"))
        .where(F.col("query") != F.col("match"))
    )
    return top_per_group(dots, ["query"], [F.col("sim").desc(), F.col("match")], k)


def concat_texts(docs: DataFrame, key: str, order: str, text: str = "text", separator: str = " ", part_reviews: int = PART_REVIEWS) -> DataFrame:
    """Texts of one key joined in ``order``: ``(key, part, text, reviews)``.

    A key with many texts gets several numbered parts of ``part_reviews`` texts, so no row and no task grows with
    the key; the parts joined in order are the whole. ``separator=""`` lets border words fuse.
    """
    ranked = group_rank(docs.select(key, order, text), [key], [F.col(order)], "_pos", "_n")
    parts = ranked.withColumn("part", F.floor((F.col("_pos") - 1) / part_reviews).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", text))), lambda t: t[text]), separator)
    return parts.groupBy(key, "part").agg(joined.alias("text"), F.count(F.lit(1)).alias("reviews"))
