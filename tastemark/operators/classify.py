"""Sentiment classification of reviews with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemark.operators import vectors
from tastemark.operators.ranking import top_rows

MAX_TREE_DEPTH = 30  # the most Spark allows; the grown trees are meant to be unlimited


def target(reviews: DataFrame, stars: str = "stars") -> DataFrame:
    """Label 1 above four stars."""
    return reviews.withColumn("label", (F.col(stars) > 4).cast("int"))


def fit_features(train: DataFrame, words: str, doc: str, max_features: int = 350, max_df: float = 1.0) -> tuple[PipelineModel, DataFrame]:
    """TF-IDF features from the train vocabulary; the same model transforms the test texts.

    The vocabulary (``max_features`` words at most) becomes the model, everything else stays in the executors.
    """
    counts = vectors.term_counts(train, F.col(words), [doc])
    vocab = vectors.vocabulary(counts, doc, train.select(doc).distinct(), max_df, max_features)
    rows = vocab.withColumn("idf", vectors.smooth_idf(vocab)).orderBy("term_id").select("term", "idf").collect()
    stages = [
        CountVectorizerModel.from_vocabulary([r[0] for r in rows], inputCol=words, outputCol="_counts"),
        ElementwiseProduct(scalingVec=Vectors.dense([r[1] for r in rows]), inputCol="_counts", outputCol="_weighted"),
        Normalizer(p=2.0, inputCol="_weighted", outputCol="features"),
    ]
    return PipelineModel(stages), vocab


def naive_bayes() -> NaiveBayes:
    return NaiveBayes(modelType="gaussian")


def logistic(n: int, c: float = 1.0, l1: bool = False) -> LogisticRegression:
    """Penalty ``1 / (c * n)`` on unscaled features equals a summed loss weighted by ``c``."""
    return LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=1.0 if l1 else 0.0, standardization=False, maxIter=100)


def forest(trees: int = 15, min_leaf: int = 1, depth: int = MAX_TREE_DEPTH, seed: int = 66) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, minInstancesPerNode=min_leaf, maxDepth=depth, seed=seed)


def models(n_train: int) -> dict:
    return {"naive_bayes": naive_bayes(), "logistic": logistic(n_train), "forest": forest()}


def accuracy(predicted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    hit = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    return predicted.groupBy(*by).agg(F.round(hit, 6).alias("accuracy"), F.count(F.lit(1)).alias("rows"))


def report(predicted: DataFrame) -> DataFrame:
    """Precision, recall, f1 and support per class, from the confusion counts."""
    pairs = predicted.groupBy(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("guess")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("label").alias("cls"), F.lit(1).alias("actual"), F.col("n"), (F.col("label") == F.col("guess")).alias("hit")),
        F.struct(F.col("guess").alias("cls"), F.lit(0).alias("actual"), F.col("n"), F.lit(False).alias("hit")),
    )).alias("s")).select("s.*")
    sums = sides.groupBy("cls").agg(
        F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("actual") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("actual") == 0, F.col("n")).otherwise(0)).alias("guessed"),
    )
    precision = F.coalesce(F.col("hits") / F.nullif(F.col("guessed"), F.lit(0)), F.lit(0.0))
    recall = F.coalesce(F.col("hits") / F.nullif(F.col("support"), F.lit(0)), F.lit(0.0))
    scored = sums.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return scored.select(
        F.col("cls").alias("label"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"),
        F.round(f1, 6).alias("f1"), F.col("support"),
    )


def fit_and_score(train: DataFrame, test: DataFrame, estimator) -> tuple[object, DataFrame]:
    """Fitted model and its predictions on both parts, marked ``train`` or ``test``."""
    model = estimator.fit(train)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return model, model.transform(both)


def compare(train: DataFrame, test: DataFrame, n_train: int) -> DataFrame:
    """Accuracy of the three models on train and test."""
    out = None
    for name, estimator in models(n_train).items():
        _, predicted = fit_and_score(train, test, estimator)
        rows = accuracy(predicted, ["part"]).withColumn("model", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def with_folds(df: DataFrame, key: str, folds: int = 5, seed: int = 66) -> DataFrame:
    """Fold number from the row key."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)).cast("int"))


def cross_validated(df: DataFrame, settings: Sequence[tuple], folds: int = 5, parallelism: int = 8) -> list[float]:
    """Mean accuracy over the ``fold`` column of every setting ``(estimator, parameters)``.

    All settings of all folds are fitted from one pool, so that the many short jobs of a deep tree overlap with those of
    other fits. Only the accuracies are wanted, so no model is fitted to all rows.
    """
    scorer = MulticlassClassificationEvaluator(metricName="accuracy")
    rows = df.persist()
    try:
        sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
        for i in range(folds):
            if not sizes.get(i) or sizes[i] == sum(sizes.values()):
                raise ValueError(f"fold {i} or the rest of the rows is empty")
        parts = [(rows.where(F.col("fold") != i), rows.where(F.col("fold") == i)) for i in range(folds)]

        def one(at: tuple[int, int]) -> float:
            (estimator, params), (train, held) = settings[at[0]], parts[at[1]]
            return scorer.evaluate(estimator.fit(train, params).transform(held))

        each = [(s, i) for s in range(len(settings)) for i in range(folds)]
        with ThreadPool(min(parallelism, len(each))) as pool:
            found = pool.map(inheritable_thread_target(df.sparkSession)(one), each, chunksize=1)
    finally:
        rows.unpersist()
    return [sum(found[s * folds : (s + 1) * folds]) / folds for s in range(len(settings))]


def cross_accuracy(df: DataFrame, n: int, folds: int = 5) -> DataFrame:
    """Mean fold accuracy of the three models."""
    chosen = models(n)
    found = cross_validated(df, [(e, {}) for e in chosen.values()], folds)
    return df.sparkSession.createDataFrame([(name, float(a)) for name, a in zip(chosen, found)], "model string, accuracy double")


def logistic_grid(estimator: LogisticRegression, n: int) -> list:
    """Penalty type times C: six settings."""
    grid = ParamGridBuilder().addGrid(estimator.elasticNetParam, [0.0, 1.0])
    return grid.addGrid(estimator.regParam, [1.0 / (c * n) for c in (0.1, 1.0, 10.0)]).build()


def forest_grid(estimator: RandomForestClassifier, trees: Sequence[int] = (5, 10, 15, 20), leaves: Sequence[int] = (1, 3, 5, 7)) -> list:
    """Trees times smallest leaf: sixteen settings."""
    return ParamGridBuilder().addGrid(estimator.numTrees, list(trees)).addGrid(estimator.minInstancesPerNode, list(leaves)).build()


def grid_search(df: DataFrame, estimator, grid: Sequence, folds: int = 5) -> DataFrame:
    """Mean accuracy of every setting, best first by ``place``."""
    found = cross_validated(df, [(estimator, m) for m in grid], folds)
    names = [", ".join(f"{p.name}={v:g}" for p, v in sorted(m.items(), key=lambda x: x[0].name)) for m in grid]
    scored = sorted(zip(names, found), key=lambda x: (-x[1], x[0]))
    rows = [(i + 1, name, float(a)) for i, (name, a) in enumerate(scored)]
    return df.sparkSession.createDataFrame(rows, "place int, setting string, accuracy double")


def strongest_words(vocab: DataFrame, weights, k: int = 20, both_ends: bool = True) -> DataFrame:
    """Words with the largest (and smallest) coefficients or importances; one weight per vocabulary word."""
    spark = vocab.sparkSession
    table = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights.toArray())], "term_id int, weight double")
    named = vocab.select("term_id", "term").join(table, "term_id")
    top = top_rows(named, [F.col("weight").desc(), F.col("term")], k, "rank").withColumn("end", F.lit("largest"))
    if not both_ends:
        return top
    low = top_rows(named, [F.col("weight").asc(), F.col("term")], k, "rank").withColumn("end", F.lit("smallest"))
    return top.unionByName(low)


