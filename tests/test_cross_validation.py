"""Mean accuracies of all settings come from one pool of fits, and nothing is fitted to all rows."""

import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator

from tastemark.operators import classify


def labelled(spark, folds=3):
    rnd = random.Random(3)
    points = [(i, rnd.random(), rnd.random()) for i in range(120)]
    rows = [(i, int(a + 0.5 * rnd.random() > 0.8), i % folds, Vectors.dense([a, b])) for i, a, b in points]
    df = spark.createDataFrame(rows, ["id", "label", "fold", "features"])
    return df.selectExpr("id", "cast(label as int) label", "cast(fold as int) fold", "features")


def test_accuracies_equal_those_of_single_runs_and_no_fit_sees_all_rows(spark, monkeypatch):
    df = labelled(spark)
    lr = classify.logistic(80)
    grid = classify.logistic_grid(lr, 80)
    scorer = MulticlassClassificationEvaluator(metricName="accuracy")
    want = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=scorer, numFolds=3, foldCol="fold").fit(df).avgMetrics
    seen, real = [], LogisticRegression._fit
    monkeypatch.setattr(LogisticRegression, "_fit", lambda self, rows: seen.append(rows.count()) or real(self, rows))
    assert classify.cross_validated(df, [(lr, m) for m in grid], 3) == pytest.approx(want)
    assert sorted(seen) == [80] * (3 * len(grid))


def test_an_empty_fold_is_an_error(spark):
    with pytest.raises(ValueError):
        classify.cross_validated(labelled(spark), [(classify.logistic(80), {})], 4)
