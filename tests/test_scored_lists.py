"""Lists made in one step against scores, seen items and ranks as separate steps; and what they shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from tastemark.operators import knn, scored_lists, similarity
from tastemark.operators.scored_lists import product, user_lists


@pytest.fixture
def small(spark, monkeypatch):
    rnd = random.Random(5)
    cells = [(u, i, float(rnd.randint(-2, 5))) for u in range(40) for i in rnd.sample(range(30), 9)]
    cells += [(None, 3, 2.0), (None, 4, 1.0), (7, None, 3.0), (8, 29, None), (9, 28, None), (7, 7, 1.0), (7, 7, 1.0)]
    nbrs = [(a, b, round(rnd.random(), 9), r) for a in range(-3, 40) for r, b in enumerate(rnd.sample(range(40), 8), 1) if a != b]
    monkeypatch.setattr(scored_lists, "PIECE_CELLS", 3)
    monkeypatch.setattr(scored_lists, "EXPANDED", 10)
    return spark.createDataFrame(nbrs, "id long, nbr long, sim double, rank int"), spark.createDataFrame(cells, "user_id long, item_id long, value double")


def same(a, b):
    columns = [c for c in ("k", "user_id", "item_id", "rank") if c in b.columns]
    both = [[(*[r[c] for c in columns], None if r.score is None else round(r.score, 8)) for r in x.collect()] for x in (a, b)]
    assert len(both[0]) == len(both[1]) > 0
    assert set(both[0]) == set(both[1])


@pytest.mark.parametrize("item_based", [False, True])
@pytest.mark.parametrize("parts", [1, 7])
def test_lists_equal_the_single_steps(small, item_based, parts):
    nbrs, ratings = small
    scores = knn.score(nbrs, ratings, item_based)
    same(user_lists(nbrs, ratings, 6, item_based, parts=parts), knn.top_k(scores, ratings, 6))
    same(user_lists(nbrs, ratings, None, item_based, parts=parts), knn.full_ranking(scores, ratings))
    ks = (2, 5, 8)
    swept = knn.sweep_scores(nbrs, ratings, ks, item_based, seen=ratings)
    same(user_lists(nbrs, ratings, 6, item_based, ks, parts=parts), knn.top_k(swept, None, 6, ["k"]))


def test_parts_follow_what_a_task_may_hold(small, monkeypatch):
    nbrs, ratings = small
    monkeypatch.setattr(scored_lists, "HELD_CELLS", 100)
    told = user_lists(nbrs, ratings, 6)
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [part" in plan and plan.count("Aggregate [user_id") == 0
    assert told.rdd.getNumPartitions() > 16


def test_no_row_a_user_and_item_is_shuffled(small):
    """The only exchanges are those of the inputs, of the called lists and of the parts."""
    nbrs, ratings = small
    plan = user_lists(nbrs, ratings, 6)._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("MapInArrow")]
    assert "Exchange" not in after


def test_keys_without_a_list_and_empty_sides(spark):
    left = spark.createDataFrame([(1, 5, 1.0, 0), (2, None, 1.0, 0)], "u long, key long, w double, at int")
    right = spark.createDataFrame([(6, 1, 1.0, 0)], "key long, item long, x double, at int")
    assert product(left, right).count() == 0
    assert product(left, right.limit(0)).count() == 0
    assert product(left.limit(0), right, left.select("u", F.col("key").alias("item"))).count() == 0


def test_new_rows_meet_all_rows_without_a_shuffle_of_pairs(spark):
    rnd = random.Random(9)
    old = [(r, c, float(rnd.randint(1, 5))) for r in range(30) for c in rnd.sample(range(12), 5)]
    new = [(r, c, 5.0) for r in (3, 7, 100) for c in rnd.sample(range(12), 4)]
    cells, queries = (spark.createDataFrame(x, "row long, col long, value double") for x in (old, new))
    plan = similarity.against(queries, cells)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]
    none = spark.createDataFrame([], "id long, nbr long, sim double")
    ids = queries.select("row").distinct()
    far, near = (similarity.against(queries, cells.join(ids, "row", how)) for how in ("left_anti", "left_semi"))
    got = similarity.append_similarities(similarity.append_similarities(none, far, apart=True), near)
    unit = [similarity.normalise(x).withColumnRenamed("row", n).withColumnRenamed("value", n[0]) for x, n in ((queries, "id"), (cells, "nbr"))]
    sims = unit[0].join(unit[1], "col").where("id <> nbr").groupBy("id", "nbr").agg(F.round(F.sum(F.col("i") * F.col("n")), 9).alias("sim"))
    want = sims.union(sims.select("nbr", "id", "sim")).distinct()
    rows = lambda x: sorted((r.id, r.nbr, round(r.sim, 8)) for r in x.collect())
    assert rows(got) == rows(want) and len(rows(got)) > 100


def test_a_part_is_sent_the_lists_it_calls_or_all(small):
    nbrs, ratings = small
    left = nbrs.select(F.col("id").alias("u"), F.col("nbr").alias("key"), F.col("sim").alias("w"), F.lit(0).alias("at"))
    right = ratings.select(F.col("user_id").alias("key"), F.col("item_id").alias("item"), F.col("value").alias("x"), F.lit(0).alias("at"))
    rows = [sorted(map(str, product(left, right, parts=3, everywhere=e).withColumn("score", F.round("score", 8)).collect())) for e in (False, True)]
    assert rows[0] == rows[1] and len(rows[0]) > 100
