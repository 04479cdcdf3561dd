import itertools
import math
import random

from pyspark.sql import functions as F

from tastemark.operators import evaluate, experiments, knn, matrix, similarity
from tastemark.operators.similarity import Recipe, combine_recipe, neighbours


def make(spark, rows):
    return spark.createDataFrame(rows, "row long, col long, value double")


def random_cells(seed, n_rows=60, n_cols=25, density=0.3):
    rnd = random.Random(seed)
    return [(r, c, float(rnd.randint(-2, 5))) for r in range(n_rows) for c in range(n_cols) if rnd.random() < density]


def cosines(cells):
    vec = {}
    for r, c, v in cells:
        vec.setdefault(r, {})[c] = v
    norm = {r: math.sqrt(sum(v * v for v in d.values())) for r, d in vec.items()}
    out = {}
    for a, b in itertools.permutations(vec, 2):
        if norm[a] and norm[b]:
            out[a, b] = sum(v * vec[b].get(c, 0.0) for c, v in vec[a].items()) / norm[a] / norm[b]
    return out


def best(sims, k):
    out = []
    for a in {x for x, _ in sims}:
        mine = sorted(((-round(s, 9), b) for (x, b), s in sims.items() if x == a and round(s, 9) > 0))[:k]
        out += [(a, b, round(-s, 6)) for s, b in mine]
    return sorted(out)


def got(df):
    return sorted((r.id, r.nbr, round(r.sim, 6)) for r in df.collect())


def test_blocks_and_segments_agree_with_brute_force(spark):
    cells = random_cells(3)
    want = best(cosines(cells), 5)
    df = make(spark, cells)
    assert got(neighbours(df, 5)) == want
    assert got(neighbours(df.repartition(64), 5, block_rows=7)) == want
    assert got(neighbours(df, 5, block_rows=25, segment_cells=3)) == want  # rows of several segments
    assert got(neighbours(df, 5, block_rows=1, segment_cells=1)) == want


def test_zero_row_identical_rows_and_repeated_cell(spark):
    df = matrix.coo(
        spark.createDataFrame([(1, 1, 2.0), (1, 1, 3.0), (2, 1, 5.0), (3, 2, 0.0), (4, 9, 1.0)], "u long, i long, v double"), "u", "i", F.col("v")
    )
    assert got(neighbours(df, 3)) == [(1, 2, 1.0), (2, 1, 1.0)]


def test_groups_do_not_mix(spark):
    a, b = random_cells(4, 20), random_cells(5, 20)
    df = spark.createDataFrame([("a", *x) for x in a] + [("b", *x) for x in b], "w string, row long, col long, value double")
    out = neighbours(df, 4, by="w", block_rows=8)
    for name, cells in (("a", a), ("b", b)):
        assert got(out.where(F.col("w") == name)) == best(cosines(cells), 4)


def test_combinations(spark):
    sets = [random_cells(s, 25, 12) for s in (6, 7)]
    sims = [cosines(c) for c in sets]
    keys = set(sims[0]) | set(sims[1])
    pair = {k: (sims[0].get(k, 0.0), sims[1].get(k, 0.0)) for k in keys}
    want = {
        "max": {k: max(*v, 0) for k, v in pair.items()}, "min": {k: min(v) for k, v in pair.items()},
        "avg": {k: sum(v) / 5 for k, v in pair.items()}, "w": {k: 0.75 * v[0] + 0.25 * v[1] for k, v in pair.items()},
    }
    recipes = [combine_recipe("max", [0, 1], "max"), combine_recipe("min", [0, 1], "min", None), combine_recipe("avg", [0, 1], "average"), combine_recipe("w", [0, 1], [0.75, 0.25])]
    dfs = [make(spark, c) for c in sets]
    for options in ({"block_rows": 8}, {"block_rows": 9, "segment_cells": 2}):
        out = neighbours(dfs, 3, recipes, **options)
        for name, values in want.items():
            assert got(out.where(F.col("recipe") == name)) == best(values, 3), (name, options)
    assert neighbours(dfs, 3, [combine_recipe("m", [0, 1], "min")]).count() == 0  # an absent matrix is all zeros


def test_weight_grid_and_subsets(spark):
    grid = similarity.weight_grid(3, [0.1 * i for i in range(11)], spark)
    assert grid.count() == 66
    assert len(list(similarity.iter_pairs(4))) == 11


def test_one_pass_sweep_equals_single_runs(spark):
    rnd = random.Random(8)
    ratings = spark.createDataFrame([(u, i, float(rnd.randint(1, 5))) for u in range(30) for i in rnd.sample(range(20), 8)], "user_id long, item_id long, value double")
    nbrs = neighbours(knn.as_matrix(ratings), 9)
    swept = knn.sweep_scores(nbrs, ratings, [2, 5, 9])
    for k in (2, 5, 9):
        one = knn.score(nbrs.where(F.col("rank") <= k), ratings)
        both = one.join(swept.where(F.col("k") == k).withColumnRenamed("score", "s2"), ["user_id", "item_id"], "full")
        assert both.where((F.abs(F.col("score") - F.col("s2")) > 1e-8) | F.col("score").isNull() | F.col("s2").isNull()).count() == 0
    lists = knn.top_k(knn.score(nbrs, ratings), ratings, 5)
    assert lists.join(ratings, ["user_id", "item_id"], "left_semi").count() == 0
    long = knn.full_ranking(knn.score(nbrs, ratings), ratings)
    assert long.where(F.col("rank") <= 5).select("user_id", "item_id", "rank").exceptAll(lists.select("user_id", "item_id", "rank")).count() == 0


def reference_metrics(pred, true, k):
    top = pred[:k]
    hits = [p in true for p in top]
    c = list(itertools.accumulate(hits))
    return {
        f"MAP@{k}": sum(h / (i + 1) for i, h in enumerate(c)) / len(top), f"Precision@{k}": sum(hits) / len(top), f"Recall@{k}": sum(hits) / len(true),
        "R-Precision": sum(p in true for p in pred[: len(true)]) / len(true),
        "NDCG": sum(1 / math.log2(i + 2) for i, p in enumerate(pred) if p in true) / sum(1 / math.log2(i + 2) for i in range(len(true))),
        "Clicks": next((i / 10 for i, p in enumerate(pred) if p in true), 5),
    }


def test_metrics_no_hit_all_hits_short_list_no_truth(spark):
    preds = {1: [1, 2, 3, 4, 5, 6], 2: [1, 2, 3], 3: [9, 8], 4: [1, 2], 6: [4, 5, 6, 7, 8, 9]}
    truth = {1: {2, 6, 50}, 2: {1, 2, 3}, 3: {1}, 5: {1}, 6: {9}}
    recs = spark.createDataFrame([(u, r + 1, i) for u, p in preds.items() for r, i in enumerate(p)], "user_id long, rank int, item_id long")
    true = spark.createDataFrame([(u, i) for u, t in truth.items() for i in t], "user_id long, item_id long")
    out = {r.user_id: r.asDict() for r in evaluate.per_user(recs, true, [2, 5]).collect()}
    assert set(out) == {1, 2, 3, 6}  # no truth or no list: not evaluated
    for u, row in out.items():
        for k in (2, 5):
            for name, value in reference_metrics(preds[u], truth[u], k).items():
                assert abs(row[name] - value) < 1e-12, (u, name)
    users = {r["name"]: r for r in evaluate.metrics(recs, true, [5], n_users=5).collect()}
    maps = [reference_metrics(preds[u], truth[u], 5)["MAP@5"] for u in out]
    mean = sum(maps) / 4
    std = math.sqrt(sum((m - mean) ** 2 for m in maps) / 4)
    assert users["MAP"]["mean"] == round(mean, 4) and users["MAP"]["ci95"] == round(1.96 * std / math.sqrt(5), 4)
    standard = {r.user_id: r["MAP@5"] for r in evaluate.per_user(recs, true, [5], mode="standard").collect()}
    assert standard[2] == 1.0


def test_impute_and_blocks(spark):
    items = spark.createDataFrame([(1, "$$"), (2, None), (3, None)], "item_id long, price string")
    similar = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.9), (3, 2, 0.8)], "id long, similar_id long, sim double")
    one = dict(similarity.impute_from_similar(items, similar, "price", "$").collect())
    two = dict(similarity.impute_from_similar(items, similar, "price", "$", rounds=2).collect())
    assert one == {1: "$$", 2: "$$", 3: "$"} and two == {1: "$$", 2: "$$", 3: "$$"}
    keyword, user = make(spark, [(1, 1, 2.0)]), make(spark, [(1, 1, 4.0), (1, 2, 1.0)])
    shared = sorted(tuple(r) for r in matrix.concat_blocks(keyword, user, 0.25).collect())
    assert shared == [(1, 1, 3.5), (1, 2, 0.75)]
    apart = sorted(tuple(r) for r in matrix.concat_blocks(keyword, user, 0.25, 10).collect())
    assert apart == [(1, 1, 0.5), (1, 11, 3.0), (1, 12, 0.75)]


def test_windows_take_rows_strictly_inside(spark):
    df = spark.createDataFrame([("2013-01-01",), ("2013-01-02",), ("2014-03-01",), ("2014-06-01",)], "date string").withColumn("date", F.to_date("date"))
    got_rows = sorted((str(r.date), r.window) for r in experiments.windows_of(df, experiments.rolling_windows(spark, 2013, 2014)).collect())
    assert got_rows == [("2013-01-02", 2013), ("2014-03-01", 2013), ("2014-03-01", 2014), ("2014-06-01", 2014)]


def test_best_k_prefers_the_smaller_of_equals(spark):
    sweep = spark.createDataFrame([("a", 5, 0.2), ("a", 10, 0.2), ("a", 20, 0.1)], "r string, k int, map double")
    assert [tuple(r) for r in experiments.best_k(sweep, ["r"]).collect()] == [("a", 5, 0.2)]


def test_recipe_default():
    assert Recipe("x").parts == (0,)
