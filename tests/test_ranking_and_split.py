import random

from pyspark.sql import functions as F

from tastemark.operators import knn, ranking, split
from tastemark.sources import writers


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def cells(spark, counts, seed=1):
    rnd = random.Random(seed)
    data = [(u, i, float(rnd.randint(1, 5)), rnd.randint(0, 3) * 86400) for u, n in counts.items() for i in rnd.sample(range(500), n)]
    return data, spark.createDataFrame(data, "user_id long, item_id long, value double, ts long")


def expected_split(data, ratio=(0.5, 0.2, 0.3)):
    out = []
    for u in {d[0] for d in data}:
        mine = sorted((d for d in data if d[0] == u), key=lambda d: (d[3], d[1]))
        n = len(mine)
        n_test, n_hold = int(n * ratio[2]), int(n * (ratio[1] + ratio[2]))
        for p, d in enumerate(mine):
            out.append((u, d[1], "test" if p >= n - n_test else "valid" if p >= n - n_hold else "train"))
    return sorted(out)


def test_split_small_users_and_equal_times(spark):
    data, df = cells(spark, {1: 1, 2: 2, 3: 3, 4: 10, 5: 37})
    assert rows(split.by_user_time(df), "user_id", "item_id", "split") == expected_split(data)


def test_split_of_a_hot_user_is_the_same_piece_by_piece(spark):
    data, df = cells(spark, {1: 200, 2: 5, 3: 9})
    got = rows(split.by_user_time(df.repartition(16)), "user_id", "item_id", "split")
    assert got == expected_split(data)


def test_each_rating_is_in_one_split_and_samples_nest(spark):
    data, df = cells(spark, {u: u for u in range(1, 30)})
    full = rows(split.by_user_time(df), "user_id", "item_id")
    assert full == sorted((d[0], d[1]) for d in data)
    new = split.train_part(split.by_user_time(df, train_share=0.5))
    old = split.train_part(split.by_user_time(df, train_share=0.5, side="oldest"))
    whole = split.train_part(split.by_user_time(df))
    assert new.join(whole, ["user_id", "item_id"], "left_anti").count() == 0
    assert old.join(whole, ["user_id", "item_id"], "left_anti").count() == 0
    n = {r[0]: r[1] for r in whole.groupBy("user_id").count().collect()}
    for part in (new, old):
        for r in part.groupBy("user_id").count().collect():
            assert r[1] == n[r[0]] // 2


def test_dense_ids_follow_sorted_order_whatever_the_partitions(spark):
    names = [f"k{random.Random(i).randint(0, 10**6)}" for i in range(300)]
    df = spark.createDataFrame([(n,) for n in names], "raw string")
    want = [(n, i) for i, n in enumerate(sorted(set(names)))]
    for parts in (1, 64):
        assert rows(ranking.dense_ids(df.repartition(parts), "raw", "num"), "raw", "num") == want
    for pieces in (1, 2, 5, 300):
        assert rows(ranking.global_index(df.distinct(), ["raw"], "num", pieces=pieces), "raw", "num") == want


def test_duplicates_once_twice_three_times(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 1), ("c", 2), ("c", 3)], "k string, v int")
    assert rows(ranking.keep_unrepeated(df, ["k"]), "k", "v") == [("a", 1)]
    assert rows(ranking.keep_first(df, ["k"], [F.col("v").desc()]), "k", "v") == [("a", 1), ("b", 2), ("c", 3)]


def test_ties_at_the_cut_stay(spark):
    df = spark.createDataFrame([("x", i, s) for i, s in enumerate([9, 7, 7, 7, 1])], "g string, i int, s int")
    assert ranking.top_with_ties(df, ["g"], "s", 2).count() == 4


def test_global_split_and_slices(spark):
    df = spark.range(103).withColumn("day", F.col("id") % 7)
    out = split.by_global_time(df, ["day", "id"])
    assert out.where("split = 'train'").count() == 83  # ceil(0.8 * 103)
    sizes = dict(writers.with_slice(df, ["id"], 10).groupBy("slice").count().collect())
    assert sizes == {**{i: 10 for i in range(10)}, 10: 3}


def test_one_hot_user_with_distinct_scores_is_ranked_in_many_ranges(spark):
    scores = spark.range(20_000).select(F.lit(1).alias("user_id"), F.col("id").alias("item_id"), F.pmod(F.col("id") * 7919, F.lit(20_011)).cast("double").alias("score"))
    order = [F.col("score").desc(), F.col("item_id")]
    sizes = [r["count"] for r in ranking._ranged(scores, [F.col("user_id"), *order], 8).groupBy("_piece").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 5_000
    want = [r["item_id"] for r in scores.orderBy(*order).collect()]
    assert [r["item_id"] for r in ranking.group_rank(scores, ["user_id"], order, pieces=8).orderBy("pos").collect()] == want
    assert [r["item_id"] for r in knn.full_ranking(scores).orderBy("rank").collect()] == want


def test_null_groups_are_ranked(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), (1, 2)], "g int, x int")
    got = ranking.group_rank(df, ["g"], [F.col("x")]).select("g", "x", "pos", "n").orderBy("g", "x").collect()
    assert [tuple(r) for r in got] == [(None, 1, 1, 2), (None, 3, 2, 2), (1, 2, 1, 1)]
