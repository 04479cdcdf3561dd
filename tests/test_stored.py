"""Ids that stay, merged sketches and bucketed tables."""

import random
import uuid

from pyspark.sql import functions as F

from tastemark.operators import id_maps, sketches
from tastemark.plans.catalog_stored import user_mean_errors_bucketed
from tastemark.sources.writers import write_bucketed


def test_ids_stay_over_loads(spark, tmp_path):
    path = str(tmp_path / "ids")
    loads = [["d", "b", None, "b"], ["a", "d", "c"], ["c", None], [], ["e", "a", "aa"]]
    seen = {}
    for version, load in enumerate(loads):
        new = sorted({k for k in load if k is not None} - seen.keys())
        seen |= {k: (len(seen) + i, version) for i, k in enumerate(new)}
        got = id_maps.store_ids(spark.createDataFrame([(k,) for k in load], "key string"), path, "key", "num")
        assert {r["key"]: (r["num"], r["version"]) for r in got.collect()} == seen
    assert sorted(n for n, _ in seen.values()) == list(range(len(seen)))


def test_a_load_that_died_is_run_again(spark, tmp_path):
    path = str(tmp_path / "ids")
    keys = spark.createDataFrame([(3,), (1,)], "key long")
    id_maps.store_ids(keys, path, "key", "num")
    (tmp_path / "ids" / "version=1").mkdir()  # begun, not committed
    got = id_maps.store_ids(spark.createDataFrame([(2,), (3,)], "key long"), path, "key", "num").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0), (2, 2, 1), (3, 1, 0)]


def test_ids_of_an_empty_first_load(spark, tmp_path):
    path = str(tmp_path / "ids")
    assert id_maps.store_ids(spark.createDataFrame([], "key long"), path, "key", "num").collect() == []
    got = id_maps.store_ids(spark.createDataFrame([(5,)], "key long"), path, "key", "num").collect()
    assert list(map(tuple, got)) == [(5, 0, 1)]


def test_merged_sketches_answer_like_the_whole(spark):
    rng = random.Random(3)
    rows = [(i % 9, rng.randrange(30_000), rng.lognormvariate(3, 2)) for i in range(60_000)] + [(2, None, None)]
    df = spark.createDataFrame(rows, "part int, who long, x double")
    merged = sketches.merge(sketches.sketch(df, ["part"], ["who"], ["x"]).withColumn("side", F.col("part") % 2), ["side"])
    for r in merged.select("side", "rows", sketches.distinct_of("who").alias("n"), *[sketches.quantile_of("x", p).alias(f"q{p * 100:.0f}") for p in (0.1, 0.5, 0.99)]).collect():
        mine = [t for t in rows if t[0] % 2 == r["side"]]
        true = len({t[1] for t in mine if t[1] is not None})
        assert r["rows"] == len(mine) and abs(r["n"] - true) <= 4 * sketches.distinct_error() * true
        values = sorted(t[2] for t in mine if t[2] is not None)
        for p in (0.1, 0.5, 0.99):
            assert abs(sum(v <= r[f"q{p * 100:.0f}"] for v in values) / len(values) - p) <= 0.01


def test_a_part_without_values(spark):
    df = spark.createDataFrame([(1, None, None), (2, 7, 1.5)], "part int, who long, x double")
    parts = sketches.sketch(df, ["part"], ["who"], ["x"])
    assert sorted(map(tuple, parts.select("part", "rows", sketches.distinct_of("who")).collect())) == [(1, 1, 0), (2, 1, 1)]
    whole = sketches.merge(parts, [])
    assert tuple(whole.select("rows", sketches.distinct_of("who"), sketches.quantile_of("x", 0.5)).first()) == (2, 1, 1.5)


def test_bucketed_tables_meet_without_an_exchange(spark, sf, tmp_path):
    tables = []
    for side in "ab":
        cells = spark.createDataFrame([(i % 50, i, float(i)) for i in range(500)], f"user_id long, {side}_item long, {side} double")
        tables.append(write_bucketed(cells, f"t_{side}_{uuid.uuid4().hex}", str(tmp_path / side), "user_id", 4))
    met = tables[0].hint("merge").join(tables[1], "user_id").groupBy("user_id").agg(F.sum(F.col("a") * F.col("b")).alias("s"))
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 50
    assert "Exchange" not in user_mean_errors_bucketed(spark, sf)._jdf.queryExecution().executedPlan().toString()
